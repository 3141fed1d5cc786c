"""DuckDB SQL for the queries that SQL can state on whole tables."""

from __future__ import annotations

from . import linededup, quality, suffixdedup

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

_MEASURES = {
    "symbols_pm": ("n_symbols", "word_chars", 1000),
    "dup_lines_pm": ("n_dup_lines", "n_lines", 1000),
    "repeat_pm": ("n_repeat_words", "n_words", 1000),
    "upper_pm": ("n_upper", "word_chars", 1000),
    "marks_pm": ("n_marks", "word_chars", 1000),
    "word_length": ("word_chars", "n_words", 100),
}


_SLACK = "CASE v.measure " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in quality.SLACK.items()) + " END"
_LANG = f"CASE WHEN l.size >= {quality.MIN_GROUP} THEN least(l.fence, a.fence + {_SLACK}) ELSE a.fence END"


def _fences(name: str, keys: str) -> str:
    on = f"{keys}, measure" if keys else "measure"
    top = "CASE WHEN bucket < 16 THEN bucket ELSE ((bucket - (bucket // 16 - 1) * 16 + 1) << (bucket // 16 - 1)::INT) - 1 END"
    slack = "CASE measure " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in quality.SLACK.items()) + " END"
    return f"""{name} AS (SELECT {on}, size, q75 + {quality.FENCE} * (q75 - q25) + {slack} AS fence FROM (
  SELECT {on}, max(size) AS size, min(CASE WHEN cum * 100 >= size * 25 THEN top END) AS q25, min(CASE WHEN cum * 100 >= size * 75 THEN top END) AS q75
  FROM (SELECT {on}, {top} AS top, sum(n) OVER (PARTITION BY {on} ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY {on}) AS size
    FROM (SELECT {on}, bucket, count(*) AS n FROM buckets GROUP BY {on}, bucket)) GROUP BY {on}))"""


QUALITY = rf"""
WITH split AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM documents),
grams AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[{quality.SYMBOLS}]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
    length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks FROM split LEFT JOIN repeats USING (doc_id)),
v AS ({" UNION ALL ".join(f"SELECT doc_id, lang, source, '{k}' AS measure, CASE WHEN {b} > 0 THEN {f} * {a} // {b} ELSE 0 END AS v FROM m" for k, (a, b, f) in _MEASURES.items())}),
buckets AS (SELECT *, CASE WHEN v < 16 THEN v ELSE (length(bin(v)) - 5) * 16 + (v >> (length(bin(v)) - 5)::INT) END AS bucket FROM v),
{_fences("own", "lang, source")}, {_fences("by_lang", "lang")}, {_fences("over_all", "")},
passed AS (SELECT doc_id, bool_and(v.v <= CASE WHEN o.size >= {quality.MIN_GROUP} THEN least(o.fence, {_LANG} + {_SLACK}) ELSE {_LANG} END) AS ok
  FROM v JOIN own o ON o.lang IS NOT DISTINCT FROM v.lang AND o.source IS NOT DISTINCT FROM v.source AND o.measure = v.measure
  JOIN by_lang l ON l.lang IS NOT DISTINCT FROM v.lang AND l.measure = v.measure JOIN over_all a ON a.measure = v.measure GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m) JOIN passed USING (doc_id)
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM items),
places AS (SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, item_id, i, p.size FROM places p JOIN items USING (size, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

SUFFIXES = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS b, generate_subscripts(regexp_extract_all(h, '..'), 1) - 1 AS p FROM h WHERE h <> ''),
starts AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {suffixdedup.LENGTH} + 1)) AS p FROM h),
named AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, {2 * suffixdedup.LENGTH})) AS k FROM starts),
twice AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM named) WHERE c > 1),
cover AS (SELECT doc_id, p, b, max(t.p IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {suffixdedup.LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM bytes LEFT JOIN twice t USING (doc_id, p)),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS first FROM cover),
per AS (SELECT doc_id, count_if(gone) AS n_removed, count_if(first) AS n_spans, coalesce(string_agg(b, '' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM edges GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN per USING (doc_id)
"""

ORACLES = {"op2_quality_rules": QUALITY, "op3_decontaminate": DECONTAMINATION, "op6_suffix_dedup": SUFFIXES, "op9_line_dedup": linededup.ORACLE}
