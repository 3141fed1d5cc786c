"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my nu xi omikron pi rho sigma tau ypsilon phi chi psi omega".split()
PLAIN = " ".join(WORDS[(i * 7 + i // 5) % 24] + str(i) for i in range(60))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, h int, rid int, n int, __rid int, __gone string, `a.b` string, __row int, __text string"


def rows():
    out = [
        (1, PLAIN, "en", "a"),
        (1, PLAIN, "en", "a"),  # a repeated row
        (2, PLAIN.replace("beta", "BETA"), None, "a"),
        (3, None, "en", None),
        (4, "", "de", "b"),
        (4, "", "de", "b"),
        (None, "no id here but some words in a line that is long enough to be told apart from others", None, None),
        (5, "one\ntwo\n" + PLAIN + "\n\nthree", "en", "a"),
        (6, "word " * 30000, "en", "a"),
        (7, "é" * 250 + "\n" + "ß" * 10, "de", "a"),
        (8, "short", "en", "a"),
        (9, "*** $$$ |||", "en", "a"),
    ]
    return [(i, t, g, s, None if t is None else len(t), "x", 1, 2, 3, 4, "g", "dot", 5, "t") for i, t, g, s in out]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
