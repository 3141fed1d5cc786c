"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, digits, plus signs, schemes, identifier cues) in the whole text;
local parsers expand each anchor to its boundaries and validate it. The base kinds follow fixed patterns, leftmost
and not overlapping within a kind: email, ip, card and phone. Added kinds: iban (mod 97), account (a cue, then 6 to
17 digits), ssn (a cue, then three groups), login (user information in a URL) and secret (a cue, an equals sign or
colon, and a value with letters and digits; keys of known forms; private key blocks).

Defined results: null or empty text has no spans; equal rows are treated alike; an empty table gives an empty
result. Spans are in code points, the end exclusive. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_text, record, text_buffer

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("account", "iban", "login", "secret", "ssn")
CUES = {"account": ("account", "Account", "ACCOUNT", "acct", "Acct", "Konto", "konto", "cuenta", "compte"), "iban": ("iban", "IBAN", "Iban"), "ssn": ("ssn", "SSN", "social security", "Social Security")}
_SECRETS = ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "access_key", "access-key", "client_key", "private_key", "bearer")
CUES["secret"] = tuple(f(w) for w in _SECRETS for f in (str.lower, str.upper, str.capitalize))
#: How keys of known kinds begin.
KEYS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat-", "sk-", "sk_live_", "xoxb-", "xoxp-", "-----BEGIN ")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?:\x20(?:number|no|nr))?[.:#\x20]{1,3}([0-9]{6,17})(?![0-9])")
_IBAN = re.compile(r"[.:\x20]{0,2}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"(?:\x20number)?[.:#\x20]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_SECRET = re.compile(r"(?:[A-Za-z0-9_]{0,20}[\"']?\s{0,3}(?:=>|:=|[:=])|(?<=[Bb]earer)|(?<=BEARER))\s{0,3}[\"']?((?=[^\s\"']{0,200}[0-9])(?=[^\s\"']{0,200}[A-Za-z])[A-Za-z0-9_+/.~=!@#$%^&*-]{8,400})")
_KEY = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|AIza[0-9A-Za-z_-]{35}|gh[pous]_[0-9A-Za-z]{36,255}|github_pat_[0-9A-Za-z_]{22,255}|glpat-[0-9A-Za-z_-]{20,64}|sk-[0-9A-Za-z_-]{20,200}|sk_live_[0-9A-Za-z]{16,100}|xox[bp]-[0-9A-Za-z-]{20,200}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,30}PRIVATE KEY-----")
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@")
_DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled; the sum of all digits is a multiple of ten."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def anchors():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for c in "0123456789":
        auto.add_word(c, ("digit", 1))
    auto.add_word("@", ("at", 1))
    auto.add_word("+", ("plus", 1))
    auto.add_word("://", ("scheme", 3))
    for kind, words in CUES.items():
        for w in words:
            auto.add_word(w, (kind, len(w)))
    for w in KEYS:
        auto.add_word(w, ("key", len(w)))
    auto.make_automaton()
    return auto


def find(text: str, auto) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, by start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE_KINDS, *ADDED_KINDS)}
    done = {"email": 0, "ip": 0, "card": 0, "phone": 0, "secret": 0}
    digit_before = -2
    for end, (kind, length) in auto.iter(text):
        at = end - length + 1
        if kind == "digit":
            begins, digit_before = digit_before != at - 1, at
            if not begins:
                continue
            if at >= done["ip"] and (m := _IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(v) <= 3 and int(v or 0) <= 255 for v in (p.lstrip("0") for p in m[0].split("."))):
                    spans["ip"].append(m.span())
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    spans["card"].append(m.span())
        elif kind == "at":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, end + 1)):
                spans["email"].append((start, m.end()))
                done["email"] = m.end()
        elif kind == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    spans["phone"].append(m.span())
        elif kind == "scheme":
            if m := _LOGIN.match(text, end + 1):
                spans["login"].append(m.span())
        elif kind == "secret":
            if at >= done["secret"] and (m := _SECRET.match(text, end + 1)):
                spans["secret"].append(m.span(1))
                done["secret"] = m.end()
        elif kind == "key":
            if at >= done["secret"] and (at == 0 or not text[at - 1].isalnum()) and (m := _KEY.match(text, at)):
                spans["secret"].append(m.span())
                done["secret"] = m.end()
        elif kind == "account":
            if m := _ACCOUNT.match(text, end + 1):
                spans["account"].append(m.span(1))
        elif kind == "iban":
            if (m := _IBAN.match(text, end + 1)) and iban_valid(m[1]):
                spans["iban"].append(m.span(1))
        elif m := _SSN.match(text, end + 1):
            spans["ssn"].append(m.span(1))
    return spans


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(set(spans[k])))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", redacted: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; with `redacted`, the text with [KIND] for each span."""

    def kernel():
        auto = anchors()
        wanted = np.zeros(256, bool)
        wanted[[ord(c) for c in "@0123456789"]] = True  # each kind needs one of them (a private key without digits is none)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            column = part.column("__text")
            buf, offs = text_buffer(column)
            sums = np.concatenate([[0], np.cumsum(wanted[buf])])
            some = sums[offs[1:]] > sums[offs[:-1]]
            empty = {k: [] for k in (*BASE_KINDS, *ADDED_KINDS)}
            found = [find(column[i].as_py(), auto) if s else empty for i, s in enumerate(some.tolist())]
            out = {"doc_id": (part.column("__id"), None)}
            for k in BASE_KINDS:
                out[f"n_{k}"] = ([len(f[k]) for f in found], pa.int64())
            out["base_sha256"] = ([hashlib.sha256(joined(f, BASE_KINDS).encode()).hexdigest() for f in found], pa.string())
            out["spans"] = ([joined(f, BASE_KINDS + ADDED_KINDS) for f in found], pa.string())
            if redacted:
                out["redacted"] = ([redact(t, f) for t, f in zip(column.to_pylist(), found)], pa.string())
            return record(**out)

        return work

    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text"))
    return map_text(chosen, "__text", kernel, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string" + ", redacted string" * redacted)


def redact(text: str | None, spans: dict[str, list[tuple[int, int]]]) -> str | None:
    """The text with the kind's name in place of each span; of overlapping spans the one that begins first stays, the longer at a tie."""
    if text is None:
        return None
    out, done = [], 0
    for a, _, b, k in sorted((a, -b, b, k) for k, v in spans.items() for a, b in v):
        if a >= done:
            out += [text[done:a], f"[{k.upper()}]"]
            done = b
    return "".join([*out, text[done:]])
