"""Personal data with exact source offsets, plain or disguised.

Plain identifiers are found in the text as it stands. A chain of transducers then
rewrites disguises: homoglyphs and other scripts' digits to ASCII, invisible
characters to nothing, spelled digits to digits, and "at"/"dot" disguises to signs.
Each carries, for every character it puts out, the source span it came from, so a
find in the rewritten text maps back to code points of the source. Finds that
lie within a plain one of their kind are dropped; plain ones stay beside longer ones.

Edge cases: a null text is empty; an empty text has no spans; ties cannot occur, as
no two spans are equal; repeated rows are handled independently and extra
columns are ignored. All scans take time in proportion to the text's length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table

KINDS = ("email", "ip", "card", "phone")

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Starts that any find has; most texts have none.
_CARD_HINT = re.compile(r"[0-9](?:[ -]?[0-9]){12}")
_IP_HINT = re.compile(r"[0-9]\.[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        twice = 2 * int(d)
        total += twice - 9 if twice > 9 else twice
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches: the local part is the whole run of its characters before the @, since the last match."""
    out, floor = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            floor = m.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", floor)
    return out


def plain(text: str) -> list[Span]:
    """Spans by kind, then start."""
    out = emails(text) if "@" in text else []
    if _IP_HINT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
    if _CARD_HINT.search(text):
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# Letters of other scripts that look like Latin ones, and signs that look like @ . + -
HOMOGLYPHS = dict(
    zip(
        "АВЕКМНОРСТУХасеорухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονﹺ﹒․。。﹫＠⁺﹢‐‑‒–—−",
        "ABEKMHOPCTYXaceopyxijsdqwABEZHIKMNOPTYXov:....@@++------",
        strict=True,
    )
)
INVISIBLE = frozenset("­​‌‍⁠﻿")
# Digit words of the four languages in which no other word of them is spelled the same
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

#: Letters that re.I takes for i, s and k, and str.lower() does not.
_FOLDED = tuple(zip("İıſ\u212a", "iisk", strict=True))
_FOLD = str.maketrans(dict(_FOLDED))
_SPELLINGS = tuple(DIGIT_WORDS)
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DIGIT_WORD = re.compile(rf"(?<!\w)(?:{_WORDS})(?!\w)", re.I)
_SPELLED = re.compile(rf"(?<!\w)(?:{_WORDS})(?:[ \-,]{{1,2}}(?:{_WORDS})){{2,}}(?!\w)", re.I)
_SPELLED_IP = re.compile(rf"(?<!\w)(?:{_WORDS})(?:[ \-,]{{1,2}}(?:{_WORDS}))*(?:\s+(?:dot|punkt|point|punto)\s+(?:{_WORDS})(?:[ \-,]{{1,2}}(?:{_WORDS}))*){{3}}(?!\w)", re.I)
_DOTS = ("dot", "punkt", "point", "punto")
_DOT_WORD = re.compile("|".join(_DOTS), re.I)
_BRACKETED = re.compile(rf"[\[({{<]\s*(?:at|arroba|@|{'|'.join(_DOTS)}|\.)")
_AT = re.compile(r"\s*[\[({<]\s*(?:at|arroba|@)\s*[\])}>]\s*|(?<=\w)\s+(?:at|arroba)\s+(?=[\w-]+(?:\s*[\[({<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}>]\s*|\s+(?:dot|punkt|punto)\s+|\.)[\w-])", re.I)
_DOT = re.compile(r"\s*[\[({<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}>]\s*|(?<=\w)\s+(?:dot|punkt|punto)\s+(?=\w)", re.I)
_PLUS = re.compile(r"(?<!\w)plus\s+(?=[0-9])", re.I)
_ODD = re.compile(f"[{re.escape(''.join([*HOMOGLYPHS, *sorted(INVISIBLE)]))}！-～٠-٩۰-۹०-९\U0001d7ce-\U0001d7ff]")

Coded = tuple[str, Sequence[int], Sequence[int]]


def rewrite(coded: Coded, pattern: re.Pattern, to) -> Coded:
    """Replaces each match by ``to(match)``, every character of which has the match's source span."""
    text, begin, end = coded
    out, b, e, at = [], [], [], 0
    for m in pattern.finditer(text):
        new = to(m)
        if new is None or m.start() == m.end():
            continue
        out += [text[at : m.start()], new]
        b += begin[at : m.start()]
        b += [begin[m.start()]] * len(new)
        e += end[at : m.start()]
        e += [end[m.end() - 1]] * len(new)
        at = m.end()
    if not out:
        return coded
    b += begin[at:]
    e += end[at:]
    return "".join([*out, text[at:]]), b, e


def _glyph(m: re.Match) -> str:
    c = m[0]
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    return unicodedata.normalize("NFKC", c)


def _digits(words: str) -> str:
    return "".join(DIGIT_WORDS[x.translate(_FOLD).lower()] for x in _DIGIT_WORD.findall(words))


def _spelled(m: re.Match) -> str:
    return _digits(m[0])


def _spelled_ip(m: re.Match) -> str:
    return ".".join(map(_digits, _DOT_WORD.split(m[0])))


#: Patterns and what becomes of their matches, in order.
STEPS = ((_ODD, _glyph), (_SPELLED_IP, _spelled_ip), (_SPELLED, _spelled), (_PLUS, lambda m: "+"), (_DOT, lambda m: "."), (_AT, lambda m: "@"))


def hints(text: str) -> tuple[bool, ...]:
    """For each step, whether its pattern can match. Each test asks for what the pattern itself demands, and no more:
    three dot words, three digit words of which the middle one stands between blanks, "plus", a dot word or a dot
    behind a bracket, "at" between blanks or behind a bracket."""
    odd = not text.isascii()
    low = text
    if odd:
        for a, b in _FOLDED:
            low = low.replace(a, b)
    low = low.lower()
    dots = sum(map(low.count, _DOTS))
    words = low.replace(",", " ").replace("-", " ").split()
    spelled = not DIGIT_WORDS.keys().isdisjoint(words) and any(
        w in DIGIT_WORDS and a.endswith(_SPELLINGS) and b.startswith(_SPELLINGS) for a, w, b in zip(words, words[1:], words[2:], strict=False)
    )
    bracket = _BRACKETED.search(low) is not None
    return odd, dots > 2, spelled, "plus" in low, bracket or dots > 0, bracket or "arroba" in low or "at" in words


def normalise(text: str) -> Coded:
    coded: Coded = (text, range(len(text)), range(1, len(text) + 1))
    may = hints(text)
    for i, (pattern, to) in enumerate(STEPS):
        if may[i]:
            before, coded = coded, rewrite(coded, pattern, to)
            if coded is not before:
                may = hints(coded[0])
    return coded


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans by kind, then start."""
    if not text:
        return [], []
    base = plain(text)
    flat, begin, end = normalise(text)
    if flat == text:
        return base, base
    added: list[Span] = []
    for kind, a, b in plain(flat):
        x, y = begin[a], end[b - 1]
        if not any(k == kind and s <= x and y <= e for k, s, e in base):
            added.append((kind, x, y))
    return base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def detect(docs: DataFrame) -> DataFrame:
    """Counts and spans of every document; the counts are of all spans."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: list[list[int]] = [[] for _ in KINDS]
            sha, spans, n_base = [], [], []
            for text in batch.column("text").to_pylist():
                base, every = find(text)
                kinds = [s[0] for s in every]
                for n, kind in zip(counts, KINDS, strict=True):
                    n.append(kinds.count(kind))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                n_base.append(len(base))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(n, pa.int64()) for n in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(n_base, pa.int64())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_base"],
            )

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_base long")


def mask(text: str | None) -> str | None:
    """The text with each span replaced by its kind's tag; of spans that overlap the first and longest counts."""
    spans = sorted(find(text)[1], key=lambda s: (s[1], -s[2]))
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents, personal data replaced by tags and n_chars renewed."""
    names = docs.columns

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [mask(t) for t in batch.column("text").to_pylist()]
            cols = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.column("n_chars").type)
            return pa.RecordBatch.from_arrays([cols.get(n, batch.column(n)) for n in names], names)

        return work

    return map_batches(docs, make, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
