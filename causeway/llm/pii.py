"""Personal data in texts, with offset-preserving deobfuscation.

Base spans are the plain matches of four patterns (email, ip, card, phone), leftmost and
non-overlapping for each kind, failing matches dropped.  On top, small transducers rewrite
disguised stretches -- homoglyph letters and digits, spelled digits, "at"/"dot" between
the parts of an address -- into plain characters.  Every output character carries the
source characters it came from, so what the same detectors find in the rewritten text maps
back to spans of the source.  An added span is never equal to or inside another span of its
kind, but it may contain or overlap one: a disguise can hide a part of an address only.

To leave prose alone: an "at" or "dot" counts as disguise only in brackets, or as a word
between parts of an address that ends in a known top-level name and has both; spelled
digits count in runs of nine or more; homoglyphs count in a run that also has plain ASCII
letters, digits or address signs.

Offsets are code points, ends exclusive.  Defined results: null counts as empty; a null
``doc_id`` is passed on; equal rows give equal rows; whole texts are read, however long,
with patterns that do not backtrack over runs of one class.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The domain part of an address; its local part is found backwards from the sign.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is always begun at its start: a match inside it would begin earlier.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
        last = max(last, 0)
    return out


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find(text: str) -> list[Span]:
    """The spans of all kinds, by kind and start."""
    out = emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# --- deobfuscation ---------------------------------------------------------

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "ӏ": "l", "ո": "n", "ս": "u", "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Α": "A",
    "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "﹒": ".",
}
# Signs that show nothing and are put inside disguised words.
_INVISIBLE = "­​‌‍⁠﻿"
# The digits as words (English, French, German, Spanish).
_SPELLED = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
# Top-level names after which a spelled "dot" is believed.
_TOP = "com org net edu gov mil int info biz io co ai app dev me uk us ca au nz ie in de at ch fr be nl lu es pt it se no dk fi pl cz ru ua eu mx ar cl br jp cn kr example test invalid"

_SUSPECT = re.compile("[" + re.escape("".join(_LOOKALIKES) + _INVISIBLE) + "\uff01-\uff5e\U0001d400-\U0001d7ff]+")
_DIGIT_WORDS = frozenset([*_SPELLED, *"0123456789"])
# Letters that match others without regard to case, though lower() keeps them.
_SAME_CASE = str.maketrans("İıſ", "iis")
_WORD = re.compile(r"\w+")
_NUMBER_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_DIGIT_RUN = re.compile(
    rf"(?<!\w)(?:(?:\+|\bplus\b)[ -]?)?(?:(?:{_NUMBER_WORD}|[0-9])(?:\W{{1,3}})){{8,}}(?:{_NUMBER_WORD}|[0-9])(?!\w)", re.I
)
_DIGIT_PART = re.compile(rf"(?:{_NUMBER_WORD})(?!\w)|plus\b|[\s\S]", re.I)
_IP_RUN = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\{\.\}|[\[({] ?dot ?[\])}]|\bdot\b) ?[0-9]{1,3}){3}(?![0-9.])", re.I)
_IN_BRACKETS = r" ?[\[({{<] ?(?:{}) ?[\])}}>] ?"
_AT_MARK, _DOT_MARK = _IN_BRACKETS.format(r"at|@|arroba|chez"), _IN_BRACKETS.format(r"dot|\.|punkt|point|punto")
_AT = rf"(?:{_AT_MARK}| at | ?@ ?)"
_DOT = rf"(?:{_DOT_MARK}| (?:dot|punkt|point|punto) |\.)"
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9_%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,3}}?){_AT}"
    rf"(?P<domain>[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{0,4}}{_DOT}(?:{_TOP.replace(' ', '|')}))(?![A-Za-z0-9-]|\.[A-Za-z0-9])",
    re.I,
)
# Without words outside of brackets any top-level name will do.
_MARKED_DOT = rf"(?:{_DOT_MARK}|\.)"
_MARKED_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9_%+-]{{1,64}}(?:{_MARKED_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,3}}?)(?:{_AT_MARK}| ?@ ?)"
    rf"(?P<domain>[A-Za-z0-9-]{{1,63}}(?:{_MARKED_DOT}[A-Za-z0-9-]{{1,63}}){{0,4}}{_MARKED_DOT}(?:xn--[A-Za-z0-9-]{{1,59}}|[A-Za-z]{{2,63}}))"
    r"(?![A-Za-z0-9-]|\.[A-Za-z0-9])",
    re.I,
)
_MARK = re.compile(f"{_AT_MARK}|{_DOT_MARK}", re.I)
_SIGN = re.compile(r"[\[({<] ?(?:at|@|arroba|chez|dot|\.|punkt|point|punto) ?[\])}>]|[^ ] @|@ [^ ]| (?:dot|punkt|point|punto) ", re.I)
_BEYOND = re.compile("[^\x00-\x7e]")
_PART = re.compile(rf"(?P<dot>{_DOT})|[\s\S]", re.I)


class Rewritten:
    """Text whose characters know the source span [start, end) they stand for."""

    def __init__(self, text: str, spans: list[tuple[int, int]]):
        self.text, self.spans = text, spans

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self.spans[start][0], self.spans[end - 1][1]


def plain_letters(source: str) -> Rewritten:
    """Homoglyphs and compatibility forms as ASCII, invisible signs left out."""
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0

    def keep(start: int, end: int) -> None:
        out.append(source[start:end])
        spans.extend(zip(range(start, end), range(start + 1, end + 1)))

    for m in _BEYOND.finditer(source):
        i, c = m.start(), m[0]
        keep(at, i)
        at = i + 1
        if c in _INVISIBLE:
            continue
        for x in _LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c):
            out.append(_LOOKALIKES.get(x, x))
            spans.append((i, at))
    keep(at, len(source))
    return Rewritten("".join(out), spans)


def spelled_digits(source: Rewritten) -> Rewritten:
    """Digit words as digits, closed up; "plus" as a plus sign."""
    out, spans = [], []
    for m in _DIGIT_PART.finditer(source.text):
        word = m[0].lower()
        c = str(_SPELLED[word]) if word in _SPELLED else "+" if word in ("plus", "+") else word if "0" <= word <= "9" else ""
        if c:
            out.append(c)
            spans.append(source.back(*m.span()))
    return Rewritten("".join(out), spans)


def spoken_dots(source: Rewritten) -> Rewritten:
    out, spans = [], []
    for m in _PART.finditer(source.text):
        if m["dot"] or not m[0].isspace():
            out.append("." if m["dot"] else m[0])
            spans.append(source.back(*m.span()))
    return Rewritten("".join(out), spans)


def _joined(*parts: Rewritten) -> Rewritten:
    return Rewritten("".join(p.text for p in parts), [s for p in parts for s in p.spans])


def _piece(text: str, start: int, end: int) -> Rewritten:
    return Rewritten(text[start:end], [(i, i + 1) for i in range(start, end)])


def _sub(r: Rewritten, start: int, end: int) -> Rewritten:
    return Rewritten(r.text[start:end], r.spans[start:end])


def _windows(found: Iterator[re.Match], size: int, n: int) -> Iterator[tuple[int, int]]:
    """Stretches of ``size`` characters on both sides of the matches, merged."""
    lo = hi = -1
    for m in found:
        a, b = max(0, m.start() - size), min(n, m.end() + size)
        if a > hi:
            if hi >= 0:
                yield lo, hi
            lo = a
        hi = b
    if hi >= 0:
        yield lo, hi


def deobfuscated(text: str) -> Iterator[Rewritten]:
    """Rewritten stretches of ``text`` in which identifiers may show."""
    plain = _piece(text, 0, len(text)) if len(text) < 4096 else None
    views: list[tuple[str, Rewritten | None]] = [(text, plain)]
    if not text.isascii() and _SUSPECT.search(text):
        view = plain_letters(text)
        yield view
        views.append((view.text, view))
    for body, view in views:

        def part(start: int, end: int, view: Rewritten | None = view) -> Rewritten:
            return _piece(text, start, end) if view is None else _sub(view, start, end)

        # a run is at least nine words that are digits, whatever stands between them
        folded = (body if body.isascii() else body.translate(_SAME_CASE)).lower()
        if b"\1" * 9 in bytes(map(_DIGIT_WORDS.__contains__, _WORD.findall(folded))):
            for m in _DIGIT_RUN.finditer(body):
                yield spelled_digits(part(*m.span()))
        for lo, hi in _windows(_SIGN.finditer(body), 320, len(body)):
            for m in _IP_RUN.finditer(body, lo, hi):
                yield spoken_dots(part(*m.span()))
            spoken = (m for m in _ADDRESS.finditer(body, lo, hi) if _SIGN.search(m[0]))
            marked = (m for m in _MARKED_ADDRESS.finditer(body, lo, hi) if _MARK.search(m[0]))
            for found in (spoken, marked):
                for m in found:
                    sign = part(m.end("local"), m.start("domain"))
                    one = Rewritten("@", [(sign.spans[0][0], sign.spans[-1][1])])
                    yield _joined(spoken_dots(part(*m.span("local"))), one, spoken_dots(part(*m.span("domain"))))


def added(text: str, base: list[Span]) -> list[Span]:
    """Spans found only in the rewritten text, mapped back; none is equal to or inside another of its kind."""
    found = {(kind, *view.back(s, e)) for view in deobfuscated(text) for kind, s, e in find(view.text)}
    out: list[Span] = []
    # from left to right, the longer first and base spans before equal ones: a span lies inside
    # another of its kind if one that began no later has ended no earlier
    far: dict[str, int] = {}
    for s, back, new, kind in sorted([(s, -e, False, k) for k, s, e in base] + [(s, -e, True, k) for k, s, e in found]):
        if -back > far.get(kind, -1):
            far[kind] = -back
            if new:
                out.append((kind, s, -back))
    return out


def _order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _named(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [pa.int64(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            body = text.as_py() or ""
            base = find(body)
            more = added(body, base)
            count = [sum(x[0] == k for x in base) for k in KINDS]
            digest = hashlib.sha256(_named(_order(base)).encode()).hexdigest()
            rows.append((doc_id, *count, digest, _named(_order(base + more)), len(more)))
        columns = list(zip(*rows)) if rows else [()] * len(fields)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields)], names=names)


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, the numbers of base spans of each kind, the digest of the base spans, all
    spans as ``kind:start:end``, and how many of them the deobfuscation added."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(
        _scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )


def redact(text: str, mark: str = "[{}]") -> str:
    """``text`` with every span replaced by its kind (overlapping spans as one, by the first)."""
    base = find(text)
    out, at = [], 0
    for kind, s, e in sorted(base + added(text, base), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], mark.format(kind)]
        at = max(at, e)
    return "".join([*out, text[at:]])
