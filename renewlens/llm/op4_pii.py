"""Personal data with offset-preserving deobfuscation.

Base detection runs four patterns over the text as it is. Then a cascade of transducers rewrites
the text: homoglyphs, full-width forms and invisible characters; disguised "at" and "dot"; runs of
spelled digits. Each writes, for every character it puts out, the span of source characters it came
from, so that a match in the rewritten text maps back to source offsets. Matches that a rewriting
made possible are added unless they touch a base span of their kind; base spans always stay.

A disguised mark counts if it is in brackets ("(at)", "[dot]"), spelled between spaces in the
whole form "name at host dot ending" or before a written host with a known ending, or a "dot" between
numbers. Any run of spelled and written digits is rewritten; the patterns decide what it is.

Defined results: null text is empty and has no spans; equal ids and repeated rows each keep a row.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.llm.common import str_texts, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# a run of digits fails or fits as a whole, so only its first digit is tried
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NON_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each "@": what lies left of it, then the host.

    A pattern that starts with the local part would be tried again from every letter of a long word.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        at = text.find("@", at + 1)


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four base patterns, leftmost and non-overlapping per kind."""
    out = []
    if "@" in text:
        out += [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NON_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NON_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- transducers ------------------------------------------------------------------------
#
# Letters of other scripts that look like Latin ones, invisible characters,
# names of digits.

_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d",
    "һ": "h", "ԛ": "q", "ԝ": "w", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "А": "A", "В": "B", "Е": "E",
    "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S",
    "Ј": "J", "ο": "o", "α": "a", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A",
    "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ⅼ": "l", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
    " ": " ", " ": " ", " ": " ",
}
_INVISIBLE = dict.fromkeys("­​‌‍⁠﻿", "")
_DIGIT_NAMES = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9",
}


def _single(c: str) -> str:
    """What one non-ASCII character becomes: itself unless it stands in for ASCII."""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if c in _INVISIBLE:
        return ""
    if "！" <= c <= "～" or "\U0001d400" <= c <= "\U0001d7ff":
        plain = unicodedata.normalize("NFKC", c)
        return plain if plain.isascii() else c
    digit = unicodedata.decimal(c, None)
    return c if digit is None else str(digit)


_ODD = re.compile(
    "["
    + "".join(map(re.escape, [*_LOOKALIKES, *_INVISIBLE]))
    + "！-～\U0001d400-\U0001d7ff٠-٩۰-۹०-९]"
)
# The patterns below start at something rare (a bracket, an "@", the blank after a word), never at any
# letter or blank of a run: the work is then bounded by the text.
_BRACKETED = re.compile(r"[(\[{<][ \t]*(?:(at|@)|(dot|punkt|punto|point|\.))[ \t]*[)\]}>][ \t]*", re.IGNORECASE)
_SPELLED = re.compile(
    r"(?<=[A-Za-z0-9._%+-])(?P<at>[ \t]+at[ \t]+)[A-Za-z0-9-]+(?:(?:[ \t]+dot[ \t]+|\.)[A-Za-z0-9-]+)*"
    r"[ \t]+dot[ \t]+[A-Za-z]{2,}",
    re.IGNORECASE,
)
_SPELLED_DOT = re.compile(r"(?<=[A-Za-z0-9._%+-])@[A-Za-z0-9.-]+(?:[ \t]+dot[ \t]+[A-Za-z0-9-]+)+", re.IGNORECASE)
_DOT = re.compile(r"[ \t]+dot[ \t]+", re.IGNORECASE)
# Endings of hosts after a spelled "at" and written dots.
_ENDINGS = (
    "com org net edu gov mil int info biz name pro io ai co me tv app dev cloud online site shop xyz eu uk us ca au nz ie"
    " de at ch fr be nl lu it es pt dk se no fi is pl cz sk hu ro bg gr hr si rs ua ru tr il za eg ng ke ma in pk bd lk"
    " cn hk tw jp kr sg my th vn id ph br mx ar cl co pe ve uy ec ae sa ir iq kz ee lv lt mt cy"
).split()
_AT_HOST = re.compile(
    rf"(?<=[A-Za-z0-9_%+-])[ \t]+at[ \t]+(?=(?:[A-Za-z0-9-]+\.)+(?:{'|'.join(_ENDINGS)})(?![A-Za-z0-9-]|\.[A-Za-z0-9]))",
    re.IGNORECASE,
)
_NAME = "(?:" + "|".join(_DIGIT_NAMES) + "|[0-9]+)"
_NUMBER_DOT = r"(?:[ \t]+dot[ \t]+|\.)"


def _digit_runs(between: str) -> re.Pattern:
    return re.compile(
        rf"(?:(?<![A-Za-z0-9+])(?P<plus>plus|\+)[ \t(-]*)?(?<![A-Za-z0-9]){_NAME}"
        rf"(?:(?:[{between}]+|{_NUMBER_DOT}){_NAME})+(?![A-Za-z0-9])",
        re.IGNORECASE,
    )


# A comma may end a number or stand between its digits: both are tried.
_DIGITS, _LISTED = _digit_runs(r" \t()-"), _digit_runs(r" \t,()-")
_ANY_NAME = re.compile("(?:" + "|".join(x for x in _DIGIT_NAMES if x != "oh") + r"|[ \t]dot[ \t])(?![a-z])", re.IGNORECASE)
_PIECE = re.compile(rf"(?P<name>{_NAME})|(?P<plus>plus|\+)|(?P<dot>{_NUMBER_DOT})", re.IGNORECASE)

Edits = list[tuple[int, int, str]]  # source start, source end, what it becomes


class Rewritten:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str, begin: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.begin, self.end = begin, end  # None: unchanged so far

    def apply(self, edits: Edits) -> Rewritten:
        if not edits:
            return self
        begin = self.begin if self.begin is not None else list(range(len(self.text)))
        end = self.end if self.end is not None else list(range(1, len(self.text) + 1))
        text, b, e, at = [], [], [], 0
        for start, stop, new in edits:
            text += (self.text[at:start], new)
            b += begin[at:start]
            e += end[at:start]
            if start < stop:
                b += [begin[start]] * len(new)
                e += [end[stop - 1]] * len(new)
            at = stop
        text.append(self.text[at:])
        return Rewritten("".join(text), b + begin[at:], e + end[at:])

    def source(self, start: int, end: int) -> tuple[int, int]:
        if self.begin is None:
            return start, end
        return self.begin[start], self.end[end - 1]


def _lookalike_edits(text: str) -> Edits:
    out = []
    for m in _ODD.finditer(text):
        new = _single(m[0])
        if new != m[0]:
            out.append((m.start(), m.end(), new))
    return out


def _bracket_edits(text: str) -> Edits:
    out, done = [], 0
    for m in _BRACKETED.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in " \t":
            start -= 1
        done = m.end()
        out.append((start, done, "@" if m[1] else "."))
    return out


def _spelled_edits(text: str) -> Edits:
    out = []
    for m in _SPELLED.finditer(text):
        out.append((m.start("at"), m.end("at"), "@"))
        out += [(m.end("at") + d.start(), m.end("at") + d.end(), ".") for d in _DOT.finditer(text[m.end("at") : m.end()])]
    return out


def _spelled_dot_edits(text: str) -> Edits:
    return [
        (m.start() + d.start(), m.start() + d.end(), ".")
        for m in _SPELLED_DOT.finditer(text)
        for d in _DOT.finditer(m[0])
    ]


def _digit_edits(text: str, runs: re.Pattern) -> Edits:
    """Each named digit of a run becomes a digit and each dot a point; what separates them goes, but for one
    blank or hyphen between written numbers, which the patterns allow."""
    out = []
    for m in runs.finditer(text):
        if not any(c.isalpha() for c in m[0]):
            continue
        at, before = m.start(), ""
        for p in _PIECE.finditer(m[0]):
            start, stop = m.start() + p.start(), m.start() + p.end()
            name = p["name"] or ""
            number = name if name.isdigit() else ""
            if at < start and not (before and number and text[at:start] in (" ", "-") and len(before + number) > 2):
                out.append((at, start, ""))
            out.append((start, stop, "+" if p["plus"] else "." if p["dot"] else _DIGIT_NAMES.get(name.lower(), name)))
            at, before = stop, number
    # a number that stays as it is keeps the places of its characters
    return [x for x in out if x[2] != text[x[0] : x[1]]]


def _rewritings(text: str) -> Iterator[Rewritten]:
    """The whole cascade, by each way to read commas; the text itself where there is nothing to rewrite."""
    now = Rewritten(text)
    if not text.isascii():
        now = now.apply(_lookalike_edits(now.text))
    low = now.text.lower()
    if any(c in low for c in "([{<"):
        now = now.apply(_bracket_edits(now.text))
    if " dot" in low or "\tdot" in low:
        now = now.apply(_spelled_edits(now.text))
        now = now.apply(_spelled_dot_edits(now.text))
    if " at" in low or "\tat" in low:
        now = now.apply([(m.start(), m.end(), "@") for m in _AT_HOST.finditer(now.text)])
    if not _ANY_NAME.search(low):
        yield now
        return
    one, two = _digit_edits(now.text, _DIGITS), _digit_edits(now.text, _LISTED)
    yield now.apply(one)
    if two != one:
        yield now.apply(two)


def rewrite(text: str) -> Rewritten:
    """The cascade with commas at the ends of numbers."""
    return next(_rewritings(text))


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and added spans of a text, each by start and kind."""
    base, added = detect(text), []
    for changed in _rewritings(text):
        if changed.begin is None:
            continue
        taken = {k: sorted((e, s) for kind, s, e in base + added if kind == k) for k in KINDS}
        for kind, s, e in detect(changed.text):
            s, e = changed.source(s, e)
            # spans of a kind do not overlap: only the first that ends after this one's start can touch it
            after = bisect.bisect_left(taken[kind], (s + 1, -1))
            if after == len(taken[kind]) or taken[kind][after][1] >= e:
                added.append((kind, s, e))
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=order), sorted(added, key=order)


SPAN_SCHEMA = "array<struct<kind:string,start:int,end:int,added:boolean,value:string>>"


def find_pii(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and all spans of every text: kind, offsets, whether the rewriting added it, source characters."""
    kind = pa.list_(
        pa.struct(
            [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_()), ("value", pa.string())]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in str_texts(b.column(1)):
                base, more = spans(t)
                both = [(*x, False) for x in base] + [(*x, True) for x in more]
                both.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
                rows.append([{"kind": k, "start": s, "end": e, "added": a, "value": t[s:e]} for k, s, e, a in both])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"doc_id bigint, spans {SPAN_SCHEMA}")


def digest_spans(found: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()


def _count(kind: str):
    base = F.filter("spans", lambda s: ~s["added"] & (s["kind"] == kind))
    return F.size(base).cast("bigint").alias(f"n_{kind}")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s["added"])
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[_count(k) for k in KINDS],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
