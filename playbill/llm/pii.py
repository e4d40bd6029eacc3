"""Operator 3: personal data, disguised or not, with offsets into the source text.

Plain identifiers are found by the base patterns. A text with signs of disguise also passes through transducers, each of
which rewrites some characters and carries along where every written character came from: homoglyphs and fullwidth forms
become ASCII, spelled digits become digits, `(at)` and `dot` disguises become `@` and `.`. The same patterns run over the
outcome, and what they find is mapped back to the source characters.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import narrow, pieces

KINDS = ("email", "ip", "card", "phone")

# -- base patterns --------------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# a match can only begin where a run of digits does; saying so keeps long runs linear
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """The check of card numbers: from the right, every second digit doubled, digit sums, a multiple of ten."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1) if begin == at else last
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping for each kind; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# -- transducers ----------------------------------------------------------------------------------------------------

# fixed values: characters that look like an ASCII character
_LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "п": "n", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K",
    "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "γ": "y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ɑ": "a", "ⅼ": "l", "ℓ": "l", "․": ".", "。": ".", "｡": ".", "·": ".", "•": ".", "﹒": ".", "﹫": "@",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "﹢": "+", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
}
# characters that show nothing
_UNSEEN = "­​‌‍‎‏⁠﻿"
_GLYPHS = dict(_LOOKALIKES) | {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
_GLYPHS |= {chr(zero + k): str(k) for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for k in range(10)}
# mathematical alphabets: 13 runs of A-Z a-z
_GLYPHS |= {chr(0x1D400 + 52 * k + j): "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[j] for k in range(13) for j in range(52)}
_GLYPH = re.compile(f"[{re.escape(''.join(_GLYPHS))}{_UNSEEN}]")
# a cheap look before that: the few of these characters below U+0250, and all above
_ODD = re.compile("[\xa0\xad\xb7\u0131\u0250-\U0010ffff]")

# fixed values: the digits' names
_NAMES = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "niner": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_TIMES = {"double": 2, "triple": 3}
_NAME = "|".join(sorted(_NAMES, key=len, reverse=True))
_SAID = rf"(?:(?:double|triple)[ -])?(?:{_NAME})"
_PLUS = r"(?:\bplus[ \t]+(?=(?:{0}|[0-9])))?".format(_NAME)
_GAP = r"(?:[ \t]*[,.;/-][ \t]*|[ \t]+)"
#: At least three digits in a row, one of them spelled.
_SPELLED = re.compile(rf"{_PLUS}\b(?:{_SAID}|[0-9]+)\b(?:{_GAP}(?:{_SAID}|[0-9]+)\b){{2,}}", re.IGNORECASE)
_PIECE = re.compile(rf"\bplus\b|(?:(double|triple)[ -])?\b({_NAME})\b|[0-9]+|.", re.IGNORECASE | re.DOTALL)

# fixed values: how an at sign and a dot are said, and the top-level names that a bare "at" needs
_AT_WORD, _DOT_WORD = r"(?:at|arroba|chez)", r"(?:dot|punto|punkt|point)"
# a match begins where a run of blanks or of words does; saying so keeps long runs linear
_BLANKS = r"(?:(?<![ \t])[ \t]++)?"
_BRACKETED_AT = re.compile(rf"{_BLANKS}(?:[\[({{<][ \t]*(?:{_AT_WORD}|@)[ \t]*[\])}}>]|[_-]{_AT_WORD}[_-])[ \t]*", re.IGNORECASE)
_BRACKETED_DOT = re.compile(rf"{_BLANKS}[\[({{<][ \t]*(?:{_DOT_WORD}|\.)[ \t]*[\])}}>][ \t]*|(?<=\w)[_-]{_DOT_WORD}[_-](?=\w)", re.IGNORECASE)
_TOP = r"(?:com|org|net|edu|gov|io|info|biz|dev|app|ai|co|me|uk|us|de|fr|es|eu|it|nl|ch|at|ca|au|in|example|test)"
# every chain of words is taken whole, with its host or without one
_BARE = re.compile(
    rf"(?P<local>[A-Za-z0-9%+-]++(?:(?:\.|[ \t]++{_DOT_WORD}[ \t]++(?!{_AT_WORD}[ \t]))[A-Za-z0-9%+-]++)*+)(?:(?:[ \t]++{_AT_WORD}[ \t]++|[ \t]*+@[ \t]*+)"
    rf"(?P<host>[A-Za-z0-9-]++(?:(?:\.|[ \t]++{_DOT_WORD}[ \t]++)[A-Za-z0-9-]++)*(?:\.|[ \t]++{_DOT_WORD}[ \t]++){_TOP})\b)?",
    re.IGNORECASE,
)
_DOT_SAID = re.compile(rf"(?<![ \t])[ \t]++{_DOT_WORD}[ \t]++", re.IGNORECASE)
_AT_SAID = re.compile(rf"(?<![ \t])(?:[ \t]++{_AT_WORD}[ \t]++|[ \t]*+@[ \t]*+)", re.IGNORECASE)
_PLAIN = re.compile(r"[^ \t]+")
_NUMBER_DOT = re.compile(rf"(?<=[0-9])[ \t]+{_DOT_WORD}[ \t]+(?=[0-9])", re.IGNORECASE)
_SIGN = re.compile(rf"[\[({{<_-][ \t]*(?:{_AT_WORD}|{_DOT_WORD}|@|\.)[ \t]*[\])}}>_-]", re.IGNORECASE)
_BRACKETED_SIGN = re.compile(r"[\[({<][ \t]*[.@]")
_TOP_SIGN = re.compile(rf"\.{_TOP}\b", re.IGNORECASE)

# what is no letter or digit of ASCII parts words; bytes beyond ASCII are parts of words
_PARTING = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_NAME_BYTES = frozenset(k.encode() for k in _NAMES)
_AT_BYTES, _DOT_BYTES = frozenset((b"at", b"arroba", b"chez")), frozenset((b"dot", b"punto", b"punkt", b"point"))


def _signs(text: str) -> tuple[bool, bool]:
    """Whether a text may hold spelled digits, and whether it may hold disguised at signs or dots. Cheap, never false where the rewriting would act."""
    words = text.lower().encode(errors="surrogatepass").translate(_PARTING).split()
    kinds = set(words)
    spelled = False
    if not kinds.isdisjoint(_NAME_BYTES):
        digit = lambda w: w in _NAME_BYTES or w in (b"double", b"triple") or w.isdigit()
        spelled = any(w in _NAME_BYTES and (k and digit(words[k - 1]) or k + 1 < len(words) and digit(words[k + 1])) for k, w in enumerate(words))
    dot, at = not kinds.isdisjoint(_DOT_BYTES), "@" in text or not kinds.isdisjoint(_AT_BYTES)
    marks = (dot or at) and _SIGN.search(text) is not None or _BRACKETED_SIGN.search(text) is not None
    if not marks and at and (dot or _TOP_SIGN.search(text) is not None):
        marks = any(m["host"] and not _PLAIN.fullmatch(m[0]) for m in _BARE.finditer(text))
    return spelled, marks or dot and (spelled or _NUMBER_DOT.search(text) is not None)


@dataclass
class Tape:
    """A rewritten text; character k of it stands for the source characters from start[k] to end[k]."""

    text: str
    start: list[int]
    end: list[int]

    @classmethod
    def of(cls, text: str) -> "Tape":
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> "Tape":
        """Replace the given stretches (ordered, apart); every new character stands for its whole stretch."""
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += self.text[at:a], new
            start += self.start[at:a]
            end += self.end[at:a]
            if new:
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
            at = b
        return Tape("".join([*text, self.text[at:]]), start + self.start[at:], end + self.end[at:])


def plain_glyphs(tape: Tape) -> Tape:
    """Look-alikes and fullwidth forms become ASCII; unseen characters go."""
    return tape.rewrite([(m.start(), m.end(), _GLYPHS.get(m[0], "")) for m in _GLYPH.finditer(tape.text)])


def plain_digits(tape: Tape) -> Tape:
    """In runs of at least three spelled or written digits, names become digits and what parts them one space, or nothing."""
    edits = []
    for m in _SPELLED.finditer(tape.text):
        if not re.search(rf"\b(?:{_NAME})\b", m[0], re.IGNORECASE):
            continue
        last = m.start()
        for p in _PIECE.finditer(tape.text, m.start(), m.end()):
            if (word := p[0].lower()) == "plus":
                new = "+"
            elif p[2]:
                new = _NAMES[p[2].lower()] * _TIMES.get((p[1] or "").lower(), 1)
            elif word[0].isascii() and word[0].isdigit():
                new = p[0]
            else:
                continue
            if p.start() > last:
                edits.append((last, p.start(), "" if edits and edits[-1][2] == "+" and edits[-1][1] == last else " "))
            edits.append((p.start(), p.end(), new))
            last = p.end()
    return tape.rewrite(edits)


def plain_marks(tape: Tape) -> Tape:
    """Bracketed and spoken at signs and dots become the marks; a bare `at` only within a whole spoken address."""
    edits = {(m.start(), m.end()): "@" for m in _BRACKETED_AT.finditer(tape.text)}
    for m in _BRACKETED_DOT.finditer(tape.text):
        edits[m.start(), m.end()] = "."
    tape = tape.rewrite(_apart(edits))
    edits = {}
    for m in filter(lambda m: m["host"], _BARE.finditer(tape.text)):
        for part in ("local", "host"):
            edits |= {(d.start(), d.end()): "." for d in _DOT_SAID.finditer(tape.text, *m.span(part))}
        if at := _AT_SAID.match(tape.text, m.end("local")):
            edits[at.start(), at.end()] = "@"
    edits |= {(d.start(), d.end()): "." for d in _NUMBER_DOT.finditer(tape.text)}
    return tape.rewrite(_apart(edits))


def _apart(edits: dict[tuple[int, int], str]) -> list[tuple[int, int, str]]:
    """In order, without those that overlap an earlier one."""
    out, last = [], 0
    for (a, b), new in sorted(edits.items()):
        if a >= last:
            out.append((a, b, new))
            last = b
    return out


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each ordered by start, then kind. An added span lies in no base span of its kind."""
    text = text or ""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    glyphs = _ODD.search(text) is not None and _GLYPH.search(text) is not None
    tape = plain_glyphs(Tape.of(text)) if glyphs else None
    now = tape.text if tape else text
    spelled, marks = _signs(now)
    if not (glyphs or spelled or marks):
        return base, base
    tape = tape or Tape.of(text)
    if spelled:
        tape = plain_digits(tape)
    if marks:
        tape = plain_marks(tape)
    added = set()
    known = {kind: [s for s in base if s[0] == kind] for kind in KINDS}  # of one kind they are apart, so one of them can hold a span
    for kind, a, b in base_spans(tape.text):
        a, b = tape.start[a], tape.end[b - 1]
        before = bisect_right(known[kind], a, key=lambda s: s[1])
        if not before or b > known[kind][before - 1][2]:
            added.add((kind, a, b))
    return base, sorted([*base, *added], key=order)


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, found (array of kind, start, end, base), the base spans marked.

    Null text is empty: no spans. Every row gives a row, repeats too; only doc_id and text are read. An empty table gives an
    empty result. Offsets are code points of the source text, end exclusive.
    """
    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for rows in pieces(batches):
            found = []
            for text in rows.column("text").to_pylist():
                base, spans = find(text)
                known = set(base)
                found.append([{"kind": k, "start": a, "end": b, "base": (k, a, b) in known} for k, a, b in spans])
            yield pa.record_batch([rows.column("doc_id"), pa.array(found, kind)], names=["doc_id", "found"])

    return narrow(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, found array<struct<kind: string, start: long, end: long, base: boolean>>")


def redact(text: str | None, mask: str = "[{}]") -> str | None:
    """The text with every span replaced by its kind; overlapping spans are replaced together by the first's kind."""
    if text is None:
        return None
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in find(text)[1]:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += text[at:a], mask.format(kind)
        at = b
    return "".join([*out, text[at:]])


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
