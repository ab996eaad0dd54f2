"""Personal data: base patterns, and disguised identifiers found through transducers.

Base spans are matched in the text as it is.  A chain of transducers then rewrites a copy:
look-alike characters to ASCII, spelled digits to digits, ``(at)`` / ``dot`` disguises to
``@`` and ``.``.  Each transducer carries, for every character it puts out, the source
span it came from, so an identifier found in the rewritten copy maps back to the source.
Such a span is added if something in it was rewritten and it overlaps no base span of its
kind.  Scans are linear in the text: e-mails are looked for from the ``@`` outwards.

Offsets are code points, end exclusive.  Defined cases: null texts are empty and have no
span; overlapping spans of different kinds are all reported; repeated rows get equal rows.
Texts are judged whole, one row at a time, however long.  An empty table gives an empty result.
Only the kept columns and the text are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.shared import map_texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# --- base patterns -------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Digit runs are taken whole; a run that fails fails from each of its digits.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[Span]:
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free))
        at = text.find("@", max(at + 1, free))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def _is_card(match: str) -> bool:
    digits = NOT_DIGIT.sub("", match)
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping spans of each kind; matches that fail a test are dropped."""
    found = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if DIGIT.search(text):
        found["ip"] = [m.span() for m in IP.finditer(text) if all(map(_part_fits, m[0].split(".")))]
        found["card"] = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 13 and _is_card(m[0])]
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return found


# --- transducers ---------------------------------------------------------------------

# Cyrillic and Greek letters that look like ASCII ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
}
# Characters without width, and blanks other than the ASCII one.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
BLANKS = "\u00a0\u2002\u2003\u2009\u202f\u3000"
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}


def _folded(char: str) -> str:
    if char in INVISIBLE:
        return ""
    if char in BLANKS:
        return " "
    if "\uff01" <= char <= "\uff5e":
        return chr(ord(char) - 0xFEE0)
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    return str(unicodedata.decimal(char)) if not char.isascii() and unicodedata.decimal(char, None) is not None else char


@dataclass
class Tape:
    """A rewritten text; character i stands for source[starts[i]:ends[i]]."""

    text: str
    starts: np.ndarray
    ends: np.ndarray
    changed: np.ndarray

    @classmethod
    def of(cls, text: str) -> Tape:
        places = np.arange(len(text), dtype=np.int64)
        return cls(text, places, places + 1, np.zeros(len(text), dtype=bool))

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Tape:
        """With each [start, end) replaced; the new characters stand for the whole span."""
        if not edits:
            return self
        text, starts, ends, changed, at = [], [], [], [], 0
        for start, end, new in edits:
            keep = slice(at, start)
            text += [self.text[keep], new]
            n = len(new)
            starts += [self.starts[keep], np.full(n, self.starts[start])]
            ends += [self.ends[keep], np.full(n, self.ends[end - 1])]
            changed += [self.changed[keep], np.ones(n, dtype=bool)]
            at = end
        keep = slice(at, None)
        joined = [np.concatenate([*parts, own[keep]]) for parts, own in ((starts, self.starts), (ends, self.ends), (changed, self.changed))]
        return Tape("".join(text) + self.text[keep], *joined)

    def source(self, span: Span) -> Span:
        return int(self.starts[span[0]]), int(self.ends[span[1] - 1])


FOLDABLE = re.compile(r"[^\x00-\xff]|[\xa0\xad]")
_WORD = "(?:" + "|".join(DIGIT_WORDS) + ")"
_GAP = r"(?:[\x20,-]{1,2}|\s{1,3}(?:dot|point)\s{1,3})"
SPELLED = re.compile(rf"\b(?:plus[\x20-])?{_WORD}(?:{_GAP}{_WORD}){{2,}}\b", re.I)
SPELLED_HINT = re.compile(rf"{_WORD}[\x20,-]{{1,2}}{_WORD}|{_WORD}\s{{1,3}}(?:dot|point)\s", re.I)
SPELLED_PART = re.compile(rf"plus|dot|point|{_WORD}", re.I)
_OPEN, _SHUT = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
AT = re.compile(rf"\s{{0,3}}{_OPEN}at{_SHUT}\s{{0,3}}|\s{{1,3}}at\s{{1,3}}|@", re.I)
DOT = re.compile(rf"\s{{0,3}}{_OPEN}dot{_SHUT}\s{{0,3}}|\s{{1,3}}dot\s{{1,3}}|\.", re.I)
LABEL = re.compile(r"[A-Za-z0-9-]+")
AT_HINT = re.compile(rf"{_OPEN}(?:at|dot){_SHUT}|\sdot\s", re.I)


def fold_look_alikes(tape: Tape) -> Tape:
    if tape.text.isascii():
        return tape
    edits = [(m.start(), m.end(), new) for m in FOLDABLE.finditer(tape.text) if (new := _folded(m[0])) != m[0]]
    return tape.rewritten(edits)


def spelled_digits(tape: Tape) -> Tape:
    if not SPELLED_HINT.search(tape.text):
        return tape
    signs = DIGIT_WORDS | {"plus": "+", "dot": ".", "point": "."}
    edits = []
    for m in SPELLED.finditer(tape.text):
        parts = [signs[p[0].lower()] for p in SPELLED_PART.finditer(m[0])]
        edits.append((m.start(), m.end(), "".join(parts)))
    return tape.rewritten(edits)


def at_and_dot(tape: Tape) -> Tape:
    """``name (at) host dot tld``: a bare word ``at`` counts only before a disguised dot."""
    text = tape.text
    if not AT_HINT.search(text):
        return tape
    edits = []
    for at in AT.finditer(text):
        if not at.start() or text[at.start() - 1] not in LOCAL or (edits and at.start() < edits[-1][1]):
            continue
        label = LABEL.match(text, at.end())
        dots, disguised = [], False
        while label:
            dot = DOT.match(text, label.end())
            label = LABEL.match(text, dot.end()) if dot else None
            if label:
                dots.append((dot.start(), dot.end(), "."))
                disguised |= dot[0] != "."
        bracketed = any(c in "[({<" for c in at[0])
        if dots and (disguised or bracketed):
            edits += [(at.start(), at.end(), "@"), *dots]
    return tape.rewritten([e for e in edits if text[e[0] : e[1]] != e[2]])


TRANSDUCERS: tuple[Callable[[Tape], Tape], ...] = (fold_look_alikes, spelled_digits, at_and_dot)


def added_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    tape = Tape.of(text) if _may_change(text) else None
    if tape is None:
        return {}
    for rewrite in TRANSDUCERS:
        tape = rewrite(tape)
    if not tape.changed.any() and len(tape.text) == len(text):
        return {}
    added: dict[str, list[Span]] = {}
    for kind, spans in base_spans(tape.text).items():
        taken = np.array(base[kind], dtype=np.int64).reshape(-1, 2)
        for span in spans:
            start, end = tape.source(span)
            same = not tape.changed[span[0] : span[1]].any() and end - start == span[1] - span[0]
            # Base spans are disjoint and in order: only the last that starts before `end` can overlap.
            last = int(np.searchsorted(taken[:, 0], end)) - 1
            if not same and not (last >= 0 and taken[last, 1] > start):
                added.setdefault(kind, []).append((start, end))
    return added


def _may_change(text: str) -> bool:
    folds = not text.isascii() and FOLDABLE.search(text)
    return bool(folds or SPELLED_HINT.search(text) or AT_HINT.search(text))


# --- over a table --------------------------------------------------------------------

SPANS = "array<struct<kind: string, start: bigint, end: bigint, base: boolean>>"
ARROW_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
)


def spans_of(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans of a text, by kind as in KINDS, then start, then end."""
    if not text:
        return []
    base = base_spans(text)
    added = added_spans(text, base)
    out = []
    for kind in KINDS:
        own = [(s, e, True) for s, e in base[kind]] + [(s, e, False) for s, e in added.get(kind, [])]
        out += [(kind, s, e, b) for s, e, b in sorted(own)]
    return out


def find(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``spans``: an array of (kind, start, end, base)."""
    names = ("kind", "start", "end", "base")

    def start():
        return lambda texts: [[[dict(zip(names, span)) for span in spans_of(t)] for t in texts]]

    return map_texts(docs, text_col, keep, {"spans": (SPANS, ARROW_SPANS)}, start)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
