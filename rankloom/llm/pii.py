"""Personal data: fixed patterns, and a linear-chain conditional random field for other forms.

The field labels tokens (runs of letters, runs of digits, single marks) from the shapes
of the token and its neighbours. It is trained on a small labelled table and decoded by
Viterbi over many sequences at once. Its sequences are the stretches around digits and
at signs: a label other than "none" needs one of these in reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.bpe import slices, texts_of
from rankloom.llm.common import arrow_schema, whole_text, with_id

KINDS = ["email", "ip", "card", "phone"]
#: Tokens on either side of a digit or an at sign that belong to its sequence.
REACH = 6

# The patterns of the kinds.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    doubled = (sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """From each at sign to both sides: one pass, whatever the runs' lengths."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1, start):
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            done = domain.end()
            yield start, done, True
        else:
            done = max(done, at + 1) if start == at else done
        at = text.find("@", max(at + 1, done))


def _candidates(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Leftmost matches of each kind's pattern: kind, start, end, whether it holds."""
    if "@" in text:
        for start, end, good in _emails(text):
            yield "email", start, end, good
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        parts = m[0].split(".")
        yield "ip", m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        yield "card", m.start(), m.end(), 13 <= len(digits) <= 19 and luhn(digits)
    for m in _PHONE.finditer(text) if "+" in text else ():
        yield "phone", m.start(), m.end(), 9 <= len(_DIGIT.findall(m[0])) <= 15


# Tokens and their shapes. Marks that have a shape of their own.
_MARKS = "@.-()+:/,_#='\"[]%$"
_DIGIT_SHAPES = 12
_LETTER_SHAPES = 4
SHAPES = 2 * (_DIGIT_SHAPES + _LETTER_SHAPES + len(_MARKS) + 1) + 1
_EDGE = SHAPES - 1
_SPACE, _LETTERS, _DIGITS, _OTHER = range(4)
_KIND = np.full(128, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _DIGITS
_KIND[65:91] = _KIND[97:123] = _LETTERS
_MARK_SHAPE = np.full(128, len(_MARKS), np.int64)
_MARK_SHAPE[[ord(c) for c in _MARKS]] = np.arange(len(_MARKS))


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (in code points) and shapes of a text's tokens.

    A shape tells letters by case and length, digits by their number and marks by the
    mark, and whether white space is before it.
    """
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(codes):
        return (np.zeros(0, np.int64),) * 3
    low = np.minimum(codes, 127)
    kind = np.where(codes < 128, _KIND[low], _LETTERS)
    first = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == _OTHER)]
    starts = np.flatnonzero(first)
    ends = np.r_[starts[1:], len(codes)]
    own = kind[starts]
    upper = (low >= 65) & (low <= 90)
    uppers = np.add.reduceat(upper.astype(np.int64), starts)
    size = ends - starts
    letters = np.where(uppers == 0, (size > 3) * 1, np.where((uppers == 1) & upper[starts], 2, 3))
    digits = np.select([size <= 8, size <= 12, size <= 19], [size - 1, 8, 9], 10)
    marks = _MARK_SHAPE[low[starts]] + _LETTER_SHAPES + _DIGIT_SHAPES
    shape = np.select([own == _LETTERS, own == _DIGITS], [letters, digits + _LETTER_SHAPES], marks)
    after_space = np.r_[True, own[:-1] == _SPACE]
    kept = own != _SPACE
    return starts[kept], ends[kept], (2 * shape + after_space)[kept]


_OFFSETS = (-2, -1, 0, 1, 2)
# Labels: none, then the begin and the inside of each kind.
LABELS = 1 + 2 * len(KINDS)


@dataclass(frozen=True)
class Field:
    """Weights: shapes at five offsets by label, and from each label to the next."""

    shapes: np.ndarray
    moves: np.ndarray

    def scores(self, shapes: np.ndarray) -> np.ndarray:
        """Label scores of each place of padded sequences (rows x places)."""
        padded = np.pad(shapes, ((0, 0), (2, 2)), constant_values=_EDGE)
        places = shapes.shape[1]
        return sum(self.shapes[k, padded[:, k : k + places]] for k in range(len(_OFFSETS)))

    def decode(self, sequences: list[np.ndarray], room: int = 1 << 15) -> list[np.ndarray]:
        """The most likely labels of each sequence of shapes; ties go to the first label.

        Sequences of like length are worked on together, up to ``room`` places at once.
        """
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        at = 0
        while at < len(order):
            width = max(1, len(sequences[order[at]]))
            some = order[at : at + max(1, room // width)]
            at += len(some)
            sizes = np.array([len(sequences[i]) for i in some])
            grid = np.full((len(some), width), _EDGE)
            for row, i in enumerate(some):
                grid[row, : sizes[row]] = sequences[i]
            score = self.scores(grid)
            back = np.zeros((width, len(some), LABELS), np.int8)
            best = score[:, 0] + _START
            last = best.copy()
            for t in range(1, width):
                paths = best[:, :, None] + self.moves
                back[t] = paths.argmax(axis=1)
                best = paths.max(axis=1) + score[:, t]
                last = np.where((sizes > t)[:, None], best, last)
            label = last.argmax(axis=1)
            labels = np.zeros((len(some), width), np.int64)
            rows = np.arange(len(some))
            for t in range(width - 1, -1, -1):
                inside = t < sizes
                labels[inside, t] = label[inside]
                before = back[t][rows, label]
                label = np.where(inside, before, label) if t else label
            for row, i in enumerate(some):
                out[i] = labels[row, : sizes[row]]
        return out


# An inside label needs a begin or an inside of its kind before it.
_ALLOWED = np.zeros((LABELS, LABELS))
for _k in range(len(KINDS)):
    _ALLOWED[:, 2 + 2 * _k] = -1e4
    _ALLOWED[1 + 2 * _k, 2 + 2 * _k] = _ALLOWED[2 + 2 * _k, 2 + 2 * _k] = 0
_START = _ALLOWED[0]

# A labelled table. Marked parts are in brackets with their kind's number in KINDS.
LABELLED = """
write to {0:ann.lee@mail.example.org} about the offer
contact {0:office@example.com}, please
from {0:b.moor+news@lists.example.net} on monday
mail {0:x99@mail7.example.com} or call
reach {0:jo @ example.org} for that
ask {0:kim.sol @ mail.example.com} then
the host {1:10.20.30.40} was down
login from {1:192.0.2.17} at night
address {1:203.0.113.250}, port 80
and {1:198.51.100.3} answered. Then it stopped
card {2:4111 1111 1111 1111} was charged
paid with {2:5500-0000-0000-0004} on friday
the card {2:4000.0000.0000.0002} was declined
paid by {2:5105.1051.0510.5100} at noon
number {2:4242  4242  4242  4242} on file
used {2:6011  0000  0000  0004}, then left
charge {2:3782.822463.10005} for it
the server {1:10 . 1 . 2 . 3} is down
ping {1:172 . 16 . 0 . 9} from here
logged {1:198 . 51 . 100 . 24} twice
seen at {1:203. 0. 113. 77} today
blocked {1:192. 0. 2. 45} again
call {3:+1 (555) 010-2030} after six
phone {3:+44 20 7946 0018} or write
tel {3:+49 30 901820} today
ring {3:(555) 010-2030} any time
dial {3:(212) 555-0187} now
our line {3:555-010-2030} is open
The number {3:212-555-0142} rings
Call {3:555.010.9876} for help
fax {3:(030) 555-0199}, room two
It rose by 12 of 300 in total
in 2024 there were 1500 of them
on 2024-01-15 it was closed
from 10:30 to 12:45 each day
version 1.2.3 and 2.0 came out
about 3.5 or 4.25 in all
it cost $19.99 or $5 then
see pages 10-20 and 31-35
rule 4 (2) of part 7
token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567" the
key = "fedcba98765432100123456789abcdef00112233" then
the row 10203040506071 was read
And then 1234567890123456 came later
one, 1122334455667789 more. Then
. Between 1020304050607081 9080706050403021 again
| of | 1357913579135791 | in all |
row 239047 and 81 of 9
id 998877665544332211009988 in the log
a 50% cut on 3/4 of it
room 12-34 and box 5-6
meet @ noon or @home with them
we are 1,200 and 3,400,000 strong
chapter 3. The end of part 12. Then
score 3-2 and 10-0 on 12.05.2023
item #17 and #204, lot 88/12
from 1999-2003 and 2010-2012 again
C3PO and R2D2, B12 and H2O
book 978-3-16-148410-0 was sold
x1y2z3 and 7up, 4ever 2b
serial 12-345-678-90 is void
""".strip().splitlines()


def labelled_rows(lines: list[str]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts without the brackets, and the ``(start, end, kind)`` that these marked."""
    rows = []
    for line in lines:
        text, spans = "", []
        for part in re.split(r"(\{[0-9]:[^}]*\})", line):
            if part.startswith("{"):
                spans.append((len(text), len(text) + len(part) - 4, int(part[1])))
                part = part[3:-1]
            text += part
        rows.append((text, spans))
    return rows


def train(lines: list[str] | None = None, rounds: int = 300, pull: float = 0.02) -> Field:
    """Fit the weights to the labelled lines by gradient steps; the same lines give the same field."""
    rows = labelled_rows(LABELLED if lines is None else lines)
    cut = [tokens(text) for text, _ in rows]
    width = max((len(shape) for *_, shape in cut), default=1) or 1
    shapes = np.full((len(rows), width), _EDGE)
    truth = np.zeros((len(rows), width), np.int64)
    inside = np.zeros((len(rows), width), bool)
    for r, ((_, spans), (starts, ends, shape)) in enumerate(zip(rows, cut)):
        shapes[r, : len(shape)], inside[r, : len(shape)] = shape, True
        for a, b, kind in spans:
            at = np.flatnonzero((starts >= a) & (ends <= b))
            truth[r, at] = 2 + 2 * kind
            truth[r, at[:1]] = 1 + 2 * kind
    padded = np.pad(shapes, ((0, 0), (2, 2)), constant_values=_EDGE)
    one = np.eye(LABELS)
    weights = [np.zeros((len(_OFFSETS), SHAPES, LABELS)), np.zeros((LABELS, LABELS))]
    speed = [np.zeros_like(w) for w in weights]
    both = inside[:, 1:, None, None]
    seen = (one[truth[:, :-1]][..., None] * one[truth[:, 1:]][:, :, None, :] * both).sum(axis=(0, 1))
    for _ in range(rounds):
        field = Field(weights[0], weights[1] + _ALLOWED)
        score = field.scores(shapes) * inside[..., None]
        ahead = np.zeros((len(rows), width, LABELS))
        behind = np.zeros_like(ahead)
        ahead[:, 0] = score[:, 0] + _START
        for t in range(1, width):
            step = _logsum(ahead[:, t - 1, :, None] + field.moves, 1) + score[:, t]
            ahead[:, t] = np.where(inside[:, t, None], step, ahead[:, t - 1])
        for t in range(width - 2, -1, -1):
            step = _logsum(field.moves + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(inside[:, t + 1, None], step, 0.0)
        total = _logsum(ahead[:, -1], 1)[:, None, None]
        share = np.exp(ahead + behind - total) * inside[..., None]
        pair = ahead[:, :-1, :, None] + field.moves + (score[:, 1:] + behind[:, 1:])[:, :, None, :]
        pairs = (np.exp(np.minimum(pair - total[..., None], 0.0)) * both).sum(axis=(0, 1))
        miss = (one[truth] - share) * inside[..., None]
        slope = np.zeros_like(weights[0])
        for k in range(len(_OFFSETS)):
            np.add.at(slope[k], padded[:, k : k + width], miss)
        for i, g in enumerate((slope, seen - pairs)):
            speed[i] = 0.9 * speed[i] + 0.1 * (g - pull * weights[i])
            weights[i] = weights[i] + 0.3 * speed[i]
    return Field(weights[0], weights[1] + _ALLOWED)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


_IS_TRIGGER = np.zeros(SHAPES, bool)
_IS_TRIGGER[2 * _LETTER_SHAPES : 2 * (_LETTER_SHAPES + _DIGIT_SHAPES)] = True
_IS_TRIGGER[2 * (_LETTER_SHAPES + _DIGIT_SHAPES) : 2 * (_LETTER_SHAPES + _DIGIT_SHAPES) + 2] = True


def _stretches(shapes: np.ndarray) -> Iterator[slice]:
    """Tokens within reach of a digit or an at sign, as maximal runs."""
    hits = np.flatnonzero(_IS_TRIGGER[shapes])
    if len(hits):
        apart = np.flatnonzero(np.diff(hits) > 2 * REACH)
        for a, b in zip(np.r_[hits[0], hits[apart + 1]], np.r_[hits[apart], hits[-1]]):
            yield slice(max(0, int(a) - REACH), min(len(shapes), int(b) + REACH + 1))


def _labelled_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """What the field marks in each text."""
    places, sequences = [], []
    for row, text in enumerate(texts):
        if "@" not in text and not _DIGIT.search(text):
            continue
        starts, ends, shapes = tokens(text)
        for part in _stretches(shapes):
            places.append((row, starts[part], ends[part]))
            sequences.append(shapes[part])
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (row, starts, ends), labels in zip(places, field.decode(sequences)):
        for at in np.flatnonzero(labels % 2 == 1).tolist():
            last = at
            while last + 1 < len(labels) and labels[last + 1] == labels[at] + 1:
                last += 1
            out[row].append((KINDS[labels[at] // 2], int(starts[at]), int(ends[last])))
    return out


# What a marked span has to look like to be added.
_WELL_FORMED = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+\x20?@\x20?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\x20?\.\x20?[0-9]+){3}"),
    "card": re.compile(r"[0-9](?:[\x20.-]{0,2}[0-9]){12,18}"),
    "phone": re.compile(r"\(?[0-9]{2,4}[\x20).-]+[0-9]{2,4}[\x20.-]+[0-9]{2,5}(?:[\x20.-][0-9]{2,4})?"),
}


def _well_formed(kind: str, span: str) -> bool:
    if not _WELL_FORMED[kind].fullmatch(span):
        return False
    digits = "".join(_DIGIT.findall(span))
    if kind == "card":
        return luhn(digits)
    return kind != "ip" or all(len(p.strip(" 0")) <= 3 and int(p.strip()) <= 255 for p in span.split("."))


def _judged(kind: str, a: int, b: int, matches: list) -> bool:
    """Whether a span meets a pattern's span, or its own kind's pattern has failed there.

    What failed for an ip address or a card may be a part of a wider form, so there it has to hold the span.
    """
    part = kind in ("ip", "card")
    return any(
        a < y and x < b and (good or k == kind and (not part or (x <= a and b <= y)))
        for k, x, y, good in matches
    )


def find(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """For each text the spans ``(kind, start, end)`` of the patterns, and those the field adds.

    A span is added if it is well formed (an ip address's numbers are at most 255, a card's digits
    pass Luhn's check) and was not judged by the patterns already.
    """
    out = []
    for text, marked in zip(texts, _labelled_spans(texts, field)):
        matches = list(_candidates(text)) if marked or "@" in text or _DIGIT.search(text) else []
        base = [(kind, a, b) for kind, a, b, good in matches if good]
        added = [
            (kind, a, b)
            for kind, a, b in marked
            if _well_formed(kind, text[a:b]) and not _judged(kind, a, b, matches)
        ]
        out.append((base, added))
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    """``kind:start:end`` by kind as in ``KINDS``, then by start, joined by commas."""
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in ordered)


def map_spans(docs: DataFrame, field: Field, made: str, make) -> DataFrame:
    """``doc_id`` and what ``make(base, added)`` derives from each text's spans.

    One row for each row of ``docs``; a null or empty text has no spans. Texts count
    whole, rows that repeat get equal rows, and other columns are not read. The field is
    sent to every executor; its size is fixed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select("doc_id", whole_text().cast("binary").alias("text"))
    schema = arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = find(list(texts_of(batch.column(1))), shared.value)
                yield with_id(batch.column(0), [make(*spans) for spans in found], schema)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {made}")


def personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """Rows ``(doc_id, kind, start, end, added)``, one for each span; see ``map_spans``."""

    def as_rows(base: list, added: list) -> tuple[list]:
        keys = ("kind", "start", "end", "added")
        marked = [(*s, False) for s in base] + [(*s, True) for s in added]
        return ([dict(zip(keys, s)) for s in marked],)

    made = "spans array<struct<kind:string,start:bigint,end:bigint,added:boolean>>"
    found = map_spans(docs, field, made, as_rows)
    return found.select("doc_id", F.explode("spans").alias("span")).select("doc_id", "span.*")
