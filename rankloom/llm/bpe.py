"""Byte-level BPE, encoded by backtracking over longest matches and decoded by an offset table.

A pre-token's tokens are found from the left: an Aho-Corasick automaton over the
vocabulary gives the longest token at a position. It stands if it is compatible with the
token before it, that is, if merging the two tokens' bytes would never join anything
across their border. If not, the next shorter token at the position is tried, and if none
is left the last token is taken back. Each position is given up at most once, so the time
is linear in the length. The result equals applying the merges in order.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import arrow_schema, content_key, flat_bytes, whole_text, with_id

# Code points that the regex module takes for letters and for numbers, but
# the Unicode version of the vocabulary's library does not.
NEWER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D "
    "107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 "
    "16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 "
    "191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF "
    "1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
NEWER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


def _spans(code_points: str) -> str:
    ends = (part.partition("-") for part in code_points.split())
    return "".join(f"\\U{a:0>8}-\\U{b or a:0>8}" for a, _, b in ends)


def _pre_tokens(letter: str, number: str) -> str:
    """Fixed: the pattern that cuts byte-level BPE's text into pre-tokens."""
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+"
        rf"| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+"
    )


LETTERS = rf"[\p{{L}}--[{_spans(NEWER_LETTERS)}]]"
NUMBERS = rf"[\p{{N}}--[{_spans(NEWER_NUMBERS)}]]"
# For texts with newer letters or numbers, for other texts, and for ASCII, which is faster.
PRE_TOKENS = "(?V1)" + _pre_tokens(LETTERS, NUMBERS)
USUAL_PRE_TOKENS = _pre_tokens(r"\p{L}", r"\p{N}")
ASCII_PRE_TOKENS = (
    r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+"
    r"| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
)

#: Bytes of pre-tokens, and number of token pairs, that a Python worker remembers. Only speed depends on it.
REMEMBERED_BYTES = 32 << 20
REMEMBERED_PAIRS = 100_000
#: What an entry takes besides its letters and ids, and the letters of the longest that is worth it.
ENTRY_BYTES = 200
#: A place in a dict at its emptiest, and what two objects are rounded up by.
PLACE_BYTES = 96
LONGEST_REMEMBERED = 64


def _byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    letters = {b: chr(b) for b in shown}
    return [letters[b] if b in letters else chr(next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """What a vocabulary file holds: tokens as bytes by id, merges by rank, added tokens."""

    tokens: dict[int, bytes]
    merges: list[tuple[bytes, bytes]]
    added: dict[str, int]


def read_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file of the tokenizers library, on the driver."""
    with open(path, "rb") as file:
        return parse_vocabulary(file.read())


def parse_vocabulary(file: bytes) -> Vocabulary:
    """What the bytes of such a file hold."""
    content = json.loads(file)
    to_byte = {letter: b for b, letter in enumerate(_byte_letters())}

    def as_bytes(token: str) -> bytes:
        return bytes(to_byte[letter] for letter in token)

    added = {t["content"]: t["id"] for t in content["added_tokens"]}
    model = content["model"]
    tokens = {i: as_bytes(t) for t, i in model["vocab"].items() if t not in added}
    tokens |= {i: t.encode() for t, i in added.items()}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return Vocabulary(tokens, [(as_bytes(a), as_bytes(b)) for a, b in pairs], added)


def _listed(kind: str) -> str:
    """The code points up to U+FFFF that ``kind`` matches, as ranges of a character class."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    runs = [run.span() for run in regex.compile(f"(?V1)(?:{kind})+").finditer(every)]
    ends = [(ord(every[a]), ord(every[b - 1])) for a, b in runs]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ends)


def _pattern_below_astral() -> str:
    """``PRE_TOKENS`` with its classes written out, for texts without code points above U+FFFF."""
    letters, numbers, blanks = _listed(LETTERS), _listed(NUMBERS), _listed(r"\s")
    return (
        rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+"
        rf"| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
    )


class PreTokens:
    """Cuts texts into pre-tokens; texts without rare characters take faster patterns."""

    def __init__(self) -> None:
        self._astral = re.compile("[\U00010000-\U0010ffff]").search
        self._below_astral = re.compile(_pattern_below_astral()).findall
        self._any = regex.compile(PRE_TOKENS).findall
        self._usual = regex.compile(USUAL_PRE_TOKENS).findall
        self._ascii = re.compile(ASCII_PRE_TOKENS).findall
        self._newer = re.compile(f"[{_spans(NEWER_LETTERS)}{_spans(NEWER_NUMBERS)}]").search

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self._ascii(text)
        if not self._astral(text):
            return self._below_astral(text)
        return self._any(text) if self._newer(text) else self._usual(text)


class OffsetTable:
    """Strings end to end with the offset of each, to look many of them up at once."""

    def __init__(self, strings: dict[int, bytes]) -> None:
        listed = [strings.get(i, b"") for i in range(max(strings, default=-1) + 1)]
        self._ends = np.cumsum([0, *map(len, listed)])
        self._blob = np.frombuffer(b"".join(listed), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        """The strings of ``ids`` one after another."""
        starts = self._ends[ids]
        sizes = self._ends[ids + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self._blob[np.repeat(starts - ends + sizes, sizes) + np.arange(total)].tobytes()


class _Remembered(dict):
    """The ids of pre-tokens, worked out where they are missing.

    Half of ``REMEMBERED_BYTES`` holds what was met since it last was full, the other half what was
    met before that. So what is met often stays, and what was met once goes.
    """

    def __init__(self, work_out: Callable[[str], bytes]) -> None:
        self.work_out = work_out
        self.forget()

    def __missing__(self, pre_token: str) -> bytes:
        pieces = self.older.get(pre_token) or self.work_out(pre_token)
        size = PLACE_BYTES + sys.getsizeof(pre_token) + sys.getsizeof(pieces)
        half = REMEMBERED_BYTES // 2
        if len(pre_token) > LONGEST_REMEMBERED or size > half:
            return pieces
        if self.bytes + size > half:
            older = dict(self)
            self.forget()
            self.older = older
        self[pre_token] = pieces
        self.bytes += size
        return pieces

    def forget(self) -> None:
        self.clear()
        self.older: dict[str, bytes] = {}
        self.bytes = 0


class Codec:
    """Encoder and decoder of one vocabulary, as each Python worker builds it."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        ids = {t: i for i, t in vocabulary.tokens.items() if i not in vocabulary.added.values()}
        size = max(ids.values(), default=-1) + 1
        # A pair of tokens is one number, the left token times ``_size`` plus the right one.
        self._size = size
        self._ranks: dict[int, int] = {}  # pair -> rank of its merge
        self._last = len(vocabulary.merges) + 1
        # By token, the merge that makes it: its rank (-1: none), the left and the right token.
        self._made, self._lefts, self._rights = [-1] * size, [0] * size, [0] * size
        for rank, (left, right) in enumerate(vocabulary.merges):
            a, b, joined = ids[left], ids[right], ids[left + right]
            self._ranks.setdefault(a * size + b, rank)
            if self._made[joined] < 0:
                self._made[joined], self._lefts[joined], self._rights[joined] = rank, a, b
        self._matcher = ahocorasick.Automaton()
        for token, i in ids.items():
            self._matcher.add_word(token.decode("latin-1"), i)
        self._matcher.make_automaton()
        # By token: its bytes, and the longest token that it begins with besides itself (-1: none).
        self._lengths, self._shorter = [0] * size, [-1] * size
        for token, i in ids.items():
            self._lengths[i] = len(token)
            cuts = (token[:n] for n in range(len(token) - 1, 0, -1))
            self._shorter[i] = next((ids[c] for c in cuts if c in ids), -1)
        self._added = vocabulary.added
        names = sorted(map(regex.escape, vocabulary.added), key=len, reverse=True)
        self._specials = regex.compile("(" + "|".join(names) + ")") if names else None
        self._cut = PreTokens()
        self._every_byte = all(bytes([b]) in ids for b in range(256))
        self._known = _Remembered(self._pieces)
        self._fits: dict[int, bool] = {}
        self._texts = OffsetTable(vocabulary.tokens)
        self._numbers = OffsetTable({i: b"%d," % i for i in vocabulary.tokens})

    def _compatible(self, left: int, right: int) -> bool:
        """Whether no merge ever joins bytes of ``left`` with bytes of ``right``.

        Both tokens are taken apart, the later merge first. At each moment the two
        pieces at the border stood side by side; a merge of them that comes before
        the one just undone would have been applied.
        """
        ranks, made, size = self._ranks.get, self._made, self._size
        a, b, undone = left, right, self._last
        while True:
            if ranks(a * size + b, undone) < undone:
                answer = False
                break
            if made[a] > made[b]:
                undone, a = made[a], self._rights[a]
            elif made[b] >= 0:
                # Equal merges apply from the left, so this one counts as later.
                undone, b = made[b] + 1, self._lefts[b]
            else:
                answer = True
                break
        if len(self._fits) >= REMEMBERED_PAIRS:
            self._fits.clear()
        self._fits[left * size + right] = answer
        return answer

    def _pieces(self, pre_token: str) -> bytes:
        """The ids of one pre-token as 32-bit numbers."""
        letters = pre_token.encode().decode("latin-1")
        tokens = [token for _, token in self._matcher.iter_long(letters)]
        if not self._every_byte and sum(map(self._lengths.__getitem__, tokens)) < len(letters):
            raise ValueError(f"no token for some byte of {pre_token!r}")
        # Mostly the longest matches, one after another, stand as they are.
        known, base, last = self._fits.get, self._size, -1
        for k, token in enumerate(tokens):
            if last >= 0:
                fit = known(last * base + token)
                if not (self._compatible(last, token) if fit is None else fit):
                    tokens = self._settled(letters, tokens, k)
                    break
            last = token
        return array("i", tokens).tobytes()

    def _settled(self, letters: str, tokens: list[int], k: int) -> list[int]:
        """The ids of ``letters``, whose longest matches stand up to the ``k``-th, which does not."""
        found, last, trying = tokens[:k], tokens[k - 1], self._shorter[tokens[k]]
        search, shorter, lengths = self._matcher.iter_long, self._shorter, self._lengths
        known, base = self._fits.get, self._size
        size, at = len(letters), sum(map(lengths.__getitem__, found))
        alive = bytearray(b"\x01") * (size + 1)
        # Longest matches are searched anew where a shorter token was taken.
        in_step = False
        while True:
            while trying >= 0:
                if alive[at + lengths[trying]]:
                    if last < 0:
                        break
                    fit = known(last * base + trying)
                    if fit or (fit is None and self._compatible(last, trying)):
                        break
                trying, in_step = shorter[trying], False
            if trying >= 0:
                found.append(trying)
                last = trying
                at += lengths[trying]
                if at == size:
                    return found
                if not in_step:
                    following, in_step = search(letters, at), True
                _, trying = next(following)
            else:
                alive[at] = 0
                trying = found.pop()
                at -= lengths[trying]
                last = found[-1] if found else -1
                in_step = False

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._known.__getitem__, self._cut(text)))

    @property
    def _known_bytes(self) -> int:
        return self._known.bytes

    def forget(self) -> None:
        """Empty the memory of pre-tokens."""
        self._known.forget()

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text; the strings of added tokens become those tokens."""
        if self._specials is None:
            return np.frombuffer(self._plain(text), np.int32)
        parts = self._specials.split(text)
        ids = [
            np.int32(self._added[part]).tobytes() if k % 2 else self._plain(part)
            for k, part in enumerate(parts)
        ]
        return np.frombuffer(b"".join(ids), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids; bytes that are no UTF-8 become U+FFFD."""
        return self._texts.join(ids).decode("utf-8", "replace")

    def numbers(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self._numbers.join(ids)[:-1]


# The codec that a Python worker has built, by the content of its vocabulary file.
_BUILT: dict[str, Codec] = {}


def _mapped(
    spark: SparkSession, rows: DataFrame, path: str, schema: str, work: Callable
) -> DataFrame:
    """``work(codec, batch)`` for each Arrow batch; the vocabulary file is read once, here.

    Workers get the file as it is, a few megabytes, and keep the codec; what it remembers
    of the texts goes at the end of each task.
    """
    with open(path, "rb") as opened:
        file = opened.read()
    content, shared = content_key(file), spark.sparkContext.broadcast(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if content not in _BUILT:
            _BUILT.clear()
            _BUILT[content] = Codec(parse_vocabulary(shared.value))
        codec = _BUILT[content]
        try:
            for batch in batches:
                yield from work(codec, batch)
        finally:
            codec.forget()

    return rows.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Short batches, so that what is made of them stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> Iterator[str]:
    data, bounds = flat_bytes(column)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield data[a:b].tobytes().decode()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Rows ``(doc_id, ids array<int>)`` for each row of ``docs``; a null text has no ids.

    ``path`` is a byte-level BPE file of the tokenizers library. Equal texts get equal
    ids, rows that repeat are encoded again, and other columns are not read. Special
    tokens are not added; where a text holds the string of one, it becomes that token.
    """
    rows = docs.select("doc_id", whole_text().cast("binary").alias("text"))

    def work(codec: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            ids = [codec.encode(text) for text in texts_of(part.column(1))]
            yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _mapped(docs.sparkSession, rows, path, f"doc_id {kind}, ids array<int>", work)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows ``(doc_id, text)`` from ``(doc_id, ids)``; null ids give an empty text."""
    rows = encoded.select("doc_id", F.coalesce("ids", F.expr("array()")).cast("array<int>").alias("ids"))

    def work(codec: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            texts = [codec.decode(np.array(ids, np.int64)) for ids in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return _mapped(encoded.sparkSession, rows, path, f"doc_id {kind}, text string", work)


def round_trip(docs: DataFrame, path: str, made: str, make: Callable) -> DataFrame:
    """Encode and decode in one pass: ``doc_id`` and what ``make`` derives from both results.

    ``make(numbers, ids, text)`` gets the decimal ids joined by commas as bytes, the ids
    and the decoded text, and returns a tuple of the columns that ``made`` declares.
    """
    rows = docs.select("doc_id", whole_text().cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = arrow_schema(made)

    def work(codec: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            out = []
            for text in texts_of(part.column(1)):
                ids = codec.encode(text)
                out.append(make(codec.numbers(ids), ids, codec.decode(ids)))
            yield with_id(part.column(0), out, schema)

    return _mapped(docs.sparkSession, rows, path, f"doc_id {kind}, {made}", work)
