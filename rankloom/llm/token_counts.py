"""How many tokens a unigram model makes of each text, by dynamic programming along a trie.

The distinct pre-tokens of a batch, in order, are the paths of a trie from left to right:
what two neighbours share is the path from the root to where they part. The best score of
each node, over all ways to end a piece there, is kept on that path and worked out once
for all pre-tokens below it. A pre-token's own node gives its number of pieces, which is
stored and added up over the texts.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.bpe import ENTRY_BYTES, LONGEST_REMEMBERED, REMEMBERED_BYTES, PreTokens, slices, texts_of
from rankloom.llm.common import content_key, whole_text


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a file of base64 pieces and ranks, by rank."""
    with open(path, "rb") as file:
        rows = [line.split() for line in file if line.strip()]
    return [base64.b64decode(piece) for piece, _ in sorted(rows, key=lambda r: int(r[1]))]


def rank_scores(pieces: list[bytes]) -> dict[bytes, float]:
    """Logarithms of shares that fall with the rank, by Zipf's rule: 1 / (rank + 1), scaled."""
    scale = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {piece: -math.log(rank + 1) - scale for rank, piece in enumerate(pieces)}


class Counter:
    """Pieces and score of the best segmentation of pre-tokens under piece scores.

    The best has the largest sum of scores, then the fewest pieces. Every single byte
    has to be a piece, so that there is one for each pre-token.
    """

    def __init__(self, scores: dict[bytes, float]) -> None:
        spelled = {piece.decode("latin-1"): score for piece, score in scores.items()}
        # With the ends of pieces, without a score: where none ends so, no longer piece does.
        self._ends = dict.fromkeys(p[k:] for p in spelled for k in range(1, len(p))) | spelled
        self._pieces: dict[str, int] = {}
        self._sums: dict[str, float] = {}
        self._long: list[str] = []
        self._bytes = 0
        self.cut = PreTokens()

    def learn(self, pre_tokens: set[str]) -> None:
        """Store the numbers of new pre-tokens."""
        if self._bytes > REMEMBERED_BYTES:
            self.forget()
        known_end = self._ends.get
        path, sums, pieces = "", [0.0], [0]
        spelled = ((p.encode().decode("latin-1"), p) for p in pre_tokens.difference(self._pieces))
        for letters, pre_token in sorted(spelled):
            shared = len(commonprefix([path, letters]))
            del sums[shared + 1 :], pieces[shared + 1 :]
            for end in range(shared + 1, len(letters) + 1):
                best, fewest = -math.inf, 0
                for start in range(end - 1, -1, -1):
                    score = known_end(letters[start:end], False)
                    if score is False:
                        break
                    if score is not None:
                        total, n = sums[start] + score, pieces[start] + 1
                        if total > best or (total == best and n < fewest):
                            best, fewest = total, n
                sums.append(best)
                pieces.append(fewest)
            path = letters
            self._pieces[pre_token], self._sums[pre_token] = pieces[-1], sums[-1]
            self._bytes += ENTRY_BYTES + 4 * len(pre_token)
            if len(pre_token) > LONGEST_REMEMBERED:
                self._long.append(pre_token)

    def forget(self) -> None:
        """Empty the memory of pre-tokens."""
        self._pieces.clear()
        self._sums.clear()
        self._long.clear()
        self._bytes = 0

    def forget_long(self) -> None:
        """Empty the memory of those that rarely come back, once their texts are counted."""
        for pre_token in self._long:
            del self._pieces[pre_token], self._sums[pre_token]
            self._bytes -= ENTRY_BYTES + 4 * len(pre_token)
        self._long.clear()

    def count(self, pre_tokens: list[str]) -> tuple[int, int, float]:
        """Pre-tokens, pieces and score of a text whose pre-tokens have been learnt."""
        pieces = sum(map(self._pieces.__getitem__, pre_tokens))
        return len(pre_tokens), pieces, math.fsum(map(self._sums.__getitem__, pre_tokens))


# The counters that a Python worker has built, by the content of their scores.
_BUILT: dict[str, Counter] = {}


def token_counts(docs: DataFrame, scores: dict[bytes, float]) -> DataFrame:
    """Rows ``(doc_id, n_pre_tokens, n_tokens, score)``, one for each row of ``docs``.

    ``scores`` has the logarithm of each piece's share; it is sent to every executor and
    is as large as the vocabulary. Null and empty texts count nothing, with score 0.
    Texts of any length count whole, rows that repeat get equal rows, and other columns
    are not read.
    """
    if any(bytes([b]) not in scores for b in range(256)):
        raise ValueError("each byte has to be a piece")
    content, shared = content_key(scores), docs.sparkSession.sparkContext.broadcast(scores)
    rows = docs.select("doc_id", whole_text().cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if content not in _BUILT:
            _BUILT.clear()
            _BUILT[content] = Counter(shared.value)
        counter = _BUILT[content]
        try:
            for whole in batches:
                for batch in slices(whole):
                    cut = [counter.cut(text) for text in texts_of(batch.column(1))]
                    counter.learn(set().union(*cut))
                    counts = zip(*map(counter.count, cut)) if cut else ([], [], [])
                    yield pa.record_batch(
                        [batch.column(0), *(pa.array(c) for c in counts)],
                        ["doc_id", "n_pre_tokens", "n_tokens", "score"],
                    )
                    counter.forget_long()
        finally:
            counter.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_pre_tokens bigint, n_tokens bigint, score double")
