"""Languages of a document as a mixture, fitted by expectation-maximisation.

Each word of a text is drawn from one language of the document's set; its likelihood in a
language is that of its letter trigrams. The set grows from the best single language: a
language joins if the fitted mixture's likelihood gains more than half the logarithm of
the number of words for the added proportion. The proportions come from
expectation-maximisation. The likelihood is concave in them, so a language whose first
step up from zero gains nothing is ruled out without fitting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import flat_bytes, whole_text

UNDETERMINED = "und"
#: Trigrams are counted in so many places by a hash; a model has this many numbers a language.
PLACES = 1 << 16
#: Labelled rows that a model is fitted on, about; taken by a hash of doc_id.
TRAIN_ROWS = 20_000
ROUNDS = 10
_CHUNK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
_ASCII_LETTER = _LETTER[_LOWER] & (np.arange(256) < 128)


def _has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram places of all letter bytes, where each word starts among them, its document."""
    lower = _LOWER[data]
    letter = _LETTER[lower]
    held = np.where(letter, lower, 0).astype(np.uint32)
    before, after = np.zeros_like(held), np.zeros_like(held)
    before[1:], after[:-1] = held[:-1], held[1:]
    inner = bounds[1:-1][bounds[1:-1] < len(data)]
    before[inner] = 0
    after[inner[inner > 0] - 1] = 0
    at = np.flatnonzero(letter)
    place = (before[at] * 40503 + held[at] * 30011 + after[at] * 52711) & (PLACES - 1)
    starts = np.flatnonzero(before[at] == 0)
    document = np.searchsorted(bounds, at[starts], side="right") - 1
    return place, starts, document


@dataclass(frozen=True)
class Model:
    """Logarithms of each language's trigram shares (places x languages) and of its share."""

    languages: list[str]
    trigrams: np.ndarray
    shares: np.ndarray

    def _word_likelihoods(self, place: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.empty((len(starts), len(self.languages)))
        ends = np.r_[starts[1:], len(place)]
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + _CHUNK)))
            low = starts[first]
            rows = self.trigrams[place[low : ends[last - 1]]]
            out[first:last] = np.add.reduceat(rows, starts[first:last] - low, axis=0)
            first = last
        return out

    def mixtures(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Proportions of the languages for each document; zeros where it has no words."""
        place, starts, document = _words(data, bounds)
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        if not len(starts):
            return out
        words = self._word_likelihoods(place, starts)
        firsts = np.flatnonzero(np.r_[True, document[1:] != document[:-1]])
        rows, sizes = document[firsts], np.diff(np.r_[firsts, len(document)])
        total = np.add.reduceat(words, firsts, axis=0) + self.shares
        best = total.argmax(axis=1)
        share = np.zeros_like(total)
        share[np.arange(len(rows)), best] = 1.0
        scale = words.max(axis=1, keepdims=True)
        words = np.exp(np.maximum(words - scale, -300.0))
        open_ = np.ones(len(rows), bool)
        for _ in range(len(self.languages) - 1):
            if not open_.any():
                break
            open_ = self._grow(words, firsts, sizes, share, open_)
        out[rows] = share
        return out

    def answers(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Like ``mixtures``, with zeros also where a text has no letter."""
        if not self.languages:
            return np.zeros((len(bounds) - 1, 0))
        out = self.mixtures(data, bounds)
        for k in np.flatnonzero(out.any(axis=1)):
            text = data[bounds[k] : bounds[k + 1]]
            if not _ASCII_LETTER[text].any() and not _has_letter(text.tobytes()):
                out[k] = 0
        return out

    def _grow(self, words, firsts, sizes, share, open_) -> np.ndarray:
        """Add the best further language to each open document; returns which got one."""
        which = np.flatnonzero(open_)
        size = sizes[which]
        cuts = np.r_[0, np.cumsum(size)[:-1]]
        flat = np.repeat(firsts[which] - cuts, size) + np.arange(size.sum())
        own, now = words[flat], share[which]
        mixed = np.einsum("wl,wl->w", own, np.repeat(now, size, axis=0))
        likelihood = np.add.reduceat(np.log(mixed), cuts)
        slope = np.add.reduceat(own / mixed[:, None], cuts, axis=0) / size[:, None] - 1
        gain = np.zeros_like(now)
        fitted = np.zeros((*now.shape, now.shape[1]))
        for k in range(now.shape[1]):
            some = np.flatnonzero((now[:, k] == 0) & (slope[:, k] > 0))
            if not len(some):
                continue
            n = size[some]
            at = np.r_[0, np.cumsum(n)[:-1]]
            part = own[np.repeat(cuts[some] - at, n) + np.arange(n.sum())]
            mix = now[some] * 0.9
            mix[:, k] = 0.1
            for _ in range(ROUNDS):
                weight = part * np.repeat(mix, n, axis=0)
                weight /= weight.sum(axis=1, keepdims=True)
                mix = np.add.reduceat(weight, at, axis=0) / n[:, None]
            after = np.einsum("wl,wl->w", part, np.repeat(mix, n, axis=0))
            gain[some, k] = np.add.reduceat(np.log(after), at) - likelihood[some]
            fitted[some, k] = mix
        chosen = gain.argmax(axis=1)
        row = np.arange(len(which))
        grown = gain[row, chosen] > 0.5 * np.log(size + 1.0) + 1.0
        share[which[grown]] = fitted[row, chosen][grown]
        out = np.zeros_like(open_)
        out[which[grown]] = True
        return out


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: every fifth by the checksum of the id's decimal form."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``rows`` labelled rows that aren't held out, or all if there are fewer.

    Rows count whole, are chosen by a hash of ``doc_id`` alone, and only counts come to
    the driver: at most ``PLACES`` numbers a language.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    there = usable.agg(F.count(F.lit(1))).first()[0]
    per_million = min(1_000_000, -(-rows * 1_000_000 // max(there, 1)))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < per_million)
    texts = chosen.select("lang", whole_text().cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        lots: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, bounds = flat_bytes(batch.column(1))
            for k, lang in enumerate(langs):
                text = data[bounds[k] : bounds[k + 1]]
                place = _words(text, np.array([0, len(text)]))[0]
                counts = seen.setdefault(lang, np.zeros(PLACES, np.int64))
                counts += np.bincount(place, minlength=PLACES)
                lots[lang] = lots.get(lang, 0) + 1
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            columns = [np.r_[at, -1], np.r_[counts[at], lots[lang]]]
            names = pa.array([lang] * len(columns[0]), pa.string())
            yield pa.record_batch([names, *map(pa.array, columns)], ["lang", "place", "n"])

    counted = texts.mapInArrow(count, "lang string, place bigint, n bigint")
    counted = counted.groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    table = np.zeros((PLACES, len(languages)))
    shares = np.zeros(len(languages))
    for k, lang in enumerate(languages):
        own = counted[counted["lang"] == lang]
        grams = own[own["place"] >= 0]
        table[grams["place"].to_numpy(), k] = grams["n"].to_numpy()
        shares[k] = own.loc[own["place"] < 0, "n"].sum()
    table += 0.1
    trigrams = np.log(table / table.sum(axis=0)).astype(np.float32)
    return Model(languages, trigrams, np.log(shares / max(shares.sum(), 1)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Rows ``(doc_id, held_out, lang_pred, score, languages)``, one for each row of ``docs``.

    ``languages`` lists the document's set with proportions, the largest first, and
    ``lang_pred`` and ``score`` are its head. A text that is null or has no letter is
    ``und`` with score 0 and an empty set, and so is every text if nothing was learnt.
    A null ``doc_id`` isn't held out. Equal texts get equal answers, of equally likely
    languages the first by name counts; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), whole_text().cast("binary").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                data, bounds = flat_bytes(batch.column(2))
                names, scores, sets = [], [], []
                for mix in fitted.answers(data, bounds):
                    order = [i for i in np.argsort(-mix, kind="stable").tolist() if mix[i] > 0]
                    names.append(fitted.languages[order[0]] if order else UNDETERMINED)
                    scores.append(min(1.0, float(mix[order[0]])) if order else 0.0)
                    sets.append(",".join(f"{fitted.languages[i]}:{mix[i]:.3f}" for i in order))
                out = [batch.column(0), batch.column(1), *map(pa.array, (names, scores, sets))]
                yield pa.record_batch(out, ["doc_id", "held_out", "lang_pred", "score", "languages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages string"
    return rows.mapInArrow(run, schema)


def _where(docs: DataFrame, judge) -> DataFrame:
    """The rows of ``docs`` whose texts ``judge(data, bounds)`` says true to, with all their columns."""
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    rows = docs.select(row.alias("row"), whole_text().cast("binary").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield batch.select([0]).filter(pa.array(judge(*flat_bytes(batch.column(1))), pa.bool_()))

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")


def determined(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language isn't ``und``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return _where(docs, lambda data, bounds: shared.value.answers(data, bounds).any(axis=1))


def lettered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a letter, with all their columns; needs no model."""
    return _where(docs, lambda data, bounds: [_has_letter(data[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])])
