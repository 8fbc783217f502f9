import random
import re
from collections import Counter

import pytest

from rankloom.llm import decontaminate as dc


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(words, width):
    return [tuple(words[k : k + width]) for k in range(len(words) - width + 1)]


def brute(rows, items, similarity=0.8, width=5):
    """Every window of every document against every item."""
    out = {}
    for i, text in set(rows):
        for item_id, item in set(items):
            item_words, words = words_of(item), words_of(text)
            if not item_words:
                continue
            k = min(width, len(item_words))
            own, there = Counter(shingles(item_words, k)), shingles(words, k)
            m = sum(own.values())
            size = min(m, len(there))
            scores = []
            for start in range(len(there) - size + 1 if size else 0):
                common = sum((Counter(there[start : start + size]) & own).values())
                scores.append((common / (m + size - common), -start))
            # Of equal windows the first that starts at a shared shingle or ends the text.
            top = max(scores, default=(0,))[0]
            scores = [s for s in scores if there[-s[1]] in own or s[1] == size - len(there)]
            assert not scores or max(scores)[0] == top
            if scores and max(scores)[0] >= similarity - 1e-12:
                best = max(scores)
                key = (i, item_id, text)
                out[key] = (-best[1], size + k - 1, round(best[0], 9))
    return sorted(((i, j, *v) for (i, j, _), v in out.items()), key=repr)


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def got(docs, items, **options):
    rows = dc.leaks(docs, items, **options).collect()
    return sorted(((r.doc_id, r.item_id, r.start, r.words, round(r.similarity, 9)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def planted():
    """Passages with edits, moved to either end, in short and long texts."""
    rng = random.Random(11)
    vocabulary = [f"word{k}" for k in range(200)] + ["the", "of"] * 20
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(9, 60))) for _ in range(15)]
    items += ["the of " * 12, "only three words", "single"]
    rows = []
    for i in range(120):
        words = items[i % len(items)].split()
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3, 6])):
            at = rng.randrange(len(words))
            edit = rng.choice(["swap", "drop", "add"])
            if edit == "swap":
                words[at] = rng.choice(vocabulary)
            elif edit == "add":
                words.insert(at, rng.choice(vocabulary))
            elif len(words) > 1:
                del words[at]
        around = lambda: [rng.choice(vocabulary) for _ in range(rng.choice([0, 0, 3, 40]))]
        rows.append((i, (", ".join([*around(), *words, *around()])).title()))
    return rows, list(enumerate(items))


def test_planted(spark, documents, planted):
    rows, items = planted
    want = brute(rows, items)
    assert len(want) > 40 and any(r[4] < 1 for r in want)
    assert got(documents(rows), table(spark, items)) == want


def test_no_alike_window_is_missed_at_other_limits(spark, documents, planted):
    rows, items = planted
    want = brute(rows, items, similarity=0.5, width=3)
    assert got(documents(rows), table(spark, items), similarity=0.5, width=3) == want


def test_shuffled_instead_of_sent(spark, documents, planted, monkeypatch):
    monkeypatch.setattr(dc, "SENT_SHINGLES", 0)
    rows, items = planted
    assert got(documents(rows), table(spark, items)) == brute(rows, items)


def test_odd_rows(spark, odd):
    items = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, "nobody s text"),
             (5, "Sehr lange Zeile ohne Ende Sehr lange Zeile ohne Ende")]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(odd, table(spark, items)) == brute(rows, items)
    kept = dc.without_leaks(odd, table(spark, items))
    assert kept.columns == odd.columns
    gone = {r[0] for r in brute(rows, items)}
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(
        repr(i) for i, t in rows if i not in gone or (i is None and t is None)
    )


def test_empty(spark, odd):
    items = table(spark, [(1, "one two three four five six")])
    assert dc.leaks(odd.limit(0), items).collect() == []
    for nothing in (items.limit(0), table(spark, [(1, None), (2, "--")])):
        assert dc.leaks(odd, nothing).collect() == []
        assert dc.without_leaks(odd, nothing).count() == odd.count()


@pytest.mark.parametrize("distinct", [1, 65_536, 200_000])
def test_items_of_very_many_shingles(spark, documents, distinct):
    """Counts of a fingerprint's bits are as wide as texts can be long."""
    words = [f"w{k % distinct}" for k in range(max(distinct, 40_000))]
    item = " ".join(words)
    near = " ".join(words[:1000] + ["other"] + words[1000:])
    docs = documents([(1, item), (2, near), (3, " ".join(words[: len(words) // 2])), (4, "w0 w1 w2")])
    found = {i: s for i, _, _, _, s in got(docs, table(spark, [(7, item)]))}
    assert found[1] == 1 and 0.99 < found[2] <= 1 and set(found) == {1, 2}
