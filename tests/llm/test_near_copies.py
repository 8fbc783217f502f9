import random
import sys
from pathlib import Path

import pytest
from test_simhash import component_of

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from rankloom.llm import near_copies as nc  # noqa: E402
from rankloom.llm import simhash as sh  # noqa: E402
from rankloom.llm.common import written  # noqa: E402


def grams(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, similarity=0.8):
    """Which (doc_id, text) stay, by the similarity of all pairs."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [grams(t) for _, t in rows]
    near = [
        (a, b)
        for a, x in enumerate(sets)
        for b, y in enumerate(sets[:a])
        if len(x & y) >= similarity * len(x | y) - 1e-9
    ]
    component = component_of(near, range(len(rows)))
    return {r for k, r in enumerate(rows) if component[k] == k}


def stays(df):
    return {(r.doc_id, r.text) for r in df.collect()}


def edited(rng, base, edits, words):
    text = list(base)
    for _ in range(edits):
        text[rng.randrange(len(text))] = rng.choice(words)
    return text


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    line = [rng.choice(words) for _ in range(15)]
    bases = [[rng.choice(words) for _ in range(rng.choice([20, 60, 150]))] + line for _ in range(25)]
    texts = [edited(rng, rng.choice(bases), rng.choice([0, 1, 2, 3, 5, 8]), words) for _ in range(250)]
    hot = [rng.choice(words) for _ in range(100)]
    texts += [edited(rng, hot, rng.choice([1, 2, 3]), words) for _ in range(150)]
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("share", [3000, 1 << 20])
def test_stage_keeps_one_of_near_copies(spark, documents, rows, monkeypatch, share):
    """Also with groups dealt out."""
    monkeypatch.setattr(nc, "SHARE", share)
    want = brute(rows)
    assert 30 < len(want) < 300
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    docs = documents(rows)
    got = stage(spark, docs, "")
    assert got.columns == docs.columns and stays(got) == want


def test_sets_with_one_hash(spark, documents, rows, monkeypatch):
    """Different sets whose first hash agrees stay different."""
    monkeypatch.setattr(nc, "_node", lambda hashes: int(hashes.sum() % 50) if len(hashes) else 0)
    assert stays(nc.one_of_each(documents(rows))) == brute(rows)


def test_sample_table(spark):
    """Pairs of similarity 0.8 and more go, though their fingerprints differ in more than 3 bits."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert stays(nc.one_of_each(docs)) == want
    assert not {177, 145} & {i for i, _ in want}


def test_odd_rows(odd):
    kept = nc.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "11", "12", "13", "4", "4", "9", "None"]
    assert nc.one_of_each(odd.limit(0)).collect() == []


@pytest.mark.parametrize("one_of_each", [nc.one_of_each, sh.one_of_each])
def test_ids_that_do_not_tell_rows_apart(documents, one_of_each):
    """An id's other text stays; near copies without id go, of theirs and of others."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (2, a.upper()), (2, b), (None, a.title()), (None, c), (None, c.upper()), (None, None)]
    got = [(r.doc_id, (r.text or "").lower()) for r in one_of_each(documents(rows)).collect()]
    assert set(got) == {(1, a), (2, b), (None, c), (None, "")} and len(got) == 4


def test_fingerprints_link_first(documents):
    """Long texts with one word changed are in the groups that SimHash makes; others are not."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(900)]
    texts = [edited(rng, base, 1, words) for _ in range(20)] + [[rng.choice(words) for _ in range(60)] for _ in range(20)]
    keys = nc._keys(documents([(k, " ".join(t)) for k, t in enumerate(texts)]), 5)
    keys = written(keys, "test-keys")
    found = nc._near_prints(keys).join(keys, "node").select("doc_id").collect()
    assert len(found) > 10 and all(r.doc_id < 20 for r in found)
