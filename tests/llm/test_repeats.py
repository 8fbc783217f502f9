import hashlib
import random

import numpy as np
import pytest

from rankloom.llm import repeats as rp


def brute(texts):
    """Every string of 100 bytes of every document, in order."""
    seen, out = set(), {}
    for i in sorted(texts):
        text = (texts[i] or "").encode()
        covered = np.zeros(len(text), bool)
        for p in range(len(text) - 99):
            string = text[p : p + 100]
            if string in seen:
                covered[p : p + 100] = True
            seen.add(string)
        edges = np.diff(np.r_[0, covered.astype(int), 0])
        kept = bytes(np.frombuffer(text, np.uint8)[~covered])
        out[i] = (len(text), int(covered.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def got(docs):
    made = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return rp.map_repeats(docs, made, rp.digests).collect()


@pytest.fixture(scope="module")
def mixed():
    """Texts from shared passages of all lengths around the width, whole copies, periods."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    prose = lambda low, high: "".join(rng.choice(words) for _ in range(rng.randint(low, high)))
    passages = [prose(10, 80) for _ in range(12)]
    texts = {}
    for i in range(250):
        parts = (rng.choice(passages) if rng.random() < 0.5 else prose(1, 40) for _ in range(rng.randint(0, 6)))
        texts[i] = rng.choice(texts) if i > 9 and rng.random() < 0.1 else "".join(parts)
    return texts | {3: None, 4: "", 5: "a" * 3000, 6: "ab" * 1500, 7: "x" * 99, 8: "x" * 100, 9: "x" * 101}


def test_mixed(documents, mixed):
    rows = list(mixed.items())
    random.Random(1).shuffle(rows)
    want = brute(mixed)
    assert {r[0]: tuple(r)[1:] for r in got(documents(rows))} == want
    assert sum(v[1] for v in want.values()) > 1000


def test_crowded_anchors(documents):
    """One passage between ever other words: its ends are settled string by string."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    texts = {i: f"{rng.random()} " * 8 + passage + f" {rng.random()}" * 8 for i in range(120)}
    assert {r[0]: tuple(r)[1:] for r in got(documents(list(texts.items())))} == brute(texts)


def one_by_one(rows):
    """Rows as documents of their own, by id, null last, and then by Spark's hash of the text."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))


def check_rows(docs):
    rows = docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, ''))").collect()
    want = brute(dict(enumerate(r[1] for r in one_by_one(rows))))
    ids = [r[0] for r in one_by_one(rows)]
    assert sorted(map(repr, map(tuple, got(docs)))) == sorted(repr((ids[k], *v)) for k, v in want.items())
    return want


def test_odd_rows(odd):
    check_rows(odd)


def test_ids_that_do_not_tell_rows_apart(documents):
    """Spans of a row are cut out of that row alone, whether ids are null or shared."""
    rng = random.Random(21)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    p = prose(300)
    rows = [(1, p), (None, p + prose(200)), (None, prose(419)), (None, p), (2, prose(419)), (2, prose(50) + p), (2, p)]
    rows += [(2, p), (3, prose(500)), (-5, prose(200)), (2**63 - 1, p + prose(100)), (None, None)]
    want = check_rows(documents(rows))
    assert [v[1] for v in want.values()].count(300) == 6 and sum(v[1] == 0 for v in want.values()) == 6


def test_empty(odd):
    assert got(odd.limit(0)) == []
    assert all(r.n_removed == 0 for r in got(odd.where("length(text) < 50")))


def windows(runs):
    """Each string that runs stand for."""
    return {(int(r["doc"]), int(r["start"]) + k) for r in runs for k in range(r["size"])}


@pytest.mark.parametrize("block", [1 << 10, 1 << 12, 1 << 20])
def test_runs_cover_each_string_once(monkeypatch, block):
    monkeypatch.setattr(rp, "_BLOCK", block)
    rng = np.random.default_rng(1)
    sizes = [0, 5, 99, 100, 101, 700, 5000, 0, 3000, 250]
    bounds = np.r_[0, np.cumsum(sizes)]
    data = rng.integers(97, 100, bounds[-1]).astype(np.uint8)
    runs = np.concatenate(list(rp.text_runs(data, bounds)))
    want = {(d, p) for d, n in enumerate(sizes) for p in range(n - 99)}
    assert windows(runs) == want and int(runs["size"].sum()) == len(want)
    # Equal strings have equal keys and leads.
    at = {}
    for r in runs:
        for k in range(r["size"]):
            p = bounds[r["doc"]] + r["start"] + k
            mark = (int(r["key"]), int(r["lead"]) - k)
            assert at.setdefault(data[p : p + 100].tobytes(), mark) == mark


def test_family_against_all_at_once():
    """Whatever the batches and their order, the same runs repeat and the same keys are open."""
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randint(1, 120)
        runs = np.zeros(n, rp._RUN)
        for r in runs:
            r["key"], r["hash"] = rng.randint(0, 25), rng.choice([1, 1, 1, 2, 3])
            r["doc"], r["start"], r["size"] = rng.randint(0, 30), rng.randint(0, 3), 1
        runs = np.unique(runs)
        order = list(range(len(runs)))
        rng.shuffle(order)
        crowded = np.array(rng.sample(range(26), 2), np.uint64)
        family, gone, open_ = rp.Family(), [], []
        cut = 0
        while cut < len(order):
            step = rng.randint(1, 30)
            more = np.sort(crowded) if rng.random() < 0.2 else np.zeros(0, np.uint64)
            a, b = family.add(rp._sorted(runs[order[cut : cut + step]]), more)
            gone, open_, cut = gone + a.tolist(), open_ + b.tolist(), cut + step
        a, b = family.add(runs[:0], np.sort(crowded))
        gone, open_ = gone + a.tolist(), open_ + b.tolist()
        first = {}
        for r in sorted(runs.tolist(), key=lambda r: (r[2], r[3])):
            first.setdefault(r[:2], r)
        several = {k for k, _ in first if len({h for q, h in first if q == k}) > 1} | set(crowded.tolist())
        kept = [r for keys, level in family.levels for r in level[~family.marked.has(keys)].tolist()]
        # Each run is repeated, open or kept, and none of them twice; kept ones are the first of keys with one run.
        assert sorted(gone + open_ + kept) == sorted(runs.tolist())
        assert all(first[r[:2]] != r for r in gone)
        assert {r[0] for r in open_} <= several and {r[0] for r in kept}.isdisjoint(several)
        assert all(first[r[:2]] == r for r in kept) and all(first[k] in open_ for k in first if k[0] in several)
        sizes = [len(keys) for keys, _ in family.levels]
        assert all(len(keys) == len(set(keys.tolist())) for keys, _ in family.levels) and len(sizes) < 12
