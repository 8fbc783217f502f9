"""Classes of chunks against the similarity of all pairs."""

import random

import pytest

from rankloom.operators import chunk_copies as cc
from rankloom.operators.ingest import chunks


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near_pairs(texts, similarity=0.8):
    sets = {t: shingles(t) for t in texts}
    ordered = sorted(t for t in sets if sets[t])
    return [
        (a, b)
        for k, a in enumerate(ordered)
        for b in ordered[:k]
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9
    ]


def brute(rows):
    """``(id, least id of the class, size, kept)`` by joining the classes of all pairs."""
    parent = {t or "": t or "" for _, t in rows}

    def top(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in near_pairs(parent):
        parent[top(a)] = top(b)
    members = {}
    for i, t in rows:
        members.setdefault(top(t or ""), []).append(i)
    return sorted((i, min(m), len(m), i == min(m)) for m in members.values() for i in m)


def got(spark, rows, **options):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id long, body string, key string, label int")
    out = cc.chunk_copies(table.repartition(3), ["id"], "body", **options)
    assert out.columns == ["id", "first", "copies", "kept"]
    return sorted((r.id, r.first.id, r.copies, r.kept) for r in out.collect())


@pytest.fixture(scope="module")
def edited():
    """Texts of all degrees of likeness, one large group of near copies and one of exact ones."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(2000)]
    texts = []
    for _ in range(15):
        first = [rng.choice(words) for _ in range(rng.choice([5, 12, 40, 80]))]
        for _ in range(8):
            text = list(first)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(" ".join(text))
    hot = [rng.choice(words) for _ in range(60)]
    for k in range(150):
        text = list(hot)
        text[rng.randrange(60)] = f"v{k}"
        texts.append(" ".join(text))
    texts += ["equal text of six words here"] * 60 + ["Equal TEXT of six  words here", "one", "ONE", "two", "", None, " \n"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_classes(spark, edited):
    want = brute(edited)
    assert len({r[1] for r in want}) > 40 and max(r[2] for r in want) > 100
    assert got(spark, edited) == want


def test_bands_in_shares(spark, edited, monkeypatch):
    monkeypatch.setattr(cc, "SHARE", 10)
    assert got(spark, edited) == brute(edited)


def test_members_apart_from_the_first_of_their_band(spark):
    """Chains of near copies whose ends are not alike share bands without being alike to the first."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    rows, text = [], list(words)
    for k in range(12):
        rows.append((k, " ".join(text)))
        text[rng.randrange(60)] = f"x{k}"
    assert got(spark, rows) == brute(rows)


def test_recall_of_bands(spark):
    """Which pairs of 0.8 and more meet in a band, before anything is verified."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = sorted({r.chunk for r in chunks(docs, "doc_id", "text").collect()})
    factors, terms = cc._functions(cc.BANDS * cc.ROWS)
    at = {}
    for t in texts:
        own = cc.shingles_of(t.lower().encode())
        for band in cc.bands_of(own, factors, terms) if len(own) else []:
            at.setdefault(band, set()).add(t)
    met = {frozenset((a, b)) for group in at.values() if len(group) > 1 for a in group for b in group if a < b}
    holders = {}
    for t in texts:
        for s in shingles(t):
            holders.setdefault(s, []).append(t)
    sets = {t: shingles(t) for t in texts}
    shared = {(a, b) for group in holders.values() for a in group for b in group if a < b}
    wanted = {frozenset((a, b)) for a, b in shared if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    assert len(wanted) > 20 and len(wanted & met) >= 0.99 * len(wanted)


def test_odd_tables(spark):
    assert got(spark, []) == []
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "a b")]
    out = {tuple(r) for r in got_raw(spark, rows)}
    assert {(r[0], r[2]) for r in out} == {(1, 3), (None, 3), (2, 2), (3, 2)}


def got_raw(spark, rows):
    return cc.chunk_copies(spark.createDataFrame(rows, "id long, body string"), ["id"], "body").collect()


def test_connected(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)]
    parent = {n: n for pair in links for n in pair}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    table = spark.createDataFrame(links, "a long, b long").repartition(3)
    assert {r.node: r.label for r in cc.connected(table).collect()} == {n: top(n) for n in parent}
    assert cc.connected(table.limit(0)).collect() == []


def test_members_of_bands_that_several_texts_have(spark, monkeypatch):
    """Against counting every band's texts: many buckets, a band of most texts, bands met in one batch or in two."""
    rng = random.Random(11)
    monkeypatch.setattr(cc, "BUCKETS", 40)
    monkeypatch.setattr(cc, "BANDS", 8)
    hot, rare = -5, [rng.getrandbits(64) - (1 << 63) for _ in range(900)]
    rows = []
    for k in range(700):
        bands = [*rng.sample(rare, 7), hot if k % 5 else rng.getrandbits(64) - (1 << 63)]
        body = b"" if k % 50 == 0 else b"".join(band.to_bytes(8, "little", signed=True) for band in bands)
        rows.append((k.to_bytes(15, "big") + b"\0", k, body, bands if body else []))
    # Some texts come again in other batches.
    again = [r[:3] for r in rows] + [r[:3] for r in rows[::3]]
    table = spark.createDataFrame(again, "key binary, size int, bands binary").coalesce(1).repartition(5)
    of = {}
    for key, size, _, bands in rows:
        for band in bands:
            of.setdefault(band, []).append((band, key, size))
    want = sorted(m for members in of.values() if len(members) > 1 for m in members)
    assert len(of) > len({m[0] for m in want}) > 300

    def once(batches):
        for batch in batches:
            first = {key: at for at, key in reversed(list(enumerate(batch.column(0).to_pylist())))}
            yield batch.take(sorted(first.values()))

    for batch in ("10000", "64"):
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        found = sorted((r.band, bytes(r.key), r.size) for r in cc._members(table, once).collect())
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert found == want


def test_a_band_goes_to_its_bucket_once_a_batch():
    import numpy as np
    import pyarrow as pa

    bands = np.arange(3000 * 4, dtype=np.uint64).reshape(3000, 4) << np.uint64(40)
    bands[:, 0] = 7
    keys = [k.to_bytes(16, "big") for k in range(3000)]
    columns = [pa.array(keys), pa.array([9] * 3000, pa.int32()), pa.array([b.tobytes() for b in bands])]
    (out,) = cc._dealt(6, iter([pa.record_batch(columns, ["key", "size", "bands"])]))
    entries = np.frombuffer(b"".join(out["entries"].to_pylist()), cc._ENTRY)
    assert (entries["band"] == 7).sum() == 1 and entries["sure"][entries["band"] == 7].all()
    assert len(entries) == 3000 * 3 + 1 and not entries["sure"][entries["band"] != 7].any()
    met = np.frombuffer(b"".join(out["met"].to_pylist()), cc._ENTRY)
    assert len(met) == 2999 and (met["band"] == 7).all()


def test_shingles_are_sets_of_runs():
    """Equal exactly where the runs of words are, in texts shorter and longer than a run, in any batch."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(n % 13)) for n in range(200)] + ["a\t\x0bb  a\x0cb a", "a b a b a"]
    values, sizes = cc._shingles([t.encode() for t in texts], 5)
    assert sizes.tolist() == [len(shingles(t)) for t in texts]
    ends, by_run = sizes.cumsum().tolist(), {}
    for t, end, n in zip(texts, ends, sizes.tolist()):
        own = values[end - n : end].tolist()
        assert own == sorted(set(own)) == cc.shingles_of(t.encode()).tolist()
        by_run.setdefault(frozenset(own), set()).add(frozenset(shingles(t)))
    assert all(len(sets) == 1 for sets in by_run.values())
    assert len(by_run) == len({frozenset(shingles(t)) for t in texts})


def test_rounds_do_not_add_to_the_plan(spark):
    """What Spark infers about the labels is no more after many rounds than after few."""

    def inferred(length):
        chain = spark.createDataFrame([(k, k + 1) for k in range(length)], "a long, b long").repartition(2)
        return cc.connected(chain)._jdf.queryExecution().optimizedPlan().constraints().size()

    assert inferred(100) == inferred(3) < 10
