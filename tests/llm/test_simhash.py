import random
import re

import numpy as np
import pytest
import xxhash

from rankloom.llm import components as cc
from rankloom.llm import simhash as sh


def print_of(text, words_each=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i : i + words_each]) for i in range(len(words) - words_each + 1)]
    grams = grams or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, radius=3):
    prints = [(i, print_of(t)) for i, t in rows]
    ids = sorted({i for i, _ in prints if i is not None})
    known = [(i, p) for i, p in prints if i is not None]
    links = [(a, b) for a, p in known for b, q in known if (p ^ q).bit_count() <= radius]
    component = component_of(links, ids)
    of_print = {p: component[i] for i, p in known}
    return sorted(((i, f"{p:016x}", of_print.get(p)) for i, p in prints), key=repr)


def got(docs, **options):
    return sorted((tuple(r) for r in sh.near_duplicates(docs, **options).collect()), key=repr)


def test_odd_rows(odd):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_near_texts(documents):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(12)]
    rows = []
    for i in range(150):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(text).title()))
    want = brute(rows)
    assert 20 < len({c for *_, c in want}) < 140
    assert got(documents(rows)) == want


def test_empty(odd):
    assert sh.near_duplicates(odd.limit(0)).collect() == []
    assert sh.one_of_each(odd.limit(0)).collect() == []


def test_one_of_each(odd):
    kept = sh.one_of_each(odd)
    assert kept.columns == odd.columns
    stays = {i for i, _, c in brute([(r.doc_id, r.text) for r in odd.collect()]) if i == c}
    assert {r.doc_id for r in kept.collect()} == stays


def test_gray_rank():
    codes = np.arange(64, dtype=np.uint64)
    sequence = codes ^ (codes >> np.uint64(1))
    assert sh.gray_rank(sequence).tolist() == list(range(64))


@pytest.mark.parametrize("share", [40, 100_000])
def test_cells(spark, monkeypatch, share):
    """Clusters of many prints: cells of several leaves and levels, dealt out or not."""
    monkeypatch.setattr(sh, "SHARE", share)
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    codes = {rng.getrandbits(64) for _ in range(50)}
    for k in range(900):
        code = centres[k % 4]
        for _ in range(rng.choice([1, 2, 3, 5])):
            code ^= 1 << rng.randrange(64)
        codes.add(code)
    codes = sorted(codes)
    rows = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)]
    prints = spark.createDataFrame(rows, "id long, print long").repartition(3)
    for radius in (3, 2):
        links = sh.near_links(prints, radius).collect()
        assert all((codes[a] ^ codes[b]).bit_count() <= 64 for a, b in links)
        near = [
            (a, b)
            for a in range(len(codes))
            for b in range(a)
            if (codes[a] ^ codes[b]).bit_count() <= radius
        ]
        nodes = range(len(codes))
        assert component_of([tuple(x) for x in links], nodes) == component_of(near, nodes)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 160)]
    odd = [(7, 7), (3, 2), (2, 3), (None, 5), (5, None), (300, 200)]
    links = chain + star + odd
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.component for r in cc.components(df).collect()}
    whole = [(a, b) for a, b in links if None not in (a, b)]
    want = component_of(whole, {n for pair in whole for n in pair})
    assert found == {n: c for n, c in want.items() if n != c}
    assert cc.components(df.limit(0)).collect() == []
