import re
from collections import Counter, defaultdict

import pytest

from rankloom.llm import mixing


def by_cycle(sources):
    return mixing.repeating_weights(sources, [1, 2, 3])


def filled(sizes, weights, epochs=3):
    """Targets by sharing out and clamping one source after another."""
    left, given = dict(weights), {}
    budget = float(sum(sizes.values()))
    while left:
        total = sum(left.values())
        rest = budget - sum(given.values())
        over = [s for s in left if rest * left[s] / total >= epochs * sizes[s]]
        if not over:
            return given | {s: rest * w / total for s, w in left.items()}
        for s in over:
            given[s] = epochs * sizes[s]
            del left[s]
    return given


def as_docs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.selectExpr("*", "'x' AS size", "'y' AS draw", "'z' AS `weight`", "1 AS `row`", "2 AS target").repartition(3)


@pytest.fixture(scope="module")
def rows():
    names = ["b", "a", None, "ä", "Z", "", "hot", "tiny"]
    rows = [(k, "w " * (1 + k * k % 97), names[k % 7] if k % 3 else "hot") for k in range(600)]
    return rows + [(700, "one", "tiny"), (701, None, "void"), (702, " \t\n", "void"), (703, " x y", "b")]


def test_mix_comes_near_its_targets(spark, rows):
    got = mixing.mixture(as_docs(spark, rows), by_cycle).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    of = {i: s for i, _, s in rows}
    sizes = Counter()
    for i, s in of.items():
        sizes[s] += size[i]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled(sizes, {s: 1 + k % 3 for k, s in enumerate(order)})
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[of[r.doc_id]])
        assert r.target == pytest.approx(want[of[r.doc_id]], rel=1e-12, abs=1e-9)
        assert r.taken == r.size * r.times and 0 <= r.times <= 3
        taken[of[r.doc_id]] += r.taken
        largest[of[r.doc_id]] = max(largest[of[r.doc_id]], r.size)
    assert sorted(r.doc_id for r in got) == sorted(of)
    assert want["tiny"] == 3 == taken["tiny"] and want["void"] == 0 == taken["void"]
    for s, target in want.items():
        assert abs(taken[s] - target) <= largest[s] / 2
        if sizes[s] > 1000:
            assert abs(taken[s] - target) <= 0.005 * target
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_reruns_and_layouts_agree(spark, rows):
    docs = as_docs(spark, rows)
    first = sorted(map(tuple, mixing.mixture(docs, by_cycle).select("doc_id", "taken").collect()))
    again = mixing.mixture(docs.repartition(7, "text"), by_cycle).select("doc_id", "taken")
    assert sorted(map(tuple, again.collect())) == first
    other = mixing.mixture(docs, by_cycle, seed=4).select("doc_id", "taken")
    assert sorted(map(tuple, other.collect())) != first


def test_mixed_rows(spark, rows):
    docs = as_docs(spark, rows)
    times = {r.doc_id: r.times for r in mixing.mixture(docs, by_cycle).collect()}
    out = mixing.mixed(docs, by_cycle)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: n for i, n in times.items() if n})


def test_own_weights_and_budget(spark):
    docs = as_docs(spark, [(k, "w w", "abcd"[k % 4]) for k in range(400)])

    def weights(sources):
        return sources.selectExpr("*", "CASE source WHEN 'a' THEN 0.5 WHEN 'b' THEN 8 WHEN 'c' THEN 0 END AS weight")

    got = mixing.mixture(docs, weights, epochs=2, budget=500)
    target = {r.source: r.target for r in got.collect()}
    assert target == pytest.approx({"a": 100, "b": 400, "c": 0, "d": 0})
    beyond = mixing.mixture(docs, weights, epochs=2, budget=10**6).collect()
    assert {(r.source, r.target, r.times) for r in beyond} == {
        ("a", 400, 2), ("b", 400, 2), ("c", 0, 0), ("d", 0, 0)
    }


def test_rows_that_repeat_and_nothing(spark, odd):
    got = mixing.mixture(odd, by_cycle).collect()
    assert len(got) == odd.count()
    assert len({r.times for r in got if r.doc_id == 4}) == 1
    assert all(r.taken <= 3 * r.size for r in got)
    assert mixing.mixture(odd.limit(0), by_cycle).collect() == []
    assert mixing.mixed(odd.limit(0), by_cycle).collect() == []
    blank = as_docs(spark, [(1, None, None), (2, "", "a")])
    assert {(r.target, r.taken) for r in mixing.mixture(blank, by_cycle).collect()} == {(0.0, 0)}


def test_cells_of_several_documents(spark, rows, monkeypatch):
    """One digit a cell: the last round sorts cells of several documents."""
    monkeypatch.setattr(mixing, "DIGITS", 1)
    docs = as_docs(spark, rows)
    coarse = sorted(map(tuple, mixing.mixture(docs, by_cycle).select("doc_id", "taken").collect()))
    monkeypatch.undo()
    assert coarse == sorted(map(tuple, mixing.mixture(docs, by_cycle).select("doc_id", "taken").collect()))


def test_places_over_several_ranges(spark):
    names = [(f"s{k:03}",) for k in range(200)] + [(None,)]
    sources = spark.createDataFrame(names, "source string").repartition(5)
    got = {r.source: r.weight for r in by_cycle(sources).collect()}
    assert got == {n: 1 + k % 3 for k, (n,) in enumerate(names)}
