import numpy as np
import pytest

from rankloom.llm import whitening as wh


def usable(rows):
    """Entries as whole steps, by vec_id, of vectors that hold finite numbers only."""
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    return [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in good]


def brute(rows, most=16):
    """Components by the covariance's eigenvectors, in whole numbers as far as possible."""
    kept = usable(rows)
    fit = np.array(sorted({tuple(x) for _, x in kept}), object)
    n, sums = len(fit), fit.sum(0)
    apart = n * fit - sums
    v = (apart.T @ apart).astype(float) / n**3
    values, vectors = np.linalg.eigh(v)
    out = {}
    for i, x in kept:
        d = n * np.array(x, object) - sums
        for c in range(min(most, len(values))):
            e = values[-1 - c]
            out.setdefault((i, c + 1), []).append(
                (n, int((d**2).sum()), abs(float(d @ vectors[:, -1 - c]) / n / np.sqrt(e)), e / np.trace(v))
            )
    return out


def as_table(spark, rows, kind="float"):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return table.selectExpr("*", "1 AS key", "2 AS component", "3 AS n").repartition(3)


def agree(df, rows, most=16):
    want = brute(rows, most)
    got = {}
    for r in df.collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for key, values in want.items():
        for have, (n, deviation, size, explained) in zip(
            sorted(got[key], key=lambda r: abs(r.whitened)), sorted(values, key=lambda v: v[2])
        ):
            assert (have.n, have.deviation) == (n, deviation)
            assert abs(have.whitened) == pytest.approx(size, rel=1e-7, abs=1e-7)
            assert have.explained == pytest.approx(explained, rel=1e-7)
            assert have.identity_error < 1e-9
    return got


def signs_agree(got, rows):
    """Each component has one sign: the whitened values are uncorrelated with mean zero over distinct vectors."""
    kept = {tuple(x): i for i, x in usable(rows)}
    most = max(c for _, c in got)
    z = np.array([[got[i, c][0].whitened for c in range(1, most + 1)] for i in kept.values()])
    assert np.abs(z.mean(0)).max() < 1e-9
    assert np.abs(z.T @ z / len(z) - np.eye(most)).max() < 1e-9


def test_sample_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    signs_agree(agree(wh.whitened(table)[0], rows), rows)


def test_correlated_vectors(spark):
    rng = np.random.default_rng(11)
    spread = rng.normal(size=(20, 20)) @ np.diag(2.0 ** -np.arange(0, 10, 0.5))
    vectors = (rng.normal(size=(300, 20)) @ spread.T * 1000 + rng.normal(size=20) * 1e4).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [(1000 + k, rows[7][1]) for k in range(200)] + [rows[3]]  # copies, and a row that repeats
    df, model = wh.whitened(as_table(spark, rows))
    signs_agree(agree(df, rows), rows)
    assert model.passes >= 3


def test_rows_that_dont_count(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (103, [float("nan")] * 6),
           (104, [1.0, 2.0, 3.0, 4.0, 5.0, float("-inf")]), (None, rows[0][1])]
    got = agree(wh.whitened(as_table(spark, rows + bad))[0], rows + bad)
    assert (None, 1) in got
    other = [(200, [1.0, 2.0]), (201, [1e300] * 6)]
    got = agree(wh.whitened(as_table(spark, rows + other, "double"))[0], rows)
    assert not {200, 201} & {i for i, _ in got}


def test_directions_that_do_not_vary(spark):
    rng = np.random.default_rng(5)
    free = rng.integers(-50, 50, size=(60, 3)) / 64
    vectors = np.column_stack([free, free[:, 0] + free[:, 1], np.full(60, 7.5), free[:, 2] * 2])
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    df, model = wh.whitened(as_table(spark, rows, "double"))
    assert len(model.variances) == 3
    signs_agree(agree(df, rows, 3), rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_varies(spark, rows):
    df, model = wh.whitened(as_table(spark, rows))
    assert df.collect() == [] and model is None
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_wide_numbers(spark):
    """Entries of all widths; deviations that 64 bits don't hold are null."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(50, 4)) * [1, 1e3, 1e8, 1e12]
    df, _ = wh.whitened(as_table(spark, [(k, v.tolist()) for k, v in enumerate(vectors)], "double"))
    rows = df.collect()
    assert len(rows) == 200 and {r.deviation for r in rows} == {None}
    small = vectors * [1, 1, 1e-6, 1e-11]
    rows = [(k, v.tolist()) for k, v in enumerate(small)]
    agree(wh.whitened(as_table(spark, rows, "double"))[0], rows)


def test_more_than_sixteen_is_cut(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=30).tolist()) for k in range(100)]
    got = agree(wh.whitened(as_table(spark, rows))[0], rows)
    assert {c for _, c in got} == set(range(1, 17))
    got = agree(wh.whitened(as_table(spark, rows), 20)[0], rows, 20)
    assert {c for _, c in got} == set(range(1, 21))


def test_triangular_solve():
    rng = np.random.default_rng(4)
    r = np.triu(rng.normal(size=(9, 9))) + 4 * np.eye(9)
    block = rng.normal(size=(30, 9))
    assert np.allclose(wh.solved(block, r) @ r, block)


def test_packing_keeps_vectors_apart():
    rng = np.random.default_rng(6)
    vectors = [rng.integers(-(2**b), 2**b, size=5) for b in (1, 7, 8, 15, 16, 31, 32, 50) for _ in range(20)]
    for v in vectors:
        assert wh._unpacked(wh._packed(v)).tolist() == v.tolist()
    edge = np.array([-128, 127])
    assert wh._packed(edge)[0] == 1 and wh._packed(edge + 1)[0] == 2
