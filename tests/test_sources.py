from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rankloom.sources import collections as col
from rankloom.sources import history as hist
from rankloom.sources import reqlog


def test_collections(spark, tmp_path):
    root = str(tmp_path / "store")
    assert col.list_collections(spark, root) == []
    col.reset_collections(spark, root, "internal, external,", metric="dot_product")
    assert col.list_collections(spark, root) == ["external", "internal"]
    assert col.collection_exists(spark, root, "internal") and not col.collection_exists(spark, root, "x")
    about = col.read_collection(spark, root, "internal").schema["embedding"].metadata
    assert about == {"dim": 1536, "metric": "dot"}

    col.reset_collections(spark, root, ["internal"], dimension=2, metric="nonsense")
    data = spark.createDataFrame([("a", [1.0, 2.0], "t"), ("b", None, "u")], "point_id string, embedding array<double>, text string")
    col.append_points(data, root, "internal")
    info = col.get_collection_info(spark, root, "internal").first()
    assert tuple(info) == ("internal", 2, 1)
    stored = col.read_collection(spark, root, "internal")
    assert stored.schema["embedding"].metadata == {"dim": 2, "metric": "cosine"}
    assert stored.select("collection").distinct().first()[0] == "internal"
    with pytest.raises(Exception, match="dimension 2"):
        col.append_points(data.withColumn("embedding", F.array(F.lit(1.0))), root, "internal")
    with pytest.raises(ValueError, match="not found"):
        col.get_collection_info(spark, root, "x")
    assert col.read_points(spark, root).count() == 2
    col.reset_collections(spark, root, ["internal"], dimension=2)
    assert col.read_collection(spark, root, "internal").count() == 0


def test_audit_and_hint(spark, one):
    points = spark.createDataFrame(
        [("a", "internal", [1.0, 2.0]), ("b", "internal", [1.0])], "point_id string, collection string, embedding array<float>"
    )
    out = {r.collection: r.ok for r in col.dimension_audit(points, 2).collect()}
    assert out == {"internal": False, "external": False}
    for n, want in ((0, 64), (1024, 64), (20000, 282), (10**6, 512), (None, 64)):
        assert one(col.tuning_hint(F.lit(n).cast("long"))) == want


def test_snapshots(spark, tmp_path):
    taken = [datetime(2024, 1, d, 3) for d in (1, 16, 17, 30)]
    data = spark.createDataFrame([(t,) for t in taken], "t timestamp_ntz")
    now = F.lit("2024-01-31 03:00:00").cast("timestamp_ntz")
    out = col.retention(data, F.col("t"), now, 14).orderBy("t").collect()
    assert [(r.age_days, r.keep) for r in out] == [(30, False), (15, False), (14, True), (1, True)]
    col.write_snapshot(data, str(tmp_path / "s"), "20240131-0300")
    assert spark.read.parquet(str(tmp_path / "s")).first()["snapshot_ts"] == "20240131-0300"


def test_history_round_trip(spark, tmp_path):
    path = str(tmp_path / "h")
    rows = spark.createDataFrame([(datetime(2024, 1, 2, 3, 4, 5), 7, "a|b?"), (datetime(2024, 1, 2), None, "c")], "ts timestamp, tokens long, question string")
    hist.append_history(rows, path)
    hist.append_history(rows.limit(1), path)
    out = sorted(map(tuple, hist.read_history(spark, path).collect()))
    assert out == [("2024-01-02 00:00:00", 0, "c")] + [("2024-01-02 03:04:05", 7, "a|b?")] * 2


def test_history_lines(spark):
    lines = spark.createDataFrame([("t|x1|q",), ("t|5",), ("t|٣|q",), ("t|12|q|r ",), ("t||",)], "value string")
    assert [tuple(r) for r in hist.parse_history(lines, "value").collect()] == [
        ("t", 0, "q"), ("t", 0, "q"), ("t", 12, "q|r"), ("t", 0, ""),
    ]


@pytest.mark.parametrize(
    "headers,host,want",
    [
        ({"cf-connecting-ip": " 1.1.1.1 ", "x-forwarded-for": "2.2.2.2"}, "h", "1.1.1.1"),
        ({"cf-connecting-ip": "", "x-forwarded-for": " 2.2.2.2 , 3.3.3.3"}, "h", "2.2.2.2"),
        ({"x": ""}, "h", "h"),
        ({"x-forwarded-for": ""}, None, "unknown"),
    ],
)
def test_client_key(spark, headers, host, want):
    row = spark.createDataFrame([(headers, host)], "headers map<string,string>, host string")
    assert row.select(reqlog.client_key(F.col("headers"), F.col("host"))).first()[0] == want


@pytest.mark.parametrize(
    "length,large",
    [
        ("1048577", True), ("1048576", False), (None, False), ("abc", False), ("", False),
        (" 2000000 ", True), ("-5", False), ("9" * 50, True), ("2_000_000", True), ("1.5e9", False),
    ],
)
def test_body_limit(one, length, large):
    assert one(reqlog.body_too_large(F.lit(length).cast("string"))) is large


def test_request_ids(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 0), datetime(2024, 1, 1, 0, 0, 1, 500000))] * 3, "a timestamp, b timestamp")
    out = reqlog.with_request_id(rows, "a", "b").collect()
    assert [r.duration_ms for r in out] == [1500.0] * 3 and len({r.request_id for r in out}) == 3


def test_history_with_endless_numbers(spark):
    lines = [("t|" + "9" * 23 + "|q",), ("t|" + "0" * 40 + "7|q",), ("t|12|a|b",), ("t|-1|q",)]
    rows = hist.parse_history(spark.createDataFrame(lines, "value string"), "value").collect()
    assert [(r.tokens, r.question) for r in rows] == [(None, "q"), (7, "q"), (12, "a|b"), (0, "q")]


def test_chunks(spark):
    from rankloom.operators.ingest import chunks

    texts = [None, "", "abc", "0123456789", "0123456789a", "é💥\nx" * 9, "x" * 61]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for size, overlap in ((10, 3), (10, 0), (4, 2)):
        got = sorted(map(tuple, chunks(rows, "k", "t", size, overlap).collect()))
        step = size - overlap
        want = [
            (k, i, t[i * step : i * step + size])
            for k, t in enumerate(texts)
            for i in range(len(t or ""))
            if i == 0 or i * step + overlap < len(t)
        ]
        assert got == sorted(want)
    with pytest.raises(ValueError):
        chunks(rows, "k", "t", 5, 3)
