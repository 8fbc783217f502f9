import hashlib

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.functions import vectors as vx
from rankloom.params import Params, check_bound, effective_top_k


@pytest.mark.parametrize("raw", ["\t a b \n", " x　", "\x1cq\x1f", "plain", "", " \n "])
def test_strip_equals_python(one, raw):
    assert one(tx.strip(F.col("t")), t=raw) == raw.strip()


@pytest.mark.parametrize("n", [499, 500, 501])
def test_ellipsize_edges(one, n):
    text = "a" * n
    want = text if n <= 500 else "a" * 500 + "..."
    assert one(tx.ellipsize(F.col("t"), 500), t=text) == want


def test_cut_counts_code_points(one):
    assert one(tx.ellipsize(F.col("t"), 2), t="a😀b") == "a😀..."
    assert one(tx.truncate(F.col("t"), 8000), t="a" * 10000) == "a" * 8000
    assert one(tx.preview(F.col("t"), 60), t="kısa") == "kısa..."


def test_disclaimer_once(one):
    assert one(tx.with_disclaimer(F.col("t")), t="x") == "x\n\n" + tx.DISCLAIMER
    held = "x " + tx.DISCLAIMER + " y"
    assert one(tx.with_disclaimer(F.col("t")), t=held) == held


@pytest.mark.parametrize(
    "raw,reason",
    [
        ("ab", "too_short"), ("abc", None), ("a" * 500, None), ("a" * 501, "too_long"),
        ("  a  ", "too_short_stripped"), ("     ", "empty"), ("", "too_short"),
        (" " * 498 + "abc", "too_long"),
    ],
)
def test_question_problem(one, raw, reason):
    assert one(tx.question_problem(F.col("q")), q=raw) == reason


def test_cache_key(one):
    want = hashlib.sha256("q=ağrı nedir|topk=3|model=m".encode()).hexdigest()
    assert one(tx.cache_key(F.col("q"), 3, "m"), q="  ağrı nedir\n") == want


@pytest.mark.parametrize(
    "at,start,end,quiet",
    [
        ("03:00", "00:00", "08:00", True), ("08:00", "00:00", "08:00", False),
        ("23:30", "22:00", "06:00", True), ("06:00", "22:00", "06:00", False),
        ("05:59", "22:00", "06:00", True), ("12:00", "08:00", "08:00", True),
        ("12:00", "", "08:00", False),
    ],
)
def test_quiet_hours(one, at, start, end, quiet):
    ts = F.concat(F.lit("2024-01-01 "), F.col("at"), F.lit(":00")).cast("timestamp")
    assert one(tx.in_quiet_hours(ts, start, end), at=at) is quiet


def test_prompt_fills_slots_in_any_order(one):
    out = tx.prompt("{b}-{a}-{b}!", a=F.col("a"), b=F.col("b"))
    assert one(out, a="1{b}", b="2") == "2-1{b}-2!"


def test_backoff_and_json(one):
    assert one(tx.backoff_seconds(F.col("n")), n=2) == pytest.approx(0.8)
    assert one(tx.json_message(F.col("t")), t='a"b\\') == '{"text":"a\\"b\\\\"}'


def test_stamps(one):
    ts = F.col("t").cast("timestamp")
    assert one(tx.stamp(ts), t="2024-01-02 03:04:05") == "2024-01-02 03:04:05"
    assert one(tx.file_stamp(ts), t="2024-01-02 03:04:05") == "20240102_030405"


@pytest.mark.parametrize(
    "provider,model,dim",
    [
        ("openai", "text-embedding-3-small", 1536), ("openai", "text-embedding-3-LARGE", 3072),
        ("unknown", "text-embedding-3-large", 1536),
    ],
)
def test_dimension(one, provider, model, dim):
    assert vx.get_embedding_dimension(provider, model) == dim
    assert one(vx.expected_dimension(F.col("p"), F.col("m")), p=provider, m=model) == dim


@pytest.mark.parametrize(
    "name,metric",
    [("Cosine ", "cosine"), ("dotproduct", "dot"), ("dot_product", "dot"), ("euclidean", "euclid"), ("?", "cosine")],
)
def test_metric_names(name, metric):
    assert vx.metric_name(name) == metric


def test_vector_scores(one):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(vx.dot(a, b)) == 24.0
    assert one(vx.cosine(a, b)) == pytest.approx(0.96)
    assert one(vx.cosine(a, zero)) is None
    assert one(vx.euclid(a, b)) == pytest.approx(2**0.5)


def test_params_bounds():
    assert Params().top_k == 5 and Params().cache_ttl_seconds == 300
    for bad in ({"top_k": 0}, {"top_k": 101}, {"cache_ttl_seconds": 9}, {"temperature": 2.1},
                {"max_context_chunks": 21}, {"rate_limit": 0}, {"embed_batch_size": 2049}):
        with pytest.raises(ValueError, match="must be between"):
            Params(**bad)
    check_bound("max_body_bytes", 1024)
    assert effective_top_k(None, Params()) == 5
    assert effective_top_k(0, Params(top_k=7)) == 7
    with pytest.raises(ValueError):
        effective_top_k(101, Params())
