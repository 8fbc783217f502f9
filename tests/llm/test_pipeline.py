"""The pipeline's rows against the stages by brute force, and the queries against their SQL."""

import hashlib
import re
import sys
from pathlib import Path

import duckdb
import pytest
from test_bpe import PATH, ids_of
from test_decontaminate import brute as leaks
from test_exact_dedup import brute as classes
from test_near_copies import brute as near
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import check_queries  # noqa: E402
import corpus_pipeline  # noqa: E402
from rankloom.llm import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_whole_pipeline(spark):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    items = con.execute(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    docs = [(i, t) for i, t in docs if any(map(str.isalpha, t or ""))]
    text = dict(docs)
    docs = [(r[0], text[r[0]]) for r in classes(docs) if r[3]]
    docs = sorted(near(docs))  # five-word similarity of 0.8, pair by pair
    with_shared = [(i, t) for i, t in docs if _shares(t, items)]
    gone = {r[0] for r in leaks(with_shared, items)}
    library = Tokenizer.from_file(PATH)
    want = {}
    for i, t in docs:
        if i not in gone:
            ids = ids_of(library, t)
            want[i] = (ids, hashlib.sha256(t.encode()).hexdigest())
    assert gone and len(want) < len(text)
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id: (r.ids, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def _shares(text, items):
    words = re.findall(r"[^\W_]+", text.lower())
    grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    own = ((w := re.findall(r"[^\W_]+", i.lower())) and (tuple(w[k : k + 5]) for k in range(len(w) - 4)) for _, i in items)
    return any(g in grams for some in own for g in some)


def test_stages_keep_the_columns(spark, odd):
    docs = odd.repartition(2)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == odd.columns
    ids = [r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()]
    assert sorted(map(str, ids)) == ["11", "13", "6", "9", "None"]


def test_stages_on_nothing(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), FOLDER).collect() == []


def test_operators_used():
    assert [n for n in entry.queries() if re.match(r"op\d+_", n)] == list(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert "pipeline" in entry.queries() and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    good, message = check_queries.compare(spark, check_queries.connect(FOLDER), name, FOLDER)
    assert good, message
