import zlib

import numpy as np

from rankloom.llm import language as lg

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = lg.identify(docs, lg.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture_finds_both(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = lg.train(docs)
    texts = {r.lang: r.text for r in docs.where("n_chars between 2000 and 4000").orderBy("doc_id").collect()}
    both = (texts["de"][:1800] + " " + texts["en"][:600]).encode()
    data = np.frombuffer(both, np.uint8)
    mix = dict(zip(model.languages, model.mixtures(data, np.array([0, len(data)]))[0]))
    assert mix["de"] > mix["en"] > 0.1 and abs(sum(mix.values()) - 1) < 1e-9
    one = np.frombuffer(texts["fr"].encode(), np.uint8)
    alone = dict(zip(model.languages, model.mixtures(one, np.array([0, len(one)]))[0]))
    assert alone["fr"] > 0.9


def test_odd_rows(odd, spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = lg.train(docs)
    rows = lg.identify(odd, model).collect()
    assert len(rows) == odd.count()
    texts = {(r.doc_id, r.text) for r in odd.collect()}
    blank = {i for i, t in texts if not any(map(str.isalpha, t or ""))} - {None}
    for r in rows:
        if r.doc_id in blank:
            assert (r.lang_pred, r.score, r.languages) == ("und", 0.0, "")
        elif r.doc_id is not None:
            assert r.lang_pred in model.languages and 0 < r.score <= 1
        else:
            assert not r.held_out
    kept = lg.determined(odd, model)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in texts if any(map(str.isalpha, t or ""))}


def test_marks_beyond_ascii_are_no_letters(documents, spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = lg.identify(documents([(1, "💥 — … 123"), (2, "漢字")]), lg.train(docs)).collect()
    assert {r.doc_id: r.lang_pred == "und" for r in rows} == {1: True, 2: False}


def test_nothing_to_learn_from(odd):
    nothing = lg.train(odd.limit(0))
    assert {r.lang_pred for r in lg.identify(odd, nothing).collect()} == {"und"}
    assert lg.determined(odd, nothing).collect() == []
    assert lg.identify(odd.limit(0), nothing).collect() == []


def test_held_out_rows_teach_nothing(documents):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = documents([(i, "wort und wort") for i in held], lang=["de"] * len(held))
    assert lg.train(docs).languages == []
