import hashlib
import re
from collections import defaultdict

from rankloom.llm import exact_dedup as ed

NAMES = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows):
    classes = defaultdict(list)
    for i, text in rows:
        classes[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i))
    out = []
    for i, text in rows:
        normal = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        keep = min(classes[normal], key=lambda m: (m[0], m[1], m[2] or 0))[2]
        out.append((i, keep, len(classes[normal]), i == keep, hashlib.sha256(normal.encode()).hexdigest()))
    return out


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def check(docs):
    got = [tuple(r) for r in ed.exact_duplicates(docs).select(NAMES).collect()]
    key = repr
    assert sorted(got, key=key) == sorted(brute(rows_of(docs)), key=key)


def test_odd_rows(odd):
    check(odd)


def test_ties_and_large_class(documents):
    rows = [(i, "x y" if i % 2 else "xy") for i in range(50)] + [(100 + i, f"t{i % 7}") for i in range(30)]
    check(documents(rows))


def test_empty(odd):
    assert ed.exact_duplicates(odd.limit(0)).collect() == []
    assert ed.without_copies(odd.limit(0)).collect() == []


def test_rows_that_stay(odd):
    kept = ed.without_copies(odd)
    assert kept.columns == odd.columns
    want = {(r[0], r[4]) for r in brute(rows_of(odd)) if r[3]}
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
    got = [(r.doc_id, sha(r.text)) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_columns_named(odd):
    assert ed.exact_duplicates(odd).columns == NAMES
