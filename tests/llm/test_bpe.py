"""The codec against the tokenizers library, which it has to equal in every id."""

import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rankloom.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_vocabulary(PATH))


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_random_texts(library, codec):
    rng = random.Random(1)
    alphabet = " aabcdeht1'\néßñ漢😀\t\x00$%#AB  ́"
    for k in range(1500):
        n = rng.choice([0, 1, 2, 5, 20, 60, 300])
        text = "".join(rng.choice(alphabet) for _ in range(n)) + "<|endoftext|>" * (k % 5 == 0)
        ids = codec.encode(text)
        assert ids.tolist() == ids_of(library, text), text
        assert codec.decode(ids) == text
        assert codec.numbers(ids) == ",".join(map(str, ids.tolist())).encode()


@pytest.mark.parametrize("letters", ["a", "ab", " ", "=-", "aeiou", "\n", "é"])
def test_long_pre_tokens(library, codec, letters):
    text = letters * 3000
    assert codec.encode(text).tolist() == ids_of(library, text)


def test_pre_tokens_of_every_code_point(library):
    cut, cutter = bpe.PreTokens(), library.pre_tokenizer
    for code in [*range(0x3000), *range(0xA000, 0xD800), *range(0xE000, 0x12700), *range(0x1D000, 0x1FB00)]:
        text = "a{0}1{0}!{0} {0}  {0}".format(chr(code))
        assert cut(text) == [text[slice(*span)] for _, span in cutter.pre_tokenize_str(text)], hex(code)


def test_memory_limit_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 2000)
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 7)
    codec = bpe.Codec(bpe.read_vocabulary(PATH))
    for text in ("the quick brown fox jumps over the lazy dog", "again the lazy dog naps, naps, naps", "fox"):
        assert codec.encode(text).tolist() == ids_of(library, text)


def test_long_pre_tokens_are_not_remembered(codec):
    """10,000 pre-tokens of 2,000 letters, and 300,000 short ones, stay within the bytes allowed."""
    rng = random.Random(12)
    for _ in range(20):
        codec.encode(" ".join("".join(rng.choices("abcdefgh", k=2000)) for _ in range(20)))
    assert not codec._known or max(map(len, codec._known)) <= bpe.LONGEST_REMEMBERED
    for k in range(6):
        codec.encode(" ".join(f"w{n}x" for n in range(50_000 * k, 50_000 * (k + 1))))
        held = sum(map(sys.getsizeof, [*codec._known, *codec._known.values()])) + sys.getsizeof(codec._known)
        assert codec._known_bytes <= bpe.REMEMBERED_BYTES and held <= bpe.REMEMBERED_BYTES
    codec.forget()
    assert not codec._known


def test_frequent_pre_tokens_outlive_rare_ones(monkeypatch):
    """Words of every text are worked out once, however many others fill the memory between them."""
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 40_000)
    worked_out, pieces = [], bpe.Codec._pieces
    monkeypatch.setattr(bpe.Codec, "_pieces", lambda codec, p: worked_out.append(p) or pieces(codec, p))
    codec = bpe.Codec(bpe.read_vocabulary(PATH))
    frequent = [" often" + letter for letter in "abcdefghij"]
    rare = [f" once{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    for k in range(0, len(rare), 20):
        codec.encode("".join(frequent + rare[k : k + 20]))
    assert sorted(worked_out) == sorted(frequent + rare)


def test_patterns_cut_alike(library):
    """Texts without code points above U+FFFF have a pattern of their own, with the same cuts."""
    cut, cutter = bpe.PreTokens(), library.pre_tokenizer
    rng = random.Random(5)
    alphabet = "ab Z19 '\t\n\x1c\x85\xa0\u2028\u3000éß²½Ⅷ٣漢́_-!\u088f\ua7d2" + "s"
    for _ in range(3000):
        text = "é" + "".join(rng.choices(alphabet, k=rng.randrange(12)))
        want = [text[slice(*span)] for _, span in cutter.pre_tokenize_str(text)]
        assert cut(text) == cut(text + "a😀")[: len(want) - 1] + want[-1:] == want, text


def test_decode_of_broken_bytes(library, codec):
    ids = [i for i, t in bpe.read_vocabulary(PATH).tokens.items() if t in (b"\xc3", b"\xff", b"a")]
    assert codec.decode(np.array(ids * 2)) == library.decode(ids * 2, skip_special_tokens=False)
    assert codec.decode(np.array([], np.int64)) == ""


def test_table(library, odd, monkeypatch, spark):
    got = {(r.doc_id, r.ids_sha256): r for r in _op1(spark, odd, monkeypatch)}
    for row in odd.collect():
        text = row.text or ""
        ids = ids_of(library, text)
        want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        found = got[row.doc_id, want]
        assert found.n_tokens == len(ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert found.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert queries.QUERIES["op1_bpe"](spark, "/root/testdata/sf0.001").count() == 200


def _op1(spark, docs, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    rows = queries.op1_bpe(spark, "").collect()
    monkeypatch.undo()
    assert len(rows) == docs.count()
    return rows


def test_encode_then_decode(odd):
    encoded = bpe.encode(odd, PATH)
    texts = {(r.doc_id, r.text) for r in bpe.decode(encoded, PATH).collect()}
    assert texts == {(r.doc_id, r.text or "") for r in odd.collect()}
    assert bpe.encode(odd.limit(0), PATH).collect() == []


def test_two_vocabularies_in_one_session(odd, tmp_path):
    """A worker keeps a codec for its vocabulary, not for whichever came first."""
    import json

    with open(PATH, encoding="utf-8") as file:
        content = json.load(file)
    content["model"]["merges"] = []
    content["model"]["vocab"] = {t: i for t, i in content["model"]["vocab"].items() if len(t) == 1}
    small = tmp_path / "bytes.json"
    small.write_text(json.dumps(content))
    some = odd.where("length(text) < 100 and doc_id <> 13")
    for path in (PATH, str(small), PATH):
        bytes_only = path != PATH
        for r in bpe.encode(some, path).join(some, "doc_id").collect():
            assert (len(r.ids) == len(r.text.encode())) == bytes_only or len(r.text) < 4
