import math
import random

import public_tokenizers
import pytest

from rankloom.llm import token_counts as tc
from rankloom.llm.bpe import PreTokens

PIECES = tc.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def scores():
    return tc.rank_scores(PIECES)


def best(text, scores):
    """Score and pieces of the best segmentation of one pre-token, without any sharing."""
    raw = text.encode()
    table = [(0.0, 0)] + [(-math.inf, 0)] * len(raw)
    for end in range(1, len(raw) + 1):
        for start in range(end):
            score = scores.get(raw[start:end])
            if score is not None:
                now = (table[start][0] + score, table[start][1] - 1)
                table[end] = max(table[end], now)
    return table[-1][0], -table[-1][1]


def brute(text, scores):
    pre_tokens = PreTokens()(text or "")
    found = [best(p, scores) for p in pre_tokens]
    return len(pre_tokens), sum(n for _, n in found), math.fsum(s for s, _ in found)


def test_random_texts(scores):
    rng = random.Random(1)
    texts = ["".join(rng.choice(" aeinrst.é漢1\n") for _ in range(rng.choice([0, 3, 40, 200]))) for _ in range(200)]
    counter = tc.Counter(scores)
    for text in texts:
        cut = counter.cut(text)
        counter.learn(set(cut))
        n, pieces, score = counter.count(cut)
        want = brute(text, scores)
        assert (n, pieces) == want[:2] and math.isclose(score, want[2], abs_tol=1e-9)


def test_shares_are_probabilities(scores):
    assert math.isclose(math.fsum(map(math.exp, scores.values())), 1.0)


def test_memory_limit_changes_nothing(scores, monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED_BYTES", 1000)
    counter = tc.Counter(scores)
    for text in ("the quick brown fox jumps over the lazy dog again", "the lazy dog"):
        cut = counter.cut(text)
        counter.learn(set(cut))
        assert counter.count(cut)[:2] == brute(text, scores)[:2]


def test_odd_rows(odd, scores):
    short = odd.where("length(text) < 1000 or text is null")
    rows = {(r.doc_id, r.n_pre_tokens, r.n_tokens, round(r.score, 6)) for r in tc.token_counts(odd, scores).collect()}
    assert len(tc.token_counts(odd, scores).collect()) == odd.count()
    for r in short.collect():
        n, pieces, score = brute(r.text, scores)
        assert (r.doc_id, n, pieces, round(score, 6)) in rows
    assert tc.token_counts(odd.limit(0), scores).collect() == []
    with pytest.raises(ValueError):
        tc.token_counts(odd, {b"a": -1.0})
