"""Mixtures against plain expectation-maximisation over every subset of the languages."""

import itertools
import random

import numpy as np
import pytest

from rankloom.llm import language as lg


@pytest.fixture(scope="module")
def model(spark):
    """Four languages of made-up words, each from letters of its own and some shared ones."""
    rng = random.Random(4)
    letters = {"aa": "abcdefst", "bb": "ghijklst", "cc": "mnopqrst", "dd": "abcmnost"}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(3, 8))) for _ in range(150)] for k, v in letters.items()}
    rows = [
        (k, " ".join(rng.choice(words[lang]) for _ in range(60)), lang) for k, lang in enumerate(sorted(letters) * 40)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return lg.train(docs), words


def fitted(words, chosen):
    """Proportions and likelihood of a set of languages after very many rounds."""
    own = np.exp(words[:, chosen] - words.max(axis=1, keepdims=True))
    mix = np.full(len(chosen), 1 / len(chosen))
    for _ in range(500):
        weight = own * mix
        weight /= weight.sum(axis=1, keepdims=True)
        mix = weight.mean(axis=0)
    return mix, float((np.log(own @ mix) + words.max(axis=1)).sum())


def best_subset(model, text):
    """The set with the best likelihood less its penalty, and its proportions."""
    data = np.frombuffer(text.encode(), np.uint8)
    place, starts, _ = lg._words(data, np.array([0, len(data)]))
    words = model._word_likelihoods(place, starts)
    penalty = 0.5 * np.log(len(words) + 1.0) + 1.0
    scores = {}
    for size in range(1, len(model.languages) + 1):
        for chosen in itertools.combinations(range(len(model.languages)), size):
            mix, likelihood = fitted(words, list(chosen))
            scores[chosen] = (likelihood - penalty * (size - 1), mix)
    chosen = max(scores, key=lambda c: scores[c][0])
    return chosen, scores


def test_sets_and_proportions(model):
    model, words = model
    rng = random.Random(9)
    for _ in range(60):
        some = rng.sample(sorted(words), rng.choice([1, 1, 2, 2, 3]))
        parts = [rng.choice(words[lang]) for lang in some for _ in range(rng.randint(12, 60))]
        rng.shuffle(parts)
        text = " ".join(parts)
        (mix,) = model.answers(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        want, scores = best_subset(model, text)
        got = tuple(np.flatnonzero(mix > 0).tolist())
        # Where another set is chosen, it is as good to within the last rounds.
        assert scores[got][0] >= scores[want][0] - 0.5, (got, want)
        assert np.abs(mix[list(got)] - scores[got][1]).max() < 0.05
        assert mix.sum() == pytest.approx(1)


def test_one_language(model):
    model, words = model
    for lang, own in words.items():
        text = " ".join(own[:40]).encode()
        (mix,) = model.answers(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert model.languages[int(mix.argmax())] == lang
