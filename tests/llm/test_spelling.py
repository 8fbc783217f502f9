import random
import re
import zlib
from collections import Counter

import pytest

from rankloom.llm import spelling as sp


def spelled(rows):
    """Counts of words with slips, run by run."""
    counts = Counter()
    for i, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def neighbours(words):
    """All pairs one edit apart, through each word's shortened forms and then pair by pair."""
    shortened = {}
    for w in words:
        for form in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            shortened.setdefault(form, set()).add(w)
    near = {w: set() for w in words}
    for group in shortened.values():
        for a in group:
            near[a] |= {b for b in group if one_apart(a, b)}
    return near


def brute(words):
    near = neighbours(words)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    rows = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, words[w], len(near[w]), form[w], words.get(form[w]), root))
    return rows


def found(df):
    rows = df.select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(set(rows)) == len(rows)
    return set(map(tuple, rows))


def as_words(spark, words):
    return spark.createDataFrame(sorted(words.items()), "word string, n long").repartition(3)


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghijklmnopqrstuvwxyzé÷×"])
def test_variants_of_random_words(spark, letters):
    rng = random.Random(len(letters))
    words = {}
    for _ in range(400):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(5, 11)))
        for _ in range(3):
            k = rng.randrange(len(word))
            edited = rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice(letters) + word[k:],
                                 word[:k] + rng.choice(letters) + word[k + 1 :]])
            for w in (word, edited):
                if len(w) >= 5:
                    words[w] = rng.choice([3, 4, 6, 12, 24, 50, 100])
            word = edited if rng.random() < 0.5 else word
            if len(word) < 5:
                break
    assert any(r[5] not in (r[0], r[3]) for r in brute(words))
    assert found(sp.variants(as_words(spark, words))) == brute(words)


def test_words_of_one_letter(spark):
    """All bigrams are equal and fill the prefix; long words, too."""
    words = {"a" * k: 3 + 5 * k for k in [*range(5, 40), 2000, 2001]}
    assert found(sp.variants(as_words(spark, words))) == brute(words)


def test_long_chain_of_forms(spark):
    words = {"a" * 20 + "b" * k: 3 * 2**k for k in range(1, 14)}
    got = found(sp.variants(as_words(spark, words)))
    assert got == brute(words) and {r[5] for r in got} == {"a" * 20 + "b" * 13}


def test_sample_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = spelled([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = found(sp.variants(sp.spelled_words(docs)))
    assert got == brute(words) and any(r[3] for r in got)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(sp.variants(sp.spelled_words(odd))) == brute(spelled(rows))
    assert found(sp.variants(sp.spelled_words(odd.limit(0)))) == set()


def test_runs(spark):
    text = "ÉTUDES études ÉTUDES ×÷àáâ naïveté's Straße x1abcdefg_abcdefg-ABCDEFGĀ " * 3
    rows = [(k, text) for k in range(40)] + [(None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.word, r.n) for r in sp.spelled_words(docs).collect()}
    assert got == set(spelled(rows).items()) and ("Études", 1) not in got


def test_cheapest_disjoint_pivots():
    rng = random.Random(3)
    for _ in range(500):
        length = rng.randint(5, 16)
        prefix = sorted(rng.sample(range(length - 1), rng.randint(3, min(7, length - 1))))
        if prefix[-1] - prefix[0] < 2:
            continue
        cost = lambda a, b: sum(sp.CHANCES**n for n in (a + 2, b - a - 2, length - b))
        pairs = [(cost(a, b), (a, b)) for a in prefix for b in prefix if b >= a + 2]
        a, b = sp.pivots_of(prefix, length)
        assert (cost(a, b), (a, b)) == min(pairs)


def test_very_long_words(spark):
    """Runs of one letter and of two, of which many have equal grams."""
    words = {"ab" * 1500: 50, "ab" * 1500 + "a": 20, "a" + "ab" * 1499 + "b": 8, "xy" * 10: 9, "xy" * 9 + "y": 4}
    assert found(sp.variants(as_words(spark, words))) == brute(words)
