"""Masking: what goes, what stays, and that nothing raw reaches the model."""

import hashlib
import random
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rankloom.functions import masking as mk
from rankloom.operators.ingest import chunks
from rankloom.operators.models import embed_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
KEY = "k1"
EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"


def with_luhn(digits):
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
    return digits + str(-total % 10)


def with_national_checks(nine):
    d = list(map(int, nine))
    tenth = (7 * sum(d[::2]) - sum(d[1::2])) % 10
    return f"{nine}{tenth}{(sum(d) + tenth) % 10}"


def name(kind, normal, key=KEY):
    inner = hashlib.sha256(f"{key}{kind}:{normal}".encode()).hexdigest()
    short = hashlib.sha256((key + inner).encode()).hexdigest()[: mk.PSEUDONYM_LETTERS]
    return f"<{kind}:{short.translate(str.maketrans('0123456789', 'ghijklmnop'))}>"


def luhn_holds(digits):
    return 13 <= len(digits) <= 19 and with_luhn(digits[:-1]) == digits


def brute(text):
    """The same kind by kind with Python's own substitution."""
    def put(kind, normal, valid):
        def one(match):
            n = normal(match[0])
            return name(kind, n) if valid(n) else match[0]

        return one

    digits = lambda m: re.sub("[^0-9]", "", m)
    octets = lambda n: n.count(".") == 3 and all(len(p) <= 3 and int(p) <= 255 for p in n.split("."))
    national = lambda n: len(n) == 11 and n[0] != "0" and with_national_checks(n[:9]) == n
    text = re.sub(EMAIL, put("email", str.lower, lambda n: True), text)
    text = re.sub(r"\+[0-9](?:[ ().-]{0,3}[0-9])*", put("phone", digits, lambda n: 9 <= len(n) <= 15), text)
    text = re.sub(r"[0-9](?:[ -]?[0-9])*", put("card", digits, luhn_holds), text)
    text = re.sub(r"[0-9]+", put("national_id", digits, national), text)
    return re.sub(r"[0-9]+(?:\.[0-9]+)*", put("ip", str, octets), text)


CARD, NATIONAL = with_luhn("453957876362148"), with_national_checks("123456789")


@pytest.mark.parametrize(
    "text, want",
    [
        ("Write to Ann.B@Example.org.", f"Write to {name('email', 'ann.b@example.org')}."),
        ("a@b stays", "a@b stays"),
        ("call +90 (212) 555-12-34, or not", f"call {name('phone', '902125551234')}, or not"),
        ("+123 stays", "+123 stays"),
        (f"card {CARD[:4]} {CARD[4:8]}-{CARD[8:]}!", f"card {name('card', CARD)}!"),
        ("1234 5678 9012 3456 stays", "1234 5678 9012 3456 stays"),
        (f"id {NATIONAL}; 12345678901 stays", f"id {name('national_id', NATIONAL)}; 12345678901 stays"),
        ("at 10.0.255.1. Not 1.2.3, 1.2.3.4.5, 300.1.1.1 or 1.2.3.99999999999", f"at {name('ip', '10.0.255.1')}. Not 1.2.3, 1.2.3.4.5, 300.1.1.1 or 1.2.3.99999999999"),
        ("", ""),
        ("no data, ğüş 💥 \n", "no data, ğüş 💥 \n"),
    ],
)
def test_what_is_masked(one, text, want):
    assert brute(text) == want
    assert one(mk.mask(F.lit(text), KEY)) == want
    assert one(mk.mask(F.lit(want), KEY)) == want


def test_null_and_key(one):
    assert one(mk.masked(F.lit(None).cast("string"), KEY)) is None
    with pytest.raises(ValueError):
        mk.mask(F.lit("x"), "")


def random_texts(n):
    rng = random.Random(6)

    def digits(k):
        return "".join(rng.choice("0123456789") for _ in range(k))

    makers = [
        lambda: f"{rng.choice(['Ann', 'bob.x', 'c+d', 'x' * 70])}@{rng.choice(['a.org', 'B.co.uk', 'local', '-.-'])}",
        lambda: "+" + rng.choice(" ().-").join(digits(rng.randint(1, 4)) for _ in range(rng.randint(1, 6))),
        lambda: rng.choice(["", " ", "-"]).join(re.findall("....?", with_luhn(digits(rng.randint(10, 20))))),
        lambda: with_national_checks(rng.choice("123456789") + digits(8)),
        lambda: ".".join(str(rng.randint(0, 300)) for _ in range(rng.randint(1, 5))),
        lambda: digits(rng.randint(1, 30)),
        lambda: rng.choice(["word", "ğ", ".", ",", "\n", "<email:abc>", "@", "+", "--"]),
    ]
    return ["".join(rng.choice(makers)() + rng.choice(["", " ", " ", ", "]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_random_texts(spark):
    texts = random_texts(600)
    rows = spark.createDataFrame([(t, "x") for t in texts], "text string, masked_ string")
    got = rows.select("text", mk.mask(F.col("text"), KEY).alias("out")).collect()
    assert {r.text: r.out for r in got} == {t: brute(t) for t in texts}
    assert sum(brute(t) != t for t in texts) > 300


def test_other_key_other_names(one):
    a, b = (one(mk.mask(F.lit("a@b.org A@B.ORG"), k)) for k in ("k1", "k2"))
    assert a != b and len(set(a.split())) == 1 == len(set(b.split()))


def test_very_long_runs_take_one_pass(one):
    for text in ("7" * 200_000, "a" * 200_000, "1." * 100_000, "+1" + " 1" * 100_000):
        assert one(mk.mask(F.lit(text), KEY)) == text


class Recorder:
    """An embedder that takes nothing but the texts it was told to expect."""

    def __init__(self, expected):
        self.expected = expected

    def embed(self, texts):
        assert self.expected.issuperset(texts), texts
        return [[float(len(t))] for t in texts]


def test_nothing_raw_reaches_the_model(spark):
    texts = [*random_texts(200), None, " ", " a@b.org ", "a@b.org", "A@B.org\n"]
    expected = {brute(t.strip()) for t in texts if t}
    assert not any(re.search(EMAIL, t) for t in expected)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    got = embed_texts(rows, "body", Recorder(expected), masking_key=KEY).collect()
    assert {r.id: r.body for r in got} == dict(enumerate(texts)) and len(got) == len(texts)
    assert all(r.embed_error is None for r in got)
    assert all((r.embedding is None) == (not (r.body or "").strip()) for r in got)


def test_chunks_cut_no_match(spark):
    """Masked before it is cut: no chunk holds a part of an address."""
    text = "y" * 480 + " ann@example.org " + "z" * 600
    rows = spark.createDataFrame([(1, text), (2, None)], "id long, body string")
    got = chunks(rows, "id", "body", 490, 10, masking_key=KEY).collect()
    assert got and not any("ann" in r.chunk or "example" in r.chunk for r in got)


def test_audit(spark):
    rows = spark.createDataFrame([("a@b.org c@d.org 1.2.3.4", 1), (None, 2), ("a@b.org", 3)], "text string, masked int")
    out = mk.mask_column(rows.drop("masked"), "text", KEY)
    assert out.columns == ["text", "masked"]
    got = {r.kind: (r.found, r.texts) for r in mk.audit(out).collect()}
    assert got == {"email": (3, 2), "ip": (1, 1), "phone": (0, 0), "card": (0, 0), "national_id": (0, 0)}
    assert {r.found for r in mk.audit(out.limit(0)).collect()} <= {0}


@pytest.mark.parametrize("kind", mk.KINDS, ids=lambda kind: kind.name)
def test_texts_without_the_sign_of_a_kind_hold_none(spark, kind):
    """What a kind's quick pattern leaves out has no valid candidate; what is masked has the sign."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("0123456789.+-@ ab") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["4111 1111 1111 1111", "10000000146", "1.2.3.4", "255.1.22.333", "+49 30 1234567", "a@b.c", "A@b-c.de.f"]
    plain = mk.Kind(kind.name, kind.pattern, kind.normal, kind.valid)
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    both = table.select("text", mk.masked(F.col("text"), "k", [kind]).alias("a"), mk.masked(F.col("text"), "k", [plain]).alias("b"))
    assert kind.sign and both.where("a != b").isEmpty()
    assert not both.where("a.counts[0] > 0").isEmpty()
