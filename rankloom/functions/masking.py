"""Personal data in texts replaced by keyed pseudonyms, as one native expression.

Each kind has a pattern for candidates and a test that a candidate has to pass. A match
becomes ``<kind:letters>``; the letters come of a keyed hash of its normal form, so one
address or number has the same pseudonym in every text and every run with the key, and
no one without the key can tell which it is. Placeholders hold no digit, plus or at sign, so
no kind that comes later finds anything in them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PSEUDONYM_LETTERS = 12
_DIGITS, _LETTERS = "0123456789", "ghijklmnop"


@dataclass(frozen=True)
class Kind:
    """What is masked: candidates, the normal form of one, and whether that is valid.

    ``sign`` is a quick pattern found in every text with a valid candidate; texts without it are left at once.
    """

    name: str
    pattern: str
    normal: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    sign: str = ""


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it occurs in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _digit(digits: Column, at: Column) -> Column:
    return F.substring(digits, at, F.lit(1)).cast("int")


def _weighed(digits: Column, count: Column, weigh: Callable[[Column, Column], Column]) -> Column:
    """The sum of ``weigh(digit, place from the left)`` over the first ``count`` digits."""
    places = F.sequence(F.lit(1), count)
    return F.aggregate(places, F.lit(0), lambda total, at: total + weigh(_digit(digits, at), at))


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits carry the check digit of a payment card."""
    size = F.length(digits)

    def weigh(digit: Column, at: Column) -> Column:
        twice = (size - at) % 2 == 1
        return F.when(~twice, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)

    return size.between(13, 19) & (_weighed(digits, size, weigh) % 10 == 0)


def national_id(digits: Column) -> Column:
    """Whether 11 digits are a Turkish identity number, by its two check digits."""
    eleven = (F.length(digits) == 11) & (F.left(digits, F.lit(1)) != "0")
    tenth = _weighed(digits, F.lit(9), lambda d, at: F.when(at % 2 == 1, 7 * d).otherwise(-d))
    eleventh = _weighed(digits, F.lit(10), lambda d, at: d)
    checked = (F.pmod(tenth, F.lit(10)) == _digit(digits, F.lit(10))) & (eleventh % 10 == _digit(digits, F.lit(11)))
    return eleven & F.when(eleven, checked).otherwise(False)


def _octets(dotted: Column) -> Column:
    parts = F.split(dotted, r"\.")
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    return (F.size(parts) == 4) & small


#: In the order in which they are masked. Candidates of numbers are whole runs, so that long
#: texts take one pass; groups repeat possessively, which takes no stack.
KINDS = [
    Kind(
        "email",
        r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})++",
        F.lower,
        lambda _: F.lit(True),
        "@",
    ),
    Kind("phone", r"\+[0-9](?:[ ().-]{0,3}[0-9])*+", _digits, lambda d: F.length(d).between(9, 15), r"\+[0-9]"),
    Kind("card", r"[0-9](?:[ -]?[0-9])*+", _digits, luhn, r"[0-9](?:[ -]?[0-9]){12}"),
    Kind("national_id", r"[0-9]+", _digits, national_id, r"[0-9]{11}"),
    Kind("ip", r"[0-9]+(?:\.[0-9]+)*+", lambda m: m, _octets, r"[0-9](?:\.[0-9]{1,3}){3}"),
]


def pseudonym(kind: str, normal: Column, key: str) -> Column:
    """``<kind:letters>`` from a hash that is keyed on the inside and the outside."""
    inner = F.sha2(F.concat(F.lit(f"{key}{kind}:"), normal), 256)
    short = F.substring(F.sha2(F.concat(F.lit(key), inner), 256), 1, PSEUDONYM_LETTERS)
    return F.concat(F.lit(f"<{kind}:"), F.translate(short, _DIGITS, _LETTERS), F.lit(">"))


def _masking_of(kind: Kind, key: str) -> Callable[[Column], Column]:
    """From a state of text and counts to the state with this kind masked, too."""

    def name(match: Column) -> Column:
        return bound(kind.normal(match), lambda n: F.when(kind.valid(n), pseudonym(kind.name, n, key)))

    def joined(counts: Column, parts: Column) -> Column:
        def put(names: Column) -> Column:
            kept = F.zip_with(names, parts["found"], lambda n, m: F.coalesce(n, m))
            pieces = F.zip_with(parts["gaps"], kept, lambda gap, k: F.concat(gap, F.coalesce(k, F.lit(""))))
            count = F.size(F.filter(names, lambda n: n.isNotNull()))
            return F.struct(
                F.array_join(pieces, "").alias("text"),
                F.concat(counts, F.array(count)).alias("counts"),
            )

        return bound(F.transform(parts["found"], name), put)

    def step(state: Column) -> Column:
        text = state["text"]
        found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
        parts = F.struct(found.alias("found"), F.split(text, kind.pattern, -1).alias("gaps"))
        changed = bound(parts, lambda p: joined(state["counts"], p))
        same = F.struct(text.alias("text"), F.concat(state["counts"], F.array(F.lit(0))).alias("counts"))
        return F.when(text.rlike(kind.sign), changed).otherwise(same) if kind.sign else changed

    return step


def masked(text: Column, key: str, kinds: list[Kind] = KINDS) -> Column:
    """A struct of the masked ``text`` and ``counts``, one for each of ``kinds``; null for a null text."""
    if not key:
        raise ValueError("masking needs a key")
    state = F.array(F.struct(text.cast("string").alias("text"), F.expr("CAST(array() AS array<int>)").alias("counts")))
    for kind in kinds:
        state = F.transform(state, _masking_of(kind, key))
    return F.when(text.isNotNull(), F.get(state, F.lit(0)))


def mask(text: Column, key: str) -> Column:
    return masked(text, key)["text"]


def mask_column(rows: DataFrame, column: str, key: str, audit: str = "masked") -> DataFrame:
    """``rows`` with ``column`` masked and ``audit``, a struct of the number of matches of each kind."""
    held = f"_{audit}"
    whole = rows.withColumn(held, masked(F.col(column), key))
    counts = F.struct(*[F.get(f"{held}.counts", F.lit(k)).alias(kind.name) for k, kind in enumerate(KINDS)])
    return whole.withColumn(column, F.col(f"{held}.text")).withColumn(audit, counts).drop(held)


def audit(rows: DataFrame, audit: str = "masked") -> DataFrame:
    """Rows ``(kind, found, texts)``: matches of each kind, and texts with any, of masked rows."""
    each = F.array(*[F.struct(F.lit(k.name).alias("kind"), F.col(f"{audit}.{k.name}").alias("n")) for k in KINDS])
    counts = rows.select(F.inline(each))
    return counts.groupBy("kind").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("found"), F.count_if(F.col("n") > 0).alias("texts")
    )
