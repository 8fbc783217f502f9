"""Secrets by rules, found through an inverted index of trigrams.

Each rule is a regular expression. From its parts that every match must hold, a Boolean
query over trigrams is derived: all of several clauses, of each one alternative, of that
all trigrams. The index lists for each trigram that some rule asks for the texts that
hold it; intersecting the lists gives a rule's candidates, which are verified with the
rule itself. A rule without mandatory trigrams is verified on every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as parts
from re import _parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import whole_text

#: Alternatives of one clause; what would have more is cut into clauses before.
MOST_ALTERNATIVES = 64
#: Characters of a class that are spelled out; a larger class ends a clause.
SPELLED = 8


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The rules of the base kinds, then well-known formats of further ones.
RULES = [
    Rule(
        "assign",
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2,
        least=12,
        base=True,
    ),
    # Both match a run to its end, so asking for the length within the pattern finds the same
    # spans as dropping short matches, without listing every short run of a text.
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{24,247}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
]

Clause = frozenset[frozenset[str]]


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that every match of a pattern fulfils, over trigrams of the lower-cased text.

    A clause is fulfilled if all trigrams of one of its alternatives occur. No clauses
    mean that nothing is mandatory.
    """
    clauses: list[Clause] = []

    def close(spelled: set[str]) -> set[str]:
        alternatives = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in spelled}
        if alternatives and frozenset() not in alternatives:
            least = {a for a in alternatives if not any(b < a for b in alternatives)}
            clauses.append(frozenset(least))
        return {""}

    def spell(node) -> set[str] | None:
        """All strings that a part stands for, if they are few."""
        op, arg = node
        if op is parts.LITERAL:
            return {chr(arg).lower()}
        if op is parts.IN and all(kind is parts.LITERAL for kind, _ in arg):
            chars = {chr(code).lower() for _, code in arg}
            return chars if len(chars) <= SPELLED else None
        if op is parts.SUBPATTERN:
            return spell_all(arg[-1])
        if op is parts.BRANCH:
            every = [spell_all(branch) for branch in arg[1]]
            return None if None in every else set().union(*every)
        if op in (parts.MAX_REPEAT, parts.MIN_REPEAT):
            low, high, inner = arg
            one = spell_all(inner) if high in (1, low) and high <= 16 else None
            if one is not None and len(one) ** low <= MOST_ALTERNATIVES:
                many = {"".join(p) for p in product(one, repeat=low)}
                return many | one | {""} if low == 0 else many
        return None

    def spell_all(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            some = spell(node)
            if some is None or len(out) * len(some) > MOST_ALTERNATIVES:
                return None
            out = {a + b for a in out for b in some}
        return out

    def walk(nodes) -> None:
        spelled = {""}
        for op, arg in nodes:
            some = spell((op, arg))
            if some is None:
                spelled = close(spelled)
                if op is parts.SUBPATTERN:
                    walk(arg[-1])
                elif op in (parts.MAX_REPEAT, parts.MIN_REPEAT) and arg[0] > 0:
                    walk(arg[2])
            else:
                if len(spelled) * len(some) > MOST_ALTERNATIVES:
                    spelled = close(spelled)
                spelled = {a + b for a in spelled for b in some}
        close(spelled)

    walk(_parser.parse(pattern))
    return clauses


def _row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart; equal for rows that repeat both id and text."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), text))


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """``(trigram, row_key)``: where each of the trigrams occurs in the lower-cased text."""
    lower = rows.select("row_key", F.lower("text").alias("lower"))
    held = F.array_compact(F.array(*[F.when(F.contains("lower", F.lit(t)), F.lit(t)) for t in trigrams]))
    # The outer form: for the other Spark infers a filter and looks every trigram up twice.
    return lower.select("row_key", F.explode_outer(held).alias("trigram")).where("trigram IS NOT NULL")


def candidates(rows: DataFrame, queries: dict[str, list[Clause]]) -> DataFrame:
    """``(row_key, kinds)``: the rules whose trigram query a text fulfils.

    The parts of a query are as many as the rules make them, whatever the data, and are
    matched while the lists are read; what is shuffled is one row for each text and
    alternative at most.
    """
    wanted = [
        (trigram, kind, c, a, len(alternative), len(clauses))
        for kind, clauses in queries.items()
        for c, clause in enumerate(clauses)
        for a, alternative in enumerate(sorted(clause, key=sorted))
        for trigram in alternative
    ]
    names = ["trigram", "kind", "clause", "alternative", "grams", "clauses"]
    listed = [F.struct(*[F.lit(value).alias(name) for name, value in zip(names, w)]) for w in wanted]
    one = rows.sparkSession.range(1)
    parts_of = F.broadcast(one.select(F.explode(F.array(*listed)).alias("w")).select("w.*"))
    lists = postings(rows, sorted({w[0] for w in wanted}))
    held = lists.join(parts_of, "trigram").groupBy(
        "row_key", "kind", "clauses", "clause", "alternative", "grams"
    ).agg(F.count_distinct("trigram").alias("n"))
    clauses = held.where("n = grams").groupBy("row_key", "kind", "clauses").agg(F.count_distinct("clause").alias("n"))
    return clauses.where("n = clauses").groupBy("row_key").agg(F.collect_set("kind").alias("kinds"))


def _lengths(array: str) -> Column:
    return F.transform(array, F.char_length)


def found(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Rows ``(row_key, doc_id, kind, start, end)``, in code points, and the rule's place ``k``.

    Matches are leftmost and do not overlap within a rule; those whose group is too short
    are dropped. A start is the sum of the lengths of what the pattern's matches leave
    of the text and of the matches before.
    """
    rules = RULES if rules is None else rules
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    text = whole_text()
    rows = docs.select("doc_id", text.alias("text"), _row_key(F.col("doc_id"), text).alias("row_key"))
    by_trigrams = {kind: clauses for kind, clauses in queries.items() if clauses}
    if by_trigrams:
        rows = rows.join(candidates(rows, by_trigrams), "row_key", "left")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    names = [f"found{k}" for k in range(len(rules))]
    matches = []
    for rule, name in zip(rules, names):
        every = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        if queries[rule.kind]:
            every = F.when(F.array_contains("kinds", rule.kind), every)
        matches.append(every.alias(name))
    rows = rows.select("row_key", "doc_id", "text", *matches)
    pieces = []
    for k, (rule, name) in enumerate(zip(rules, names)):
        group = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else F.col(name)
        gaps = F.split("text", rule.pattern, -1)
        piece = F.struct(
            F.lit(k).alias("k"),
            F.transform(gaps, F.char_length).alias("gaps"),
            _lengths(name).alias("sizes"),
            F.transform(group, F.char_length).alias("groups"),
        )
        pieces.append(F.when(F.size(name) > 0, piece))
    rows = rows.select("row_key", "doc_id", F.explode_outer(F.array_compact(F.array(*pieces))).alias("p"))
    rows = rows.where("p IS NOT NULL").select(
        "row_key", "doc_id", "p.k", F.posexplode_outer(F.arrays_zip("p.gaps", "p.sizes", "p.groups")).alias("i", "z")
    )
    # Rows that repeat were found twice; each place counts once.
    rows = rows.where("z.sizes IS NOT NULL").groupBy("row_key", "doc_id", "k", "i").agg(
        F.max("z.gaps").alias("gap"), F.max("z.sizes").alias("size"), F.max("z.groups").alias("held")
    )
    before = Window.partitionBy("row_key", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    least = F.array(*[F.lit(rule.least) for rule in rules])
    return ends.where(F.col("held") >= F.get(least, F.col("k"))).select(
        "row_key", "doc_id", F.get(kinds, F.col("k")).alias("kind"),
        (F.col("end") - F.col("size")).alias("start"), "end", "k",
    )


def listed(spans: str) -> Column:
    """``kind:start:end`` by start, then rule, joined by commas."""
    shown = F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(shown, ",")


def secrets(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Rows ``(doc_id, spans)``, one for each row of ``docs``, spans as an array in order.

    A span is ``(start, k, kind, end, base)``. A null or empty text has none, texts of any
    length count whole, rows that repeat get equal rows, and other columns are not read.
    """
    rules = RULES if rules is None else rules
    base = F.array(*[F.lit(rule.base) for rule in rules])
    span = F.struct("start", "k", "kind", "end", F.get(base, F.col("k")).alias("base"))
    by_row = found(docs, rules).groupBy("row_key").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    text = whole_text()
    rows = docs.select("doc_id", _row_key(F.col("doc_id"), text).alias("row_key"))
    nothing = F.array().cast("array<struct<start:bigint,k:int,kind:string,end:bigint,base:boolean>>")
    return rows.join(by_row, "row_key", "left").select("doc_id", F.coalesce("spans", nothing).alias("spans"))
