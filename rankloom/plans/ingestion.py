"""Queries on what ingestion does to articles before they are embedded, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.masking import KINDS, PSEUDONYM_LETTERS, audit, mask_column
from rankloom.operators.chunk_copies import chunk_copies
from rankloom.operators.ingest import chunks
from rankloom.operators.models import embed_texts
from rankloom.plans import tables as tb
from rankloom.plans.standins import LetterCountEmbedder
from rankloom.session import settle

CHUNK_CHARS, CHUNK_OVERLAP = 500, 50
#: Of the registered queries only; a real key belongs in a secret store.
MASKING_KEY = "example-key"


def masked_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of masked articles, with the letters that the embedder saw."""
    docs = tb.table(spark, d, "documents")
    # Written down: the vectors' keys and the rows they are joined to both read the chunks.
    cut = settle(chunks(docs, "doc_id", "text", CHUNK_CHARS, CHUNK_OVERLAP, masking_key=MASKING_KEY))
    seen = embed_texts(cut, "chunk", LetterCountEmbedder())
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return seen.select("doc_id", "pos", "chunk", total.cast("long").alias("letters"))


def masking_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit(mask_column(tb.table(spark, d, "documents"), "text", MASKING_KEY))


def chunk_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The class of each chunk, and the one that stays for it."""
    cut = chunks(tb.table(spark, d, "documents"), "doc_id", "text", CHUNK_CHARS, CHUNK_OVERLAP)
    found = chunk_copies(cut, ["doc_id", "pos"], "chunk")
    return found.select(
        "doc_id", "pos", F.col("first.doc_id").alias("first_doc_id"), F.col("first.pos").alias("first_pos"),
        "copies", "kept",
    )


QUERIES = {
    "masked_chunks": masked_chunks,
    "masking_audit": masking_audit,
    "chunk_duplicates": chunk_duplicates,
}


# --- the same in SQL ----------------------------------------------------------

_ONLY_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_NORMAL = {"email": "lower(x)", "ip": "x"}
_AT = "substring(n, i::BIGINT, 1)::INT"
_VALID = {
    "email": "true",
    "phone": "length(n) BETWEEN 9 AND 15",
    "card": f"""length(n) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(n) + 1),
        lambda i: CASE WHEN (length(n) - i) % 2 = 0 THEN {_AT}
                       WHEN {_AT} > 4 THEN 2 * {_AT} - 9 ELSE 2 * {_AT} END)) % 10 = 0""",
    "national_id": f"""CASE WHEN length(n) = 11 AND n[1] <> '0' THEN
        (list_sum(list_transform(range(1, 10), lambda i: CASE WHEN i % 2 = 1 THEN 7 * {_AT} ELSE -{_AT} END)) % 10 + 10) % 10
            = n[10]::INT
        AND list_sum(list_transform(range(1, 11), lambda i: {_AT})) % 10 = n[11]::INT ELSE false END""",
    "ip": """len(string_split(n, '.')) = 4
        AND len(list_filter(string_split(n, '.'), lambda p: length(p) > 3 OR coalesce(try_cast(p AS INT), 999) > 255)) = 0""",
}


def _masking_sql() -> str:
    """CTEs ``masked (doc_id, text, n_<kind>...)``: one kind after another, match by match."""
    parts = ["m0 AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"]
    for k, kind in enumerate(KINDS):
        pattern = kind.pattern.replace(")*+", ")*").replace(")++", ")+")  # the same, as nothing follows
        counts = "".join(f", n_{done.name}" for done in KINDS[:k])
        normal = _NORMAL.get(kind.name, _ONLY_DIGITS)
        inner = f"sha256('{MASKING_KEY}' || sha256('{MASKING_KEY}{kind.name}:' || n))"
        name = f"'<{kind.name}:' || translate({inner}[1:{PSEUDONYM_LETTERS}], '0123456789', 'ghijklmnop') || '>'"
        parts.append(f"""
    f{k} AS (SELECT *, regexp_extract_all(text, '{pattern}') AS found,
                    string_split_regex(text, '{pattern}') AS gaps FROM m{k}),
    u{k} AS (SELECT doc_id, found, unnest(range(1, len(found) + 1)) AS j FROM f{k}),
    x{k} AS (SELECT doc_id, j, found[j] AS x FROM u{k}),
    v{k} AS (SELECT *, {normal} AS n FROM x{k}),
    w{k} AS (SELECT doc_id, list(CASE WHEN {_VALID[kind.name]} THEN {name} ELSE x END ORDER BY j) AS names,
                    count_if({_VALID[kind.name]}) AS n_{kind.name} FROM v{k} GROUP BY doc_id),
    m{k + 1} AS (SELECT doc_id, CASE WHEN names IS NULL THEN text ELSE array_to_string(list_transform(
                     range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(names[i], '')), '') END AS text{counts},
                 coalesce(n_{kind.name}, 0)::BIGINT AS n_{kind.name}
                 FROM f{k} LEFT JOIN w{k} USING (doc_id))""")
    return ",".join(parts) + f",\n    masked AS (SELECT * FROM m{len(KINDS)})"


_STEP = CHUNK_CHARS - CHUNK_OVERLAP


def _chunks_sql(source: str) -> str:
    return f"""places AS (SELECT doc_id, text, unnest(range(0, length(text))) AS pos FROM {source}),
    cut AS (SELECT doc_id, pos::INT AS pos, substring(text, pos * {_STEP} + 1, {CHUNK_CHARS}) AS chunk
            FROM places WHERE pos = 0 OR pos * {_STEP} + {CHUNK_OVERLAP} < length(text))"""


# Every two texts that share a shingle are compared, and classes are what is reached step by step.
_COPIES_SQL = f"""WITH RECURSIVE {_chunks_sql("documents")},
    t AS (SELECT chunk, row_number() OVER (ORDER BY chunk) AS id FROM (SELECT DISTINCT chunk FROM cut)),
    w AS (SELECT id, regexp_extract_all(translate(chunk, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\\x20\\x09-\\x0D]+') AS words FROM t),
    h AS (SELECT id, list_distinct(list_transform(range(1, greatest(len(words) - 3, 2)),
                     lambda i: array_to_string(words[i:i + 4], ' '))) AS own FROM w WHERE len(words) > 0),
    s AS (SELECT id, len(own) AS n, unnest(own) AS shingle FROM h),
    near AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.id <> b.id
             GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
    reach AS (SELECT id, id AS to_id FROM t UNION
              SELECT reach.id, near.b FROM reach JOIN near ON near.a = reach.to_id),
    named AS (SELECT doc_id, pos, class FROM cut JOIN t USING (chunk)
              JOIN (SELECT id, min(to_id) AS class FROM reach GROUP BY id) USING (id)),
    classes AS (SELECT class, min((doc_id, pos)) AS first, count(*) AS copies FROM named GROUP BY class)
    SELECT doc_id, pos, first[1] AS first_doc_id, first[2] AS first_pos, copies,
           doc_id = first[1] AND pos = first[2] AS kept
    FROM named JOIN classes USING (class)"""

SQL = {
    "masked_chunks": f"""WITH {_masking_sql()}, {_chunks_sql("masked")}
        SELECT doc_id, pos, chunk, length(regexp_replace(chunk, '[^a-z]', '', 'g'))::BIGINT AS letters FROM cut""",
    "masking_audit": f"""WITH {_masking_sql()},
        long AS (UNPIVOT masked ON {", ".join(f"n_{kind.name}" for kind in KINDS)} INTO NAME kind VALUE n)
        SELECT substring(kind, 3) AS kind, sum(n)::BIGINT AS found, count_if(n > 0)::BIGINT AS texts
        FROM long GROUP BY kind""",
    "chunk_duplicates": _COPIES_SQL,
}
