"""The same results in SQL, by plainer ways: whole-table groupings and window by window."""

from __future__ import annotations

from rankloom.llm.secret_scan import RULES, Rule

EXACT_DEDUP = r"""
    WITH rows AS (
        SELECT doc_id, length(coalesce(text, '')) AS n,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS normal
        FROM documents),
    classes AS (
        SELECT normal, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id
        FROM rows GROUP BY normal)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(normal) AS text_sha256
    FROM rows JOIN classes USING (normal)"""


def _without_case_mark(pattern: str) -> str:
    """Spell out ``(?i:...)`` in ASCII letters: the marks of the two engines differ beyond these."""
    begin = pattern.find("(?i:")
    if begin < 0:
        return pattern
    end = pattern.index(")", begin)
    inside = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in pattern[begin + 4 : end])
    return f"{pattern[:begin]}(?:{inside}){pattern[end + 1 :]}"


def _matches(k: int, rule: Rule) -> str:
    pattern = "'" + _without_case_mark(rule.pattern).replace("'", "''") + "'"
    return f"""
        SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, {rule.least} AS least,
               regexp_extract_all(t, {pattern}, 0) AS found, string_split_regex(t, {pattern}) AS gaps,
               regexp_extract_all(t, {pattern}, {rule.group}) AS held
        FROM d WHERE regexp_matches(t, {pattern})"""


_BASE = [k for k, rule in enumerate(RULES) if rule.base]
_SIZE = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
SECRETS = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({" UNION ALL ".join(_matches(k, rule) for k, rule in enumerate(RULES))}),
    places AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
    s AS (SELECT doc_id, k, kind, length(held[i]) AS n, length(found[i]) AS size, least,
                 {_SIZE.format("gaps[1:i]")} + {_SIZE.format("found[1:i-1]")} AS start FROM places),
    spans AS (SELECT *, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span
              FROM s WHERE n >= least),
    r AS (SELECT doc_id, {", ".join(f"count_if(k = {k})::BIGINT AS n_{RULES[k].kind}" for k in _BASE)},
                 string_agg(span, ',' ORDER BY start, k) FILTER (WHERE k <= {_BASE[-1]}) AS base,
                 string_agg(span, ',' ORDER BY start, k) AS spans
          FROM spans GROUP BY doc_id)
    SELECT doc_id, {", ".join(f"coalesce(n_{RULES[k].kind}, 0) AS n_{RULES[k].kind}" for k in _BASE)},
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN r USING (doc_id)"""

WARC = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
    r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS newest FROM p)
    SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
           CASE WHEN n >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND page_id <> newest THEN newest END AS refers_to
    FROM r"""


def _word_shingles(table: str, key: str) -> str:
    """The five-word shingles of a table's texts as a list."""
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    return f"""
        SELECT {key}, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS sh
        FROM (SELECT {key}, {words} AS w FROM {table}) WHERE len(w) >= 5"""


# Items of at least five words, as the benchmark's are. Every window of every text that shares
# a shingle with the item is compared; of the most alike the first at a shared shingle or the end.
LEAKS = f"""
    WITH i AS ({_word_shingles("benchmark", "item_id")}),
    d AS ({_word_shingles("documents", "doc_id")}),
    ic AS (SELECT item_id, s, count(*) AS n FROM (SELECT item_id, unnest(sh) AS s FROM i) GROUP BY ALL),
    pairs AS (SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, unnest(sh) AS s FROM d) JOIN ic USING (s)),
    w AS (SELECT doc_id, item_id, len(i.sh) AS m, least(len(i.sh), len(d.sh)) AS size, len(d.sh) AS there,
                 d.sh, unnest(range(0, len(d.sh) - least(len(i.sh), len(d.sh)) + 1)) AS start
          FROM pairs JOIN d USING (doc_id) JOIN i USING (item_id)),
    g AS (SELECT doc_id, item_id, m, size, there, start, sh[start + 1] AS head, unnest(sh[start + 1:start + size]) AS s FROM w),
    c AS (SELECT doc_id, item_id, m, size, there, start, head, s, count(*) AS n FROM g GROUP BY ALL),
    o AS (SELECT doc_id, item_id, m, size, there, start, sum(least(c.n, ic.n)) AS common,
                 bool_or(s = head OR start = there - size) AS eligible
          FROM c JOIN ic USING (item_id, s) GROUP BY ALL),
    f AS (SELECT doc_id, item_id, start, size + 4 AS words, common / (m + size - common)::DOUBLE AS similarity
          FROM o WHERE eligible)
    SELECT doc_id, item_id, start, words, similarity FROM f WHERE similarity >= 0.8 - 1e-12
    QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""

# Bytes as pairs of hexadecimal digits.
REPEATS = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    p AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS pos, h FROM d),
    s AS (SELECT doc_id, pos, substring(h, 2 * pos + 1, 200) AS string FROM p),
    r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY string ORDER BY doc_id, pos) AS n FROM s)
          WHERE n > 1),
    e AS (SELECT doc_id, pos, coalesce(pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100, true) AS fresh FROM r),
    k AS (SELECT doc_id, pos, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM e),
    spans AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 100 AS b FROM k GROUP BY ALL),
    cut AS (SELECT doc_id, h, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before,
                   lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM spans JOIN d USING (doc_id)),
    kept AS (SELECT doc_id, sum(b - a)::BIGINT AS removed, count(*) AS n,
                    string_agg(substring(h, 2 * before + 1, 2 * (a - before))
                               || CASE WHEN next IS NULL THEN substring(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS rest
             FROM cut GROUP BY doc_id)
    SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans,
           sha256(unhex(coalesce(rest, h))) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)"""

# The level is found in closed form: clamping any first few sources by cap over weight gives a level
# that is too low, or the right one.
MIXTURE = r"""
    WITH d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
        FROM documents),
    u AS (SELECT *, md5('13:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size) AS draw FROM d),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
                 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
          FROM u GROUP BY source),
    l AS (SELECT ((SELECT sum(source_size) FROM s)
                  - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                 / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
          FROM s WINDOW o AS (ORDER BY cap / weight, source)),
    t AS (SELECT source, source_size, least(cap::DOUBLE, weight::DOUBLE * (SELECT max(level) FROM l)) AS target FROM s),
    w AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM t),
    m AS (SELECT *, greatest(target - whole * source_size, 0) AS more FROM w),
    c AS (SELECT u.doc_id, u.source, size, draw, source_size, target, whole, more,
                 sum(size) OVER (PARTITION BY u.source ORDER BY draw) AS upto
          FROM u JOIN m ON u.source IS NOT DISTINCT FROM m.source),
    e AS (SELECT source, min(draw) AS edge FROM c WHERE upto > more GROUP BY source),
    r AS (SELECT c.source, edge, any_value(more) - coalesce(sum(size) FILTER (WHERE draw < edge), 0) AS rest
          FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source GROUP BY c.source, edge),
    a AS (SELECT c.source, arg_min(draw, (abs(rest - size), size, draw)) AS added
          FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source
          WHERE draw >= edge AND abs(rest - size) < rest GROUP BY c.source)
    SELECT doc_id, size, source_size, target,
           size * (whole + coalesce(draw < edge OR draw = added, draw < edge, false)::BIGINT) AS taken
    FROM c LEFT JOIN r ON c.source IS NOT DISTINCT FROM r.source
    LEFT JOIN a ON c.source IS NOT DISTINCT FROM a.source"""
