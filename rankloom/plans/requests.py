"""Queries over the request log: metrics, limiter, cache replay, monitor, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.functions import vectors as vx
from rankloom.operators import metrics as mx
from rankloom.operators.cache_replay import cache_stats, lru_replay, ttl_replay
from rankloom.operators.clock import from_micros, micros, slot
from rankloom.operators.costs import token_cost
from rankloom.operators.limiter import offered_load, rate_limit
from rankloom.operators.monitor import notices, outage_events, probe_state
from rankloom.operators.runs import streaks
from rankloom.plans import tables as tb
from rankloom.sources import collections as col
from rankloom.sources import history as hist
from rankloom.sources import reqlog

HOUR = 3600
WINDOW, STEP = 6 * HOUR, HOUR
BOUNDS = mx.STAGE_BOUNDS["total"]


def _naive(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, tb.naive(name))
    return df


# --- histograms, rates, quantiles ---------------------------------------------


def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = mx.histogram(tb.request_log(spark, d), F.col("seconds"), BOUNDS, ["event_type"])
    le = F.when(F.col("le") == float("inf"), F.lit("+Inf")).otherwise(F.col("le").cast("string"))
    return rows.withColumn("le", le).withColumn("total_sum", F.round("total_sum", 6))


def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    out = mx.latency_windows(
        tb.request_log(spark, d), "ts", F.col("seconds"), BOUNDS, ["event_type"], WINDOW, STEP
    )
    return _naive(out, "window_start", "window_end").select(
        "window_start", "window_end", "event_type", "requests", F.col("quantile").alias("p95")
    )


def _ticks():
    return F.round(F.col("seconds") * 10_000).cast("long")


def latency_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of whole ticks of 0.1 ms, so that sums are exact in any order."""
    out = mx.latency_windows(tb.request_log(spark, d), "ts", _ticks(), BOUNDS, [], WINDOW, STEP)
    return _naive(out, "window_start").select(
        "window_start", "requests", F.col("mean_seconds").alias("mean_ticks")
    )


def latency_quantile_exact(spark: SparkSession, d: str) -> DataFrame:
    return mx.exact_quantile(tb.request_log(spark, d), F.col("seconds"), 0.95, ["event_type"])


def rate_by_type(spark: SparkSession, d: str) -> DataFrame:
    out = mx.event_rate(tb.request_log(spark, d), "ts", ["event_type"], WINDOW, STEP)
    return _naive(out, "window_start", "window_end")


def token_rate(spark: SparkSession, d: str) -> DataFrame:
    out = mx.event_rate(
        tb.request_log(spark, d), "ts", ["event_type"], WINDOW, STEP, F.col("tokens")
    )
    return _naive(out, "window_start", "window_end")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Hourly samples of a per-type counter that restarts every midnight."""
    log = tb.request_log(spark, d)
    hourly = log.groupBy("event_type", slot(micros("ts"), HOUR * 1_000_000).alias("us")).agg(
        F.count("*").alias("n")
    )
    day = slot(F.col("us"), 24 * HOUR * 1_000_000)
    so_far = Window.partitionBy("event_type", day).orderBy("us")
    return hourly.select(
        "event_type", from_micros(F.col("us")).alias("ts"), "us", F.sum("n").over(so_far).alias("value")
    )


def sampled_rate(spark: SparkSession, d: str) -> DataFrame:
    out = mx.sampled_rate(_samples(spark, d), ["event_type"], "ts", "us", "value", WINDOW, STEP)
    return _naive(out, "window_start", "window_end")


def error_ratio(spark: SparkSession, d: str) -> DataFrame:
    out = mx.error_ratio(tb.request_log(spark, d), "ts", F.col("failed"), WINDOW, STEP)
    return _naive(out, "window_start", "window_end")


def counters(spark: SparkSession, d: str) -> DataFrame:
    return mx.counters(tb.request_log(spark, d), ["event_type"], F.col("tokens"))


def status_classes(spark: SparkSession, d: str) -> DataFrame:
    """Requests by status; 5xx are those matching ``5..``."""
    code = F.concat(
        F.when(F.col("failed"), F.lit("5")).otherwise(F.lit("2")),
        F.lpad(F.pmod(F.col("tokens"), F.lit(4)).cast("string"), 2, "0"),
    )
    log = tb.request_log(spark, d).withColumn("status", code)
    return (
        log.where(mx.status_matches(F.col("status"), "5.."))
        .groupBy("status")
        .agg(F.count("*").alias("requests"))
    )


def label_topk(spark: SparkSession, d: str) -> DataFrame:
    return mx.most_frequent(tb.request_log(spark, d), "user_id", 10)


def updown_stats(spark: SparkSession, d: str) -> DataFrame:
    out = mx.up_summary(tb.request_log(spark, d), ["user_id"], ~F.col("failed"), _ticks())
    return out.withColumnRenamed("mean_seconds", "mean_ticks")


# --- limiter, cache, monitor ----------------------------------------------------


def limiter(spark: SparkSession, d: str) -> DataFrame:
    return rate_limit(tb.request_log(spark, d), "event_type", "ts", "event_id", 2, HOUR)


def limiter_load(spark: SparkSession, d: str) -> DataFrame:
    return _naive(offered_load(tb.request_log(spark, d), "event_type", "ts", HOUR), "slot_start")


def ttl_cache_replay(spark: SparkSession, d: str) -> DataFrame:
    return ttl_replay(tb.request_log(spark, d), "user_id", "ts", "event_id", 6 * HOUR)


LRU_ENTRIES = 64


def lru_cache_replay(spark: SparkSession, d: str) -> DataFrame:
    return lru_replay(tb.request_log(spark, d), "user_id", "ts", "event_id", LRU_ENTRIES)


def ttl_lru_cache_replay(spark: SparkSession, d: str) -> DataFrame:
    return lru_replay(
        tb.request_log(spark, d), "user_id", "ts", "event_id", LRU_ENTRIES, ttl_seconds=6 * HOUR
    )


def lru_cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return cache_stats(lru_cache_replay(spark, d), 0, LRU_ENTRIES)


_OK = "value < 250"


def _probes(spark: SparkSession, d: str) -> DataFrame:
    """One host per event type; a probe is good when its value is below 250."""
    return tb.table(spark, d, "events").withColumn("ok", F.expr(_OK))


def fail_streaks(spark: SparkSession, d: str) -> DataFrame:
    out = streaks(_probes(spark, d), ["event_type"], "ts", "event_id", F.col("ok"))
    return out.select("event_type", "event_id", "position", "island", "bad_streak", "good_streak")


def _outages(spark: SparkSession, d: str) -> DataFrame:
    return outage_events(
        _probes(spark, d), "event_type", "ts", "event_id", F.col("ok"), 3, 60, "22:00", "06:00"
    )


def outage_monitor(spark: SparkSession, d: str) -> DataFrame:
    return _outages(spark, d).select("event_type", "event_id", "streak", "event")


def outage_notices(spark: SparkSession, d: str) -> DataFrame:
    return notices(_outages(spark, d), "event_type", "ts")


def probe_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    out = probe_state(_probes(spark, d), "event_type", "ts", "event_id", F.col("ok"))
    return out.select("event_type", "event_id", "state")


# --- history, request columns, collections --------------------------------------


def _history_lines(spark: SparkSession, d: str) -> DataFrame:
    """Stored history with bars inside questions, unreadable and endless counts and short lines."""
    said = tb.table(spark, d, "conversations")
    at = F.expr(
        "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, cast(conv_id as int), cast(turn as int), 0)"
    )
    tokens = (
        F.when(F.col("turn") == 2, F.lit("9" * 23))
        .when(F.col("role") == "assistant", F.lit("n/a"))
        .otherwise(F.char_length("text").cast("string"))
    )
    bars = F.regexp_replace("text", ",", "|")
    line = F.when(
        F.col("turn") == 3, F.concat_ws("|", tx.stamp(at), tokens)
    ).otherwise(F.concat_ws("|", tx.stamp(at), tokens, bars))
    return said.select("conv_id", "turn", line.alias("line"))


def history_parse(spark: SparkSession, d: str) -> DataFrame:
    return hist.parse_history(_history_lines(spark, d), "line")


def history_recent(spark: SparkSession, d: str) -> DataFrame:
    log = tb.table(spark, d, "events").withColumn(
        "question", F.concat_ws(" ", "event_type", "props", F.col("ts").cast("string"))
    )
    newest = [F.desc("ts"), F.desc("event_id")]
    return hist.recent_questions(log, ["user_id"], newest).select("user_id", "place", "event_id", "shown")


def client_key(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose headers depend on the event type."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    direct = F.when(kind == "click", F.concat(F.lit(" 10.0.0."), user, F.lit(" "))).when(
        kind == "purchase", F.lit("")
    )
    forwarded = F.when(
        kind.isin("view", "purchase"), F.concat(F.lit("10.1.0."), user, F.lit(" , 10.9.9.9"))
    )
    host = F.when(kind == "signup", F.concat(F.lit("host-"), user))
    headers = F.create_map(
        F.lit("cf-connecting-ip"), direct, F.lit("x-forwarded-for"), forwarded
    )
    return tb.table(spark, d, "events").select(
        "event_id", reqlog.client_key(headers, host).alias("client")
    )


def body_limit(spark: SparkSession, d: str) -> DataFrame:
    """Documents as request bodies; some lengths are missing or unreadable."""
    length = F.when(F.col("lang") == "fr", F.concat(F.col("n_chars").cast("string"), F.lit("b"))).when(
        F.col("lang") != "de", F.col("n_chars").cast("string")
    )
    return tb.table(spark, d, "documents").select(
        "doc_id", reqlog.body_too_large(length, 2048).alias("rejected")
    )


def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return col.collection_stats(tb.points(spark, d))


def dimension_audit(spark: SparkSession, d: str) -> DataFrame:
    return col.dimension_audit(tb.points(spark, d), 64, ["internal", "external", "archive"])


def tuning_hint(spark: SparkSession, d: str) -> DataFrame:
    return col.collection_stats(tb.points(spark, d)).select(
        "collection", "points_count", col.tuning_hint(F.col("points_count") * 50).alias("hint")
    )


def model_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Expected vector length where the source names the model, the language the provider."""
    model = F.when(F.col("lang") == "en", F.concat("source", F.lit("-Large"))).otherwise(F.col("source"))
    provider = F.when(F.col("lang") == "fr", F.lit("local")).otherwise(F.lit("openai"))
    return tb.table(spark, d, "documents").select(
        "doc_id", vx.expected_dimension(provider, model).alias("dim")
    )


def neighbour_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of each vector against the next one, as column expressions."""
    this = tb.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    after = this.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    a, b = F.col("a"), F.col("b")
    return this.join(after, "vec_id").select(
        "vec_id",
        F.size(a).alias("dim"),
        F.round(vx.dot(a, b), 6).alias("dot"),
        F.round(vx.cosine(a, b), 6).alias("cosine"),
        F.round(vx.euclid(a, b), 6).alias("euclid"),
    )


def snapshot_retention(spark: SparkSession, d: str) -> DataFrame:
    days = tb.table(spark, d, "events").select(F.date_trunc("day", "ts").alias("day")).distinct()
    taken = tb.naive(F.col("day")) + F.expr("interval 3 hours")
    now = F.lit("2024-01-31 02:00:00").cast("timestamp_ntz")
    listed = days.select(taken.alias("taken_at"))
    return col.retention(listed, F.col("taken_at"), now, 14)


def tokens_cost(spark: SparkSession, d: str) -> DataFrame:
    out = token_cost(tb.request_log(spark, d), "ts", "event_type", F.col("tokens"))
    return out


def stage_events(spark: SparkSession, d: str) -> DataFrame:
    """Requests as stage events: all embed, failed ones never reach generation."""
    log = tb.request_log(spark, d).withColumn(
        "status", F.when(F.col("failed"), F.lit("embedding")).otherwise(F.lit("ok"))
    )
    stages = {
        "embed": F.col("seconds") * 0.25,
        "generate": F.when(~F.col("failed"), F.col("seconds") * 0.75),
    }
    events = reqlog.stage_events(log, F.col("ts"), F.col("event_type"), stages)
    return events.groupBy("stage", "model", "status").agg(
        F.count("*").alias("events"),
        F.round(F.sum("seconds"), 6).alias("seconds"),
        F.sum("tokens").alias("tokens"),
    )


def quiet_minutes(spark: SparkSession, d: str) -> DataFrame:
    return tb.table(spark, d, "events").select(
        "event_id",
        tx.in_quiet_hours(F.col("ts"), "22:30", "06:15").alias("night"),
        tx.in_quiet_hours(F.col("ts"), "09:00", "17:00").alias("office"),
        tx.in_quiet_hours(F.col("ts"), "08:00", "08:00").alias("always"),
        tx.stamp(F.col("ts")).alias("stamp"),
        tx.file_stamp(F.col("ts")).alias("file_stamp"),
    )


def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    """Waiting time if the k-th property were a retry number."""
    attempt = F.pmod(F.col("tokens"), F.lit(3))
    return tb.request_log(spark, d).select(
        "event_id", tx.backoff_seconds(attempt).alias("wait_seconds")
    )


QUERIES = {
    "latency_histogram": latency_histogram,
    "latency_p95": latency_p95,
    "latency_mean": latency_mean,
    "latency_quantile_exact": latency_quantile_exact,
    "rate_by_type": rate_by_type,
    "token_rate": token_rate,
    "sampled_rate": sampled_rate,
    "error_ratio": error_ratio,
    "counters": counters,
    "status_classes": status_classes,
    "label_topk": label_topk,
    "updown_stats": updown_stats,
    "rate_limit": limiter,
    "offered_load": limiter_load,
    "ttl_cache_replay": ttl_cache_replay,
    "lru_cache_replay": lru_cache_replay,
    "ttl_lru_cache_replay": ttl_lru_cache_replay,
    "lru_cache_stats": lru_cache_stats,
    "fail_streaks": fail_streaks,
    "outage_monitor": outage_monitor,
    "outage_notices": outage_notices,
    "probe_hysteresis": probe_hysteresis,
    "history_parse": history_parse,
    "history_recent": history_recent,
    "client_key": client_key,
    "body_limit": body_limit,
    "collection_stats": collection_stats,
    "dimension_audit": dimension_audit,
    "tuning_hint": tuning_hint,
    "model_dimensions": model_dimensions,
    "neighbour_scores": neighbour_scores,
    "snapshot_retention": snapshot_retention,
    "token_cost": tokens_cost,
    "stage_events": stage_events,
    "quiet_minutes": quiet_minutes,
    "retry_backoff": retry_backoff,
}


# --- the same in SQL ----------------------------------------------------------

_LOG = """log AS (SELECT event_id, ts, user_id, event_type, value / 100 AS seconds,
    (props->>'$.k')::BIGINT AS tokens, event_type = 'error' AS failed FROM events)"""
# Every window of 6 hours, one per hour, that contains a row.
_WINDOWS = """
    w AS (SELECT log.*, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(g.i) AS window_start
          FROM log, (SELECT unnest(range(6)) AS i) g)"""
_LE = ", ".join(f"({b}::DOUBLE, {i})" for i, b in enumerate(BOUNDS))
_P95 = f"""
    b AS (SELECT window_start, event_type, x.le, x.i, count_if(seconds <= x.le) AS cum, count(*) AS n
          FROM w, (VALUES {_LE}) x(le, i) GROUP BY ALL),
    c AS (SELECT *, lag(le, 1, 0) OVER g AS low, lag(cum, 1, 0) OVER g AS below FROM b
          WINDOW g AS (PARTITION BY window_start, event_type ORDER BY i)),
    first_reached AS (SELECT window_start, event_type, any_value(n) AS n,
          min(i) FILTER (WHERE cum >= n * 0.95::DOUBLE) AS i FROM c GROUP BY ALL)"""

_ISLANDS = f"""
    r AS (SELECT event_type, event_id, ts, {_OK} AS ok,
                 row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS position
          FROM events),
    k AS (SELECT *, coalesce(max(CASE WHEN ok THEN position END) OVER x, 0) AS island,
                 coalesce(max(CASE WHEN NOT ok THEN position END) OVER x, 0) AS last_bad,
                 coalesce(lag(ok) OVER (PARTITION BY event_type ORDER BY position), true) AS ok_before
          FROM r WINDOW x AS (PARTITION BY event_type ORDER BY position))"""
_QUIET = "(extract(hour FROM ts) >= 22 OR extract(hour FROM ts) < 6)"
_OUTAGES = f"""
    j AS (SELECT *, position - island AS streak, {_QUIET} AS quiet FROM k),
    wanting AS (SELECT *, epoch_us(date_trunc('second', ts)) // 1000000 AS sec,
                row_number() OVER (PARTITION BY event_type, island ORDER BY position) AS n
                FROM j WHERE NOT ok AND streak >= 3 AND NOT quiet),
    chain AS (
        SELECT event_type, island, n, event_id, sec AS told, true AS sent FROM wanting WHERE n = 1
        UNION ALL
        SELECT x.event_type, x.island, x.n, x.event_id,
               CASE WHEN x.sec - c.told >= 3600 THEN x.sec ELSE c.told END,
               x.sec - c.told >= 3600
        FROM chain c JOIN wanting x
          ON x.event_type = c.event_type AND x.island = c.island AND x.n = c.n + 1),
    outages AS (SELECT j.event_type, j.event_id, j.ts, j.streak,
        CASE WHEN j.ok AND NOT ok_before THEN CASE WHEN quiet THEN 'recovery_quiet' ELSE 'recovery' END
             WHEN j.ok THEN 'ok' WHEN j.streak < 3 THEN 'pending' WHEN quiet THEN 'quiet'
             WHEN chain.sent THEN 'alert' ELSE 'cooldown' END AS event
        FROM j LEFT JOIN chain USING (event_id))"""

_TOUCHES = """
    a AS (SELECT event_id, user_id, ts, row_number() OVER (ORDER BY ts, event_id) AS p FROM events),
    t AS (SELECT *, lag(p) OVER (PARTITION BY user_id ORDER BY p) AS prev,
                 lead(p) OVER (PARTITION BY user_id ORDER BY p) AS next FROM a)"""
# Distinct keys used since the key's previous use: rows in between that are the
# last use of their key before now.
_LRU = f"""
    between_uses AS (SELECT t.event_id, count(o.p) AS others FROM t
        LEFT JOIN t o ON o.p > t.prev AND o.p < t.p AND (o.next IS NULL OR o.next > t.p)
        WHERE t.prev IS NOT NULL GROUP BY t.event_id),
    seen AS (SELECT event_id, count_if(prev IS NULL) OVER (ORDER BY p
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS keys FROM t),
    lru AS (SELECT user_id, ts, t.event_id,
        CASE WHEN prev IS NOT NULL AND others < {LRU_ENTRIES} THEN 'hit' ELSE 'miss' END AS event,
        NOT (prev IS NOT NULL AND others < {LRU_ENTRIES}) AND coalesce(keys, 0) >= {LRU_ENTRIES} AS evicted, p
        FROM t LEFT JOIN between_uses USING (event_id) JOIN seen USING (event_id))"""

SQL = {
    "latency_histogram": f"""WITH {_LOG},
        edges AS (SELECT * FROM (VALUES {_LE}, ('inf'::DOUBLE, {len(BOUNDS)})) x(le, i))
        SELECT event_type, CASE WHEN le = 'inf' THEN '+Inf' ELSE le::VARCHAR END AS le,
               count_if(seconds <= le) AS cum_count, round(sum(seconds), 6) AS total_sum,
               count(*) AS total_count
        FROM log, edges GROUP BY event_type, edges.le""",
    "latency_p95": f"""WITH {_LOG}, {_WINDOWS}, {_P95}
        SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, event_type,
               f.n AS requests, CASE WHEN f.i IS NULL THEN {BOUNDS[-1]}::DOUBLE
                    ELSE low + (le - low) * ((f.n * 0.95::DOUBLE - below) / (cum - below)) END AS p95
        FROM first_reached f LEFT JOIN c USING (window_start, event_type, i)""",
    "latency_mean": f"""WITH {_LOG}, {_WINDOWS}
        SELECT window_start, count(*) AS requests, sum(round(seconds * 10000)::BIGINT)::BIGINT / count(*) AS mean_ticks
        FROM w GROUP BY 1""",
    "latency_quantile_exact": f"""WITH {_LOG}
        SELECT event_type, quantile_disc(seconds, 0.95) AS quantile FROM log GROUP BY 1""",
    "rate_by_type": f"""WITH {_LOG}, {_WINDOWS}
        SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, event_type,
               count(*) AS increase, count(*) / 21600.0::DOUBLE AS rate
        FROM w GROUP BY window_start, event_type""",
    "token_rate": f"""WITH {_LOG}, {_WINDOWS}
        SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, event_type,
               sum(tokens)::BIGINT AS increase, sum(tokens)::BIGINT / 21600.0::DOUBLE AS rate
        FROM w GROUP BY window_start, event_type""",
    "sampled_rate": """WITH h AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS ts,
                 count(*) AS n FROM events GROUP BY ALL),
        s AS (SELECT event_type, ts, sum(n) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts) AS v
              FROM h),
        l AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM s),
        g AS (SELECT event_type, ts, CASE WHEN v < p THEN v ELSE v - p END AS delta FROM l
              WHERE p IS NOT NULL),
        w AS (SELECT event_type, delta, ts - to_hours(i) AS window_start
              FROM g, (SELECT unnest(range(6)) AS i))
        SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, event_type,
               sum(delta)::BIGINT AS increase, sum(delta)::BIGINT / 21600.0::DOUBLE AS rate
        FROM w GROUP BY window_start, event_type""",
    "error_ratio": f"""WITH {_LOG}, {_WINDOWS}
        SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end,
               count_if(failed) AS errors, count(*) AS requests,
               100.0::DOUBLE * count_if(failed) / count(*) AS error_pct
        FROM w GROUP BY window_start""",
    "counters": f"""WITH {_LOG} SELECT event_type, count(*) AS events, sum(tokens)::BIGINT AS total
        FROM log GROUP BY 1""",
    "status_classes": f"""WITH {_LOG},
        s AS (SELECT CASE WHEN failed THEN '5' ELSE '2' END || lpad((tokens % 4)::VARCHAR, 2, '0') AS status FROM log)
        SELECT status, count(*) AS requests FROM s WHERE regexp_full_match(status, '5..') GROUP BY 1""",
    "label_topk": """SELECT user_id, count(*) AS events FROM events GROUP BY 1
        ORDER BY events DESC, user_id LIMIT 10""",
    "updown_stats": f"""WITH {_LOG} SELECT user_id, max((NOT failed)::INT) AS up,
        sum(round(seconds * 10000)::BIGINT)::BIGINT / count(*) AS mean_ticks, count(*) AS probes FROM log GROUP BY 1""",
    "rate_limit": """WITH RECURSIVE r AS (SELECT event_type, ts, event_id, epoch_us(ts) AS us,
            row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
        f AS (SELECT event_type, n, [us] AS taken, true AS accepted FROM r WHERE n = 1
            UNION ALL
            SELECT r.event_type, r.n,
                CASE WHEN len(list_filter(f.taken, lambda x: r.us - x <= 3600000000)) < 2
                     THEN list_append(list_filter(f.taken, lambda x: r.us - x <= 3600000000), r.us)
                     ELSE list_filter(f.taken, lambda x: r.us - x <= 3600000000) END,
                len(list_filter(f.taken, lambda x: r.us - x <= 3600000000)) < 2
            FROM f JOIN r ON r.event_type = f.event_type AND r.n = f.n + 1)
        SELECT event_type, ts, event_id, accepted FROM f JOIN r USING (event_type, n)""",
    "offered_load": """WITH s AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS slot_start,
                      count(*) AS requests FROM events GROUP BY ALL)
        SELECT a.event_type, a.slot_start, a.requests,
               a.requests + coalesce(b.requests, 0) AS requests_with_previous
        FROM s a LEFT JOIN s b ON b.event_type = a.event_type
             AND b.slot_start = a.slot_start - INTERVAL 1 HOUR""",
    "ttl_cache_replay": """WITH RECURSIVE r AS (SELECT user_id, ts, event_id, epoch_us(ts) AS us,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        f AS (SELECT user_id, n, us AS stored, 'miss' AS event FROM r WHERE n = 1
            UNION ALL
            SELECT r.user_id, r.n,
                CASE WHEN r.us - f.stored > 21600000000 THEN r.us ELSE f.stored END,
                CASE WHEN r.us - f.stored > 21600000000 THEN 'expired' ELSE 'hit' END
            FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
        SELECT user_id, ts, event_id, event FROM f JOIN r USING (user_id, n)""",
    "lru_cache_replay": f"WITH {_TOUCHES}, {_LRU} SELECT user_id, ts, event_id, event, evicted FROM lru",
    "ttl_lru_cache_replay": f"""WITH RECURSIVE {_TOUCHES}, {_LRU},
        r AS (SELECT *, epoch_us(ts) AS us,
              row_number() OVER (PARTITION BY user_id ORDER BY p) AS n FROM lru),
        f AS (SELECT user_id, n, us AS stored, 'miss' AS final FROM r WHERE n = 1
            UNION ALL
            SELECT r.user_id, r.n,
                CASE WHEN r.event = 'miss' OR r.us - f.stored > 21600000000 THEN r.us ELSE f.stored END,
                CASE WHEN r.event = 'miss' THEN 'miss'
                     WHEN r.us - f.stored > 21600000000 THEN 'expired' ELSE 'hit' END
            FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
        SELECT user_id, ts, event_id, final AS event, evicted FROM f JOIN r USING (user_id, n)""",
    "lru_cache_stats": f"""WITH {_TOUCHES}, {_LRU}
        SELECT true AS enabled, count_if(event = 'miss') - count_if(evicted) AS size,
               0 AS ttl_seconds, {LRU_ENTRIES} AS max_entries, count_if(event = 'hit') AS hit,
               count_if(event = 'miss') AS miss, 0 AS expired, count_if(evicted) AS evicted FROM lru""",
    "fail_streaks": f"""WITH {_ISLANDS} SELECT event_type, event_id, position, island,
        position - island AS bad_streak, position - last_bad AS good_streak FROM k""",
    "outage_monitor": f"""WITH RECURSIVE {_ISLANDS}, {_OUTAGES}
        SELECT event_type, event_id, streak, event FROM outages""",
    "outage_notices": f"""WITH RECURSIVE {_ISLANDS}, {_OUTAGES}
        SELECT event_type, ts, event, json_object('text', '[' || strftime(ts, '%Y-%m-%d %H:%M:%S')
            || '] monitor ' || CASE WHEN event = 'alert' THEN 'ALERT' ELSE 'RECOVERY' END || ' on '
            || event_type || ', streak=' || streak)::VARCHAR AS message
        FROM outages WHERE event IN ('alert', 'recovery')""",
    "probe_hysteresis": f"""WITH {_ISLANDS},
        m AS (SELECT *, max(CASE WHEN position - island >= 3 THEN position END) OVER x AS down,
                     max(CASE WHEN position - last_bad >= 2 THEN position END) OVER x AS up
              FROM k WINDOW x AS (PARTITION BY event_type ORDER BY position))
        SELECT event_type, event_id,
               CASE WHEN coalesce(down, 0) > coalesce(up, 0) THEN 'down' ELSE 'up' END AS state
        FROM m""",
    "history_parse": r"""WITH l AS (SELECT conv_id, turn,
            strftime(TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn), '%Y-%m-%d %H:%M:%S') AS stamp,
            CASE WHEN turn = 2 THEN repeat('9', 23) WHEN role = 'assistant' THEN 'n/a'
                 ELSE length(text)::VARCHAR END AS tokens,
            replace(text, ',', '|') AS question FROM conversations WHERE turn <> 3)
        SELECT conv_id, turn, stamp AS timestamp,
            CASE WHEN regexp_full_match(tokens, '[0-9]+') THEN TRY_CAST(tokens AS BIGINT) ELSE 0 END AS tokens,
            question FROM l""",
    "history_recent": """WITH r AS (SELECT user_id, event_id,
            row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place,
            event_type || ' ' || props || ' ' || ts::VARCHAR AS question FROM events)
        SELECT user_id, place, event_id, substring(question, 1, 60) || '...' AS shown
        FROM r WHERE place <= 10""",
    "client_key": """SELECT event_id, CASE event_type WHEN 'click' THEN '10.0.0.' || user_id
            WHEN 'view' THEN '10.1.0.' || user_id WHEN 'purchase' THEN '10.1.0.' || user_id
            WHEN 'signup' THEN 'host-' || user_id ELSE 'unknown' END AS client FROM events""",
    "body_limit": """SELECT doc_id, lang NOT IN ('fr', 'de') AND n_chars > 2048 AS rejected
        FROM documents""",
    "collection_stats": """SELECT c AS collection, count(*) AS points_count,
            count(embedding) AS vectors_count
        FROM (SELECT embedding, 'internal' AS c FROM embeddings WHERE label <= 5
              UNION ALL SELECT embedding, 'external' FROM embeddings WHERE label >= 4) GROUP BY 1""",
    "dimension_audit": """WITH p AS (SELECT len(embedding) AS n, 'internal' AS collection
            FROM embeddings WHERE label <= 5
            UNION ALL SELECT len(embedding), 'external' FROM embeddings WHERE label >= 4)
        SELECT r.collection, 64 AS expected_dim, min(n) AS min_dim, max(n) AS max_dim,
               count(n) AS points_count, coalesce(min(n) = 64 AND max(n) = 64, false) AS ok
        FROM (VALUES ('internal'), ('external'), ('archive')) r(collection) LEFT JOIN p USING (collection)
        GROUP BY r.collection""",
    "tuning_hint": """SELECT c AS collection, count(*) AS points_count,
            trunc(least(512, greatest(64, 2 * sqrt(count(*) * 50))))::INT AS hint
        FROM (SELECT 'internal' AS c FROM embeddings WHERE label <= 5
              UNION ALL SELECT 'external' FROM embeddings WHERE label >= 4) GROUP BY 1""",
    "model_dimensions": """SELECT doc_id, CASE WHEN lang = 'en' THEN 3072 ELSE 1536 END AS dim
        FROM documents""",
    "neighbour_scores": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
        SELECT a.vec_id, len(a.v) AS dim, round(list_dot_product(a.v, b.v), 6) AS dot,
               round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v))
                     * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine,
               round(list_distance(a.v, b.v), 6) AS euclid
        FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""",
    "snapshot_retention": """WITH s AS (SELECT DISTINCT ts::DATE + INTERVAL 3 HOUR AS taken_at FROM events)
        SELECT taken_at, (epoch_us(TIMESTAMP '2024-01-31 02:00:00') - epoch_us(taken_at)) // 86400000000 AS age_days,
               (epoch_us(TIMESTAMP '2024-01-31 02:00:00') - epoch_us(taken_at)) // 86400000000 <= 14 AS keep
        FROM s""",
    "token_cost": f"""WITH {_LOG} SELECT strftime(ts, '%Y-%m') AS month, event_type AS model,
        count(*) AS calls, sum(tokens)::BIGINT AS tokens,
        sum(tokens)::BIGINT * 0.02::DOUBLE / 1e6::DOUBLE AS cost FROM log GROUP BY 1, 2""",
    "stage_events": f"""WITH {_LOG},
        s AS (SELECT 'embed' AS stage, event_type AS model, failed, seconds * 0.25::DOUBLE AS seconds,
                     NULL::BIGINT AS tokens FROM log
              UNION ALL SELECT 'generate', event_type, failed, seconds * 0.75::DOUBLE, tokens FROM log
              WHERE NOT failed)
        SELECT stage, model, CASE WHEN failed THEN 'embedding' ELSE 'ok' END AS status,
               count(*) AS events, round(sum(seconds), 6) AS seconds, sum(tokens)::BIGINT AS tokens
        FROM s GROUP BY ALL""",
    "quiet_minutes": """WITH m AS (SELECT event_id, ts,
            extract(hour FROM ts) * 60 + extract(minute FROM ts) AS minute_of_day FROM events)
        SELECT event_id, minute_of_day >= 1350 OR minute_of_day < 375 AS night,
               minute_of_day >= 540 AND minute_of_day < 1020 AS office,
               true AS always, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp,
               strftime(ts, '%Y%m%d_%H%M%S') AS file_stamp FROM m""",
    "retry_backoff": f"""WITH {_LOG}
        SELECT event_id, 0.2::DOUBLE * pow(2, tokens % 3) AS wait_seconds FROM log""",
}
