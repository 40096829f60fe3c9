"""Queries of request analytics and their streaming twins over events, with their SQL.

An event is a request attempt: ``value`` its latency, the id decides outcome, pod,
client and cache hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.functions.text import cpu_cores
from tessera.operators import ranges
from tessera.operators import requests as R
from tessera.operators.quantiles import linear
from tessera.session import cut, own_folder, table
from tessera.sources.writers import merge_ledgers
from tessera.streaming import windows as W

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
EDGES = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, float("inf"))
HOLD = 1800


def attempts(rows: DataFrame) -> DataFrame:
    """Attempts with what the client saw, classified."""
    i = F.col("event_id")
    k = i * 7 % 29
    status = F.when(k == 23, 429).when(k == 27, 500).when(k.isin(25, 26, 28), None).otherwise(200)
    error = F.when(k == 25, "timeout").when(k == 26, "refused").when(k == 28, "unsent")
    outcome = R.classify(status, k <= 22, F.when(k <= 22, 3).when(k == 24, 2).otherwise(0), error)
    return rows.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        outcome.alias("outcome"),
        F.concat(F.lit("pod-"), (F.col("user_id") % 4).cast("string")).alias("pod"),
        (F.col("user_id") % 6).alias("client"),
        F.when(i % 5 == 0, F.lit(None).cast("boolean")).otherwise(i % 3 == 0).alias("cache_hit"),
    )


_OUT = ", ".join(f"'{o}'" for o in R.OUTCOMES)
_A = f"""a AS (SELECT event_id, ts, user_id, event_type, value, CASE WHEN event_id * 7 % 29 < 22 THEN 'completed' ELSE ([{_OUT}])[least(event_id * 7 % 29 - 22, 6) + 1] END AS outcome,
'pod-' || (user_id % 4) AS pod, user_id % 6 AS client, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 3 = 0 END AS cache_hit FROM events)"""


def _attempts(spark, sf):
    return attempts(table(spark, sf, "events"))


def outcome_accounting(spark, sf):
    out = R.accounting(_attempts(spark, sf), "outcome", ["event_type"])
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("fraction") else c for c in out.columns])


OUTCOME_ACCOUNTING = f"""
WITH {_A}, c AS (SELECT event_type, count(*) AS planned, {", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in R.OUTCOMES)} FROM a GROUP BY event_type), s AS (SELECT *, planned - unsent AS sent FROM c)
SELECT *, round((interrupted + connection_error + error) / sent, 6) AS error_fraction, round(timeout / sent, 6) AS timeout_fraction, round(rejected / sent, 6) AS rejection_fraction,
       round((sent - completed) / sent, 6) AS unsuccessful_fraction, round(unsent / planned, 6) AS unsent_fraction FROM s
"""


def latency_quantiles(spark, sf):
    out = R.distribution(_attempts(spark, sf).where("outcome = 'completed'"), F.col("value"), ["event_type"])
    return out.select("event_type", "count", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99", "max")])


_DIST = "count(v) AS count, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, round(max(v), 6) AS max"
LATENCY_QUANTILES = f"WITH {_A} SELECT event_type, {_DIST} FROM (SELECT *, value AS v FROM a WHERE outcome = 'completed') GROUP BY event_type"


def per_pod_summary(spark, sf):
    rows = _attempts(spark, sf)
    base = rows.groupBy("pod").agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "completed").alias("successful"))
    good = R.distribution(rows.where("outcome = 'completed'"), F.col("value"), ["pod"]).select("pod", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))
    return base.join(good, "pod", "left")


PER_POD_SUMMARY = f"WITH {_A} SELECT pod, count(*) AS attempts, count(*) FILTER (outcome = 'completed') AS successful, round(quantile_cont(value, 0.5) FILTER (outcome = 'completed'), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (outcome = 'completed'), 6) AS p95 FROM a GROUP BY pod"


def cache_accounting(spark, sf):
    return R.cache_counts(_attempts(spark, sf).where("outcome = 'completed'"), F.col("cache_hit"), ["pod"]).withColumn("hit_fraction", F.round("hit_fraction", 6))


CACHE_ACCOUNTING = f"WITH {_A} SELECT pod, count(*) FILTER (cache_hit) AS hits, count(*) FILTER (NOT cache_hit) AS misses, count(*) FILTER (cache_hit IS NULL) AS unknown, round(count(*) FILTER (cache_hit) / nullif(count(cache_hit), 0), 6) AS hit_fraction FROM a WHERE outcome = 'completed' GROUP BY pod"


def inter_chunk(spark, sf):
    """Gaps between successive events of a user as one distribution, from arrays of at most 64 gaps."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    placed = ranges.ranged(table(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    seen = ranges.carried(placed, ["user_id"], ["ts", "event_id"], previous={"before": micros}, total={"i": F.lit(1)})
    gaps = seen.select("user_id", "i", ((micros - F.col("before")) / 1e6).alias("gap")).where("gap IS NOT NULL")
    nested = gaps.groupBy("user_id", F.floor(F.col("i") / 64).alias("piece")).agg(F.collect_list("gap").alias("gaps"))
    out = R.distribution(cut(nested.select(F.explode("gaps").alias("v"))), F.col("v"))
    return out.select("count", *[F.round(c, 4).alias(c) for c in ("mean", "p50", "p95", "p99", "max")])


INTER_CHUNK = "WITH g AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS us FROM events), h AS (SELECT us / 1e6 AS v FROM g WHERE us IS NOT NULL) SELECT count(v) AS count, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.95), 4) AS p95, round(quantile_cont(v, 0.99), 4) AS p99, round(max(v), 4) AS max FROM h"


def _buckets(spark, sf, where: str = "true"):
    return R.cumulative_buckets(table(spark, sf, "events").where(where).withColumn("pod", F.concat(F.lit("pod-"), (F.col("user_id") % 4).cast("string"))), F.col("value"), ["pod", "event_type"], EDGES)


_EDGES = "unnest([" + ", ".join("CAST('Infinity' AS DOUBLE)" if e == float("inf") else f"CAST({e} AS DOUBLE)" for e in EDGES) + "]) AS e(le)"


def _buckets_sql(where: str = "true") -> str:
    return f"SELECT pod, event_type, le, count(*) FILTER (value <= le) AS count FROM (SELECT *, 'pod-' || (user_id % 4) AS pod FROM events WHERE {where}), {_EDGES} GROUP BY ALL"


def histogram_buckets(spark, sf):
    return _buckets(spark, sf)


HISTOGRAM_BUCKETS = _buckets_sql()


def histogram_quantile(spark, sf):
    return stats.histogram_quantile(_buckets(spark, sf), 0.95, ["pod", "event_type"]).withColumn("quantile", F.round("quantile", 6))


def _quantile_sql(source: str, keys: str, q: float = 0.95) -> str:
    return f"""
SELECT {keys}, round(arg_min(CASE WHEN isinf(le) THEN lo WHEN count > before THEN lo + (le - lo) * (rank - before) / (count - before) ELSE le END, le) FILTER (count >= rank AND rank > 0), 6) AS quantile
FROM (SELECT *, lag(le, 1, 0.0) OVER (PARTITION BY {keys} ORDER BY le) AS lo, lag(count, 1, 0) OVER (PARTITION BY {keys} ORDER BY le) AS before, max(count) OVER (PARTITION BY {keys}) * {q} AS rank FROM ({source})) GROUP BY {keys}
"""


HISTOGRAM_QUANTILE = _quantile_sql(_buckets_sql(), "pod, event_type")


def histogram_delta(spark, sf):
    """What a month's counters gained after the 10th, summed over pods."""
    before, after = _buckets(spark, sf, "ts < TIMESTAMP '2024-01-10'"), _buckets(spark, sf)
    return R.histogram_delta(before, after, "pod", "event_type")


HISTOGRAM_DELTA = f"""
WITH b AS ({_buckets_sql("ts < TIMESTAMP '2024-01-10'")}), n AS ({_buckets_sql()})
SELECT event_type, le, CAST(sum(CASE WHEN n.count >= b.count THEN n.count - b.count ELSE 0 END) AS BIGINT) AS delta, bool_and(coalesce(n.count >= b.count, false)) AS valid FROM b FULL JOIN n USING (pod, event_type, le) GROUP BY ALL
"""


def cohort_gate(spark, sf):
    """Whether the histogram's gain is the number of requests a client counted, and its quantiles."""
    delta = histogram_delta(spark, sf).withColumnRenamed("delta", "count")
    q = stats.histogram_quantile(delta, 0.5, ["event_type"])
    total = delta.groupBy("event_type").agg(F.max("count").alias("gained"), F.bool_and("valid").alias("valid"))
    client = table(spark, sf, "events").where("ts >= TIMESTAMP '2024-01-10'").groupBy("event_type").agg(F.count("*").alias("successful"))
    joined = total.join(client, "event_type", "full_outer").join(q, "event_type", "left")
    return joined.select("event_type", "gained", (F.col("valid") & (F.col("gained") == F.col("successful"))).alias("valid"), F.round("quantile", 6).alias("quantile"))


COHORT_GATE = f"""
WITH d AS (SELECT event_type, le, delta AS count FROM ({HISTOGRAM_DELTA})), q AS ({_quantile_sql("SELECT * FROM d", "event_type", 0.5)}), c AS (SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1)
SELECT event_type, max(count) AS gained, max(count) = any_value(n) AS valid, any_value(quantile) AS quantile FROM d JOIN q USING (event_type) JOIN c USING (event_type) GROUP BY event_type
"""


def arrivals_per_hour(spark, sf):
    """Arrivals in each hour of a range, zeros included."""
    hours = table(spark, sf, "events").select(F.date_trunc("hour", "ts").alias("hour"))
    span = hours.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).where("a IS NOT NULL")
    grid = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    counts = hours.groupBy("hour").agg(F.count("*").alias("n"))
    return grid.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("arrivals"))


ARRIVALS_PER_HOUR = "WITH h AS (SELECT date_trunc('hour', ts) AS hour FROM events) SELECT g.hour, count(h.hour) AS arrivals FROM (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour) g LEFT JOIN h ON h.hour = g.hour GROUP BY g.hour"


def state_transitions(spark, sf):
    return R.transitions(table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "previous", "event_type")


STATE_TRANSITIONS = "SELECT event_id, user_id, lag(event_type) OVER w AS previous, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY row_number() OVER w = 1 OR event_type <> lag(event_type) OVER w"


def first_ready(spark, sf):
    """When each pod was first ready: its first signup."""
    e = _attempts(spark, sf)
    return e.groupBy("pod").agg(F.min("ts").alias("first_seen"), F.min_by("event_id", F.when(F.col("event_type") == "signup", F.struct("ts", "event_id"))).alias("event_id"))


FIRST_READY = f"WITH {_A} SELECT pod, min(ts) AS first_seen, arg_min(event_id, ts) FILTER (event_type = 'signup') AS event_id FROM a GROUP BY pod"


def ordered_pattern(spark, sf):
    """Users whose events go view, click, purchase, view in this order, others in between."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return R.follows_in_order(events, "user_id", ["ts", "event_id"], "event_type", ["view", "click", "purchase", "view"])


ORDERED_PATTERN = """
WITH v AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1), c AS (SELECT user_id, min(ts) AS t FROM events JOIN v USING (user_id) WHERE event_type = 'click' AND ts > v.t GROUP BY 1),
p AS (SELECT user_id, min(ts) AS t FROM events JOIN c USING (user_id) WHERE event_type = 'purchase' AND ts > c.t GROUP BY 1), w AS (SELECT DISTINCT user_id FROM events JOIN p USING (user_id) WHERE event_type = 'view' AND ts > p.t)
SELECT DISTINCT user_id, user_id IN (SELECT user_id FROM w) AS followed FROM events
"""


def _hourly(rows: DataFrame) -> DataFrame:
    out = W.ratio_alert(rows, "ts", ["pod"], F.col("outcome") != "completed", 0.25, 3, "2 hours", "1 hour")
    return out


def alert_windows(spark, sf):
    """Sliding windows of two hours with the share of failed requests."""
    return _hourly(_attempts(spark, sf)).select("window_start", "pod", "n", "bad", F.round("ratio", 6).alias("ratio"), "breach")


_WINDOWS = f"""
{_A}, w AS (SELECT date_trunc('hour', ts) - h * INTERVAL 1 HOUR AS window_start, * FROM a, (VALUES (0), (1)) t(h)),
r AS (SELECT window_start, pod, count(*) AS n, count(*) FILTER (outcome <> 'completed') AS bad FROM w GROUP BY ALL),
b AS (SELECT *, bad / n AS ratio, bad / n > 0.25 AND n >= 3 AS breach FROM r)
"""
ALERT_WINDOWS = f"WITH {_WINDOWS} SELECT window_start, pod, n, bad, round(ratio, 6) AS ratio, breach FROM b"


def alert_states(spark, sf):
    """inactive, pending and, after half an hour of breach, firing."""
    return R.alert_states(_hourly(_attempts(spark, sf)), "pod", "window_start", "breach", HOLD).select("window_start", "pod", "alert")


ALERT_STATES = f"""
WITH {_WINDOWS}, i AS (SELECT *, sum(CASE WHEN breach THEN 0 ELSE 1 END) OVER (PARTITION BY pod ORDER BY window_start) AS island FROM b),
s AS (SELECT *, min(window_start) FILTER (breach) OVER (PARTITION BY pod, island) AS since FROM i)
SELECT window_start, pod, CASE WHEN NOT breach THEN 'inactive' WHEN epoch(window_start) - epoch(since) >= {HOLD} THEN 'firing' ELSE 'pending' END AS alert FROM s
"""


def quantile_windows(spark, sf):
    """Sliding windows with the histogram quantile of latencies and whether it is over the limit."""
    out = W.quantile_alert(_attempts(spark, sf), "ts", ["event_type"], F.col("value"), EDGES, 0.95, 60.0, 5, "6 hours", "3 hours")
    return out.select("window_start", "event_type", "n", F.round("quantile", 6).alias("quantile"), "breach")


QUANTILE_WINDOWS = f"""
WITH w AS (SELECT to_timestamp(floor(epoch(ts) / 10800) * 10800)::TIMESTAMP - h * INTERVAL 3 HOUR AS window_start, event_type, value FROM events, (VALUES (0), (1)) t(h)),
b AS (SELECT window_start, event_type, le, count(*) FILTER (value <= le) AS count FROM w, {_EDGES} GROUP BY ALL), q AS ({_quantile_sql("SELECT * FROM b", "window_start, event_type")}), n AS (SELECT window_start, event_type, count(*) AS n FROM w GROUP BY ALL)
SELECT window_start, event_type, n, quantile, quantile > 60 AND n >= 5 AS breach FROM q JOIN n USING (window_start, event_type)
"""


def lru_hits(spark, sf):
    """Hits of an LRU cache of four users' kinds per pod, replayed in order."""
    rows = _attempts(spark, sf).select("event_id", "pod", "ts", F.concat_ws("-", "event_type", F.col("user_id") % 3).alias("item"))
    return R.lru_hits(rows, "pod", ["ts", "event_id"], "item", 8).select("event_id", "hit")


LRU_HITS = f"""
WITH {_A}, r AS (SELECT event_id, pod, event_type || '-' || (user_id % 3) AS item, row_number() OVER (PARTITION BY pod ORDER BY ts, event_id) AS i FROM a),
p AS (SELECT *, lag(i) OVER (PARTITION BY pod, item ORDER BY i) AS before FROM r)
SELECT x.event_id, x.before IS NOT NULL AND (SELECT count(DISTINCT y.item) FROM r y WHERE y.pod = x.pod AND y.i > x.before AND y.i < x.i) < 8 AS hit FROM p x
"""


def admission_queue(spark, sf):
    """A bounded first-in first-out queue per pod, replayed."""
    rows = _attempts(spark, sf).select(F.col("event_id").alias("id"), "pod", (F.unix_micros(F.col("ts").cast("timestamp")) / 60e6).alias("t"), F.col("value").alias("s"))
    return R.admission(rows, "pod", "t", "s", waiting=8, timeout=120.0)


# an arrival of each pod at a time
ADMISSION_QUEUE = """
WITH RECURSIVE r AS MATERIALIZED (SELECT event_id AS id, 'pod-' || (user_id % 4) AS pod, epoch_us(ts) / 60e6 AS t, value AS s, row_number() OVER (PARTITION BY user_id % 4 ORDER BY epoch_us(ts) / 60e6, event_id) AS k FROM events),
q AS (SELECT DISTINCT pod, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS DOUBLE) AS queue_seconds, CAST(-1e300 AS DOUBLE) AS free, CAST([] AS DOUBLE[]) AS waits FROM r
      UNION ALL SELECT pod, k, id, outcome, CASE outcome WHEN 'served' THEN start - t WHEN 'queue_timeout' THEN 120.0 END, CASE WHEN outcome = 'served' THEN start + s ELSE free END,
                       CASE WHEN outcome = 'queue_timeout' THEN list_append(waits, t + 120.0) WHEN outcome = 'served' AND start > t THEN list_append(waits, start) ELSE waits END
      FROM (SELECT *, CASE WHEN start > t AND len(waits) >= 8 THEN 'queue_full' WHEN start - t > 120.0 THEN 'queue_timeout' ELSE 'served' END AS outcome
            FROM (SELECT r.pod, r.k, r.id, r.t, r.s, q.free, greatest(r.t, q.free) AS start, list_filter(q.waits, lambda x: x > r.t) AS waits FROM q JOIN r ON r.pod = q.pod AND r.k = q.k + 1)))
SELECT id, pod AS server, outcome, queue_seconds FROM q WHERE k > 0
"""


def open_loop_schedule(spark, sf):
    """Arrivals at two a second, as many as there are events, four of five of one client."""
    return R.open_loop_schedule(spark, table(spark, sf, "events").count() / 2, 2, 4, True)


OPEN_LOOP_SCHEDULE = "SELECT i, i / 2.0 AS offset_seconds, CAST(CASE WHEN i % 5 <> 4 THEN 0 ELSE (i // 5) % 3 + 1 END AS BIGINT) AS client FROM range((SELECT count(*) FROM events)) t(i)"


def schedule_difference(spark, sf):
    """A plan of as many arrivals as there are events against these, as multisets: what is on one side only; every ninth went to another client."""
    events = table(spark, sf, "events")
    planned = R.open_loop_schedule(spark, events.count(), 1, 4).select("i", "client")
    actual = events.select(F.col("event_id").alias("i"), F.when(F.col("event_id") % 9 == 0, F.col("user_id") % 4).otherwise(F.col("event_id") % 4).alias("client"))
    side = lambda a, b, name: a.exceptAll(b).groupBy("i", "client").agg(F.count("*").alias("times")).withColumn("side", F.lit(name))
    return side(planned, actual, "planned").unionByName(side(actual, planned, "actual"))


SCHEDULE_DIFFERENCE = """
WITH p AS (SELECT i, i % 4 AS client FROM range((SELECT count(*) FROM events)) t(i)), a AS (SELECT event_id AS i, CASE WHEN event_id % 9 = 0 THEN user_id % 4 ELSE event_id % 4 END AS client FROM events)
SELECT i, client, count(*) AS times, 'planned' AS side FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM a) GROUP BY ALL UNION ALL SELECT i, client, count(*), 'actual' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM p) GROUP BY ALL
"""


def routing_trace(spark, sf):
    e = _attempts(spark, sf).select(F.col("event_id").alias("request_id"), "client", F.concat(F.lit("10.0.0."), (F.col("user_id") % 5).cast("string")).alias("client_ip"), F.when(F.col("outcome") != "unsent", F.col("pod")).alias("pod"))
    logs = table(spark, sf, "events").where("event_id % 4 < 3").select(F.col("event_id").alias("request_id"), F.concat(F.lit("10.0.0."), F.when(F.col("event_id") % 7 == 0, F.lit("9")).otherwise((F.col("user_id") % 5).cast("string"))).alias("source_ip"))
    return R.routing_trace(e, logs)


ROUTING_TRACE = f"""
WITH {_A}, e AS (SELECT event_id, client, '10.0.0.' || (user_id % 5) AS client_ip, coalesce(CASE WHEN outcome <> 'unsent' THEN pod END, 'no response') AS pod, user_id FROM a),
l AS (SELECT event_id, '10.0.0.' || CASE WHEN event_id % 7 = 0 THEN '9' ELSE CAST(user_id % 5 AS VARCHAR) END AS ip FROM events WHERE event_id % 4 < 3)
SELECT client, client_ip, pod, count(*) AS requests, count(ip) AS matched, count(*) FILTER (ip <> client_ip) AS mismatched FROM e LEFT JOIN l USING (event_id) GROUP BY ALL
"""


def routing_decision(spark, sf):
    """Runs are weeks of two policies: even users are routed normally, odd ones by address."""
    e = _attempts(spark, sf).withColumn("policy", F.when(F.col("user_id") % 2 == 0, "normal").otherwise("clientip")).withColumn("run", F.least(F.floor(F.dayofmonth("ts") / 11), F.lit(2)))
    latency = e.where("outcome = 'completed'")
    p95 = linear(latency, ["policy", "run"], "value", {"p95": 0.95}).drop("n")
    runs = e.groupBy("policy", "run").agg(F.count_if(F.col("outcome") != "unsent").alias("sent"), F.count_if(F.col("outcome") == "completed").alias("successful")).join(p95, ["policy", "run"], "left")
    return R.routing_decision(runs)


ROUTING_DECISION = f"""
WITH {_A}, r AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'normal' ELSE 'clientip' END AS policy, least(day(ts) // 11, 2) AS run, quantile_cont(value, 0.95) FILTER (outcome = 'completed') AS p95, count(*) FILTER (outcome <> 'unsent') AS sent, count(*) FILTER (outcome = 'completed') AS ok FROM a GROUP BY ALL),
p AS (SELECT policy, count(*) AS k, median(p95) AS m, sum(sent - ok) / sum(sent) AS f FROM r GROUP BY policy)
SELECT CASE WHEN n.m < c.m AND n.f <= c.f AND n.k = 3 AND c.k = 3 THEN 'normal' END AS choice, n.k = 3 AND c.k = 3 AS ready FROM p n, p c WHERE n.policy = 'normal' AND c.policy = 'clientip'
"""


def interval_join(spark, sf):
    """Errors of a user within five to sixty minutes before a purchase: equal keys and a range, bucketed by hour."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("h"))
    purchases = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", F.col("ts").alias("at"), F.explode(F.array(F.col("h"), F.col("h") - 1)).alias("h"))
    errors = e.where("event_type = 'error'").select(F.col("event_id").alias("error"), "user_id", "ts", "h")
    gap = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return purchases.join(errors, ["user_id", "h"]).where(gap.between(300_000_000, 3_600_000_000)).select("purchase", "error")


INTERVAL_JOIN = "SELECT p.event_id AS purchase, e.event_id AS error FROM events p JOIN events e ON p.user_id = e.user_id AND p.event_type = 'purchase' AND e.event_type = 'error' AND epoch_us(p.ts) - epoch_us(e.ts) BETWEEN 300000000 AND 3600000000"


def chunk_contract(spark, sf):
    """Requests whose stream of chunks ended as declared: users' days as requests, purchases as final markers."""
    e = table(spark, sf, "events").select(F.concat_ws("-", "user_id", F.dayofmonth("ts")).alias("request"), "event_type", "event_id")
    return W.completion(e, "request", F.col("event_type") == "purchase", F.col("event_id") % 3)


CHUNK_CONTRACT = """
WITH e AS (SELECT user_id || '-' || day(ts) AS request, event_type = 'purchase' AS done, event_id % 3 AS declared FROM events)
SELECT request, count(*) FILTER (NOT done) AS chunks, max(declared) FILTER (done) AS declared, coalesce(count(*) FILTER (done) = 1 AND count(*) FILTER (NOT done) = max(declared) FILTER (done), false) AS clean FROM e GROUP BY request
"""


KINDS = ("view", "click", "purchase", "error", "signup")


def merged_ledger(spark, sf):
    """The logs of all kinds of events, whose columns differ, in one ledger; a kind that is not known is an entry of its own."""
    e = table(spark, sf, "events")
    logs = [e.where(F.col("event_type") == k).select("event_id", "value" if i % 2 else "user_id", F.lit(k).alias("run")) for i, k in enumerate(KINDS)]
    other = e.where(F.col("event_type").isNull() | ~F.col("event_type").isin(*KINDS)).select("event_id", F.lit("other").alias("run"))
    return merge_ledgers([*logs, other], ["run", "event_id"])


MERGED_LEDGER = """
SELECT event_id, CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN user_id END AS user_id, CASE WHEN event_type IN ('view', 'click', 'purchase', 'error', 'signup') THEN event_type ELSE 'other' END AS run,
       CASE WHEN event_type IN ('click', 'error') THEN value END AS value FROM events
"""


def log_violations(spark, sf):
    """Requests that break an invariant of the log, as a sorted set of reasons per pod."""
    e = _attempts(spark, sf)
    reasons = F.filter(F.array(F.when((F.col("outcome") == "completed") & (F.col("value") > 200), F.lit("slow success")), F.when((F.col("outcome") == "rejected") & (F.col("value") > 1), F.lit("slow rejection")), F.when(F.col("cache_hit") & (F.col("value") > 100), F.lit("slow hit"))), lambda x: x.isNotNull())
    return e.select("pod", F.explode(reasons).alias("r")).groupBy("pod").agg(F.array_join(F.array_sort(F.collect_set("r")), "; ").alias("violations"))


LOG_VIOLATIONS = f"""
WITH {_A}, r AS (SELECT pod, unnest(list_filter([CASE WHEN outcome = 'completed' AND value > 200 THEN 'slow success' END, CASE WHEN outcome = 'rejected' AND value > 1 THEN 'slow rejection' END, CASE WHEN cache_hit AND value > 100 THEN 'slow hit' END], lambda x: x IS NOT NULL)) AS r FROM a)
SELECT pod, string_agg(DISTINCT r, '; ' ORDER BY r) AS violations FROM r GROUP BY pod
"""


def outcome_classes(spark, sf):
    """Outcomes from status, completion, chunks and error by ordered cases; all combinations occur."""
    i = F.col("event_id")
    status = F.when(i % 5 == 0, 200).when(i % 5 == 1, 429).when(i % 5 == 2, 503).when(i % 5 == 3, 500)
    error = F.when(i % 7 == 1, "timeout").when(i % 7 == 2, "reset by peer").when(i % 7 == 3, "")
    return table(spark, sf, "events").select("event_id", R.classify(status, i % 2 == 0, i % 3, error).alias("outcome"), cpu_cores(F.when(i % 2 == 0, F.concat((i % 900).cast("string"), F.lit("m"))).otherwise((i % 9).cast("string"))).alias("cores"))


OUTCOME_CLASSES = """
WITH t(s5, e7, r) AS (VALUES (1, NULL, 'rejected'), (2, NULL, 'rejected'), (3, NULL, 'error'), (0, 1, 'timeout'), (4, 1, 'timeout'), (0, 2, 'interrupted')),
e AS (SELECT event_id AS i, event_id % 5 AS s5, event_id % 7 AS e7, event_id % 3 > 0 AS chunks, event_id % 2 = 0 AS done FROM events)
SELECT i AS event_id, coalesce((SELECT r FROM t WHERE t.s5 = e.s5 AND (t.e7 IS NULL OR t.e7 = e.e7)), CASE WHEN done AND e7 <> 2 THEN 'completed' WHEN s5 = 0 OR chunks THEN 'interrupted' ELSE 'connection_error' END) AS outcome,
CASE WHEN i % 2 = 0 THEN (i % 900) / 1000 ELSE CAST(i % 9 AS DOUBLE) END AS cores FROM e
"""


# -- streams: the same files read as a stream and run to their end


def _stream(spark, sf) -> DataFrame:
    return attempts(W.read_events(spark, sf, "events.parquet", EVENTS))


def _drained(spark, stream: DataFrame, mode: str) -> DataFrame:
    return W.drain(stream, f"{own_folder(spark, 'stream')}/out", mode)


def stream_alert_windows(spark, sf):
    """The sliding windows of alert_windows, by a stream."""
    out = _drained(spark, _hourly(_stream(spark, sf)), "complete")
    return out.select("window_start", "pod", "n", "bad", F.round("ratio", 6).alias("ratio"), "breach")


STREAM_ALERT_WINDOWS = ALERT_WINDOWS


def stream_lru_hits(spark, sf):
    """The cache hits of lru_hits, by a stateful stream."""
    rows = _stream(spark, sf).select("event_id", "pod", "ts", F.concat_ws("-", "event_type", F.col("user_id") % 3).alias("item"))
    out = _drained(spark, W.lru_stream(rows, "pod", "ts", "item", 8, F.col("event_id")), "append")
    return out.groupBy("key", "item").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


STREAM_LRU_HITS = f"SELECT pod AS key, event_type || '-' || (user_id % 3) AS item, count(*) AS n, count(*) FILTER (hit) AS hits FROM (SELECT 'pod-' || (user_id % 4) AS pod, * FROM events) JOIN ({LRU_HITS}) USING (event_id) GROUP BY ALL"


def stream_sessions(spark, sf):
    """Sessions of users with gaps below two hours, by a stream with a watermark; the last ones stay open."""
    out = W.sessions(_stream(spark, sf), "ts", "user_id", "2 hours", [F.count("*").alias("n")], "10 minutes")
    closed = _drained(spark, out, "append")
    return closed.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


STREAM_SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g),
c AS (SELECT user_id, s, count(*) AS n, max(ts) + INTERVAL 2 HOUR AS until FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, sum(n) AS events FROM c WHERE until <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY user_id
"""


def stream_alert_states(spark, sf):
    """Changes of the alert of each pod, by a state machine over streamed events in any order: breaches are slow requests.

    As far as the watermark, ten minutes before the last event, has come."""
    rows = _stream(spark, sf).withColumn("breach", F.col("value") > 20)
    out = _drained(spark, W.alert_machine(rows, "pod", "ts", "breach", HOLD, F.col("event_id")), "append")
    return out.groupBy("key", "alert").agg(F.count("*").alias("times"))


STREAM_ALERT_STATES = f"""
WITH e AS (SELECT 'pod-' || (user_id % 4) AS key, ts, event_id, value > 20 AS breach FROM events WHERE epoch_ms(ts) < (SELECT epoch_ms(max(ts)) FROM events) - 600000),
i AS (SELECT *, sum(CASE WHEN breach THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY ts, event_id) AS island FROM e),
s AS (SELECT *, min(ts) FILTER (breach) OVER (PARTITION BY key, island) AS since FROM i), a AS (SELECT *, CASE WHEN NOT breach THEN 'inactive' WHEN floor(epoch(ts)) - floor(epoch(since)) >= {HOLD} THEN 'firing' ELSE 'pending' END AS alert FROM s)
SELECT key, alert, count(*) AS times FROM (SELECT *, lag(alert, 1, 'inactive') OVER (PARTITION BY key ORDER BY ts, event_id) AS before FROM a) WHERE alert <> before GROUP BY ALL
"""


def stream_interval_join(spark, sf):
    """The pairs of interval_join, by a join of two streams that forgets what can have no partner any more."""
    events = W.read_events(spark, sf, "events.parquet", EVENTS)
    purchases = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", F.col("ts").alias("at"))
    errors = events.where("event_type = 'error'").select(F.col("event_id").alias("error"), "user_id", "ts")
    pairs = W.interval_matches(purchases, errors, "user_id", "at", "ts", "5 MINUTES", "60 MINUTES")
    return _drained(spark, pairs.select("purchase", "error"), "append")


STREAM_INTERVAL_JOIN = INTERVAL_JOIN

QUERIES = {
    f.__name__: f
    for f in (
        outcome_accounting, latency_quantiles, per_pod_summary, cache_accounting, inter_chunk, histogram_buckets, histogram_quantile, histogram_delta, cohort_gate, arrivals_per_hour,
        state_transitions, first_ready, ordered_pattern, alert_windows, alert_states, quantile_windows, lru_hits, admission_queue, open_loop_schedule, schedule_difference, routing_trace,
        routing_decision, interval_join, chunk_contract, merged_ledger, log_violations, outcome_classes, stream_alert_windows, stream_lru_hits, stream_sessions, stream_alert_states, stream_interval_join,
    )
}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
