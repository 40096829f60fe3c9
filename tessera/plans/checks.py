"""Queries of set comparisons, gates over earlier results, and capacity studies, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import ident, text
from tessera.operators import dedup, evaluate, ranges, runs, sets, split
from tessera.plans import curation, scoring
from tessera.plans import requests as req
from tessera.session import cut, table
from tessera.sources.readers import canonical_json


def record_equality(spark, sf):
    """Documents against their source: which fields differ, after every seventh was edited."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    edited = d.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang"))).withColumn("n_chars", F.when(F.col("doc_id") % 14 == 0, None).otherwise(F.col("n_chars")))
    return sets.changed_records(d, edited, "doc_id", ["lang", "source", "n_chars"])


RECORD_EQUALITY = "SELECT doc_id, CASE WHEN doc_id % 14 = 0 THEN 'lang,n_chars' ELSE 'lang' END AS columns FROM documents WHERE doc_id % 7 = 0"


def set_operations(spark, sf):
    """Sizes of intersection, differences and union of the customers of two years, and what holds of them."""
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    a, b = (o.where(F.col("y") == y).select("o_custkey").distinct() for y in (1995, 1996))
    size = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    out = size(a.intersect(b), "both").unionAll(size(a.subtract(b), "left")).unionAll(size(b.subtract(a), "right")).unionAll(size(a.union(b).distinct(), "any"))
    return out.unionAll(size(sets.one_sided(a, b, "o_custkey"), "one side"))


SET_OPERATIONS = """
WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1995), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996)
SELECT 'both' AS what, count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'left', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'right', count(*) FROM (FROM b EXCEPT FROM a)
UNION ALL SELECT 'any', count(*) FROM (FROM a UNION FROM b) UNION ALL SELECT 'one side', count(*) FROM ((FROM a EXCEPT FROM b) UNION (FROM b EXCEPT FROM a))
"""


def contamination_examples(spark, sf):
    """Keys that two parts of the documents share: how many rows each has, and the first three."""
    d = cut(table(spark, sf, "documents").select("doc_id", F.sha2(text.normalize_text(F.col("text")), 256).alias("k")))
    over = dedup.key_overlap(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), F.col("k"), "doc_id", "doc_id")
    return over.select(F.col("key").alias("digest"), "left_rows", "right_rows", F.array_join("left_ids", ",").alias("left_ids"), F.array_join("right_ids", ",").alias("right_ids"))


CONTAMINATION_EXAMPLES = f"""
WITH d AS (SELECT doc_id, {curation.norm('text')} AS k FROM documents), g AS (SELECT k, list_sort(list(doc_id) FILTER (doc_id % 2 = 0)) AS l, list_sort(list(doc_id) FILTER (doc_id % 2 = 1)) AS r FROM d GROUP BY k)
SELECT sha256(k) AS digest, len(l) AS left_rows, len(r) AS right_rows, array_to_string(l[1:3], ',') AS left_ids, array_to_string(r[1:3], ',') AS right_ids FROM g WHERE len(l) > 0 AND len(r) > 0
"""


def contamination_gate(spark, sf):
    """The verdict: every counter is zero."""
    return curation.contamination_report(spark, sf).agg((F.sum("value") == 0).alias("passed"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("value") > 0, F.col("metric")))), ",").alias("broken"))


CONTAMINATION_GATE = f"SELECT sum(value) = 0 AS passed, coalesce(string_agg(CASE WHEN value > 0 THEN metric END, ',' ORDER BY metric), '') AS broken FROM ({curation.CONTAMINATION_REPORT})"


def split_gate(spark, sf):
    """The verdict on a split: its drift is within the limit and no group is in two splits."""
    rows = curation._split_rows(spark, sf)
    drift = split.drift(rows, "split", "labels").agg(F.coalesce(F.max("total_variation"), F.lit(0.0)).alias("drift"))
    shared = split.overlaps(rows, "split", "grp").agg(F.coalesce(F.sum("shared_groups"), F.lit(0).cast("long")).alias("shared"))
    return drift.crossJoin(shared).select(F.round("drift", 6).alias("drift"), "shared", ((F.col("drift") <= 0.10) & (F.col("shared") == 0)).alias("passed"))  # one row each


SPLIT_GATE = f"""
SELECT drift, shared, drift <= 0.10 AND shared = 0 AS passed FROM (SELECT max(total_variation) AS drift FROM ({curation.GROUP_SPLIT_DRIFT})), 
(WITH {curation._SPLIT_SQL}, p AS (SELECT DISTINCT split, grp FROM r) SELECT count(*) AS shared FROM p a JOIN p b ON a.grp = b.grp AND a.split < b.split)
"""


def report_recompute(spark, sf):
    """A stored report against its recomputation: the metrics of slices that do not agree, one having been altered."""
    scores = scoring._scores(spark, sf, 0)
    fresh = evaluate.by_slice(scores, scoring._labels(spark))
    stored = fresh.withColumn("correct", F.when(F.col("slice") == "all", F.col("correct") + 1).otherwise(F.col("correct")))
    near = lambda c: F.abs(F.col(f"f.{c}") - F.col(f"s.{c}")) <= 1e-12
    joined = fresh.alias("f").join(stored.alias("s"), "slice", "full_outer")
    ok = F.lit(True)
    for c in ("n", "correct", "valid", "accuracy", "micro_f1", "macro_f1"):
        ok = ok & near(c)
    return joined.where(~F.coalesce(ok, F.lit(False))).select("slice")


REPORT_RECOMPUTE = f"""
WITH f AS ({scoring.SCORE_SLICES}), s AS (SELECT * REPLACE (CASE WHEN slice = 'all' THEN correct + 1 ELSE correct END AS correct) FROM f)
SELECT coalesce(f.slice, s.slice) AS slice FROM f FULL JOIN s ON f.slice = s.slice WHERE f.n IS DISTINCT FROM s.n OR f.correct IS DISTINCT FROM s.correct OR f.valid IS DISTINCT FROM s.valid
"""


def workload_identity(spark, sf):
    """Whether all runs of a kind of traffic had the same schedule, by a digest of each."""
    e = table(spark, sf, "events").select((F.col("event_id") % 3).alias("run"), (F.col("event_id") % 2).alias("traffic"), F.floor(F.col("event_id") / 6).alias("i"), (F.floor(F.col("event_id") / 6) % 5).alias("client"))
    digests = sets.multiset_digests(e, ["i", "client"], ["traffic", "run"])
    return digests.groupBy("traffic").agg(F.count("*").alias("runs"), (F.count_distinct("digest") == 1).alias("same"))


WORKLOAD_IDENTITY = """
WITH e AS (SELECT event_id % 3 AS run, event_id % 2 AS traffic, event_id // 6 AS i FROM events), d AS (SELECT traffic, run, string_agg(i || ':' || (i % 5), ';' ORDER BY i) AS d FROM e GROUP BY ALL)
SELECT traffic, count(*) AS runs, count(DISTINCT d) = 1 AS same FROM d GROUP BY traffic
"""


def counter_resets(spark, sf):
    """Per user, how often a counter went down from one event to the next."""
    counter = F.col("event_id") % 50
    placed = ranges.ranged(table(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    rows = ranges.carried(placed, ["user_id"], ["ts", "event_id"], previous={"before": counter}).select("user_id", (counter < F.col("before")).alias("down"))
    return rows.groupBy("user_id").agg(F.count_if("down").alias("resets"))


COUNTER_RESETS = "SELECT user_id, count(*) FILTER (down) AS resets FROM (SELECT user_id, event_id % 50 < lag(event_id % 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS down FROM events) GROUP BY user_id"


def scale_down_latency(spark, sf):
    """Minutes from the last purchase of each pod to the first error after it."""
    e = req._attempts(spark, sf).select("pod", "ts", "event_type")
    stop = e.where("event_type = 'purchase'").groupBy("pod").agg(F.max("ts").alias("stopped"))
    after = e.where("event_type = 'error'").join(stop, "pod").where("ts > stopped").groupBy("pod", "stopped").agg(F.min("ts").alias("down"))
    gap = F.unix_micros(F.col("down").cast("timestamp")) - F.unix_micros(F.col("stopped").cast("timestamp"))
    return stop.join(after.select("pod", "stopped", "down"), ["pod", "stopped"], "left").select("pod", F.round(gap / 60e6, 3).alias("minutes"))


SCALE_DOWN_LATENCY = """
WITH e AS (SELECT 'pod-' || (user_id % 4) AS pod, ts, event_type FROM events), s AS (SELECT pod, max(ts) AS stopped FROM e WHERE event_type = 'purchase' GROUP BY pod)
SELECT s.pod, round((epoch_us(min(e.ts)) - epoch_us(any_value(stopped))) / 60e6, 3) AS minutes FROM s LEFT JOIN e ON e.pod = s.pod AND e.event_type = 'error' AND e.ts > s.stopped GROUP BY s.pod
"""


def affinity_study(spark, sf):
    """The busiest replica's share of requests: dealt by client, and in turn."""
    e = table(spark, sf, "events").select((F.least(F.col("user_id") % 6, F.lit(2))).alias("client"), (F.col("event_id") % 3).alias("turn"))
    by_client = e.select(F.lit("by client").alias("policy"), ident.hex_mod(F.sha2(F.col("client").cast("string"), 256), 3).alias("replica"))
    both = by_client.unionAll(e.select(F.lit("in turn").alias("policy"), F.col("turn").alias("replica")))
    loads = both.groupBy("policy", "replica").agg(F.count("*").alias("n"))
    return loads.groupBy("policy").agg(F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"), F.count("*").alias("replicas"))


AFFINITY_STUDY = """
WITH e AS (SELECT least(user_id % 6, 2) AS c, event_id % 3 AS t FROM events),
b AS (SELECT 'by client' AS policy, list_reduce(list_transform(string_split(sha256(CAST(c AS VARCHAR)), ''), lambda x: CAST(strpos('0123456789abcdef', x) - 1 AS BIGINT)), lambda a, x: (a * 16 + x) % 3) % 3 AS r FROM e UNION ALL SELECT 'in turn', t FROM e),
l AS (SELECT policy, r, count(*) AS n FROM b GROUP BY ALL)
SELECT policy, round(max(n) / sum(n), 6) AS largest_share, count(*) AS replicas FROM l GROUP BY policy
"""


def batch_benchmark(spark, sf):
    """Throughput and latency by concurrency, errors apart."""
    e = req._attempts(spark, sf).withColumn("concurrency", F.col("user_id") % 2 + 1)
    ok = F.col("outcome") == "completed"
    out = e.groupBy("concurrency").agg(F.count("*").alias("requests"), F.count_if(~ok).alias("errors"), F.round(F.avg(F.when(ok, F.col("value"))), 6).alias("mean"), F.max(F.when(ok, F.col("value"))).alias("max"), F.round(F.try_divide(F.count_if(ok).cast("double"), F.sum(F.when(ok, F.col("value")))), 6).alias("throughput"))
    return out


BATCH_BENCHMARK = f"WITH {req._A} SELECT user_id % 2 + 1 AS concurrency, count(*) AS requests, count(*) FILTER (outcome <> 'completed') AS errors, round(avg(value) FILTER (outcome = 'completed'), 6) AS mean, max(value) FILTER (outcome = 'completed') AS max, round(count(*) FILTER (outcome = 'completed') / sum(value) FILTER (outcome = 'completed'), 6) AS throughput FROM a GROUP BY 1"


def ready_pods(spark, sf):
    """Samples of pods and whether their nested conditions say ready."""
    e = table(spark, sf, "events")
    condition = lambda kind, ok: F.struct(F.lit(kind).alias("type"), F.when(ok, "True").otherwise("False").alias("status"))
    conditions = F.when(F.col("event_id") % 11 != 0, F.array(condition("Initialized", F.lit(True)), condition("Ready", F.col("event_type") == "view")))
    return e.select("event_id", sets.ready(conditions).alias("ready"))


READY_PODS = "SELECT event_id, event_id % 11 <> 0 AND event_type = 'view' AS ready FROM events"


def canonical_json_digests(spark, sf):
    """sha256 of records as canonical JSON: sorted keys, no spaces."""
    d = table(spark, sf, "documents")
    inner = F.struct(F.col("lang").alias("y"), F.lit(None).cast("string").alias("b"))
    return d.select("doc_id", F.struct(F.col("source").alias("z"), F.col("doc_id").alias("a"), inner.alias("m")).alias("r")).select("doc_id", F.sha2(canonical_json(F.col("r")), 256).alias("digest"))


CANONICAL_JSON_DIGESTS = """SELECT doc_id, sha256('{"a":' || doc_id || ',"m":{"b":null,"y":"' || lang || '"},"z":"' || source || '"}') AS digest FROM documents"""


def run_selection(spark, sf):
    """Runs of suppliers in one region whose loss fell enough: the best of each nation."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("run_id"), F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("kind"), F.when(F.col("s_suppkey") % 2 == 0, "lora").otherwise("full")).alias("tags"), F.col("s_nationkey").alias("nation"), F.lit(2.5).alias("base_loss"), F.round(F.abs("s_acctbal") % 997 / 400, 6).alias("final_loss"))
    return runs.best(runs.passing(runs.search_runs(s, {"kind": "lora"}), 0.9), ["nation"])


RUN_SELECTION = """
SELECT s_nationkey AS nation, round(abs(s_acctbal) % 997 / 400, 6) AS final_loss, s_suppkey AS run_id FROM supplier WHERE s_suppkey % 2 = 0 AND round(abs(s_acctbal) % 997 / 400, 6) / 2.5 <= 0.9
QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY round(abs(s_acctbal) % 997 / 400, 6), s_suppkey) = 1
"""

QUERIES = {
    f.__name__: f
    for f in (
        record_equality, set_operations, contamination_examples, contamination_gate, split_gate, report_recompute, workload_identity, counter_resets, scale_down_latency,
        affinity_study, batch_benchmark, ready_pods, canonical_json_digests, run_selection,
    )
}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
