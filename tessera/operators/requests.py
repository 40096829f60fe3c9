"""Request logs: outcomes, latencies, histograms, routing, transitions, alerts, caches, queues."""

from __future__ import annotations

import itertools
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.stats import finite
from tessera.operators import ranges
from tessera.operators.quantiles import linear

#: fixed values
OUTCOMES = ("completed", "rejected", "interrupted", "timeout", "connection_error", "error", "unsent")
EDGES = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0, float("inf"))


def classify(status: Column, completed: Column, chunks: Column, error: Column) -> Column:
    """The outcome of an attempt; the first case that holds.

    A refusal by the server decides before anything that followed it; 429 and 503 are
    rejections.  An error text or a missing end is an interruption where an answer had
    begun (status 200 or a chunk), else the connection failed.  'unsent' marks attempts
    that the scheduler never made."""
    begun = F.coalesce(status == 200, F.lit(False)) | (F.coalesce(chunks, F.lit(0)) > 0)
    broken = F.when(begun, "interrupted").otherwise("connection_error")
    refused = F.when(status.isin(429, 503), "rejected").otherwise("error")
    failed = F.coalesce(error, F.lit("")) != ""
    return (
        F.when(status >= 400, refused)
        .when(error == "unsent", "unsent")
        .when(error == "timeout", "timeout")
        .when(~failed & F.coalesce(completed, F.lit(False)), "completed")
        .otherwise(broken)
    )


def accounting(rows: DataFrame, outcome: str, keys: list[str] | None = None) -> DataFrame:
    """Counts of every outcome, planned, sent, and shares that are null where nothing was sent."""
    counts = [F.count_if(F.col(outcome) == o).alias(o) for o in OUTCOMES]
    base = rows.groupBy(*(keys or [])).agg(F.count("*").alias("planned"), *counts).withColumn("sent", F.col("planned") - F.col("unsent"))
    share = lambda x: F.try_divide(x.cast("double"), F.col("sent").cast("double"))
    return base.withColumns(
        {
            "error_fraction": share(F.col("interrupted") + F.col("connection_error") + F.col("error")),
            "timeout_fraction": share(F.col("timeout")),
            "rejection_fraction": share(F.col("rejected")),
            "unsuccessful_fraction": share(F.col("sent") - F.col("completed")),
            "unsent_fraction": F.try_divide(F.col("unsent").cast("double"), F.col("planned").cast("double")),
        }
    )


def distribution(rows: DataFrame, value: Column, keys: list[str] | None = None) -> DataFrame:
    """count, mean, p50, p95, p99 and max of the finite values, linear between neighbours; null where there are none.

    Quantiles are exact and by ranges, so a group may hold any number of distinct values."""
    keys = keys or []
    values = rows.select(*keys, F.when(finite(value), value).alias("__value"))
    whole = values.groupBy(*keys).agg(F.count("__value").alias("count"), F.avg("__value").alias("mean"), F.max("__value").alias("max"))
    placed = linear(values, keys, "__value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("n")
    both = whole.join(placed.withColumnsRenamed({k: f"__{k}" for k in keys}), _all(F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)) if keys else whole.crossJoin(placed)  # one row each
    return both.select(*keys, "count", "mean", "p50", "p95", "p99", "max")


def _all(tests: Iterable[Column]) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def cache_counts(rows: DataFrame, hit: Column, keys: list[str] | None = None) -> DataFrame:
    base = rows.groupBy(*(keys or [])).agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"), F.count_if(~F.coalesce(hit, F.lit(True))).alias("misses"), F.count_if(hit.isNull()).alias("unknown"))
    return base.withColumn("hit_fraction", F.try_divide(F.col("hits").cast("double"), (F.col("hits") + F.col("misses")).cast("double")))


def cumulative_buckets(rows: DataFrame, value: Column, keys: list[str], edges: tuple[float, ...] = EDGES) -> DataFrame:
    """``(keys, le, count)``: how many finite values are at most each edge; all edges for every key."""
    v = F.when(finite(value), value)
    sums = rows.groupBy(*keys).agg(*[F.count_if(v <= e).alias(f"b{i}") for i, e in enumerate(edges)])
    return sums.select(*keys, F.explode(F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"b{i}").alias("count")) for i, e in enumerate(edges)])).alias("b")).select(*keys, "b.le", "b.count")


def histogram_delta(before: DataFrame, after: DataFrame, pod: str, metric: str) -> DataFrame:
    """``(metric, le, delta, valid)``: after less before, summed over pods.

    Not valid where a pod or an edge is on one side only or a counter went down."""
    a, b = before.select(pod, metric, "le", F.col("count").alias("was")), after.select(pod, metric, "le", F.col("count").alias("now"))
    both = a.join(b, [pod, metric, "le"], "full_outer")
    ok = F.coalesce(F.col("now") >= F.col("was"), F.lit(False))
    return both.groupBy(metric, "le").agg(F.sum(F.when(ok, F.col("now") - F.col("was")).otherwise(0)).alias("delta"), F.bool_and(ok).alias("valid"))


def routing_trace(attempts: DataFrame, logs: DataFrame) -> DataFrame:
    """``(client, client_ip, pod, requests, matched, mismatched)``: attempts against the source addresses logged for them.

    ``attempts(request_id, client, client_ip, pod)``, ``logs(request_id, source_ip)``."""
    seen = logs.where("request_id IS NOT NULL AND source_ip IS NOT NULL").groupBy("request_id").agg(F.min("source_ip").alias("low"), F.max("source_ip").alias("high"))
    joined = attempts.join(seen, "request_id", "left")
    matched = F.col("low").isNotNull()
    wrong = matched & ~((F.col("low") == F.col("high")) & F.col("low").eqNullSafe(F.col("client_ip")))
    return joined.groupBy("client", "client_ip", F.coalesce("pod", F.lit("no response")).alias("pod")).agg(F.count("*").alias("requests"), F.count_if(matched).alias("matched"), F.count_if(wrong).alias("mismatched"))


def routing_decision(runs: DataFrame, repeats: int = 3) -> DataFrame:
    """``(choice)``: 'normal' if its median run p95 is lower at no higher share of failures than 'clientip', else null.

    ``runs(policy, p95, sent, successful)``; both policies need ``repeats`` runs with a p95."""
    by = runs.groupBy("policy").agg(F.count("*").alias("k"), F.count("p95").alias("measured"), F.percentile("p95", F.lit(0.5)).alias("median"), F.try_divide(F.sum(F.col("sent") - F.col("successful")).cast("double"), F.sum("sent").cast("double")).alias("failed"))
    of = lambda c, p: F.max(F.when(F.col("policy") == p, F.col(c)))
    row = by.agg(*[of(c, p).alias(f"{p}_{c}") for c in ("k", "measured", "median", "failed") for p in ("normal", "clientip")])
    ready = (F.col("normal_k") == repeats) & (F.col("clientip_k") == repeats) & (F.col("normal_measured") > 0) & (F.col("clientip_measured") > 0)
    better = (F.col("normal_median") < F.col("clientip_median")) & (F.col("normal_failed") <= F.col("clientip_failed"))
    return row.select(F.when(ready & better, F.lit("normal")).alias("choice"), F.coalesce(ready, F.lit(False)).alias("ready"))


def transitions(rows: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The rows where the state differs from the one before, the first included; ``order`` is total within a key.

    A key of any size: its history lies in range partitions, and each hands its last state to the next."""
    placed = ranges.ranged(rows, [key], order)
    seen = ranges.carried(placed, [key], order, previous={"__before": F.struct(F.col(state).alias("s"))})
    change = F.col("__before").isNull() | ~F.col(state).eqNullSafe(F.col("__before.s"))
    return seen.where(change).select(*[c for c in rows.columns if c != "previous"], F.col("__before.s").alias("previous"))


def follows_in_order(rows: DataFrame, key: str, order: list[str], state: str, pattern: list[str]) -> DataFrame:
    """``(key, followed)``: whether the states of a key hold ``pattern`` as a subsequence in ``order``, others in between.

    Each stretch of a key within a range partition is summed up as what it makes of the pattern's automaton: for each number
    of steps already taken, how many are taken after it.  These tables, one for each key and partition, are applied in turn."""
    steps = [sorted(set(pattern)).index(p) for p in pattern]
    code = F.lit(-1)
    for i, p in enumerate(sorted(set(pattern))):
        code = F.when(F.col(state) == p, i).otherwise(code)
    placed = ranges.ranged(rows, [key], order).select(F.col(key).alias("key"), code.cast("int").alias("code"), ranges.PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the sorted rows of a partition only the table of the key that is being read is held."""
        current, table, part = None, None, 0
        for batch in batches:
            keys, codes = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(zero_copy_only=False)
            if not len(codes):
                continue
            at, part = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False), batch.column(2)[0].as_py()
            done_keys, done_tables = [], []
            for lo, hi in itertools.pairwise([0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]):
                name = (keys.dictionary[int(at[lo])].as_py() if at[lo] >= 0 else None,)
                if name != current:
                    if current is not None:
                        done_keys.append(current[0])
                        done_tables.append(table)
                    current, table = name, list(range(len(steps) + 1))
                table = _advanced(table, codes[lo:hi], steps)
            if done_keys:
                yield _tables(done_keys, part, done_tables, batch.schema.field(0).type)
        if current is not None:
            yield _tables([current[0]], part, [table], batch.schema.field(0).type)

    kind = placed.schema["key"].dataType.simpleString()
    tables = placed.mapInArrow(run, f"key {kind}, part int, after array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("part", "after")))  # at most one for each partition
    taken = F.aggregate(ordered, F.lit(0), lambda at, x: F.get(x["after"], at))
    return tables.groupBy("key").agg((taken == len(steps)).alias("followed")).withColumnRenamed("key", key)


def _advanced(table: list[int], codes: np.ndarray, steps: list[int]) -> list[int]:
    """``table`` followed by a stretch of codes."""
    where = {c: np.flatnonzero(codes == c) for c in set(steps)}

    def after(step: int) -> int:
        at = 0
        while step < len(steps):
            k = np.searchsorted(where[steps[step]], at)
            if k == len(where[steps[step]]):
                break
            at, step = where[steps[step]][k] + 1, step + 1
        return step

    moved = {s: after(s) for s in set(table)}
    return [moved[s] for s in table]


def _tables(keys: list, part: int, tables: list[list[int]], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array([part] * len(keys), pa.int32()), pa.array(tables, pa.list_(pa.int32()))], names=["key", "part", "after"])


def follows(states: Column, pattern: list[str]) -> Column:
    """Whether the array of states has the pattern as a subsequence."""
    wanted = F.array(*map(F.lit, pattern))
    return F.aggregate(states, F.lit(0), lambda at, s: F.when(F.get(wanted, at) == s, at + 1).otherwise(at)) == len(pattern)


def alert_states(windows: DataFrame, key: str, time: str, breach: str, hold_seconds: int) -> DataFrame:
    """``windows`` with ``alert``: inactive, pending, or firing once the breach has lasted ``hold_seconds``; a null breach is none.

    A key has a window at a time at most once.  A breach that goes on across range partitions carries the time of its start."""
    bad = F.coalesce(F.col(breach), F.lit(False))
    placed = ranges.ranged(windows, [key], [time])
    seen = ranges.carried(placed, [key], [time], previous={"__before": bad})
    began = F.when(bad & ~F.coalesce("__before", F.lit(False)), F.col(time))
    marked = ranges.carried(seen, [key], [time], latest={"__since": began})
    since = F.coalesce(began, "__since")
    held = F.unix_seconds(F.col(time).cast("timestamp")) - F.unix_seconds(since.cast("timestamp"))
    return marked.select(*[c for c in windows.columns if c != "alert"], F.when(~bad, "inactive").when(held >= hold_seconds, "firing").otherwise("pending").alias("alert"))


def lru_hits(rows: DataFrame, key: str, order: list[str], item: str, capacity: int) -> DataFrame:
    """``rows`` with ``hit``: whether an LRU cache per key holds the item, by exact replay in order.

    Rows are sorted on the executors, with spilling; a task keeps one cache of
    ``capacity`` items at a time.  A replay is sequential, so a key is one task."""
    columns = rows.columns
    schema = rows.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cache = None, OrderedDict()
        for batch in batches:
            hits = []
            for k, x in zip(batch[key], batch[item], strict=True):
                if k != now:
                    now, cache = k, OrderedDict()
                hit = x in cache
                cache.pop(x, None)
                if capacity:
                    cache[x] = None
                    if len(cache) > capacity:
                        cache.popitem(last=False)
                hits.append(hit)
            yield batch[columns].assign(hit=hits)

    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInPandas(run, schema.simpleString()[7:-1].replace(":", " ") + ", hit boolean")


def admission(rows: DataFrame, server: str, arrival: str, service: str, *, running: int = 1, waiting: int = 32, timeout: float = 30.0) -> DataFrame:
    """``(id, server, outcome, queue_seconds)``: a bounded first-in first-out queue per server, replayed by arrival.

    ``rows(id, server, arrival, service)`` in seconds.  An arrival that finds
    ``waiting`` others in the queue is 'queue_full'; one that waits longer than
    ``timeout`` is 'queue_timeout' and leaves the queue then.  A replay is sequential,
    so a server is one task, which holds the queue (``waiting`` at most) alone."""
    import heapq

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, free, queue = None, [], []
        for batch in batches:
            out = []
            for k, i, t, s in zip(batch["server"], batch["id"], batch["arrival"], batch["service"], strict=True):
                if k != now:
                    now, free, queue = k, [-1e300] * running, []
                queue = [start for start in queue if start > t]  # who still waits, by when it leaves the queue
                start = max(t, free[0])
                if start > t and len(queue) >= waiting:
                    out.append((i, k, "queue_full", None))
                elif start - t > timeout:
                    queue.append(t + timeout)
                    out.append((i, k, "queue_timeout", timeout))
                else:
                    heapq.heapreplace(free, start + s)
                    if start > t:
                        queue.append(start)
                    out.append((i, k, "served", start - t))
            yield pd.DataFrame(out, columns=["id", "server", "outcome", "queue_seconds"])

    plain = rows.select(F.col("id").cast("long").alias("id"), F.col(server).cast("string").alias("server"), F.col(arrival).cast("double").alias("arrival"), F.col(service).cast("double").alias("service"))
    return plain.repartition("server").sortWithinPartitions("server", "arrival", "id").mapInPandas(run, "id long, server string, outcome string, queue_seconds double")


def open_loop_schedule(spark, seconds: float, rate: float, clients: int = 4, skewed: bool = False) -> DataFrame:
    """``(i, offset_seconds, client)``: arrivals at a fixed rate; skewed, four of five go to client 0."""
    i = F.col("id")
    others = F.floor(i / 5) % (clients - 1) + 1
    client = F.when(i % 5 != 4, F.lit(0)).otherwise(others) if skewed else i % clients
    return spark.range(int(seconds * rate)).select(i.alias("i"), (i / F.lit(float(rate))).alias("offset_seconds"), client.cast("long").alias("client"))
