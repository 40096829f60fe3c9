"""Structured Streaming twins of the request analytics: sliding windows, alerts, caches, completion contracts.

Sources are folders of parquet files; the same functions take a batch frame where the
operator allows it, which is how tests compare both.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, name: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the parquet files ``name`` below ``folder``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def drain(stream: DataFrame, folder: str, mode: str = "append", name: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote, of any size: files below ``folder``, which all machines share.

    In mode ``append`` rows go to a file sink, which lists each batch once; in mode ``complete`` each batch
    replaces the result, so the last one is returned."""
    spark, last = stream.sparkSession, []
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer = writer.queryName(name) if name else writer
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch-{batch}")
        last.append(batch)

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/batch-{last[-1]}") if last else spark.createDataFrame([], stream.schema)


def sliding(events: DataFrame, time: str, keys: list[str], aggregates: list[Column], width: str = "30 seconds", slide: str = "5 seconds", late: str | None = None) -> DataFrame:
    """``(window_start, window_end, keys, aggregates)``; ``late`` sets a watermark, beyond which rows are dropped and windows closed."""
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.window(time, width, slide), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def ratio_alert(events: DataFrame, time: str, keys: list[str], bad: Column, limit: float, support: int, width: str, slide: str, late: str | None = None) -> DataFrame:
    """Windows with the share of bad rows and whether it is over the limit with enough rows behind it."""
    out = sliding(events, time, keys, [F.count("*").alias("n"), F.count_if(bad).alias("bad")], width, slide, late)
    share = F.col("bad") / F.col("n")
    return out.withColumn("ratio", share).withColumn("breach", (share > limit) & (F.col("n") >= support))


def quantile_alert(events: DataFrame, time: str, keys: list[str], value: Column, edges: tuple[float, ...], q: float, limit: float, support: int, width: str, slide: str, late: str | None = None) -> DataFrame:
    """Windows with the histogram quantile of a value and whether it is over the limit with enough rows behind it.

    Buckets are counted in the window's state, never the values; the quantile is a
    column expression over them, so it runs in a stream as in a batch."""
    sums = [F.count_if(value <= e).alias(f"b{i}") for i, e in enumerate(edges)]
    out = sliding(events, time, keys, [F.count(value).alias("n"), *sums], width, slide, late)
    rank, result = F.col("n") * q, F.lit(None).cast("double")
    for i in range(len(edges) - 1, -1, -1):
        lower, before = (edges[i - 1], F.col(f"b{i - 1}")) if i else (0.0, F.lit(0))
        here = F.col(f"b{i}")
        inside = F.lit(lower) if edges[i] == float("inf") else F.when(here > before, lower + (edges[i] - lower) * F.try_divide(rank - before, here - before)).otherwise(F.lit(edges[i]))
        result = F.when((here >= rank) & (rank > 0), inside).otherwise(result)
    return out.withColumn("quantile", result).withColumn("breach", (F.col("quantile") > limit) & (F.col("n") >= support)).drop(*[f"b{i}" for i in range(len(edges))])


def first_per_key(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows without repeats of the keys within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, time: str, key: str, gap: str, aggregates: list[Column], late: str | None = None) -> DataFrame:
    """Session windows by key: a stretch of events with gaps below ``gap``."""
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.session_window(time, gap), key).agg(*aggregates)
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *[c for c in out.columns if c not in ("session_window", key)])


def completion(chunks: DataFrame, request: str, done: Column, declared: Column) -> DataFrame:
    """``(request, chunks, declared, clean)``: a stream is clean with one final marker that declares as many chunks as came."""
    out = chunks.groupBy(request).agg(F.count_if(~done).alias("chunks"), F.count_if(done).alias("markers"), F.max(F.when(done, declared)).alias("declared"))
    return out.select(request, "chunks", "declared", F.coalesce((F.col("markers") == 1) & (F.col("chunks") == F.col("declared")), F.lit(False)).alias("clean"))


ALERT = "key string, at timestamp, alert string"
_ALERT_STATE = "since long, last string, held binary"
_STATES = np.array(["inactive", "pending", "firing"], object)
#: a row that waits, 17 bytes
_HELD = np.dtype([("at", "<i8"), ("tie", "<i8"), ("bad", "?")])
#: rows given out at once
PIECE = 10_000


def alert_machine(windows: DataFrame, key: str, time: str, breach: str, hold_seconds: int, tie: Column | None = None, late: str = "10 minutes") -> DataFrame:
    """``(key, at, alert)`` at every change among inactive, pending and firing, in the order of event time and then ``tie``.

    Rows may come in any order within ``late``: they wait in the state of their key until the watermark has passed them, and a timer
    takes them up in order then; rows behind the watermark are dropped.  A key holds the rows of that stretch of time, packed in 17 bytes
    each, when the breach began and the last alert.  Rows that the watermark has not passed when the stream ends are not in the result."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, last, held = state.get if state.exists else (None, "inactive", b"")
        parts = [np.frombuffer(held, _HELD)]
        for f in frames:
            part = np.empty(len(f), _HELD)
            part["at"], part["tie"], part["bad"] = f["micros"], f["tie"], f["breach"]
            parts.append(part)
        rows = np.concatenate(parts)
        del parts, held
        rows = rows[np.lexsort((rows["tie"], rows["at"]))]
        n = int(np.searchsorted(rows["at"] // 1000, state.getCurrentWatermarkMs()))
        ready, rest = rows[:n], rows[n:]
        at, now = np.empty(0, np.int64), np.empty(0, np.int8)
        if n:
            seconds, bad = ready["at"] // 1_000_000, ready["bad"]
            # where the breach began that a row is in: behind the last row that was none
            first = np.maximum.accumulate(np.where(bad, 0, np.arange(1, n + 1)))
            begun = seconds[np.minimum(first, n - 1)]
            if since is not None:
                begun = np.where(first == 0, since, begun)
            states = np.where(bad, np.where(seconds - begun >= hold_seconds, 2, 1), 0)
            changed = np.nonzero(states != np.concatenate([[list(_STATES).index(last)], states[:-1]]))[0]
            at, now = ready["at"][changed], states[changed]
            since, last = int(begun[-1]) if bad[-1] else None, str(_STATES[states[-1]])
        state.update((since, last, rest.tobytes()))
        if len(rest):
            state.setTimeoutTimestamp(max(int(rest["at"][0]) // 1000, state.getCurrentWatermarkMs() + 1))
        for i in range(0, max(1, len(at)), PIECE):
            yield pd.DataFrame({"key": k[0], "at": pd.to_datetime(at[i : i + PIECE], unit="us", utc=True), "alert": _STATES[now[i : i + PIECE]]})

    rows = windows.withWatermark(time, late)
    at = F.col(time).cast("timestamp")
    plain = rows.select(F.col(key).cast("string").alias("key"), F.col(time), F.unix_micros(at).alias("micros"), (F.lit(0) if tie is None else tie).cast("long").alias("tie"), F.coalesce(F.col(breach), F.lit(False)).alias("breach"))
    return plain.groupBy("key").applyInPandasWithState(step, ALERT, _ALERT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def interval_matches(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, least: str, most: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of equal key where the right row is ``least`` to ``most`` before the left one; in a stream as in a batch.

    In a stream both sides are kept only while the watermark still allows for a partner.  The key and times have names of their own on each side's other columns."""
    a, b = left.withWatermark(left_time, late).alias("a"), right.withWatermark(right_time, late).alias("b")
    inside = F.expr(f"b.{right_time} <= a.{left_time} - INTERVAL {least} AND b.{right_time} >= a.{left_time} - INTERVAL {most}")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & inside)


def lru_stream(rows: DataFrame, key: str, order: str, item: str, capacity: int, tie: Column | None = None) -> DataFrame:
    """``(key, at, item, hit)``: an LRU cache per key, kept across micro-batches, in the order of time and then ``tie``.

    Of a micro-batch's rows a key holds 24 bytes each, and every item once; they are given out in pieces."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[Any, None] = dict.fromkeys(state.get[0] if state.exists else [])
        numbers: dict[Any, int] = {}
        parts = [(f["at"].to_numpy(), f["tie"].to_numpy(), np.fromiter((numbers.setdefault(x, len(numbers)) for x in f["item"]), np.int64, len(f))) for f in frames]
        at, ties, items = (np.concatenate([p[i] for p in parts]) for i in range(3))
        del parts
        names, by = np.array(list(numbers), object), np.lexsort((ties, at))
        for i in range(0, len(by), PIECE):
            some = by[i : i + PIECE]
            asked, hits = names[items[some]], []
            for x in asked:
                hits.append(x in held)
                held.pop(x, None)
                held[x] = None
                while len(held) > capacity:
                    del held[next(iter(held))]
            yield pd.DataFrame({"key": k[0], "at": at[some], "item": asked, "hit": hits})
        state.update((list(held),))

    plain = rows.select(F.col(key).cast("string").alias("key"), F.col(order).alias("at"), (F.lit(0) if tie is None else tie).cast("long").alias("tie"), F.col(item).cast("string").alias("item"))
    return plain.groupBy("key").applyInPandasWithState(step, "key string, at timestamp, item string, hit boolean", "held array<string>", "append", GroupStateTimeout.NoTimeout)
