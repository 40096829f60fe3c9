"""First-fit decreasing over a histogram of lengths.

Items of equal length are alike to the algorithm, so the bins follow from how many items there are of each
length.  These counts, at most one for each length up to the bin's size, are all that the driver sees: it works out runs of
neighbouring bins that are filled alike.  Each item then finds its bin from its rank among the items of its length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranges import ranked


@dataclass
class Run:
    """``bins`` neighbouring bins from ``first`` on, each with ``room`` left and ``items`` in it."""

    first: int
    bins: int
    room: int
    items: int


@dataclass
class Deal:
    """Items ``rank`` to ``rank + bins * each`` - 1 of one length go to ``bins`` bins from ``first`` on, ``each`` to each, in order, from place ``place``."""

    length: int
    rank: int
    first: int
    bins: int
    each: int
    place: int


def first_fit_deals(counts: dict[int, int], size: int) -> list[Deal]:
    """What first-fit decreasing does with ``counts[length]`` items of each length, in the order of lengths and ranks.

    Longest first; the items of one length go to the first bin with room until it has none, then to the next, and so
    on to bins of their own.  Runs of bins that are alike stay alike, but where the items of a length end: a
    length adds at most three runs, however many items there are."""
    runs: list[Run] = []
    deals: list[Deal] = []
    for length in sorted(counts, reverse=True):
        if not 0 <= length <= size:
            raise ValueError(f"an item of {length} does not fit into bins of {size}")
        left, rank, after = counts[length], 0, []
        fresh = Run(runs[-1].first + runs[-1].bins if runs else 0, left, size, 0)
        for run in [*runs, fresh]:
            fits = run.room // length if length else left
            while left and fits and run.bins:
                each, bins = (fits, min(run.bins, left // fits)) if left >= fits else (left, 1)
                deals.append(Deal(length, rank, run.first, bins, each, run.items))
                after.append(Run(run.first, bins, run.room - each * length, run.items + each))
                rank, left = rank + bins * each, left - bins * each
                run.first, run.bins = run.first + bins, run.bins - bins
            if run.bins and run is not fresh:
                after.append(run)
        runs = after
    return deals


PLACED = "bin long, position long, id long, length long"


def pack_first_fit(rows: DataFrame, id_col: str, length_col: str, size: int) -> DataFrame:
    """``(bin, position, id, length)``: first-fit decreasing over all rows, items of equal length in the order of their ids.

    One answer at any size and on any number of cores.  Rows without a length are an error, as are lengths beyond ``size``."""
    items = rows.select(F.col(id_col).cast("long").alias("id"), F.col(length_col).cast("long").alias("length"))
    checked = F.when(F.col("length").isNull() | (F.col("length") < 0) | (F.col("length") > size), F.raise_error(F.lit(f"an item does not fit into bins of {size}")).cast("long")).otherwise(F.col("length"))
    placed = ranked(items.withColumn("length", checked), [F.col("length").desc(), F.col("id")])
    counts = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size + 1 rows
    deals = first_fit_deals(counts, size)
    of = np.array([[d.rank, d.first, d.each, d.place] for d in deals], np.int64).reshape(-1, 4)
    start, at = {}, 0
    for length in sorted(counts, reverse=True):
        start[length], at = at, at + counts[length]
    # deals are in the order of ranks over all lengths
    of[:, 0] += np.array([start[d.length] for d in deals], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, ranks = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            mine = of[np.searchsorted(of[:, 0], ranks, "right") - 1] if len(ranks) else of[:0]
            within = ranks - mine[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(mine[:, 1] + within // mine[:, 2]), pa.array(mine[:, 3] + within % mine[:, 2]), pa.array(ids), pa.array(lengths)], names=["bin", "position", "id", "length"])

    return placed.select("id", "length", "rank").mapInArrow(run, PLACED)
