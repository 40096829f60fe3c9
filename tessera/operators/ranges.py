"""Orders over whole tables and within hot keys: range partitions, and what one hands to the next.

Rows are dealt out by ranges of (keys, order), so that a key with most of the rows
lies in many partitions, in order.  What a row needs from all rows before it is what its own partition holds before it,
and a carried value: one for each partition, from a prefix over the partitions' own totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

PART = "__p"


def ranged(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """``rows`` in range partitions of (keys, order), written down, with the partition's number in ``__p``.

    Written down, as ranges come from samples and must not be drawn twice."""
    by = [*keys, *order]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn(PART, F.spark_partition_id()))


def ranked(rows: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """``rows`` with their rank from 0 by ``order``, without a window over everything."""
    local = F.monotonically_increasing_id() % F.lit(1 << 33)
    placed = ranged(rows, [], order).withColumn("__i", local)
    counts = placed.groupBy(PART).agg(F.count("*").alias("__c"))  # a row for each partition
    before = F.coalesce(F.sum("__c").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(PART, before.alias("__before"))
    return placed.join(F.broadcast(starts), PART).withColumn(name, F.col("__before") + F.col("__i")).drop(PART, "__i", "__before")


def carried(
    placed: DataFrame,
    keys: list[str],
    order: list[Column | str],
    *,
    previous: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
) -> DataFrame:
    """``placed`` (from ranged()) with new columns, each over the rows of the same key in ``order``:

    ``previous``: the value one row before, null for the first; ``latest``: the last value that isn't null, in the rows before
    (not in the row itself); ``total``: the sum up to the row, itself included.
    ``order`` must be total within a key.  Null keys are a key like others.

    Windows are over (partition, key): no task holds more of a key than a range partition does.  The table of what is carried
    has at most a row for each partition, as only the first key of one can have begun before it; it is broadcast."""
    previous, latest, total = previous or {}, latest or {}, total or {}
    own = Window.partitionBy(PART, *keys).orderBy(*order)
    before, upto = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumns({"__first": F.row_number().over(own) == 1, **{f"__o_{n}": c for n, c in (previous | latest | total).items()}})
    at = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order])
    held = [F.max_by(F.struct(F.col(f"__o_{n}").alias("x")), at).alias(f"__c_{n}") for n in previous]
    held += [F.max_by(F.struct(F.col(f"__o_{n}").alias("x")), F.when(F.col(f"__o_{n}").isNotNull(), at)).alias(f"__c_{n}") for n in latest]
    held += [F.sum(f"__o_{n}").alias(f"__c_{n}") for n in total]
    sources = placed.withColumns({f"__o_{n}": c for n, c in (previous | latest | total).items()})
    segments = sources.groupBy(PART, *keys).agg(*held)
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = segments.select(
        F.col(PART).alias("__q"),
        *[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)],
        F.count("*").over(earlier).alias("__n"),
        *[F.last(f"__c_{n}", ignorenulls=True).over(earlier).alias(f"__c_{n}") for n in previous | latest],
        *[F.sum(f"__c_{n}").over(earlier).alias(f"__c_{n}") for n in total],
    ).where("__n > 0")
    same = F.col(PART) == F.col("__q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    rows = rows.withColumns(
        {f"__w_{n}": F.lag(f"__o_{n}").over(own) for n in previous}
        | {f"__w_{n}": F.last(f"__o_{n}", ignorenulls=True).over(before) for n in latest}
        | {f"__w_{n}": F.sum(f"__o_{n}").over(upto) for n in total}
    )
    found = rows.join(F.broadcast(carry), same, "left")
    new = {n: F.when(F.col("__first"), F.col(f"__c_{n}.x")).otherwise(F.col(f"__w_{n}")) for n in previous}
    new |= {n: F.coalesce(f"__w_{n}", F.col(f"__c_{n}.x")) for n in latest}
    new |= {n: F.coalesce(F.col(f"__w_{n}") + F.coalesce(f"__c_{n}", F.lit(0)), f"__w_{n}", f"__c_{n}") for n in total}
    return found.select(*[F.col(c) for c in placed.columns if c not in new], *[x.alias(n) for n, x in new.items()])
