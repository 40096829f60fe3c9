"""Order statistics with exact definitions, as aggregates and as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.quantiles import nearest


def nearest_rank(values: DataFrame, column: str, probabilities: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """The element at index min(n - 1, int(q n)) of the sorted values, by group; no rows give no group.

    By ranges where there are ``keys``, so that a group may hold any number of values; else from counts of distinct values in range partitions, each starting
    from what the ones before it hold."""
    if keys:
        return nearest(values, keys, column, probabilities).where("n > 0").drop("n")
    return _ranks_of_all(values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__c")), column, probabilities)


def _ranks_of_all(counts: DataFrame, column: str, probabilities: dict[str, float]) -> DataFrame:
    from pyspark.sql import Window

    from tessera.session import cut

    ranged = cut(counts.repartitionByRange(column).withColumn("__p", F.spark_partition_id()))
    parts = {r["__p"]: r["n"] for r in ranged.groupBy("__p").agg(F.sum("__c").alias("n")).collect()}  # a row per partition
    before, total = [], 0
    for p, n in sorted(parts.items()):
        before.append((p, total))
        total += n
    starts = counts.sparkSession.createDataFrame(before, "__p int, __before long")
    order = Window.partitionBy("__p").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    to = ranged.withColumn("__run", F.sum("__c").over(order)).join(F.broadcast(starts), "__p").withColumn("__to", F.col("__before") + F.col("__run"))
    at = {name: min(total - 1, int(q * total)) for name, q in probabilities.items()}
    return to.agg(*[F.min(F.when(F.col("__to") > k, F.col(column))).alias(name) for name, k in at.items()])


def round_even(value: Column, digits: int) -> Column:
    """The nearest decimal of a double's exact binary value, ties to even: 2.675 is 2.67, 0.125 is 0.12.

    round() and bround() go by the shortest decimal form of a double and give 2.68."""
    @F.pandas_udf("double")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or x != x else round(float(x), digits) for x in values], dtype="float64")

    return of(value.cast("double"))


def nearest_rank_of(array: Column, q: float) -> Column:
    """The same of an array column; 0 where it is empty."""
    n = F.size(array)
    return F.coalesce(F.get(F.array_sort(array), F.least(n - 1, F.floor(F.lit(q) * n)).cast("int")), F.lit(0))


def spread(values: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """p10, p50, p90, p99, ratio_p90_p10 (of at least 1), mean, cv, min and max by group."""
    keys = keys or []
    ranks = nearest_rank(values, column, {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}, keys)
    moments = values.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"), F.min(column).alias("min"), F.max(column).alias("max"))
    joined = moments.join(ranks, keys) if keys else moments.crossJoin(ranks)  # one row each
    return joined.select(
        *keys,
        "p10",
        "p50",
        "p90",
        "p99",
        (F.col("p90") / F.greatest(F.col("p10"), F.lit(1))).alias("ratio_p90_p10"),
        "mean",
        F.coalesce(F.try_divide(F.col("sd"), F.col("mean")), F.lit(0.0)).alias("cv"),
        "min",
        "max",
    )


def finite(x: Column) -> Column:
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def histogram_quantile(buckets: DataFrame, q: float, keys: list[str]) -> DataFrame:
    """``(keys, quantile)`` from cumulative ``buckets(keys, le, count)``.

    Linear within a bucket that starts at the edge before it (0 for the first); what
    falls into the infinite bucket is at its lower edge; null for an empty histogram.
    The quantile 0 is the lower edge of a first bucket that holds something, else its upper one."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("le")
    whole = Window.partitionBy(*keys)
    infinite = float("inf")
    rows = buckets.withColumn("__total", F.max(F.when(F.col("le") == infinite, F.col("count"))).over(whole)).withColumn("__rank", F.col("__total") * q).withColumn("__lower", F.lag("le", 1, 0.0).over(order)).withColumn("__before", F.lag("count", 1, 0).over(order).cast("double"))
    inside = F.col("__lower") + (F.col("le") - F.col("__lower")) * F.try_divide(F.col("__rank") - F.col("__before"), F.col("count") - F.col("__before"))
    value = F.when(F.col("le") == infinite, F.col("__lower")).when(F.col("count") > F.col("__before"), inside).otherwise(F.col("le"))
    hit = (F.col("count") >= F.col("__rank")) & (F.col("__total") > 0)
    return rows.groupBy(*keys).agg(F.min_by(F.when(hit, value), F.when(hit, F.col("le"))).alias("quantile"))
