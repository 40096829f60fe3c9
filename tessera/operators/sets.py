"""Set and record comparisons between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_set(a: DataFrame, b: DataFrame) -> bool:
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def same_multiset(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def multiset_digests(rows: DataFrame, columns: list[str], keys: list[str] | None = None, salt: str = "") -> DataFrame:
    """``(keys, n, digest)``: equal for groups that hold the same rows equally often, in any order, and with that certainty of SHA-256 only for these.

    A row's hash is taken as four numbers of 64 bits, each summed exactly over the group and before the shuffle; the digest is that of the sums and the count.
    ``salt`` keys the hashes, for rows that others may choose.  Nulls are values like others; columns are told apart by their lengths."""
    field = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    whole = F.sha2(F.concat(F.lit(f"{len(salt)}:{salt}"), *map(field, columns)), 256)
    hashed = rows.select(*(keys or []), whole.alias("__h"))
    parts = [F.conv(F.substring("__h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = hashed.groupBy(*(keys or [])).agg(F.count("*").alias("n"), *[F.sum(p).alias(f"__s{i}") for i, p in enumerate(parts)])
    return sums.select(*(keys or []), "n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[F.col(f"__s{i}").cast("string") for i in range(4)]), 256).alias("digest"))


def subset(a: DataFrame, b: DataFrame) -> bool:
    return a.subtract(b).isEmpty()


def one_sided(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``(key, side)`` of keys on one side only."""
    left, right = a.select(key).distinct().withColumn("__l", F.lit(True)), b.select(key).distinct().withColumn("__r", F.lit(True))
    return left.join(right, key, "full_outer").where("__l IS NULL OR __r IS NULL").select(key, F.when(F.col("__l"), "left").otherwise("right").alias("side"))


def changed_records(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, columns)``: for keys on both sides, the names of the columns that differ, null-safe."""
    left = a.select(key, F.struct(*columns).alias("__a"))
    right = b.select(key, F.struct(*columns).alias("__b"))
    names = F.filter(F.array(*[F.when(~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return left.join(right, key).select(key, F.array_join(names, ",").alias("columns")).where("columns <> ''")


def ready(conditions: Column) -> Column:
    """Whether an array of (type, status) conditions says Ready."""
    return F.coalesce(F.exists(conditions, lambda c: (c["type"] == "Ready") & (c["status"] == "True")), F.lit(False))
