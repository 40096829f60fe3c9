"""Deterministic samples by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_prefix(rows: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    """The first ``n`` rows by sha256 of the key: a smaller sample is a prefix of a larger one."""
    digest = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)
    return rows.orderBy(digest, key).limit(n)


def quotas(limit: int, strata: list[str], seed: int = 0) -> dict[str, int]:
    """Equal shares; what is left over goes to the first strata in order of a seeded hash."""
    import hashlib

    share, rest = divmod(limit, len(strata))
    lucky = sorted(strata, key=lambda s: hashlib.sha256(f"{seed}|{s}".encode()).hexdigest())[:rest]
    return {s: share + (s in lucky) for s in strata}


def stratified(rows: DataFrame, stratum: Column, key: str, quota: dict[str, int], salt: str) -> DataFrame:
    """Per stratum the first ``quota`` rows by hash; a stratum that has fewer is an error.

    The position within a stratum comes from a window that Spark turns into a limited
    top-k per task before the shuffle."""
    wanted = F.create_map(*[F.lit(x) for pair in sorted(quota.items()) for x in pair])
    named = rows.withColumn("stratum", stratum)
    digest = F.sha2(F.concat_ws("|", F.lit(salt), "stratum", F.col(key).cast("string")), 256)
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(digest, key))
    most = max(quota.values(), default=0)
    picked = named.withColumn("position", place).where(F.col("position") <= most)
    return picked.where(F.col("position") <= F.coalesce(F.try_element_at(wanted, F.col("stratum")), F.lit(0)))


def deficits(rows: DataFrame, stratum: Column, quota: dict[str, int]) -> DataFrame:
    """``(stratum, quota, available)`` of the strata with too few rows."""
    spark = rows.sparkSession
    want = spark.createDataFrame(sorted(quota.items()), "stratum string, quota long")
    have = rows.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("available"))
    return want.join(have, "stratum", "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long"))).where("available < quota")
