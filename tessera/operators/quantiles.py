"""Exact order statistics of all groups at once, by refining ranges.

The values of a group are counted in ranges of equal width between its smallest and largest; only ranges that hold a wanted rank are
cut again, between the smallest and largest value that they hold, until they are small or hold one value.  Each pass
is a sum over cells that is combined before the shuffle; the last one orders the values of small ranges.  So no group's values are ever
in one task, however large it is, and memory follows the number of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

#: cells a range is cut into, and rows up to which it is ordered as it is
CELLS, SMALL = 256, 20_000
#: ranges are broadcast to the values up to this number, a few megabytes; more are joined by key, where adaptive execution splits a key with many values
BROADCAST_ROWS = 50_000


def _extents(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    whole = values.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count(value).alias("__n"))
    return cut(whole.withColumn("__below", F.lit(0).cast("long")))


def at_ranks(values: DataFrame, keys: list[str], value: str, wanted: DataFrame, *, cells: int = CELLS, small: int = SMALL, extents: DataFrame | None = None) -> DataFrame:
    """``(keys, __rank, value)``: the k-th smallest value, from 0, for each row of ``wanted(keys, __rank)``; nulls are not counted, and ranks beyond a group give no row.

    ``values`` is read once a pass: a narrow scan, or a table that was written down."""
    rows = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    ranges = _extents(values, keys, value) if extents is None else extents
    wanted = cut(wanted.select(*keys, F.col("__rank").cast("long").alias("__rank")).distinct())
    settled = None
    while True:
        ranges = cut(_holding(ranges, keys, wanted))
        large = (F.col("__n") > small) & (F.col("__lo") < F.col("__hi"))
        settled = ranges.where(~large) if settled is None else settled.unionByName(ranges.where(~large))
        if ranges.where(large).isEmpty():
            break
        inside = _within(rows, ranges.where(large), keys)
        width = F.col("__hi").cast("double") - F.col("__lo").cast("double")
        cell = F.least(F.floor((F.col("__v").cast("double") - F.col("__lo").cast("double")) / width * cells), F.lit(cells - 1)).cast("long")
        # where the width is beyond a double, or too small for it: below or above the middle, or the largest value apart
        cell = F.when((width > 0) & (width < float("inf")), cell).when(width > 0, (F.col("__v") > 0).cast("long")).otherwise((F.col("__v") == F.col("__hi")).cast("long"))
        found = inside.groupBy(*keys, "__lo", "__below", cell.alias("__cell")).agg(F.min("__v").alias("__a"), F.max("__v").alias("__b"), F.count("*").alias("__n"))
        before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys, "__lo").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranges = found.withColumn("__below", F.col("__below") + before).select(*keys, F.col("__a").alias("__lo"), F.col("__b").alias("__hi"), "__n", "__below")
    one = settled.where(F.col("__lo") == F.col("__hi"))
    alike = _matched(one, keys, wanted).select(*keys, "__rank", F.col("__lo").alias(value))
    few = _within(rows, settled.where(F.col("__lo") < F.col("__hi")), keys)
    place = F.row_number().over(Window.partitionBy(*keys, "__lo").orderBy("__v")) - 1
    ordered = few.withColumn("__rank", F.col("__below") + place)
    return alike.unionByName(ordered.join(_renamed(wanted, keys), _same(keys) & (F.col("__rank") == F.col("__kk"))).select(*keys, "__rank", F.col("__v").alias(value)))


def _renamed(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.select(*[F.col(c).alias(f"__r_{i}") for i, c in enumerate(keys)], *[F.col(c).alias("__kk" if c == "__rank" else c) for c in table.columns if c not in keys])


def _same(keys: list[str]) -> Column:
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{i}"))
    return same


def _matched(ranges: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    inside = (F.col("__kk") >= F.col("__below")) & (F.col("__kk") < F.col("__below") + F.col("__n"))
    return ranges.join(_renamed(wanted, keys), _same(keys) & inside).withColumn("__rank", F.col("__kk"))


def _holding(ranges: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    columns = [*keys, "__lo", "__hi", "__n", "__below"]
    return _matched(ranges, keys, wanted).select(*columns).distinct()


def _within(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the range that holds them."""
    right = _renamed(ranges, keys)
    right = F.broadcast(right) if ranges.count() <= BROADCAST_ROWS else right
    return rows.join(right, _same(keys) & F.col("__v").between(F.col("__lo"), F.col("__hi"))).select(*keys, "__v", "__lo", "__hi", "__below")


def _grouped(values: DataFrame, keys: list[str], value: str, at: dict[str, Column], **limits: int) -> DataFrame:
    """``(keys, n, <name>...)``: the values at the ranks ``at``, expressions over ``n``, the number of values of a group."""
    extents = _extents(values, keys, value)
    counts = extents.select(*keys, F.col("__n").alias("n"))
    wanted = counts.select(*keys, F.explode(F.array(*[c.cast("long") for c in at.values()])).alias("__rank"), F.col("n")).where("__rank < n")
    found = at_ranks(values, keys, value, wanted, extents=extents, **limits)
    pairs = counts.join(_renamed(found.withColumnRenamed(value, "__x"), keys), _same(keys), "left")
    picked = [F.max(F.when(F.col("__kk") == c.cast("long"), F.col("__x"))).alias(name) for name, c in at.items()]
    return pairs.groupBy(*keys, "n").agg(*picked)


def nearest(values: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], **limits: int) -> DataFrame:
    """``(keys, n, <names>)``: the elements at index min(n - 1, int(q n)) of the sorted values, null where there are none."""
    return _grouped(values, keys, value, {name: F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n"))) for name, q in probabilities.items()}, **limits)


def linear(values: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], **limits: int) -> DataFrame:
    """``(keys, n, <names>)``: quantiles, linear between neighbours at (n - 1) q, null where there are no values."""
    at = {}
    for name, q in probabilities.items():
        place = (F.col("n") - 1) * F.lit(float(q))
        at |= {f"__{name}_0": F.floor(place), f"__{name}_1": F.ceil(place)}
    found = _grouped(values, keys, value, at, **limits)

    def between(name: str, q: float) -> Column:
        place = (F.col("n") - 1) * F.lit(float(q))
        low, high = F.col(f"__{name}_0").cast("double"), F.col(f"__{name}_1").cast("double")
        return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return found.select(*keys, "n", *[between(name, q).alias(name) for name, q in probabilities.items()])
