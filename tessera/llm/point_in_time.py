"""Point-in-time feature join by dyadic stabbing-max.

A version is usable over an interval of whole seconds.  The interval is the union of at
most two nodes a level of the binary tree over time, whose node (l, i) spans
[i 2^l, (i + 1) 2^l).  Of the versions at one node the best one is kept; a question at
time t meets all intervals that hold t at the nodes (l, t >> l), so it is joined with these
on equality and takes the best of at most one version a level.

What is shuffled: versions times their nodes, summed up before the shuffle, and distinct
(entity, time) questions times the levels.  A node of level l answers at most 2^l
distinct questions, however many rows ask and whatever share one entity has; nodes of
more than 2^16 seconds are dealt out in 32 copies.  Nothing but one number, the length of
the longest interval, reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: nodes above this level are copied SALTS times, each copy for a share of the questions
SALT_LEVEL, SALTS = 16, 32


def _shift(x: Column, level: int) -> Column:
    return F.shiftright(x, level) if level else x


def canonical_nodes(lo: Column, hi: Column, top: int) -> Column:
    """Nodes (l, n) that make up [lo, hi), which has at most 2^(top + 1) - 1 seconds; some array items are null."""
    found = []
    for level in range(top + 1):
        first, end = -_shift(-lo, level), _shift(hi, level)  # nodes first to end - 1 are inside
        node = lambda n, level=level: F.struct(F.lit(level).alias("l"), n.alias("n"))
        found.append(F.when((first < end) & (first.bitwiseAND(F.lit(1)) == 1), node(first)))
        found.append(F.when((first < end) & (end.bitwiseAND(F.lit(1)) == 1), node(end - 1)))
    return F.array(*found)


def point_in_time(
    questions: DataFrame,
    versions: DataFrame,
    *,
    entity: str = "entity",
    at: str = "t",
    event: str = "event",
    arrival: str = "arrival",
    expiry: str = "expiry",
    version_id: str = "version_id",
    features: list[str] | None = None,
    out: str = "version",
    salt_level: int = SALT_LEVEL,
) -> DataFrame:
    """Each row of ``questions`` with ``<out>``: the version to use at its time, a struct
    ``(event, arrival, version_id, <features>...)``, or null where there is none.

    ``questions`` has ``<entity>`` and ``<at>``, ``versions`` has ``<entity>``, whole
    seconds ``<event>``, ``<arrival>`` and ``<expiry>``, and ``<version_id>``.  A version is usable for equal
    entities where event <= t and arrival <= t < expiry.  The latest event wins, then the earliest
    arrival, then the largest id, then the largest features, which must have an order.
    Nulls in entity, time or any of the three times fit nothing; a null id counts as the smallest.
    Repeated questions are answered each; repeated versions count once.  A column ``<out>`` of the questions
    is replaced; other columns of theirs stay, other columns of the versions are not read.
    No versions: all answers are null; no questions: no rows."""
    features = features or []
    asks = questions.drop(out)
    asks = asks.select(F.struct(*[F.col(f"`{c}`") for c in asks.columns]).alias("q") if asks.columns else F.struct().alias("q"), F.col(entity).alias("e"), F.col(at).cast("long").alias("t"))
    lo, hi = F.greatest(F.col(event).cast("long"), F.col(arrival).cast("long")), F.col(expiry).cast("long")
    # ~arrival falls as arrival grows, for all values of it
    best = F.struct(F.col(event).cast("long").alias("event"), F.bitwise_not(F.col(arrival).cast("long")).alias("late"), F.col(version_id).alias("version_id"), *features)
    usable = versions.where(F.col(entity).isNotNull() & F.col(event).isNotNull() & F.col(arrival).isNotNull() & (lo < hi))
    longest = usable.select(F.max(F.coalesce(F.try_subtract(hi, lo), F.lit(2**63 - 1)))).first()[0]
    if longest is None:
        none = F.lit(None).cast(_answer(usable.select(best.alias("best"))))
        return asks.select("q.*", none.alias(out))
    top = longest.bit_length() - 1
    nodes = usable.select(F.col(entity).alias("e"), F.explode(canonical_nodes(lo, hi, top)).alias("node"), best.alias("best")).where("node IS NOT NULL")
    nodes = nodes.groupBy("e", "node.l", "node.n").agg(F.max("best").alias("best"))
    asked = asks.where("e IS NOT NULL AND t IS NOT NULL").select("e", "t").distinct()
    path = F.explode(F.array(*[F.struct(F.lit(level).alias("l"), _shift(F.col("t"), level).alias("n")) for level in range(top + 1)])).alias("node")
    asked = asked.select("e", "t", path).select("e", "t", "node.l", "node.n")
    on = ["e", "l", "n"]
    if top > salt_level:
        on.append("s")
        high = F.col("l") > salt_level
        nodes = nodes.withColumn("s", F.explode(F.when(high, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).repartition(*on)
        asked = asked.withColumn("s", F.when(high, F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int")).otherwise(0))
    answers = asked.join(nodes, on).groupBy("e", "t").agg(F.max("best").alias("best"))
    found = asks.join(answers, ["e", "t"], "left")
    return found.select("q.*", F.when(F.col("best").isNotNull(), _shown(features)).alias(out))


def _shown(features: list[str]) -> Column:
    return F.struct(F.col("best.event").alias("event"), F.bitwise_not("best.late").alias("arrival"), F.col("best.version_id").alias("version_id"), *[F.col(f"best.`{f}`").alias(f) for f in features])


def _answer(best: DataFrame):
    features = best.schema["best"].dataType.names[3:]
    return best.select(_shown(features).alias("x")).schema["x"].dataType
