"""Splitting whole groups into train, val and test."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

SPLITS = ("train", "val", "test")


def check_ratios(ratios: dict[str, float]) -> dict[str, float]:
    if set(ratios) != set(SPLITS):
        raise ValueError(f"ratios are needed for {', '.join(SPLITS)}")
    for r in ratios.values():
        if isinstance(r, bool) or not isinstance(r, int | float) or not math.isfinite(r) or r <= 0:
            raise ValueError("ratios are positive finite numbers")
    if abs(sum(ratios.values()) - 1) > 1e-9:
        raise ValueError("ratios add up to 1")
    return {s: float(ratios[s]) for s in SPLITS}


def cover(groups: dict[str, tuple[int, dict[str, int]]]) -> list[str]:
    """Groups that together have all labels: each time the one with most new labels, then fewest rows, then the smallest key.

    ``groups``: key -> (rows, label -> count)."""
    missing = {label for _, labels in groups.values() for label in labels}
    if not missing:
        raise ValueError("no group has a label")
    chosen: list[str] = []
    while missing:
        best = min(groups, key=lambda g: (-len(missing & groups[g][1].keys()), groups[g][0], g))
        chosen.append(best)
        missing -= groups[best][1].keys()
    return chosen


def assign(groups: dict[str, tuple[int, dict[str, int]]], anchors: list[str], ratios: dict[str, float], salt: str) -> dict[str, str]:
    """Each group to the split where squared relative errors of the sizes stay smallest, in an order by salted hash.

    Anchors are in train; when as many groups are left as splits are empty, those get them."""
    total = sum(n for n, _ in groups.values())
    goal = {s: total * ratios[s] for s in SPLITS}
    size = dict.fromkeys(SPLITS, 0)
    where = dict.fromkeys(anchors, "train")
    size["train"] = sum(groups[g][0] for g in anchors)
    order = sorted(groups.keys() - where.keys(), key=lambda g: (hashlib.sha256(f"{salt}|{g}".encode()).hexdigest(), g))
    for i, g in enumerate(order):
        empty = [s for s in SPLITS if s not in where.values()]
        best, least = None, math.inf
        for s in empty if len(order) - i == len(empty) else SPLITS:
            error = sum(((size[x] + (groups[g][0] if x == s else 0) - goal[x]) / goal[x]) ** 2 for x in SPLITS)
            if error < least:
                best, least = s, error
        where[g] = best
        size[best] += groups[g][0]
    return where


def rate(groups: dict[str, tuple[int, dict[str, int]]], where: dict[str, str], ratios: dict[str, float]) -> tuple[float, float]:
    """(score, largest total variation) of an assignment; a label that train lacks costs 1000."""
    return rate_sums(*summed(groups, where), ratios)


def summed(groups: dict[str, tuple[int, dict[str, int]]], where: dict[str, str]) -> tuple[dict[str, int], dict[str, dict[str, int]]]:
    """Rows and label counts of each split."""
    size = dict.fromkeys(SPLITS, 0)
    counts: dict[str, dict[str, int]] = {s: {} for s in SPLITS}
    for g, (n, labels) in groups.items():
        s = where[g]
        size[s] += n
        for label, c in labels.items():
            counts[s][label] = counts[s].get(label, 0) + c
    return size, counts


def rate_sums(size: dict[str, int], counts: dict[str, dict[str, int]], ratios: dict[str, float]) -> tuple[float, float]:
    total = sum(size.values())
    whole = {s: sum(c.values()) for s, c in counts.items()}
    share = lambda s, label: counts[s].get(label, 0) / whole[s] if whole[s] else 0.0
    labels = sorted({label for c in counts.values() for label in c})
    drift = [0.5 * math.fsum(abs(share(s, x) - share("train", x)) for x in labels) for s in SPLITS[1:]]
    absent = sum(1 for s in SPLITS[1:] for x in counts[s] if x not in counts["train"])
    off = sum(abs(size[s] - total * ratios[s]) for s in SPLITS) / total
    return 1000 * absent + 4 * off + sum(drift), max(drift)


def cover_of(table: DataFrame) -> list[str]:
    """cover() of ``table(g, n, labels)``: a group a round, each found by a sum over the groups; rounds and what the driver holds follow the labels."""
    missing = {r["x"] for r in table.select(F.explode("labels").alias("x")).distinct().toLocalIterator()}
    if not missing:
        raise ValueError("no group has a label")
    chosen: list[str] = []
    while missing:
        new = F.size(F.array_intersect("labels", F.array(*map(F.lit, sorted(missing)))))
        best = table.where(F.col("labels").isNotNull()).select(F.min(F.struct((-new).alias("new"), "n", "g", "labels")).alias("b")).first()["b"]
        chosen.append(best["g"])
        missing -= set(best["labels"])
    return chosen


def _held(pdf: pd.DataFrame) -> dict[str, tuple[int, dict[str, int]]]:
    empty = lambda x: [] if x is None else x
    return {g: (int(n), {x: int(c) for x, c in zip(empty(labels), empty(counts), strict=True)}) for g, n, labels, counts in zip(pdf["g"], pdf["n"], pdf["labels"], pdf["counts"], strict=True)}


def search(rows: DataFrame, group: str, labels: str, ratios: dict[str, float], seed: int = 42, attempts: int = 512, chunk_groups: int = 100_000) -> DataFrame:
    """``(group, split, attempt, score, max_total_variation)`` of the best of many seeded assignments.

    ``rows``: ``group`` and an array of ``labels``.  Groups are tables and stay on the executors: they are dealt by a hash to chunks of about ``chunk_groups``,
    and each attempt assigns the groups of a chunk in its own order, towards the ratios within the chunk; up to ``chunk_groups`` there is one chunk, and the
    assignment is that of assign().  What the chunks sum up by split and label is added, and the best attempt is the least (score, attempt).  Attempts of a chunk
    are spread over the cluster.  Rows with a null group are a group of no name and are an error."""
    ratios = check_ratios(ratios)
    if isinstance(attempts, bool) or not isinstance(attempts, int) or attempts < 1:
        raise ValueError("attempts is a positive integer")
    name = F.when(F.col(group).isNull(), F.raise_error(F.lit("a row has no group"))).otherwise(F.col(group).cast("string"))
    read = rows.select(name.alias("g"), F.col(labels).alias("labels"))
    sizes = read.groupBy("g").agg(F.count("*").alias("n"))
    counted = read.select("g", F.explode("labels").alias("label")).where("label IS NOT NULL").groupBy("g", "label").agg(F.count("*").alias("c"))
    pairs = F.array_sort(F.collect_list(F.struct("label", "c")))  # a label once
    by = counted.groupBy("g").agg(pairs.alias("p")).select("g", F.col("p.label").alias("labels"), F.col("p.c").alias("counts"))
    table = cut(sizes.join(by, "g", "left"))
    many = table.count()
    anchors = cover_of(table)
    if many - len(anchors) < 2:
        raise ValueError("no two groups are left for val and test")
    chunks = max(1, math.ceil(many / chunk_groups))
    slices = max(1, min(attempts, 64 // chunks))
    dealt = table.withColumn("chunk", F.pmod(F.xxhash64("g", F.lit(seed)), F.lit(chunks)))

    def assigned(groups: dict[str, tuple[int, dict[str, int]]], attempt: int) -> dict[str, str]:
        return assign(groups, [a for a in anchors if a in groups], ratios, f"{seed}|{attempt}")

    def tried(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        groups, out = _held(pdf), []
        for attempt in range(int(key[1]), attempts, slices):
            size, counts = summed(groups, assigned(groups, attempt))
            out += [(attempt, s, None, size[s]) for s in SPLITS] + [(attempt, s, x, c) for s in SPLITS for x, c in counts[s].items()]
        return pd.DataFrame(out, columns=["attempt", "split", "label", "c"])

    def rated(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = pdf["label"].isna()
        size = dict.fromkeys(SPLITS, 0) | {s: int(c) for s, c in zip(pdf["split"][whole], pdf["c"][whole], strict=True)}
        counts: dict[str, dict[str, int]] = {s: {} for s in SPLITS}
        for s, x, c in zip(pdf["split"][~whole], pdf["label"][~whole], pdf["c"][~whole], strict=True):
            counts[s][x] = int(c)
        return pd.DataFrame([(int(pdf["attempt"].iat[0]), *rate_sums(size, counts, ratios))], columns=["attempt", "score", "drift"])

    spread = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(chunks * slices, "chunk", "slice")
    sums = spread.groupBy("chunk", "slice").applyInPandas(tried, "attempt long, split string, label string, c long")
    sums = sums.groupBy("attempt", "split", "label").agg(F.sum("c").alias("c"))
    best = sums.groupBy("attempt").applyInPandas(rated, "attempt long, score double, drift double").orderBy("score", "attempt").first()

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(sorted(assigned(_held(pdf), best["attempt"]).items()), columns=["group", "split"])

    where = dealt.groupBy("chunk").applyInPandas(chosen, "group string, split string")
    return where.select("group", "split", *[F.lit(best[c]).alias(n) for c, n in (("attempt", "attempt"), ("score", "score"), ("drift", "max_total_variation"))])


def drift(rows: DataFrame, split: str, labels: str) -> DataFrame:
    """``(split, total_variation, max_prevalence_delta, largest_delta_label, missing_in_train)`` of val and test against train.

    Label shares are of all labels of a split; prevalence is of its rows.  Ties go to
    the first label in order."""
    sizes = rows.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("rows"))
    counts = rows.select(F.col(split).alias("split"), F.explode(F.array_distinct(labels)).alias("label")).groupBy("split", "label").agg(F.count("*").alias("c"))
    totals = counts.groupBy("split").agg(F.sum("c").alias("total"))
    wide = counts.join(totals, "split").join(sizes, "split").select("split", "label", "c", (F.col("c") / F.col("total")).alias("share"), (F.col("c") / F.col("rows")).alias("prevalence"))
    train = wide.where("split = 'train'").select("label", F.col("share").alias("t_share"), F.col("prevalence").alias("t_prevalence"), F.col("c").alias("t_c"))
    names = counts.select("label").distinct()
    others = sizes.where("split <> 'train'").select("split")
    grid = F.broadcast(others).join(names)  # two splits
    joined = grid.join(wide, ["split", "label"], "left").join(train, "label", "left").na.fill(0)
    delta = F.abs(F.col("prevalence") - F.col("t_prevalence"))
    # the largest delta, the first label of equal ones
    top = joined.groupBy("split").agg(
        (F.sum(F.abs(F.col("share") - F.col("t_share"))) / 2).alias("total_variation"),
        F.max(delta).alias("max_prevalence_delta"),
        F.min(F.struct((-delta).alias("d"), "label"))["label"].alias("largest_delta_label"),
        F.count_if((F.col("c") > 0) & (F.col("t_c") == 0)).alias("missing_in_train"),
    )
    return top


def overlaps(rows: DataFrame, split: str, group: str) -> DataFrame:
    """``(left, right, shared_groups)`` of each pair of splits with a group in common."""
    pairs = rows.select(F.col(split).alias("split"), F.col(group).alias("group")).distinct()
    a, b = pairs.select(F.col("split").alias("left"), "group"), pairs.select(F.col("split").alias("right"), "group")
    return a.join(b, "group").where("left < right").groupBy("left", "right").agg(F.count("*").alias("shared_groups"))
