"""Diversity metrics and threshold gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

#: name -> (metric, 'min' or 'max', limit): fixed values
DIVERSITY_LIMITS = {
    "min_examples": ("examples", "min", 1000.0),
    "min_system_prompts": ("system_prompts", "min", 3.0),
    "min_groups": ("groups", "min", 50.0),
    "max_group_share": ("largest_group_share", "max", 0.10),
    "min_answer_len_ratio": ("answer_len_ratio", "min", 1.6),
    "max_same_length_share": ("same_length_share", "max", 0.25),
    "max_duplicate_answer_share": ("duplicate_answer_share", "max", 0.90),
    "min_genres": ("labels", "min", 15.0),
    "max_genre_share": ("largest_label_share", "max", 0.50),
    "min_multilabel_share": ("multilabel_share", "min", 0.60),
    "min_description_len_ratio": ("description_len_ratio", "min", 2.5),
}


def largest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``(name, count, distinct)``: the most frequent value; of equal ones that whose first row comes first."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("c"), F.min(order).alias("first"))
    return counts.agg(F.min_by(key, F.struct(-F.col("c"), F.col("first"))).alias("name"), F.max("c").alias("count"), F.count("*").alias("distinct"))


def value_counts(rows: DataFrame, facts: dict[str, Column], lists: dict[str, Column]) -> DataFrame:
    """``(kind, key, c)``: how often each value of each fact occurs, from one pass; ``lists`` are arrays of which each value counts. Null is a value of a fact."""
    fact = lambda kind: lambda value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("key"))
    one = [fact(kind)(value) for kind, value in facts.items()]
    more = [F.transform(values, fact(kind)) for kind, values in lists.items()]
    return rows.select(F.explode(F.concat(F.array(*one), *[F.coalesce(m, F.array().cast("array<struct<kind:string,key:string>>")) for m in more])).alias("f")).groupBy("f.kind", "f.key").agg(F.count("*").alias("c"))


def diversity(rows: DataFrame) -> DataFrame:
    """``(metric, value)`` over ``rows(seq, system, grp, description, answer, labels)``, labels an array.

    Shares of nothing are 0.  All metrics come from the counts of values, which are taken in one pass; the quantiles of lengths from the
    counts of different lengths, which the longest text bounds."""
    facts = {"system": F.col("system"), "grp": F.col("grp"), "answer_len": F.length("answer"), "description_len": F.length("description"), "answer": F.xxhash64("answer"), "multi": F.size("labels") > 1}
    counts = cut(value_counts(rows, facts, {"label": F.array_distinct("labels")}))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    of = lambda kind, known=True: (F.col("kind") == kind) & (F.col("key").isNotNull() if known else F.lit(True))
    most = lambda test: F.max(F.when(test, F.col("c")))
    whole = counts.agg(
        F.coalesce(F.sum(F.when(of("answer"), F.col("c"))), F.lit(0)).alias("n"),
        F.count_if(of("system")).alias("system_prompts"),
        F.count_if(of("answer")).alias("answers"),
        F.coalesce(F.sum(F.when(of("multi") & (F.col("key") == "true"), F.col("c"))), F.lit(0)).alias("multi"),
        F.count_if(of("grp")).alias("groups"),
        most(of("grp")).alias("g_count"),
        most(of("answer_len", False)).alias("mode"),
        F.count_if(of("label")).alias("labels"),
        most(of("label", False)).alias("l_count"),
    )
    lengths = counts.where(of("answer_len") | of("description_len"))
    by = Window.partitionBy("kind")
    upto = F.sum("c").over(by.orderBy(F.col("key").cast("long")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = lengths.select("kind", F.col("key").cast("long").alias("v"), upto.alias("upto"), F.sum("c").over(by).alias("n"))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n"))), F.col("v")))
    ratios = ranked.groupBy("kind").agg((at(0.9) / F.greatest(at(0.1), F.lit(1))).alias("ratio"))
    wide = ratios.agg(*[F.max(F.when(F.col("kind") == c, F.col("ratio"))).alias(f"{c}_ratio") for c in ("answer_len", "description_len")])
    one = whole.crossJoin(wide)  # one row each
    values = {
        "examples": F.col("n"),
        "system_prompts": F.col("system_prompts"),
        "groups": F.col("groups"),
        "largest_group_share": share("g_count", "n"),
        "answer_len_ratio": F.col("answer_len_ratio"),
        "same_length_share": share("mode", "n"),
        "duplicate_answer_share": F.coalesce(F.try_divide((F.col("n") - F.col("answers")).cast("double"), F.col("n").cast("double")), F.lit(0.0)),
        "labels": F.col("labels"),
        "largest_label_share": share("l_count", "n"),
        "multilabel_share": share("multi", "n"),
        "description_len_ratio": F.col("description_len_ratio"),
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()])).alias("m")).select("m.metric", "m.value")


def violations(metrics: DataFrame, limits: dict[str, tuple[str, str, float]]) -> DataFrame:
    """``(rule, metric, value, threshold)`` of every limit that ``metrics(metric, value)`` breaks; an absent or NaN metric breaks it."""
    table = metrics.sparkSession.createDataFrame([(k, *v) for k, v in sorted(limits.items())], "rule string, metric string, kind string, threshold double")
    ok = F.when(F.col("kind") == "min", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold")) & ~F.isnan("value")
    return F.broadcast(table).join(metrics, "metric", "left").where(~F.coalesce(ok, F.lit(False))).select("rule", "metric", "value", "threshold")  # a handful of limits


def require(found: DataFrame, what: str) -> None:
    """Raises where ``found`` has rows; the first three, in order, are in the message."""
    rows = found.orderBy(*found.columns).limit(3).collect()
    if rows:
        raise ValueError(f"{what}: " + "; ".join(", ".join(map(str, r)) for r in rows))
