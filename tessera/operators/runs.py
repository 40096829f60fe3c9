"""Training runs and curves as tables: selection, sweeps, weighted losses, parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import finite


def search_runs(runs: DataFrame, tags: dict[str, str]) -> DataFrame:
    """``runs(run_id, tags map, ...)`` with all the tags."""
    out = runs
    for k, v in sorted(tags.items()):
        out = out.where(F.try_element_at("tags", F.lit(k)).eqNullSafe(F.lit(v)))
    return out


def passing(runs: DataFrame, max_ratio: float) -> DataFrame:
    """Runs whose final loss is at most ``max_ratio`` of their base loss; null and non-finite losses do not pass."""
    ratio = F.try_divide("final_loss", "base_loss")
    return runs.where(finite(ratio) & (ratio <= max_ratio))


def best(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The run of least (final_loss, run_id) by keys."""
    return runs.groupBy(*keys).agg(F.min(F.struct("final_loss", "run_id")).alias("b")).select(*keys, "b.final_loss", "b.run_id")


def sweep_problems(runs: DataFrame, config: str, tolerance: float = 1e-6) -> DataFrame:
    """``(config, reason)``: a configuration with several runs; runs whose base losses or budgets differ."""
    several = runs.groupBy(config).agg(F.count("*").alias("k")).where("k > 1").select(F.col(config).cast("string").alias("config"), F.lit("more than one run").alias("reason"))
    span = runs.agg((F.max("base_loss") - F.min("base_loss")).alias("gap"), F.count_distinct("budget").alias("budgets"))
    uneven = span.select(F.lit("*").alias("config"), F.explode(F.filter(F.array(F.when(F.col("gap") > tolerance, F.lit("unequal base losses")), F.when(F.col("budgets") > 1, F.lit("unequal budgets"))), lambda x: x.isNotNull())).alias("reason"))
    return several.unionAll(uneven)


def weighted_mean(value: Column, weight: Column) -> Column:
    """sum(value * weight) / sum(weight), null without weight."""
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def curve_problems(curve: DataFrame, run: str, step: str) -> DataFrame:
    """``(run, not_rising, starts_at)`` of curves whose steps do not rise strictly from 0."""
    w = Window.partitionBy(run).orderBy("__row")
    rows = curve.withColumn("__row", F.monotonically_increasing_id()).withColumn("__before", F.lag(step).over(w))
    out = rows.groupBy(run).agg(F.count_if(F.col(step) <= F.col("__before")).alias("not_rising"), F.min_by(step, "__row").alias("starts_at"))
    return out.where("not_rising > 0 OR starts_at <> 0")


def adapter_parameters(rank: int, inputs: Column, outputs: Column) -> Column:
    """Of a low-rank adapter: r (in + out)."""
    return rank * (inputs + outputs)
