"""Scoring of answers, slices, labels, differences and admission."""

from __future__ import annotations

import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFUSE = "REFUSE"


def strict_json(text: str) -> Any:
    """A JSON document; repeated keys, NaN and infinities, overflowing numbers and trailing text are errors."""

    def no_repeats(pairs: list[tuple[str, Any]]) -> dict:
        found = dict(pairs)
        if len(found) != len(pairs):
            raise ValueError("a key is repeated")
        return found

    def bounded(number: str) -> float:
        x = float(number)
        if math.isinf(x):
            raise ValueError(f"{number} is not finite")
        return x

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, object_pairs_hook=no_repeats, parse_float=bounded, parse_constant=refuse)


#: what the JVM's parser may see otherwise than strict_json() does: numbers beyond a double or of many digits, surrogates
_UNUSUAL = r"[eE]\+?[0-9]{3}|[0-9]{300}|\\\\u[dD][89a-fA-F]"


def is_strict_json(text: Column) -> Column:
    """Whether a text is what strict_json() takes; null for null.

    The JVM's parser refuses repeated keys and names of numbers, but reads no further than the end of the first value.  So the text is read as the
    value of an object that goes on with a key which the text can't hold, the digest of itself: where a text ends early, that key is missing,
    where it goes on, there are more.  Texts that hold what the parser may see otherwise, or that are long or have many brackets, go through Python."""

    @F.pandas_udf("boolean")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else _accepts(t))

    mark = F.sha2(text, 256)
    whole = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit(',"'), mark, F.lit('":1}')))
    keys = F.map_keys(F.try_variant_get(whole, "$", "map<string,variant>"))
    native = F.coalesce((F.size(keys) == 2) & F.array_contains(keys, mark), F.lit(False))
    unusual = text.rlike(_UNUSUAL) | (F.length(text) > 1 << 20) | (F.length(text) - F.length(F.translate(text, "[{", "")) > 300)
    return F.when(text.isNull(), None).when(unusual, of(F.when(unusual, text))).otherwise(native)


def _accepts(text: str) -> bool:
    try:
        strict_json(text)
    except (ValueError, RecursionError):
        return False
    return True


def answer_of(raw: Column) -> Column:
    """The string under "answer" of a strict JSON object with no other key, else null."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                value = strict_json(t) if t is not None else None
            except (ValueError, RecursionError):
                value = None
            ok = isinstance(value, dict) and set(value) == {"answer"} and isinstance(value["answer"], str)
            out.append(value["answer"] if ok else None)
        return pd.Series(out, dtype=object)

    return of(raw)


def parse_labels(answer: Column, known: Column) -> Column:
    """Labels of a canonical answer: known, distinct, sorted, joined by ', '; empty for a refusal; null otherwise."""
    parts = F.split(answer, ", ")
    good = F.forall(parts, lambda p: F.array_contains(known, p)) & (F.array_join(F.array_sort(F.array_distinct(parts)), ", ") == answer)
    return F.when(answer == REFUSE, F.array().cast("array<string>")).when(F.coalesce(good, F.lit(False)), parts)


def taxonomy(choices: Column) -> Column:
    """Sorted atomic labels of a catalogue of combinations."""
    parts = F.flatten(F.transform(F.filter(choices, lambda c: c != REFUSE), lambda c: F.split(c, ", ")))
    return F.array_sort(F.array_distinct(parts))


def malformed_choices(choices: Column) -> Column:
    """True for a catalogue that is empty, repeats itself, lacks a refusal or holds a combination that is not canonical."""
    def bad(c: Column) -> Column:
        p = F.split(c, ", ")
        plain = lambda x: (x != "") & (x == F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))) & ~F.contains(x, F.lit(",")) & (x != "refuse")
        return (c != REFUSE) & ~(F.forall(p, plain) & (F.array_join(F.array_sort(F.array_distinct(p)), ", ") == c))

    whole = (F.size(choices) > 0) & (F.size(F.array_distinct(choices)) == F.size(choices)) & F.array_contains(choices, REFUSE) & ~F.exists(choices, bad) & (F.size(taxonomy(choices)) > 0)
    return ~F.coalesce(whole, F.lit(False))


def score_items(golden: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row per golden item: parsed answer, validity, correctness and label counts.

    ``golden(id, expected, choices, slices)``, ``outputs(id, raw, error)``.  An answer
    is valid without an error, as strict JSON, and as one of the choices; what is not
    valid predicts no label and stays in every denominator."""
    joined = golden.join(outputs, "id", "left").withColumn("parsed", F.when(F.col("error").isNull(), answer_of(F.col("raw"))))
    known = taxonomy(F.col("choices"))
    return scored(joined.withColumn("valid", F.coalesce(F.array_contains("choices", F.col("parsed")), F.lit(False))), known)


def scored(items: DataFrame, known: Column) -> DataFrame:
    """Adds correct, expected_labels, predicted_labels, tp, fp, fn and support to ``items(expected, parsed, valid)``."""
    empty = F.array().cast("array<string>")
    with_labels = items.withColumn("expected_labels", F.coalesce(parse_labels(F.col("expected"), known), empty)).withColumn(
        "predicted_labels", F.when(F.col("valid"), F.coalesce(parse_labels(F.col("parsed"), known), empty)).otherwise(empty)
    )
    e, p = F.col("expected_labels"), F.col("predicted_labels")
    return with_labels.withColumns(
        {
            "correct": F.col("valid") & (F.col("parsed") == F.col("expected")),
            "tp": F.size(F.array_intersect(e, p)).cast("long"),
            "fp": F.size(F.array_except(p, e)).cast("long"),
            "fn": F.size(F.array_except(e, p)).cast("long"),
            "support": F.size(e).cast("long"),
        }
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def per_label(scores: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(keys, label, tp, fp, fn, support, precision, recall, f1)`` for every label of ``labels(label)``, also those without support."""
    keys = keys or []
    one = scores.select(*keys, F.explode(F.array_union("expected_labels", "predicted_labels")).alias("label"), "expected_labels", "predicted_labels")
    e, p = F.array_contains("expected_labels", F.col("label")), F.array_contains("predicted_labels", F.col("label"))
    counts = one.groupBy(*keys, "label").agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"), F.count_if(e).alias("support"))
    grid = scores.select(*keys).distinct().join(F.broadcast(labels)) if keys else labels  # the taxonomy is a fixed, small list
    filled = grid.join(counts, [*keys, "label"], "left").na.fill(0)
    return filled.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def metrics(scores: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(keys, n, correct, valid, errors, accuracy, format_rate, tp, fp, fn, support, micro_f1, macro_f1)``.

    Micro over all labels pooled, macro over the whole taxonomy."""
    keys = keys or []
    base = scores.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if("correct").alias("correct"),
        F.count_if("valid").alias("valid"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")],
    )
    base = base.withColumns({"accuracy": ratio(F.col("correct"), F.col("n")), "format_rate": ratio(F.col("valid"), F.col("n")), "micro_f1": prf(F.col("tp"), F.col("fp"), F.col("fn"))["f1"]})
    macro = per_label(scores, labels, keys).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))
    return base.join(macro, keys) if keys else base.crossJoin(macro)  # one row each


def by_slice(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """The metrics of each slice; an item counts in all of its slices, so slices never add up."""
    return metrics(scores.withColumn("slice", F.explode(F.array_distinct("slices"))), labels, ["slice"])


def answer_diff(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """``(id, change)``: improved or regressed items."""
    a, b = baseline.select("id", F.col("correct").alias("was")), candidate.select("id", F.col("correct").alias("now"))
    change = F.when(~F.col("was") & F.col("now"), "improved").when(F.col("was") & ~F.col("now"), "regressed")
    return a.join(b, "id").select("id", change.alias("change")).where("change IS NOT NULL")


def unmatched(golden: DataFrame, outputs: DataFrame) -> DataFrame:
    """``(id, side)`` of ids that are on one side only."""
    a, b = golden.select("id", F.lit(True).alias("g")), outputs.select("id", F.lit(True).alias("o"))
    return a.join(b, "id", "full_outer").where("g IS NULL OR o IS NULL").select("id", F.when(F.col("g").isNull(), "output").otherwise("golden").alias("side"))


def gate(overall: DataFrame, slices: DataFrame, behavioral: DataFrame, critical: list[str]) -> DataFrame:
    """``(reason)`` of each ground for refusal; no row lets the candidate pass.

    ``overall(model, ...)`` and ``slices(model, slice, ...)`` hold metrics of the models
    'baseline' and 'candidate', ``behavioral`` those of the candidate's obligatory
    cases.  Missing rows, null or non-finite metrics refuse too."""
    spark = overall.sparkSession
    names = ["accuracy", "format_rate", "micro_f1", "macro_f1"]

    def two(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        a = rows.where("model = 'baseline'").select(*keys, *[F.col(c).alias(f"was_{c}") for c in columns])
        b = rows.where("model = 'candidate'").select(*keys, *[F.col(c).alias(f"now_{c}") for c in columns])
        return a.join(b, keys, "full_outer") if keys else a.crossJoin(b)

    def worse(columns: list[str], where: Column) -> Column:
        bad = lambda c: ~F.coalesce(F.col(f"now_{c}") >= F.col(f"was_{c}"), F.lit(False)) | F.isnan(f"now_{c}") | F.isnan(f"was_{c}")
        return F.explode(F.filter(F.array(*[F.when(bad(c), F.concat(where, F.lit(f": {c} fell"))) for c in columns]), lambda x: x.isNotNull()))

    need = spark.createDataFrame([(s,) for s in critical], "slice string")
    have = two(slices, ["slice"], ["accuracy", "micro_f1"])
    found = [
        two(overall, [], names).select(worse(names, F.lit("overall")).alias("reason")),
        need.join(have, "slice", "left").select(worse(["accuracy", "micro_f1"], F.concat(F.lit("slice "), F.col("slice"))).alias("reason")),
        overall.where("errors > 0").select(F.concat("model", F.lit(": generation errors")).alias("reason")),
        overall.where("n < 50").select(F.concat("model", F.lit(": fewer than 50 items")).alias("reason")),
        slices.groupBy("model").agg(F.count_distinct("slice").alias("k")).where("k < 3").select(F.concat("model", F.lit(": fewer than 3 slices")).alias("reason")),
        behavioral.where("n < 3 OR correct <> n OR valid <> n OR errors > 0").select(F.lit("behavioral cases not all passed").alias("reason")),
        overall.groupBy().agg(F.count_if(F.col("model") == "baseline").alias("a"), F.count_if(F.col("model") == "candidate").alias("b")).where("a <> 1 OR b <> 1").select(F.lit("a report is missing").alias("reason")),
        behavioral.groupBy().agg(F.count("*").alias("k")).where("k <> 1").select(F.lit("behavioral report is missing").alias("reason")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out.distinct()


def golden_contract(golden: DataFrame, behavioral: DataFrame, training: DataFrame, normalized) -> DataFrame:
    """``(reason, items)`` of each breach of the contract between golden, behavioral and training rows.

    ``normalized`` makes the key of an input.  Columns: id, group_id, input, expected,
    choices, slices; behavioral also type and paired_with."""
    from tessera.operators.dedup import leaks

    both = golden.select("id", "group_id", "input", "expected", "choices", "slices").unionByName(behavioral.select("id", "group_id", "input", "expected", "choices", "slices"))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    count = lambda rows, reason: rows.groupBy().agg(F.count("*").alias("items")).where("items > 0").select(F.lit(reason).alias("reason"), "items")
    kinds = ("format", "paraphrase", "refusal")
    pairs = behavioral.where("paired_with IS NOT NULL").select("id", "paired_with", "group_id", "expected")
    other = both.select(F.col("id").alias("paired_with"), F.col("group_id").alias("other_group"), F.col("expected").alias("other_expected"))
    paired = pairs.join(other, "paired_with", "left").where(F.col("other_group").isNull() | (F.col("id") == F.col("paired_with")) | (F.col("group_id") != F.col("other_group")) | (F.col("expected") != F.col("other_expected")))
    found = [
        golden.groupBy().agg(F.count("*").alias("items")).where("items < 50").select(F.lit("fewer than 50 golden items").alias("reason"), "items"),
        golden.select(F.explode("slices").alias("s")).agg(F.count_distinct("s").alias("items")).where("items < 3").select(F.lit("fewer than 3 slices").alias("reason"), "items"),
        behavioral.agg(F.count_distinct(F.when(F.col("type").isin(*kinds), F.col("type"))).alias("items")).where("items < 3").select(F.lit("a kind of behavioral case is missing").alias("reason"), "items"),
        count(behavioral.where(~F.coalesce(F.col("type").isin(*kinds), F.lit(False))), "unknown kind of behavioral case"),
        count(both.where(blank(F.col("id")) | blank(F.col("group_id")) | blank(F.col("input"))), "blank id, group or input"),
        count(both.where(malformed_choices(F.col("choices")) | ~F.coalesce(F.array_contains("choices", F.col("expected")), F.lit(False))), "malformed choices or expected answer"),
        both.agg(F.count_distinct("choices").alias("items")).where("items > 1").select(F.lit("more than one catalogue of choices").alias("reason"), "items"),
        count(both.groupBy("id").count().where("count > 1"), "repeated ids"),
        count(golden.groupBy(normalized(F.col("input")).alias("k")).count().where("count > 1"), "repeated golden inputs"),
        count(leaks(both.select("id", "input", "group_id"), training, normalized(F.col("input")), "group_id"), "inputs or groups shared with training"),
        count(paired, "behavioral pairs that do not hold"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out.withColumn("items", F.col("items").cast("long"))
