"""Readers for JSON lines, CSV, metric text, metric query results, logs, documents and parameters."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.evaluate import strict_json
from tessera.operators.quality import require
from tessera.session import bound_batches, cut


#: names of files that a codec reads, so that their size is not that of their text
_PACKED = r"(?i)\.(?:gz|gzip|bz2|deflate|snappy|lz4|zst|zstd|xz)$"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, value, closed)``: the lines of text files, numbered from 1 within each file; ``closed`` where the file ends with a line end.

    A file is read in splits, by as many tasks: a line's number is its place in its split
    and the lines of the splits before it.  Packed files can't be split and are read whole."""
    bound_batches(spark)
    file = F.col("_metadata.file_path")
    read = spark.read.option("lineSep", "\n").text(path).where(~file.rlike(_PACKED))
    # written down, so that splits and places stay as they are, whenever a task runs again
    rows = cut(read.select(file.alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("i"), "value"))
    splits = rows.groupBy("file", "at").agg(F.min("i").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.first("size").alias("size"))
    of_file = Window.partitionBy("file")
    before = F.sum("n").over(of_file.orderBy("at")) - F.col("n")
    # what the lines leave of a file: -1 byte where the last has no end, three more where the reader took a byte order mark
    rest = F.col("size") - F.sum("bytes").over(of_file)
    placed = cut(splits.select("file", "at", (F.col("first") - before).alias("zero"), F.sum("n").over(of_file).alias("last"), (rest % 3 == 0).alias("closed"), (rest > 1).alias("mark")))
    line = F.col("i") - F.col("zero") + 1
    ended = F.col("closed") | (line < F.col("last"))
    value = F.when(ended & F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    value = F.when(F.col("mark") & (line == 1), F.concat(F.lit("\ufeff"), value)).otherwise(value)
    plain = rows.join(F.broadcast(placed), ["file", "at"]).select("file", line.alias("line"), value.alias("value"), "closed")
    # a final line end closes a line and opens none; only lines go on from here, not the text beside each of them
    parts = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")
    whole = spark.read.text(path, wholetext=True).where(file.rlike(_PACKED)).select(file.alias("file"), F.endswith("value", F.lit("\n")).alias("closed"), parts.alias("parts"))
    packed = whole.select("file", "closed", F.posexplode("parts").alias("i", "value")).select("file", (F.col("i") + 1).cast("long").alias("line"), "value", "closed")
    return plain.unionAll(packed)


def check_json(schema: StructType, closed: bool = True):
    """(value) -> (json, error): the value where it is a strict JSON object with the schema's fields, else why not.

    ``closed`` refuses other keys, at the top level and in nested structures."""
    simple = json.loads(schema.json())

    def wrong(value: Any, kind: Any, path: str) -> str | None:
        if isinstance(kind, dict) and kind["type"] == "struct":
            if not isinstance(value, dict):
                return f"{path or 'value'} is no object"
            names = {f["name"] for f in kind["fields"]}
            if closed and (extra := sorted(set(value) - names)):
                return f"unknown key {extra[0]}"
            for f in kind["fields"]:
                if value.get(f["name"]) is None:
                    if not f["nullable"]:
                        return f"{path}{f['name']} is missing"
                elif found := wrong(value[f["name"]], f["type"], f"{path}{f['name']}."):
                    return found
            return None
        if isinstance(kind, dict) and kind["type"] == "array":
            if not isinstance(value, list):
                return f"{path.rstrip('.')} is no list"
            return next((e for x in value if (e := wrong(x, kind["elementType"], path))), None)
        if isinstance(kind, dict):
            return None
        python = {"string": str, "boolean": bool, "double": (int, float), "float": (int, float)}.get(kind, int)
        ok = isinstance(value, python) and (python is bool or not isinstance(value, bool))
        return None if ok else f"{path.rstrip('.')} is no {kind}"

    @F.pandas_udf("string")
    def errors(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            try:
                out.append("blank line" if not v.strip() else wrong(strict_json(v), simple, ""))
            except (ValueError, RecursionError) as e:
                out.append(f"bad JSON: {e}")
        return pd.Series(out, dtype=object)

    return errors


def read_jsonl_strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of JSON lines; the first line that breaks the schema is an error that names file and line."""
    checked = lines(spark, path).withColumn("error", check_json(schema)(F.col("value")))
    bad = checked.where("error IS NOT NULL").orderBy("file", "line").first()
    if bad:
        raise ValueError(f"{bad['file']}:{bad['line']}: {bad['error']}")
    return checked.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): a torn last line, one without a line end, is passed over; other bad lines are errors (file, line)."""
    checked = lines(spark, path).withColumn("error", check_json(schema, closed=False)(F.col("value")))
    last = checked.groupBy("file").agg(F.max("line").alias("last"))
    placed = checked.join(last, "file")
    torn = (F.col("line") == F.col("last")) & ~F.col("closed")
    rows = placed.where("error IS NULL").select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows, placed.where(F.col("error").isNotNull() & ~torn & (F.trim("value") != "")).select("file", "line", "error")


def read_rows_unique(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines with blank ones skipped; ids must be there, not blank, and unique."""
    kept = lines(spark, path).where(F.trim("value") != "").withColumn("error", check_json(schema, closed=False)(F.col("value")))
    require(kept.where("error IS NOT NULL").select("file", "line", "error"), "bad rows")
    rows = kept.select(F.from_json("value", schema).alias("r")).select("r.*")
    require(rows.where("id IS NULL OR trim(id) = ''").select(F.lit("a blank id").alias("reason")), path)
    require(rows.groupBy("id").count().where("count > 1"), "repeated ids")
    return rows


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with a header, all columns strings; a byte order mark is dropped, missing columns are an error."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    if missing := sorted(set(required) - set(rows.columns)):
        raise ValueError(f"{path}: missing columns {missing}")
    return rows


def read_first(spark: SparkSession, path: str, columns: list[str], order: str, limit: int) -> DataFrame:
    """The first rows by an explicit order; only the columns asked for are read."""
    return spark.read.parquet(path).select(*columns).orderBy(order).limit(limit)


def parse_metrics(texts: DataFrame, text: str, names: list[str], keys: list[str]) -> DataFrame:
    """``(keys, metric, le, value)`` of histogram lines in metric text; ``_count`` lines have a null edge."""
    line = F.explode(F.split(text, r"\r?\n"))
    rows = texts.select(*keys, line.alias("line")).where(~F.startswith("line", F.lit("#")))
    found = F.regexp_extract("line", r"^([A-Za-z_:][A-Za-z0-9_:]*)_(?:bucket|count)(?:\{|\s)", 1)
    le = F.regexp_extract("line", r'_bucket\{.*?le="([^"]+)"', 1)
    value = F.regexp_extract("line", r"\s(\S+)\s*$", 1)
    edge = F.when(le == "+Inf", F.lit(float("inf"))).otherwise(F.expr("try_cast(nullif(le_text, '') AS DOUBLE)"))
    out = rows.withColumn("metric", found).where(F.col("metric").isin(names)).withColumn("le_text", le).withColumn("value_text", value)
    kind = F.contains("line", F.lit("_count"))
    return out.select(*keys, "metric", edge.alias("le"), F.expr("try_cast(value_text AS DOUBLE)").alias("value"), kind.alias("is_count")).where(F.col("is_count") | F.col("le").isNotNull()).drop("is_count")


def unwrap_series(documents: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``(keys, labels, t, value)`` of metric query results, instant or range; nested "data" is unwrapped, non-finite values go."""
    @F.pandas_udf("array<struct<labels: map<string, string>, t: double, value: double>>")
    def points(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = []
            try:
                node = json.loads(t) if t else {}
            except ValueError:
                node = {}
            while isinstance(node, dict) and "result" not in node and "data" in node:
                node = node["data"]
            for series in node.get("result", []) if isinstance(node, dict) else []:
                for at, value in series.get("values") or [series["value"]] if "values" in series or "value" in series else []:
                    number = float(value)
                    if number - number == 0:
                        found.append({"labels": {k: str(v) for k, v in series.get("metric", {}).items()}, "t": float(at), "value": number})
            out.append(found)
        return pd.Series(out, dtype=object)

    return documents.select(*keys, F.explode(points(F.col(text))).alias("p")).select(*keys, "p.labels", "p.t", "p.value")


def read_pod_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of log lines whose JSON begins at the first brace; lines without one are passed over."""
    text = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.expr("substring(value, instr(value, '{'))").alias("body"), F.expr("instr(value, '{')").alias("at"))
    return text.where("at > 0").select("file", F.from_json("body", schema, {"mode": "PERMISSIVE"}).alias("e")).where("e IS NOT NULL").select("file", "e.*")


def read_json(path: str, default: Any = None) -> Any:
    """A strict JSON document on the driver; ``default`` where the file is missing."""
    try:
        with open(path, encoding="utf-8") as f:
            return strict_json(f.read())
    except FileNotFoundError:
        return default


def verify_files(spark: SparkSession, path: str, expected: dict[str, str]) -> DataFrame:
    """``(name, expected, found)`` of files whose sha256 differs from the expected, or that are missing."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    want = spark.createDataFrame(sorted(expected.items()), "name string, expected string")
    return want.join(files, "name", "left").where("found IS NULL OR found <> expected")


def load_split(spark: SparkSession, path: str) -> DataFrame:
    """Encoded rows of a parquet split; rows that break the invariants of training rows, or repeat an id, are errors."""
    from tessera.operators.encode import valid_row

    rows = spark.read.parquet(path)
    require(rows.where(~valid_row(F.col("input_ids"), F.col("attention_mask"), F.col("labels"))).select("id"), "invalid rows")
    require(rows.groupBy("id").count().where("count > 1"), "repeated ids")
    return rows


def canonical_json(value: Column) -> Column:
    """A struct column as JSON with sorted keys and no spaces, at every level; NaN and infinities are errors."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(strict_json(t), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))

    return of(F.to_json(value, {"ignoreNullFields": "false"}))
