"""Queries of files: what writers wrote and readers, checks and releases make of it, with their SQL.

Each writes what it reads from the tables into a folder of its own below the shared
folder.  Small files are of regions and nations, whose number is fixed."""

from __future__ import annotations

import hashlib
import io
import json
import os
import tarfile
import time
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera import config
from tessera.functions import stats
from tessera.operators import encode, release
from tessera.operators.evaluate import is_strict_json
from tessera.plans import curation, encoding
from tessera.plans import requests as req
from tessera.session import own_folder, spread, table
from tessera.sources import readers, writers
from tessera.streaming import windows as W
from tessera.streaming.progress import Progress


def _folder(spark) -> str:
    return f"{own_folder(spark, 'files')}/data"


def _mounted(spark) -> str:
    """A new folder that the driver writes to as well."""
    path = _folder(spark)
    if "://" in path.replace("file://", "", 1):
        raise ValueError("these files need a shared folder that is mounted")
    path = "/" + path.removeprefix("file:").lstrip("/")
    os.makedirs(path)
    return path


def _put(path: str, text: str) -> str:
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _regions(spark, sf) -> list[tuple[int, str]]:
    return [(r[0], r[1]) for r in table(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()]


def _nations(spark, sf) -> list[tuple[int, str]]:
    return [(r[0], r[1]) for r in table(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]


# -- JSON lines, CSV, parquet, documents


def jsonl_readers(spark, sf):
    """All documents as JSON lines, by the strict, the tolerant and the unique reader."""
    path = _folder(spark)
    writers.write_jsonl(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("topic"), "text"), path, ["id"])
    schema = StructType([StructField("id", StringType(), False), StructField("topic", StringType()), StructField("text", StringType())])
    found = {"strict": readers.read_jsonl_strict(spark, path, schema), "tolerant": readers.read_jsonl_tolerant(spark, path, schema)[0], "unique": readers.read_rows_unique(spark, path, schema)}
    parts = [rows.select(F.lit(name).alias("reader"), "id", F.sha2(F.concat_ws("|", "topic", "text"), 256).alias("digest")) for name, rows in found.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


JSONL_READERS = "SELECT reader, CAST(doc_id AS VARCHAR) AS id, sha256(source || '|' || text) AS digest FROM documents, (VALUES ('strict'), ('tolerant'), ('unique')) r(reader)"


def jsonl_damage(spark, sf):
    """Lines that are no JSON are errors with their numbers, a torn last line is passed over."""
    nations = _nations(spark, sf)
    lines = ["oops" if k % 7 == 3 else json.dumps({"id": name}) for k, name in nations[:-1]]
    path = _put(f"{_mounted(spark)}/nations.jsonl", "".join(f"{x}\n" for x in lines) + json.dumps({"id": nations[-1][1]})[:5])
    rows, errors = readers.read_jsonl_tolerant(spark, path, StructType([StructField("id", StringType(), False)]))
    return rows.select(F.lit("row").alias("kind"), "id").unionAll(errors.select(F.lit("error"), F.col("line").cast("string")))


JSONL_DAMAGE = """
WITH n AS (SELECT n_nationkey AS k, n_name, row_number() OVER (ORDER BY n_nationkey) AS line FROM nation WHERE n_nationkey < (SELECT max(n_nationkey) FROM nation))
SELECT 'row' AS kind, n_name AS id FROM n WHERE k % 7 <> 3 UNION ALL SELECT 'error', CAST(line AS VARCHAR) FROM n WHERE k % 7 = 3
"""


def csv_scan(spark, sf):
    """CSV with a byte order mark, quotes, commas and line ends within fields."""
    rows = "".join(f'{k},"{name} says ""yes"", twice\nand more",\n' for k, name in _nations(spark, sf))
    path = _put(f"{_mounted(spark)}/nations.csv", "﻿key,said,empty\n" + rows)
    return readers.read_csv(spark, path, ["key", "said"]).select(F.col("key").cast("long").alias("key"), "said", F.coalesce("empty", F.lit("")).alias("empty"))


CSV_SCAN = """SELECT CAST(n_nationkey AS BIGINT) AS key, n_name || ' says "yes", twice' || chr(10) || 'and more' AS said, '' AS empty FROM nation"""


def first_rows(spark, sf):
    """The first hundred documents by id, of two columns: the limit is the feature."""
    return readers.read_first(spark, f"{sf}/documents.parquet", ["doc_id", "lang"], "doc_id", 100)


FIRST_ROWS = "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100"


def json_documents(spark, sf):
    """Which of the documents, each written whole as JSON in one of six forms, are strict JSON: no repeated keys, no NaN or infinities, nothing after the end."""
    body = F.to_json(F.struct("text", "lang"), {"ignoreNullFields": "false"})
    inner = F.substring(body, F.lit(2), F.length(body) - 2)  # without its brackets
    forms = [
        F.concat(F.lit('{"a": '), body, F.lit(', "lang": {"a": 2}}')),
        F.concat(F.lit("{"), inner, F.lit(","), inner, F.lit("}")),
        F.concat(F.lit("["), body, F.lit(", NaN]")),
        F.concat(body, F.lit(" x")),
        F.concat(F.lit('[1, {"b": -Infinity, "c": '), body, F.lit("}]")),
        F.concat(F.lit('{"b": {"text": 1, '), inner, F.lit("}}")),
    ]
    kind = F.col("doc_id") % len(forms)
    written = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        written = F.when(kind == i, form).otherwise(written)
    rows = spread(table(spark, sf, "documents")).select("doc_id", written.alias("json"))
    return rows.select("doc_id", is_strict_json(F.col("json")).alias("strict"))


# the library's reader takes names of numbers, so what is outside strings is searched for them; keys are counted where they may repeat
JSON_DOCUMENTS = r"""
WITH b AS (SELECT doc_id, CAST(json_object('text', text, 'lang', lang) AS VARCHAR) AS b FROM documents), i AS (SELECT *, b[2 : length(b) - 1] AS n FROM b),
j AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{"a": ' || b || ', "lang": {"a": 2}}' WHEN 1 THEN '{' || n || ',' || n || '}' WHEN 2 THEN '[' || b || ', NaN]' WHEN 3 THEN b || ' x'
      WHEN 4 THEN '[1, {"b": -Infinity, "c": ' || b || '}]' ELSE '{"b": {"text": 1, ' || n || '}}' END AS j FROM i),
v AS (SELECT doc_id, j, json_valid(j) AS valid, regexp_replace(j, '"([^"\\]|\\.)*"', '', 'g') AS bare FROM j),
k AS (SELECT doc_id, valid AND NOT regexp_matches(bare, 'NaN|Infinity') AS valid, CASE WHEN valid THEN json_keys(j) END AS top, CASE WHEN valid THEN json_keys(j, '$.b') END AS inner_keys FROM v)
SELECT doc_id, valid AND len(list_distinct(coalesce(top, []))) = len(coalesce(top, [])) AND len(list_distinct(coalesce(inner_keys, []))) = len(coalesce(inner_keys, [])) AS strict FROM k
"""


def metrics_document(spark, sf):
    """The shares of labels as a metrics document, written atomically and read back."""
    path = f"{_mounted(spark)}/metrics.json"
    writers.write_metrics(curation.label_histogram(spark, sf).select(F.col("label").alias("metric"), F.col("share").alias("value")), path)
    return spark.createDataFrame(sorted(readers.read_json(path).items()), "metric string, value double")


METRICS_DOCUMENT = f"SELECT label AS metric, share AS value FROM ({curation.LABEL_HISTOGRAM})"


def comparison_lines(spark, sf):
    """A comparison report, line by line."""
    path = _folder(spark)
    writers.write_comparison(curation.label_histogram(spark, sf).select("label", "rows"), path, ["rows", "label"])
    return readers.lines(spark, path).select("line", "value")


COMPARISON_LINES = f"WITH h AS ({curation.LABEL_HISTOGRAM}) SELECT 1 AS line, 'label,rows' AS value UNION ALL SELECT 1 + row_number() OVER (ORDER BY rows, label), label || ',' || rows FROM h"


def encoded_split(spark, sf):
    """Encoded rows written as a split with its metadata, and read with all checks."""
    path = f"{_mounted(spark)}/train"
    rows = encoding._encoded(spark, sf).where("supervised > 0").select((F.col("conv_id") * encoding.PIECES + F.col("turn")).alias("id"), "input_ids", "attention_mask", "labels")
    writers.write_split(rows, path, {"limit": 120})
    limit = readers.read_json(path + ".json")["limit"]
    return readers.load_split(spark, path).select("id", F.array_join("input_ids", ",").alias("ids"), F.lit(limit).alias("limit"))


ENCODED_SPLIT = f"WITH {encoding._ENCODED} SELECT conv_id * {encoding.PIECES} + turn AS id, array_to_string(ids, ',') AS ids, 120 AS \"limit\" FROM k WHERE supervised > 0"


# -- metric texts, series, logs


_KINDS = ("view", "click", "purchase", "error", "signup")


def metric_text(spark, sf):
    """Histograms written as metric text, one text a pod, and parsed back; counts have no edge."""
    b = req._buckets(spark, sf)
    edge = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    bucket = b.select("pod", F.concat("event_type", F.lit('_seconds_bucket{pod="'), "pod", F.lit('",le="'), edge, F.lit('"} '), F.col("count").cast("string")).alias("line"))
    count = b.groupBy("pod", "event_type").agg(F.max("count").alias("n")).select("pod", F.concat("event_type", F.lit("_seconds_count "), F.col("n").cast("string")).alias("line"))
    texts = bucket.unionAll(count).groupBy("pod").agg(F.concat(F.lit("# HELP x\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\nother_total 5\n")).alias("text"))
    return readers.parse_metrics(texts, "text", [f"{k}_seconds" for k in _KINDS], ["pod"])


METRIC_TEXT = f"WITH b AS ({req.HISTOGRAM_BUCKETS}) SELECT pod, event_type || '_seconds' AS metric, le, CAST(count AS DOUBLE) AS value FROM b UNION ALL SELECT pod, event_type || '_seconds', NULL, CAST(max(count) AS DOUBLE) FROM b GROUP BY pod, event_type"


def series_points(spark, sf):
    """Points of range results, below one or two levels of "data"; values that are not finite go."""
    i = F.col("event_id")
    point = F.concat(F.lit("["), i.cast("string"), F.lit(',"'), F.when(i % 10 == 0, "NaN").when(i % 10 == 1, "+Inf").otherwise(F.col("value").cast("string")), F.lit('"]'))
    blocks = table(spark, sf, "events").groupBy("user_id", F.floor(i / 1000).alias("block")).agg(F.array_join(F.collect_list(point), ",").alias("points"))  # a thousand points at most
    result = F.concat(F.lit('{"resultType":"matrix","result":[{"metric":{"user":"'), F.col("user_id").cast("string"), F.lit('"},"values":['), "points", F.lit("]}]}"))
    once = F.concat(F.lit('{"status":"success","data":'), result, F.lit("}"))
    documents = blocks.select("block", F.when(F.col("block") % 2 == 0, once).otherwise(F.concat(F.lit('{"data":'), once, F.lit("}"))).alias("text"))
    return readers.unwrap_series(documents, "text", ["block"]).select(F.col("labels")["user"].alias("user"), "t", "value")


SERIES_POINTS = "SELECT CAST(user_id AS VARCHAR) AS user, CAST(event_id AS DOUBLE) AS t, value FROM events WHERE event_id % 10 > 1 AND value IS NOT NULL"


def pod_logs(spark, sf):
    """Events from log lines whose JSON begins at the first brace."""
    path = _folder(spark)
    event = F.to_json(F.struct("event_id", "event_type"))
    line = F.when(F.col("event_id") % 13 == 0, "plain words").otherwise(F.concat(F.lit("2024-01-01T00:00:00Z INFO "), event))
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return readers.read_pod_logs(spark, path, "event_id long, event_type string").select("event_id", "event_type")


POD_LOGS = "SELECT event_id, event_type FROM events WHERE event_id % 13 <> 0"


# -- digests, archives, journals


def file_checks(spark, sf):
    """Digests of files, and what checks of a snapshot and of an artifact find: one altered, one missing, one too many."""
    folder, regions = _mounted(spark), _regions(spark, sf)
    digests = [("digest", f"{name}.txt", release.file_digest(_put(f"{folder}/{name}.txt", name))) for _, name in regions]
    expected = {f"{name}.txt": _sha("altered" if k == 1 else name) for k, name in regions if k != 4} | {"none.txt": _sha("none")}
    found = lambda check, rows: rows.select(F.lit(check).alias("check"), "name", "found")
    out = spark.createDataFrame(digests, "check string, name string, found string")
    return out.unionAll(found("snapshot", readers.verify_files(spark, folder, expected))).unionAll(found("artifact", release.artifact_problems(spark, folder, expected)))


FILE_CHECKS = """
WITH r AS (SELECT r_regionkey AS k, r_name || '.txt' AS name, sha256(r_name) AS found FROM region)
SELECT 'digest' AS "check", name, found FROM r UNION ALL SELECT 'snapshot', name, found FROM r WHERE k = 1 UNION ALL SELECT 'artifact', name, found FROM r WHERE k IN (1, 4)
UNION ALL SELECT c, 'none.txt', NULL FROM (VALUES ('snapshot'), ('artifact')) t(c)
"""


def archives(spark, sf):
    """Regions in a compressed archive, twice and in two orders: equal bytes, and the content read back."""
    files = {name: name.encode() for _, name in _regions(spark, sf)}
    first, second = (writers.gzip_bytes(writers.tar_bytes(dict(order))) for order in (files.items(), reversed(files.items())))
    with tarfile.open(fileobj=io.BytesIO(first), mode="r:gz") as tar:
        rows = [(m.name, _sha(tar.extractfile(m).read().decode()), m.mtime == 0 and first == second) for m in tar.getmembers()]
    return spark.createDataFrame(rows, "name string, digest string, same boolean")


ARCHIVES = "SELECT r_name AS name, sha256(r_name) AS digest, true AS same FROM region"


def journal(spark, sf):
    """A journal that every nation is added to twice: once it is new, then it is known."""
    path = f"{_mounted(spark)}/journal.jsonl"
    added = [(k, writers.append_journal(path, {"key": k, "name": name}, "key"), writers.append_journal(path, {"key": k, "name": name}, "key")) for k, name in _nations(spark, sf)]
    rows = readers.lines(spark, path).select("line", F.from_json("value", "key long, name string").alias("r")).select("line", "r.*")
    return rows.join(spark.createDataFrame(added, "key long, first boolean, second boolean"), "key")


JOURNAL = "SELECT CAST(n_nationkey AS BIGINT) AS key, row_number() OVER (ORDER BY n_nationkey) AS line, n_name AS name, true AS first, false AS second FROM nation"


# -- releases


def publications(spark, sf):
    """Releases of regions, each published twice: a stale report, one that passed but not as true, an unknown schema and two that are in order."""
    rows = []
    for k, name in _regions(spark, sf):
        hashes = {h: _sha(name + h) for h in release.MANIFEST_HASHES}
        manifest = {**hashes, "schema_version": 2 if k == 3 else 1, "model_id": name, "artifact_uri": "a/b", "file_hashes": {"w.bin": _sha(name)}}
        report = {**hashes, "status": "complete", "passed": 1 if k == 2 else True, "metrics": {"accuracy": 0.5, "format_rate": 1.0}}
        if k == 1:
            report["model_sha256"] = _sha("another")
        root = _mounted(spark)
        first, second = (release.publish(root, manifest, report, now) for now in ("2024-01-01", "2024-01-02"))
        attempts = sum(1 for _ in open(f"{root}/attempts.jsonl", encoding="utf-8"))
        rows.append((k, first["state"], second["state"], "; ".join(first["problems"]), first["accepted_before_sha256"] is None, first["accepted_after_sha256"] == second["accepted_after_sha256"], os.path.exists(f"{root}/accepted.json"), attempts))
    return spark.createDataFrame(rows, "region long, first string, second string, problems string, fresh boolean, kept boolean, accepted boolean, attempts long")


PUBLICATIONS = """
WITH p(k, problems) AS (VALUES (1, 'model_sha256 differs from the manifest'), (2, 'the report did not pass'), (3, 'schema_version is not 1'))
SELECT CAST(r_regionkey AS BIGINT) AS region, CASE WHEN k IS NULL THEN 'published' ELSE 'rejected' END AS first, CASE WHEN k IS NULL THEN 'already_published' ELSE 'rejected' END AS second,
       coalesce(problems, '') AS problems, true AS fresh, true AS kept, k IS NULL AS accepted, CAST(2 AS BIGINT) AS attempts FROM region LEFT JOIN p ON k = r_regionkey
"""


def preparations(spark, sf):
    """Cached preparations by the digest of their data and configuration: built, found again, and refused once altered."""
    root, rows = _mounted(spark), []
    for k, name in _regions(spark, sf):
        make = lambda configuration: release.prepared(root, _sha(name), configuration, lambda folder: _put(f"{folder}/data", name))  # noqa: B023, E731
        folder, first = make({"b": k, "a": "x"})
        second = make({"a": "x", "b": k})[1]
        _put(f"{folder}/data", name if k % 2 else name + "!")
        try:
            third = "found" if make({"a": "x", "b": k})[1] else "built"
        except ValueError:
            third = "altered"
        rows.append((k, os.path.basename(folder), first, second, third))
    return spark.createDataFrame(rows, "region long, key string, first boolean, second boolean, third string")


PREPARATIONS = """
SELECT CAST(r_regionkey AS BIGINT) AS region, sha256('{"config":{"a":"x","b":' || r_regionkey || '},"data_sha256":"' || sha256(r_name) || '"}') AS key,
       false AS first, true AS second, CASE WHEN r_regionkey % 2 = 1 THEN 'found' ELSE 'altered' END AS third FROM region
"""


def stage_runs(spark, sf):
    """Which of three stages run again in rounds, one a region: data change in the third, one stage's parameters in the fourth."""
    root, rows = _mounted(spark), []
    for k, _ in _regions(spark, sf):
        stages = release.Stages(root)
        clean = stages.run("clean", {"data": _sha("new" if k >= 2 else "old"), "code": _sha("c")}, {"min": 3}, lambda: {"digest": _sha("clean" + ("new" if k >= 2 else "old"))})  # noqa: B023
        train = stages.run("train", {"clean": clean["digest"]}, {"rate": 2 if k >= 3 else 1}, lambda: {"digest": _sha("model")})
        stages.run("report", {"model": train["digest"]}, {}, lambda: {"digest": _sha("report")})
        rows += [(k, name) for name in stages.ran]
    return spark.createDataFrame(rows, "region long, stage string")


STAGE_RUNS = """
WITH s AS (SELECT CAST(r_regionkey AS BIGINT) AS region, r_regionkey >= 2 AS data, r_regionkey >= 3 AS rate FROM region),
c AS (SELECT region, data IS DISTINCT FROM lag(data) OVER o AS clean, rate IS DISTINCT FROM lag(rate) OVER o AS params FROM s WINDOW o AS (ORDER BY region))
SELECT region, 'clean' AS stage FROM c WHERE clean UNION ALL SELECT region, 'train' FROM c WHERE clean OR params UNION ALL SELECT min(region), 'report' FROM c
"""


def safe_paths(spark, sf):
    """Which paths of pages, some of them turned into bad ones, are safe relative paths."""

    @F.pandas_udf("boolean")
    def safe(paths: pd.Series) -> pd.Series:
        def ok(p: str) -> bool:
            try:
                release.safe_relative(p)
            except ValueError:
                return False
            return True

        return paths.map(ok)

    path = F.regexp_replace("url", r"^[a-z]+://[^/]*/", "")
    i = F.col("page_id") % 7
    path = F.when(i == 1, F.concat(F.lit("/"), path)).when(i == 2, F.concat(F.lit("../"), path)).when(i == 3, F.concat(F.lit("a//"), path)).when(i == 4, F.concat(F.lit("c:"), path)).when(i == 5, F.concat(F.lit("a\\"), path)).when(i == 6, F.concat(F.lit("./"), path)).otherwise(path)
    return table(spark, sf, "pages").select("page_id", path.alias("path")).select("page_id", safe(F.coalesce("path", F.lit(""))).alias("safe"))


SAFE_PATHS = r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/', '') AS p, page_id % 7 AS i FROM pages),
q AS (SELECT page_id, coalesce(CASE i WHEN 1 THEN '/' || p WHEN 2 THEN '../' || p WHEN 3 THEN 'a//' || p WHEN 4 THEN 'c:' || p WHEN 5 THEN 'a\' || p WHEN 6 THEN './' || p ELSE p END, '') AS p FROM p)
SELECT page_id, NOT contains(p, ':') AND NOT contains(p, '\') AND NOT list_has_any(string_split(p, '/'), ['', '.', '..']) AS safe FROM q
"""


def parameter_checks(spark, sf):
    """Which parameter documents are refused before anything runs."""
    cases = {
        "defaults": {}, "unknown": {"clean": {"more": 1}}, "no table": {"clean": 3}, "truth value": {"clean": {"shingle_words": True}}, "threshold 0": {"clean": {"threshold": 0}}, "two thresholds": {"clean": {"threshold": 0.9}},
        "one threshold": {"clean": {"threshold": 0.9}, "contamination": {"threshold": 0.9}}, "order of lengths": {"clean": {"min_user_chars": 9, "max_user_chars": 8}}, "ratios": {"split": {"ratios": {"train": 0.8, "val": 0.1, "test": 0.2}}}, "drift": {"split": {"max_total_variation": 1.5}},
    }
    rows, folder = [], _mounted(spark)
    for name, values in cases.items():
        try:
            config.load(_put(f"{folder}/{name}.json", json.dumps(values)))
            rows.append((name, True))
        except ValueError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "name string, accepted boolean")


PARAMETER_CHECKS = "SELECT name, name IN ('defaults', 'one threshold') AS accepted FROM (VALUES ('defaults'), ('unknown'), ('no table'), ('truth value'), ('threshold 0'), ('two thresholds'), ('one threshold'), ('order of lengths'), ('ratios'), ('drift')) t(name)"


# -- small functions over whole tables


def prompt_boundaries(spark, sf):
    """Tokens of the prompt by character offsets, in texts of prompt and answer."""
    e = encoding._examples(spark, sf).select("conv_id", "turn", F.length("user").alias("boundary"), F.split(F.concat("user", F.lit(" "), "assistant"), " ").alias("t"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("o"))
    step = lambda s, t: F.struct((s["at"] + F.length(t) + 1).alias("at"), F.concat(s["o"], F.array(F.struct(s["at"].alias("start"), (s["at"] + F.length(t)).alias("end")))).alias("o"))
    offsets = F.aggregate("t", start, step, lambda s: s["o"])
    return e.select("conv_id", "turn", "boundary", offsets.alias("o")).select("conv_id", "turn", encode.prompt_boundary(F.col("o"), F.col("boundary")).cast("long").alias("tokens"))


PROMPT_BOUNDARIES = f"WITH {encoding._EXAMPLES} SELECT conv_id, turn, len(string_split(u, ' ')) - CASE WHEN u = '' OR ends_with(u, ' ') THEN 1 ELSE 0 END AS tokens FROM x"


def rounded_values(spark, sf):
    """Eighths rounded to one digit, ties to even."""
    return table(spark, sf, "events").select("event_id", stats.round_even(F.col("event_id") / 8, 1).alias("rounded"))


ROUNDED_VALUES = "WITH n AS (SELECT event_id, event_id * 10 // 8 AS q, event_id * 10 % 8 AS r FROM events) SELECT event_id, (q + CASE WHEN r > 4 OR (r = 4 AND q % 2 = 1) THEN 1 ELSE 0 END) / 10 AS rounded FROM n"


# -- streams over files


def stream_torn_lines(spark, sf):
    """Events from a stream of text files, lines that were torn apart passed over."""
    path = _folder(spark)
    line = F.to_json(F.struct("event_id", "event_type"))
    table(spark, sf, "events").select(F.when(F.col("event_id") % 17 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    parsed = spark.readStream.text(path).select(F.from_json("value", "event_id long, event_type string").alias("e")).where("e.event_type IS NOT NULL").select("e.*")
    return req._drained(spark, parsed.groupBy("event_type").agg(F.count("*").alias("rows")), "complete")


STREAM_TORN_LINES = "SELECT event_type, count(*) AS rows FROM events WHERE event_id % 17 <> 0 GROUP BY event_type"


def stream_progress(spark, sf):
    """What the progress reports of a stream say that it read."""
    progress, name = Progress(), f"p{uuid.uuid4().hex}"
    spark.streams.addListener(progress)
    try:
        W.drain(req._stream(spark, sf).groupBy("event_type").count(), _folder(spark), "complete", name)
        until = time.monotonic() + 30  # reports come from another thread
        while not any(r["name"] == name and r["rows"] for r in list(progress.reports)) and time.monotonic() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    mine = [r for r in progress.reports if r["name"] == name]
    return spark.createDataFrame([(sum(r["rows"] for r in mine), max(r["state_rows"] for r in mine), sum(r["dropped_late"] for r in mine))], "rows long, groups long, late long")


STREAM_PROGRESS = "SELECT count(*) AS rows, count(DISTINCT event_type) AS groups, CAST(0 AS BIGINT) AS late FROM events"

QUERIES = {
    f.__name__: f
    for f in (
        jsonl_readers, jsonl_damage, csv_scan, first_rows, json_documents, metrics_document, comparison_lines, encoded_split, metric_text, series_points, pod_logs, file_checks, archives, journal,
        publications, preparations, stage_runs, safe_paths, parameter_checks, prompt_boundaries, rounded_values, stream_torn_lines, stream_progress,
    )
}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
