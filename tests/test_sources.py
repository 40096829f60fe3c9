import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tessera.sources import readers, writers

MESSAGE = StructType([StructField("role", StringType(), False), StructField("content", StringType(), False)])
SCHEMA = StructType([StructField("id", StringType(), False), StructField("messages", ArrayType(MESSAGE), False)])
GOOD = json.dumps({"id": "é", "messages": [{"role": "user", "content": "x"}]}, ensure_ascii=False)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_strict_lines(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", f"{GOOD}\n{GOOD}\n")
    assert [r["id"] for r in readers.read_jsonl_strict(spark, path, SCHEMA).collect()] == ["é", "é"]


@pytest.mark.parametrize(
    ("line", "why"),
    [("", "blank line"), ("{", "bad JSON"), ("[]", "no object"), ('{"id": "a", "messages": [], "more": 1}', "unknown key more"), ('{"id": 1, "messages": []}', "id is no string"), ('{"messages": []}', "id is missing"), ('{"id": "a", "id": "b", "messages": []}', "repeated"), ('{"id": "a", "messages": [{"role": "u"}]}', "content is missing"), ('{"id": "a", "messages": [{"role": "u", "content": "c", "x": 1}]}', "unknown key x")],
)
def test_the_first_bad_line_is_named(spark, tmp_path, line, why):
    path = write(tmp_path / "raw.jsonl", f"{GOOD}\n{GOOD}\n{line}\n{GOOD}\n")
    with pytest.raises(ValueError, match=rf"raw\.jsonl:3: .*{why}"):
        readers.read_jsonl_strict(spark, path, SCHEMA)


def test_only_a_torn_end_is_tolerated(spark, tmp_path):
    rows, errors = readers.read_jsonl_tolerant(spark, write(tmp_path / "a.jsonl", f"{GOOD}\noops\n{GOOD}\n{GOOD[:9]}"), SCHEMA)
    assert rows.count() == 2 and [r["line"] for r in errors.collect()] == [2]
    rows, errors = readers.read_jsonl_tolerant(spark, write(tmp_path / "b.jsonl", f"{GOOD}\n{GOOD[:9]}\n"), SCHEMA)
    assert rows.count() == 1 and [r["line"] for r in errors.collect()] == [2]


def test_unique_rows(spark, tmp_path):
    other = GOOD.replace("é", "f")
    assert readers.read_rows_unique(spark, write(tmp_path / "a.jsonl", f"{GOOD}\n\n{other}\n"), SCHEMA).count() == 2
    with pytest.raises(ValueError, match="repeated ids"):
        readers.read_rows_unique(spark, write(tmp_path / "b.jsonl", f"{GOOD}\n{GOOD}\n"), SCHEMA)
    with pytest.raises(ValueError, match="blank id"):
        readers.read_rows_unique(spark, write(tmp_path / "c.jsonl", GOOD.replace("é", " ") + "\n"), SCHEMA)


def test_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", '﻿Title,Genre\n"a ""q""\nb","x, y"\n')
    assert [tuple(r) for r in readers.read_csv(spark, path, ["Title", "Genre"]).collect()] == [('a "q"\nb', "x, y")]
    with pytest.raises(ValueError, match=r"missing columns \['Year'\]"):
        readers.read_csv(spark, path, ["Title", "Year"])


METRICS = """# HELP h_seconds x
h_seconds_bucket{pod="p",le="0.1"} 3
h_seconds_bucket{le="+Inf",pod="p"} 5.0
h_seconds_count 5
h_seconds_sum 9
other_count 7
"""


def test_metric_text(spark):
    df = spark.createDataFrame([("p", METRICS)], "pod string, t string")
    got = {(r["pod"], r["metric"], r["le"], r["value"]) for r in readers.parse_metrics(df, "t", ["h_seconds"], ["pod"]).collect()}
    assert got == {("p", "h_seconds", 0.1, 3.0), ("p", "h_seconds", float("inf"), 5.0), ("p", "h_seconds", None, 5.0)}


def test_metric_series(spark):
    document = json.dumps({"data": {"data": {"result": [{"metric": {"pod": "a"}, "values": [[1, "2"], [2, "NaN"]]}, {"metric": {}, "value": [3, "4.5"]}]}}})
    df = spark.createDataFrame([(1, document), (2, "{"), (3, None)], "k int, d string")
    got = {(r["k"], r["t"], r["value"], r["labels"].get("pod")) for r in readers.unwrap_series(df, "d", ["k"]).collect()}
    assert got == {(1, 1.0, 2.0, "a"), (1, 3.0, 4.5, None)}


def test_pod_logs(spark, tmp_path):
    path = write(tmp_path / "pod.log", 'x INFO {"event": "a", "request_id": "1"}\nplain\nINFO {"event": "b"}\n')
    rows = readers.read_pod_logs(spark, path, "event string, request_id string").orderBy("event").collect()
    assert [(r["file"], r["event"], r["request_id"]) for r in rows] == [("pod.log", "a", "1"), ("pod.log", "b", None)]


def test_documents_and_hashes(spark, tmp_path):
    assert readers.read_json(str(tmp_path / "none"), {"d": 1}) == {"d": 1}
    with pytest.raises(ValueError):
        readers.read_json(write(tmp_path / "bad.json", '{"a": NaN}'))
    from tessera.operators.release import file_digest

    path = write(tmp_path / "f.bin", "content")
    assert readers.verify_files(spark, str(tmp_path), {"f.bin": file_digest(path)}).count() == 0
    assert {r["name"] for r in readers.verify_files(spark, str(tmp_path), {"f.bin": "0" * 64, "gone": "1" * 64}).collect()} == {"f.bin", "gone"}


def test_first_rows(spark, tmp_path):
    spark.range(100).selectExpr("99 - id AS id", "id AS other").write.parquet(str(tmp_path / "t"))
    df = readers.read_first(spark, str(tmp_path / "t"), ["id"], "id", 3)
    assert [r["id"] for r in df.collect()] == [0, 1, 2]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(2, "é", None), (1, "b", 1.5)], "i int, s string, v double")
    writers.write_jsonl(rows, str(tmp_path / "out"), ["i"], single=True)
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text(encoding="utf-8").splitlines() == ['{"i":1,"s":"b","v":1.5}', '{"i":2,"s":"é","v":null}']
    path = str(tmp_path / "deep" / "x.json")
    assert writers.write_json_atomic(path, {"a": 1}) and not writers.write_json_atomic(path, {"a": 1}) and writers.write_json_atomic(path, {"a": 2})
    with pytest.raises(ValueError):
        writers.write_json_atomic(path, {"a": float("nan")})
    assert json.load(open(path)) == {"a": 2} and len(list((tmp_path / "deep").iterdir())) == 1
    journal = str(tmp_path / "j.jsonl")
    assert writers.append_journal(journal, {"id": 1}, "id") and not writers.append_journal(journal, {"id": 1}, "id") and writers.append_journal(journal, {"id": 2}, "id")
    writers.write_comparison(rows, str(tmp_path / "csv"), ["i"])
    assert next((tmp_path / "csv").glob("part-*")).read_text().splitlines()[0] == "i,s,v"
    assert writers.write_metrics(spark.createDataFrame([("a", 1.0)], "metric string, value double"), str(tmp_path / "m.json")) == {"a": 1.0}
    merged = writers.merge_ledgers([spark.createDataFrame([(2, "x")], "i int, a string"), spark.createDataFrame([(None, 1), (1, 2)], "i int, b int")], ["i"]).collect()
    assert [tuple(r) for r in merged] == [(None, None, 1), (1, None, 2), (2, "x", None)]


def test_archives_are_deterministic():
    a = writers.gzip_bytes(b"x")
    assert a == writers.gzip_bytes(b"x") and gzip.decompress(a) == b"x"
    t = writers.tar_bytes({"b": b"2", "a": b"1"})
    assert t == writers.tar_bytes({"a": b"1", "b": b"2"})
    assert tarfile.open(fileobj=io.BytesIO(t)).getnames() == ["a", "b"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_file_is_read_by_many_tasks(spark, tmp_path, end):
    """Numbers and ends of lines hold across the splits of a file; with and without a last line end, a byte order mark, blank lines."""
    texts = {"a.txt": [f"é{i}" * (i % 7) for i in range(900)], "b.txt": ["\ufeffx", "y", ""], "c.txt": ["z"] * 50, "d.txt": ["\ufeffz"], "e.txt": ["q", "", ""]}
    want, folder = [], tmp_path / "in"
    folder.mkdir()
    for name, rows in texts.items():
        closed = name not in ("c.txt", "d.txt")
        (folder / name).write_bytes((end.join(rows) + (end if closed else "")).encode())
        want += [(name, i, v, closed) for i, v in enumerate(rows, 1)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "600")
        found = readers.lines(spark, str(folder))
        got = found.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["file"].rsplit("/", 1)[1], r["line"], r["value"], r["closed"]) for r in got) == sorted(want)
    tasks = found.where(F.col("file").endswith("a.txt")).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 3


def test_packed_lines(spark, tmp_path):
    import gzip

    (tmp_path / "a.jsonl.gz").write_bytes(gzip.compress(b"x\n\ny"))
    (tmp_path / "b.jsonl").write_bytes(b"z\n")
    got = sorted((r["line"], r["value"], r["closed"]) for r in readers.lines(spark, str(tmp_path)).collect())
    assert got == [(1, "x", False), (1, "z", True), (2, "", False), (3, "y", False)]
