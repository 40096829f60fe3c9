import json

import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.operators import encode, runs, sets
from tessera.sources import readers, writers
from tessera.streaming.progress import Progress


def test_parameters(tmp_path):
    path = tmp_path / "p.toml"
    path.write_text("[clean]\nthreshold = 0.9\n[contamination]\nthreshold = 0.9\n[split]\nsearch_attempts = 8\n")
    c = config.load(str(path))
    assert c.clean.threshold == 0.9 and c.split.search_attempts == 8 and c.clean.min_user_chars == 30
    (tmp_path / "p.json").write_text(json.dumps({"split": {"seed": 1}}))
    assert config.load(str(tmp_path / "p.json")).split.seed == 1


@pytest.mark.parametrize(
    "bad",
    [{"clean": {"threshold": 0.9}}, {"clean": {"min_user_chars": True}}, {"clean": {"max_user_chars": 5}}, {"more": 1}, {"clean": {"more": 1}}, {"split": {"ratios": {"train": 1.0}}}, {"split": {"search_attempts": 0}}, {"split": {"max_total_variation": float("nan")}}, {"clean": []}],
)
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        config.build(config.Config, bad)


def test_runs(spark):
    rows = [("a", {"k": "x"}, "c1", 2.0, 1.0, 10), ("b", {"k": "x"}, "c1", 2.0, 1.0, 10), ("c", {"k": "y"}, "c2", 2.0, 0.1, 10), ("d", {"k": "x"}, "c3", 2.1, float("nan"), 20), ("e", {"k": "x"}, "c3", 0.0, 1.0, 20)]
    df = spark.createDataFrame(rows, "run_id string, tags map<string, string>, config string, base_loss double, final_loss double, budget int")
    x = runs.search_runs(df, {"k": "x"})
    assert x.count() == 4
    assert [tuple(r) for r in runs.best(runs.passing(x, 0.6), ["config"]).collect()] == [("c1", 1.0, "a")]
    assert {tuple(r) for r in runs.sweep_problems(df, "config").collect()} == {("c1", "more than one run"), ("c3", "more than one run"), ("*", "unequal base losses"), ("*", "unequal budgets")}
    assert df.agg(runs.weighted_mean(F.lit(3.0), F.lit(0)).alias("m")).first()["m"] is None
    curve = spark.createDataFrame([("a", 0), ("a", 5), ("a", 5), ("b", 0), ("b", 1), ("c", 1)], "run string, step int").coalesce(1)
    assert {r["run"] for r in runs.curve_problems(curve, "run", "step").collect()} == {"a", "c"}
    assert spark.range(1).select(runs.adapter_parameters(8, F.lit(10), F.lit(20)).alias("n")).first()["n"] == 240


def test_sets(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, s string"), spark.createDataFrame([(2, None), (1, "x")], "i int, s string")
    assert sets.same_set(a, b) and not sets.same_multiset(a, b) and sets.subset(a, b) and sets.same_multiset(a.distinct(), b)
    assert not sets.subset(a, b.where("i = 1"))
    assert {tuple(r) for r in sets.one_sided(a, b.where("i = 2"), "i").collect()} == {(1, "left")}
    assert sets.changed_records(b, b.withColumn("s", F.lit("y")), "i", ["s"]).count() == 2 and sets.changed_records(b, b, "i", ["s"]).count() == 0
    pods = spark.createDataFrame([([("Ready", "True")],), ([("Ready", "False")],), (None,)], "c array<struct<type: string, status: string>>")
    assert [r["r"] for r in pods.select(sets.ready(F.col("c")).alias("r")).collect()] == [True, False, False]


def test_reencoding_is_equal_and_splits_are_checked(spark, tmp_path):
    source = spark.createDataFrame([(str(i), list(range(1, 5)), [7, 8 + i]) for i in range(5)], "id string, p array<int>, a array<int>")
    encode_again = lambda df: df.select("id", encode.encode_pair(F.col("p"), F.col("a"), 6).alias("e")).select("id", "e.input_ids", "e.attention_mask", "e.labels")
    writers.write_split(encode_again(source), str(tmp_path / "train"), {"max_len": 6})
    stored = readers.load_split(spark, str(tmp_path / "train"))
    assert sets.same_multiset(stored, encode_again(source)) and readers.read_json(str(tmp_path / "train.json")) == {"max_len": 6}
    changed = source.withColumn("a", F.when(F.col("id") == "3", F.array(F.lit(9), F.lit(9))).otherwise(F.col("a")))
    assert not sets.same_multiset(stored, encode_again(changed))  # an altered copy is rejected
    stored.withColumn("labels", F.array(F.lit(1))).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="invalid rows"):
        readers.load_split(spark, str(tmp_path / "bad"))


def test_progress_is_reported(spark, tmp_path):
    listener = Progress()
    spark.streams.addListener(listener)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).groupBy("id").count().writeStream.format("memory").queryName("progress").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(50):
            if listener.reports:
                break
            __import__("time").sleep(0.1)
        assert listener.reports[0]["rows"] == 5 and listener.reports[0]["state_rows"] == 5
    finally:
        spark.streams.removeListener(listener)
