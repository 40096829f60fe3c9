import random

from pyspark.sql import functions as F

from tessera.streaming import windows as W

SCHEMA = "id long, ts timestamp, k string, v double"


def batches(spark, folder, *parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "id long, t long, k string, v double").select("id", F.timestamp_seconds("t").alias("ts"), "k", "v").coalesce(1).write.mode("append").parquet(f"{folder}/{i}")


def stream(spark, tmp_path, *parts):
    batches(spark, str(tmp_path / "in"), *parts)
    return W.read_events(spark, str(tmp_path / "in"), "*.parquet", SCHEMA, files_per_trigger=1)


def test_windows_equal_the_batch(spark, tmp_path):
    rows = [(i, 7 * i, "ab"[i % 2], float(i)) for i in range(40)]
    s = stream(spark, tmp_path, rows[:20], rows[20:])
    f = lambda df: W.quantile_alert(df, "ts", ["k"], F.col("v"), (5.0, 20.0, float("inf")), 0.95, 10.0, 2, "30 seconds", "5 seconds")
    out = W.drain(f(s), str(tmp_path / "c"), "complete")
    batch = f(spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect())) != []


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    s = stream(spark, tmp_path, [(1, 100, "a", 1.0)], [(2, 1000, "a", 1.0)], [(6, 1002, "a", 1.0)], [(3, 101, "a", 1.0), (4, 1001, "a", 1.0)], [(5, 5000, "a", 1.0)])
    out = W.drain(W.sliding(s, "ts", ["k"], [F.count("*").alias("n")], "10 seconds", "10 seconds", late="60 seconds"), str(tmp_path / "c"))
    assert sorted(r["n"] for r in out.collect()) == [1, 3]


def test_alert_machine_keeps_its_state_between_batches(spark, tmp_path):
    s = stream(spark, tmp_path, [(1, 0, "a", 0.0), (2, 5, "a", 1.0)], [(3, 10, "a", 1.0), (4, 15, "a", 1.0)], [(5, 20, "a", 0.0), (6, 25, "a", 1.0)], [(7, 1000, "a", 1.0)])
    out = W.drain(W.alert_machine(s.withColumn("bad", F.col("v") > 0), "k", "ts", "bad", 10, late="60 seconds"), str(tmp_path / "c"))
    assert [r["alert"] for r in out.orderBy("at").collect()] == ["pending", "firing", "inactive", "pending"]


def test_alert_machine_takes_rows_in_any_order(spark, tmp_path):
    """Rows shuffled over ten batches give the answer of the ordered ones, up to the watermark."""
    rng = random.Random(8)
    rows = [(i, 3 * (i // 2), "ab"[i % 2] if i % 9 else None, float(rng.random() < 0.8)) for i in range(200)]
    dealt = [[] for _ in range(10)]
    for r in rows:
        dealt[min(9, max(0, r[0] // 20 + rng.randint(-1, 1)))].append(r)  # late by two batches at most: 90 seconds
    for part in dealt:
        rng.shuffle(part)
    s = stream(spark, tmp_path, *dealt, [(999, 10_000, "z", 0.0)])
    got = W.drain(W.alert_machine(s.withColumn("bad", F.col("v") > 0), "k", "ts", "bad", 12, F.col("id"), late="120 seconds"), str(tmp_path / "c")).collect()
    want, since, last = [], {}, {}
    for _, t, k, v in rows:
        since[k] = (t if since.get(k) is None else since[k]) if v else None
        now = "inactive" if since[k] is None else "firing" if t - since[k] >= 12 else "pending"
        if now != last.get(k, "inactive"):
            want.append((k, t, now))
        last[k] = now
    assert sorted((r["key"], int(r["at"].timestamp()), r["alert"]) for r in got if r["key"]) == sorted(w for w in want if w[0])
    assert len(want) > 20


def test_matches_of_two_streams(spark, tmp_path):
    rows = [(i, 7 * i, "ab"[i % 2], float(i % 3)) for i in range(60)]
    s = stream(spark, tmp_path, rows[:20], rows[40:], rows[20:40])
    both = lambda df: W.interval_matches(df.where("v = 0").select(F.col("id").alias("p"), "k", F.col("ts").alias("at")), df.where("v = 1").select(F.col("id").alias("e"), "k", "ts"), "k", "at", "ts", "10 SECONDS", "40 SECONDS", "1 hour").select("p", "e")
    want = sorted((p, e) for p, tp, kp, vp in rows for e, te, ke, ve in rows if vp == 0 and ve == 1 and kp == ke and 10 <= tp - te <= 40)
    assert sorted(map(tuple, W.drain(both(s), str(tmp_path / "c")).collect())) == want != []


def test_cache_keeps_its_state_between_batches(spark, tmp_path):
    s = stream(spark, tmp_path, [(1, 1, "a", 1.0), (2, 2, "a", 2.0)], [(3, 3, "a", 1.0), (4, 4, "a", 3.0), (5, 5, "a", 2.0)])
    out = W.drain(W.lru_stream(s, "k", "ts", "v", 2), str(tmp_path / "c"))
    assert [r["hit"] for r in out.orderBy("at").collect()] == [False, False, True, False, False]


def test_repeats_sessions_and_completion(spark, tmp_path):
    s = stream(spark, tmp_path, [(1, 1, "a", 1.0), (1, 1, "a", 1.0)], [(1, 1, "a", 1.0), (2, 2, "a", 1.0)])
    assert W.drain(W.first_per_key(s, "ts", ["id"]), str(tmp_path / "c5")).count() == 2
    rows = spark.createDataFrame([("r", False, None), ("r", False, None), ("r", True, 2), ("q", False, None), ("p", True, 5)], "r string, done boolean, n int")
    assert {r["r"]: r["clean"] for r in W.completion(rows, "r", F.col("done"), F.col("n")).collect()} == {"r": True, "q": False, "p": False}
    events = spark.createDataFrame([(0, "a"), (5, "a"), (50, "a")], "t long, k string").select(F.timestamp_seconds("t").alias("ts"), "k")
    assert sorted(r["n"] for r in W.sessions(events, "ts", "k", "10 seconds", [F.count("*").alias("n")]).collect()) == [1, 2]


def test_cache_gives_out_pieces_in_order_of_ties(spark, tmp_path, monkeypatch):
    """Equal times, more rows than a piece, null items: as a plain replay; no frame is larger than a piece."""
    rng = random.Random(3)
    rows = [(i, i // 40, "ab"[i % 2], rng.choice([None, 1.0, 2.0, 3.0, 4.0])) for i in range(30_000)]
    shuffled = rng.sample(rows, len(rows))
    s = stream(spark, tmp_path, shuffled)
    got = W.drain(W.lru_stream(s, "k", "ts", "v", 3, F.col("id")), str(tmp_path / "c"))
    want, held = {}, {"a": [], "b": []}
    for _, _, k, v in rows:
        hit = v in held[k]
        held[k] = ([x for x in held[k] if x != v] + [v])[-3:]
        name = (k, None if v is None else str(v), hit)
        want[name] = want.get(name, 0) + 1
    assert {(r["key"], r["item"], r["hit"]): r["count"] for r in got.groupBy("key", "item", "hit").count().collect()} == want


def test_rows_that_wait_for_the_watermark_are_packed():
    """A row that waits takes 17 bytes of one value, not a list's element that is pickled on its own."""
    assert "held binary" in W._ALERT_STATE and W._HELD.itemsize == 17
