"""Operators over hot keys, against plain loops: quantiles by ranges, patterns and states across partitions, digests of multisets, first ids."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import dedup, quantiles, requests, sets, split
from tessera.operators.similarity_index import SimilarityIndex


def rank(values, q):
    return sorted(values)[min(len(values) - 1, int(q * len(values)))]


def linear(values, q):
    at, v = (len(values) - 1) * q, sorted(values)
    lo, hi = int(at), -int(-at // 1)
    return float(v[lo]) if lo == hi else (hi - at) * v[lo] + (at - lo) * v[hi]


def spread_values(rng, n):
    """Ties, outliers by many orders of magnitude, negatives, a group of one value."""
    draw = {"hot": lambda: rng.choice([rng.gauss(0, 1), 5.0, 1e300 * rng.random(), -1e-300 * rng.random()]), "same": lambda: 7.0, None: lambda: float(rng.randint(0, 5)), "wide": lambda: rng.choice([-1.7e308, 1.7e308, 0.0])}
    return [(k, draw[k]()) for k in rng.choices(list(draw), [20, 1, 1, 1], k=n)]


@pytest.mark.parametrize(("cells", "small"), [(4, 3), (256, 50), (256, 20_000)])
def test_quantiles_by_ranges(spark, cells, small):
    rng = random.Random(cells)
    rows = spread_values(rng, 1500)
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    df = spark.createDataFrame([*rows, ("nulls", None), ("hot", None)], "k string, v double").repartition(4)
    qs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r["k"]: r for r in quantiles.nearest(df, ["k"], "v", qs, cells=cells, small=small).collect()}
    assert {k: [r[c] for c in qs] for k, r in got.items()} == {k: [rank(v, q) for q in qs.values()] for k, v in groups.items()} | {"nulls": [None] * 5}
    lines = {r["k"]: r for r in quantiles.linear(df, ["k"], "v", qs, cells=cells, small=small).collect()}
    for k, v in groups.items():
        assert [lines[k][c] for c in qs] == [pytest.approx(linear(v, q), rel=1e-12) for q in qs.values()]
    whole = quantiles.nearest(df, [], "v", qs, cells=cells, small=small).first()
    assert [whole[c] for c in qs] == [rank([v for _, v in rows], q) for q in qs.values()]


def test_quantiles_of_integers_and_nothing(spark):
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_000).alias("v"), F.lit(1).alias("k"))
    assert quantiles.nearest(df, ["k"], "v", {"m": 0.5}, small=100).first()["m"] == 50_000
    assert quantiles.nearest(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0
    assert quantiles.linear(df.limit(0), [], "v", {"m": 0.5}).first()["m"] is None


def events(rng, n):
    """(key, t, i, state): one key with nine tenths of the rows, null keys and states."""
    return [(rng.choice(["hot"] * 18 + ["a", None]), rng.randint(0, 40), i, rng.choice(["x", "y", "z", None])) for i in range(n)]


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("pattern", [["x"], ["x", "y", "x", "z"], ["z"] * 12, []])
def test_patterns(spark, pattern):
    for n in (0, 3, 60, 800):
        rows = events(random.Random(n + len(pattern)), n)
        df = spark.createDataFrame(rows, "k string, t int, i int, s string").repartition(3)
        want = {}
        for k, mine in by_key(rows).items():
            at = 0
            for r in mine:
                at += at < len(pattern) and r[3] == pattern[at]
            want[k] = at == len(pattern)
        assert {r["k"]: r["followed"] for r in requests.follows_in_order(df, "k", ["t", "i"], "s", pattern).collect()} == want


def test_transitions_of_a_hot_key(spark):
    rows = events(random.Random(3), 900)
    df = spark.createDataFrame(rows, "k string, t int, i int, s string").repartition(3)
    want = {}
    for mine in by_key(rows).values():
        for at, r in enumerate(mine):
            if at == 0 or mine[at - 1][3] != r[3]:
                want[r[2]] = mine[at - 1][3] if at else None
    got = requests.transitions(df, "k", ["t", "i"], "s")
    assert {r["i"]: r["previous"] for r in got.collect()} == want and got.columns == ["k", "t", "i", "s", "previous"]


def test_alert_states_of_a_hot_key(spark):
    rng = random.Random(4)
    rows = [("hot" if t % 10 else "a", t, rng.random() < 0.9 if t % 7 else None) for t in range(700)]
    df = spark.createDataFrame(rows, "k string, t long, bad boolean").select("k", F.timestamp_seconds("t").alias("t"), "bad").repartition(3)
    want, since = {}, {}
    for k, t, bad in rows:
        since[k] = (since.get(k) if since.get(k) is not None else t) if bad else None
        want[t] = "inactive" if since[k] is None else "firing" if t - since[k] >= 5 else "pending"
    got = requests.alert_states(df, "k", "t", "bad", 5).collect()
    assert {int(r["t"].timestamp()): r["alert"] for r in got} == want


def test_multiset_digests(spark):
    rng = random.Random(5)
    base = [(rng.choice(["a", "b", "", None, "1:a"]), rng.choice([1, 2, None])) for _ in range(300)]
    variants = {"same": base[::-1], "swapped": [(base[1][0], 99), *base[1:]], "once more": [*base, base[0]], "once less": base[1:], "moved": [("a", 1), ("b", 2)], "crossed": [("a", 2), ("b", 1)], "null": [(None, None)], "dash": [("-", None)], "none": []}
    rows = [(name, *r) for name, v in (variants | {"base": base}).items() for r in v]
    df = spark.createDataFrame(rows, "g string, x string, y int").repartition(5)
    found = {r["g"]: (r["n"], r["digest"]) for r in sets.multiset_digests(df, ["x", "y"], ["g"]).collect()}
    alike = {frozenset(b for b in found if found[b] == found[a]) for a in found}
    assert alike == {frozenset(b for b in found if Counter((variants | {"base": base})[b]) == Counter((variants | {"base": base})[a])) for a in found}
    assert sets.multiset_digests(df, ["x", "y"], ["g"], salt="k").where("g = 'base'").first()["digest"] != found["base"][1]


def test_first_ids_leave_a_task_bounded(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.col("id").alias("i")).repartition(4)
    first = dedup.first_ids(df, "key", "i", 3, "ids")
    assert first.where("key = 'hot'").first()["ids"] == [1, 2, 3]
    assert first.where("key = '40'").first()["ids"] == [40]
    assert first._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2  # before and after the shuffle
    over = dedup.key_overlap(df, df.where("i > 2"), F.col("key"), "i", "i").where("key = 'hot'").first()
    assert (over["left_rows"], over["left_ids"], over["right_rows"], over["right_ids"]) == (18_000, [1, 2, 3], 17_998, [3, 4, 5])


RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}


def labelled_groups(spark, n):
    """Groups of one to four rows, some without labels, one with the only rare label."""
    g = F.col("id")
    rows = spark.range(n).select(F.concat(F.lit("g"), g).alias("g"), F.explode(F.sequence(F.lit(0), F.pmod(F.xxhash64("id"), F.lit(4)))).alias("i"))
    h = F.pmod(F.xxhash64("g", "i", F.lit(3)), F.lit(10))
    labels = F.when(F.col("g") == "g7", F.array(F.lit("rare"), F.lit("a"))).when(h < 5, F.array(F.lit("a"), F.lit(None).cast("string"))).when(h < 8, F.array(F.lit("b"), F.lit("c"))).when(h == 8, F.array(F.lit("c")))
    return rows.select("g", labels.alias("labels"))


def test_splits_by_chunks(spark):
    """Whole groups, all labels in train, sizes and drift as those of one chunk; no group reaches the driver."""
    rows = labelled_groups(spark, 4000)
    one, many = (split.search(rows, "g", "labels", RATIOS, attempts=6, chunk_groups=k).collect() for k in (10_000, 300))
    total = dict(rows.groupBy("g").count().collect())
    for found in (one, many):
        assert sorted(r["group"] for r in found) == sorted(total)
        for s, share in RATIOS.items():
            assert sum(total[r["group"]] for r in found if r["split"] == s) == pytest.approx(share * sum(total.values()), rel=0.03)
        assert {r["split"] for r in found if r["group"] == "g7"} == {"train"}
        assert found[0]["score"] < 1
    assert many[0]["max_total_variation"] < one[0]["max_total_variation"] + 0.03


def test_cover_of_tables_is_the_cover(spark):
    rng = random.Random(6)
    for _ in range(6):
        groups = {f"g{i}": (rng.randint(1, 5), {x: 1 for x in rng.sample("abcdefgh", rng.randint(0, 3))}) for i in range(rng.randint(3, 30))}
        table = spark.createDataFrame([(g, n, sorted(x) or None) for g, (n, x) in groups.items()], "g string, n long, labels array<string>")
        if any(x for _, x in groups.values()):
            assert split.cover_of(table) == split.cover(groups)


def test_batches_give_what_one_gives(spark, tmp_path):
    """Pairs, members and removals of three batches are those of all texts at once; texts of earlier batches are not read again."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(0, 14))
        texts += [" ".join(base), " ".join([*base, rng.choice(words)]), " ".join(base[1:])]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    whole = dedup.shingle_sets(df, "i", F.col("t"), 2)
    pairs, members = dedup.similar_classes(whole, 0.7)
    sets = {r["id"]: frozenset(r["s"]) for r in whole.collect()}
    index = SimilarityIndex(spark, "grown", f"{tmp_path}/index", 0.7, 2, 4)
    found, gone = set(), set()
    for lo, hi in ((0, 50), (50, 50), (50, 120), (120, 180)):
        a, _, c = index.add(df.where((F.col("i") >= lo) & (F.col("i") < hi)), "i", F.col("t"))
        found |= {(frozenset((sets[r["a"]], sets[r["b"]])), round(r["jaccard"], 9)) for r in a.collect() if sets[r["a"]] != sets[r["b"]]}
        gone |= {r["id"] for r in c.collect()}
        index = SimilarityIndex(spark, "grown", f"{tmp_path}/index", 0.7, 2, 4)  # as a later job would open it
    assert found == {(frozenset((sets[r["a"]], sets[r["b"]])), round(r["jaccard"], 9)) for r in pairs.collect()} != set()
    assert gone == {r["id"] for r in dedup.near_duplicates(whole, 0.7).collect()} != set()
    with pytest.raises(ValueError, match="above"):
        index.add(df.limit(1), "i", F.col("t"))
    new = spark.createDataFrame([(1, 2, 3)], "h long, id long, n long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index._met(new, index.table("prefixes"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1, plan  # that of the new rows


def test_runs_that_were_lost_leave_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "i long, t string")
    index = SimilarityIndex(spark, "lost", f"{tmp_path}/index", 0.8, 2, 2)
    index._append(spark.createDataFrame([(1, [5], 1, True)], "id long, s array<long>, n long, kept boolean"), "sets", "a run that ended here")
    assert [r["id"] for r in index.add(df, "i", F.col("t"))[2].collect()] == [2]
    assert index.table("sets").count() == 1


def copies_of(rng, groups, each, size, changed):
    """Sets that are alike in groups, as (id, s, n), and the pairs at 0.85 or more by brute force."""
    sets = []
    for _ in range(groups):
        base = rng.sample(range(10**6), size)
        for _ in range(each):
            sets.append(frozenset([*base[: size - changed], *rng.sample(base[size - changed :], rng.randint(0, changed)), *rng.sample(range(10**6), rng.randint(0, changed))]))
    pairs = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if len(a & b) / len(a | b) >= 0.85}
    return [(i, sorted(s), len(s)) for i, s in enumerate(sets)], pairs


@pytest.mark.parametrize("cell", [1 << 10, 6])
def test_similar_sets_are_moved_once(spark, monkeypatch, cell):
    """Sets of some hundred shingles, whose prefixes must share several: every pair is found, and a set is moved about once, not for each candidate; dealt out where many meet."""
    rows, want = copies_of(random.Random(5), 6, 14, 300, 24)
    moved, compared = [], dedup._compared
    monkeypatch.setattr(dedup, "CELL_SETS", cell)
    monkeypatch.setattr(dedup, "_compared", lambda cells, t: (moved.append(cells.select(F.size("x")).groupBy().agg(F.sum("size(x)"), F.max("size(x)")).first()), compared(cells, t))[1])
    pairs, _ = dedup.similar_classes(spark.createDataFrame(rows, "id long, s array<long>, n long"), 0.85)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and 100 < len(want) < 6 * 14 * 13 / 2
    (total, most) = moved[0]
    assert total <= 1.2 * len(rows) if cell > 100 else most < 14 and total <= 8 * len(rows)


@pytest.mark.parametrize("name", ["near_dup_greedy", "near_dup_pairs"])
def test_sets_of_texts_are_not_written_down(spark, tmp_path, monkeypatch, name):
    """Neither texts nor whole sets go to the checkpoint folder, and what is written follows the prefixes."""
    from tessera.plans import curation
    from tests.compare import differences, duck_rows

    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(base), " ".join(base[: 190 + rng.randrange(10)]), " ".join([*base[:150], "odd", *base[150:]])]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    written = []
    for module in (dedup, curation):
        monkeypatch.setattr(module, "cut", lambda df, f=module.cut: (written.append(df), f(df))[1])
    got = [r.asDict() for r in getattr(curation, name)(spark, str(tmp_path)).collect()]
    assert got and differences(got, duck_rows(getattr(curation, name.upper()), str(tmp_path))) is None
    arrays = [(df, f.name) for df in written for f in df.schema if "array" in f.dataType.simpleString()]
    assert not any(f.name == "text" for df in written for f in df.schema)
    assert [c for _, c in arrays] == ["p"]
    assert sum(r["k"] for r in arrays[0][0].select(F.size("p").alias("k")).collect()) < 0.25 * 200 * len(texts)


def test_an_index_holds_prefixes_and_texts_not_sets(spark, tmp_path, monkeypatch):
    """Sets of whole texts are neither stored nor written on the way; links across batches that need several shared shingles are found."""
    from tessera.operators import similarity_index

    rng, texts = random.Random(4), []
    for _ in range(10):
        base = [f"w{rng.randrange(5000)}" for _ in range(260)]
        texts += [" ".join(base), " ".join(base[: 245 + rng.randrange(15)]), " ".join([*base[:200], "odd", *base[200:]]), " ".join(base)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    want = {r["id"] for r in dedup.near_duplicates(dedup.shingle_sets(df, "i", F.col("t")), 0.85).collect()}
    written = []
    for module in (dedup, similarity_index):
        monkeypatch.setattr(module, "cut", lambda d, f=module.cut: (written.append([x.name for x in d.schema if "array" in x.dataType.simpleString()]), f(d))[1])
    index = SimilarityIndex(spark, "slim", f"{tmp_path}/index", buckets=2)
    gone = [index.add(df.where(part), "i", F.col("t"))[2] for part in ("i < 20", "i >= 20")]
    assert {r["id"] for g in gone for r in g.collect()} == want != set()
    assert sum(written, []) == ["p", "p"]  # a batch's prefixes
    assert index.table("sets").columns == ["id", "n", "kept"] and index.table("texts").count() == index.table("sets").count() < 40
    assert index.table("prefixes").count() < 0.25 * 260 * 40
