import heapq
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tessera.operators import dedup, encode, evaluate, quality, requests, sampling, split


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def random_sets(seed, n=120):
    rng = random.Random(seed)
    base = [{rng.randrange(60) for _ in range(rng.randrange(1, 14))} for _ in range(n // 3)] + [set(), set()]
    out = list(base)
    while len(out) < n:
        s = set(rng.choice(base))
        for _ in range(rng.randrange(3)):
            s ^= {rng.randrange(60)}
        out.append(s)
    return out


def frame(spark, sets):
    return spark.createDataFrame([(i, sorted(s), len(s)) for i, s in enumerate(sets)], "id long, s array<long>, n long")


@pytest.mark.parametrize("t", [0.5, 0.8, 0.85, 1.0])
def test_similarity_join_is_exact(spark, t):
    sets = random_sets(int(t * 100))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if jaccard(sets[i], sets[j]) >= t}
    got = dedup.similar_pairs(frame(spark, sets), t).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    assert all(r["jaccard"] == pytest.approx(jaccard(sets[r["a"]], sets[r["b"]])) for r in got)
    left, right = sets[:50], sets[50:]
    cross = {(r["a"], r["b"]) for r in dedup.cross_similar_pairs(frame(spark, left), frame(spark, right), t).collect()}
    assert cross == {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if jaccard(a, b) >= t}


@pytest.mark.parametrize("share", [0.3, 0.5, 1.0])
def test_containment_is_exact(spark, share):
    items, docs = random_sets(7, 40), random_sets(8)
    docs = [s | {777} for s in docs]  # a shingle that all documents have
    items = [s | {777} if i % 2 else s for i, s in enumerate(items)]
    want = {(i, j): len(a & b) / len(a) for i, a in enumerate(items) for j, b in enumerate(docs) if a and len(a & b) / len(a) >= share}
    got = dedup.contained_pairs(frame(spark, items), frame(spark, docs), share).collect()
    assert {(r["a"], r["b"]): r["share"] for r in got} == pytest.approx(want) and len(got) == len(want)


def test_classes_of_equal_sets(spark):
    classes, members = dedup.equal_classes(frame(spark, [{1}, {2, 3}, {1}, set(), {3, 2}, set(), {1}]))
    assert sorted((r["id"], r["s"], r["n"]) for r in classes.collect()) == [(0, [1], 1), (1, [2, 3], 2), (3, [], 0)]
    assert sorted(map(tuple, members.collect())) == [(0, 0), (1, 1), (2, 0), (3, 3), (4, 1), (5, 3), (6, 0)]


def test_greedy_removal_is_the_scan(spark):
    assert [r["id"] for r in dedup.greedy_removal(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).collect()] == [2]  # a chain keeps both ends
    rng = random.Random(1)
    for n in (10, 40):
        pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(2 * n)})
        kept = []
        for i in range(n):
            if not any((j, i) in pairs for j in kept):
                kept.append(i)
        got = {r["id"] for r in dedup.greedy_removal(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert got == set(range(n)) - set(kept)


@pytest.mark.parametrize("t", [0.5, 0.8])
def test_near_duplicates_of_copies(spark, t):
    sets = random_sets(31)
    sets += sets[:40]
    kept = []
    for i, s in enumerate(sets):
        if not any(jaccard(s, sets[j]) >= t for j in kept):
            kept.append(i)
    got = [r["id"] for r in dedup.near_duplicates(frame(spark, sets), t).collect()]
    assert sorted(got) == [i for i in range(len(sets)) if i not in set(kept)]


def test_minhash_agrees_on_equal_sets(spark):
    sets = [{1, 2, 3}, {1, 2, 3}, {9, 8}, set()]
    rows = {r["id"]: r["signature"] for r in dedup.minhash(frame(spark, sets)).collect()}
    assert rows[0] == rows[1] != rows[2] and rows[3][0] is None
    got = {(r["a"], r["b"]) for r in dedup.minhash_candidates(dedup.minhash(frame(spark, sets))).collect()}
    assert got == {(0, 1)}


@pytest.mark.parametrize("t", [0, 1.5, True, "x"])
def test_thresholds_are_checked(t):
    with pytest.raises(ValueError):
        dedup.check_threshold(t)


def test_duplicates_and_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "i long, t string")
    assert {r["i"] for r in dedup.exact_duplicates(rows, F.col("t"), "i").where("is_duplicate").collect()} == {3, 5}
    a = dedup.keyed_first(rows.withColumn("k", F.lit(1)), "k", [F.col("t")]).collect()
    b = dedup.keyed_first(rows.orderBy(F.desc("i")).withColumn("k", F.lit(1)), "k", [F.col("t")]).collect()
    assert len(a) == 1 and a[0]["t"] == b[0]["t"]
    over = dedup.key_overlap(rows, rows.where("i > 1"), F.col("t"), "i", "i").collect()
    assert {(r["key"], r["left_rows"], tuple(r["right_ids"])) for r in over} == {("a", 2, (3,)), ("b", 1, (2,))}


def test_samples(spark):
    rows = spark.range(300).select(F.col("id"), (F.col("id") % 3).cast("string").alias("s"))
    small = {r["id"] for r in sampling.hash_prefix(rows, "id", 20).collect()}
    assert small < {r["id"] for r in sampling.hash_prefix(rows.orderBy(F.rand(1)), "id", 60).collect()}
    quota = sampling.quotas(32, ["0", "1", "2"], 7)
    assert sum(quota.values()) == 32 and max(quota.values()) - min(quota.values()) <= 1
    got = sampling.stratified(rows, F.col("s"), "id", quota, "x").groupBy("stratum").count().collect()
    assert {r["stratum"]: r["count"] for r in got} == quota
    assert sampling.stratified(rows, F.col("s"), "id", quota, "y").exceptAll(sampling.stratified(rows, F.col("s"), "id", quota, "x")).count() > 0
    short = sampling.deficits(rows, F.col("s"), {"0": 101, "1": 5, "z": 1}).collect()
    assert {(r["stratum"], r["available"]) for r in short} == {("0", 100), ("z", 0)}


RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}


def test_split_search(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randrange(40)}", rng.sample(["a", "b", "c", "d"], rng.randrange(1, 3))) for _ in range(800)] + [("g0", ["rare"])]
    df = spark.createDataFrame(rows, "g string, labels array<string>")
    got = split.search(df, "g", "labels", RATIOS, attempts=40).collect()
    where = {r["group"]: r["split"] for r in got}
    assert set(where) == {g for g, _ in rows} and where["g0"] == "train" and set(where.values()) == set(split.SPLITS)
    assert {tuple(r) for r in split.search(df, "g", "labels", RATIOS, attempts=40).collect()} == {tuple(r) for r in got}
    table = {}
    for g, labels in rows:
        n, c = table.setdefault(g, [0, {}])
        table[g][0] = n + 1
        for x in labels:
            c[x] = c.get(x, 0) + 1
    table = {g: tuple(v) for g, v in table.items()}
    anchors = split.cover(table)
    scores = [(split.rate(table, split.assign(table, anchors, RATIOS, f"42|{k}"), RATIOS)[0], k) for k in range(40)]
    assert (got[0]["score"], got[0]["attempt"]) == min(scores)
    assert {x for g in anchors for x in table[g][1]} == {"a", "b", "c", "d", "rare"}


@pytest.mark.parametrize("bad", [{"train": 1.0}, {"train": 0.8, "val": 0.1, "test": 0.2}, {"train": 1.0, "val": 0.0, "test": 0.0}, {"train": float("nan"), "val": 0.1, "test": 0.1}, {"train": True, "val": 0.1, "test": 0.1}])
def test_bad_ratios(bad):
    with pytest.raises(ValueError):
        split.check_ratios(bad)


def test_padding_goldens(spark):
    df = spark.createDataFrame([(0, [10, 11], [1, 1], [-100, 11], 0), (1, [20, 21, 22], [1, 1, 1], [-100, 21, 22], 0)], "i int, input_ids array<int>, attention_mask array<int>, labels array<int>, batch int")
    rows = encode.pad(df, "batch", {"input_ids": 99, "attention_mask": 0, "labels": -100}, "left").orderBy("i").collect()
    assert [r["input_ids"] for r in rows] == [[99, 10, 11], [20, 21, 22]]
    assert [r["attention_mask"] for r in rows] == [[0, 1, 1], [1, 1, 1]] and [r["labels"] for r in rows] == [[-100, -100, 11], [-100, 21, 22]]


def test_encoding(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5]), ([1, 2, 3], []), ([], [7])], "p array<int>, a array<int>")
    rows = [r["e"] for r in df.select(encode.encode_pair(F.col("p"), F.col("a"), 4).alias("e")).collect()]
    assert rows[0]["input_ids"] == [1, 2, 3, 4] and rows[0]["labels"] == [-100, -100, -100, 4] and rows[0]["truncated"] and rows[0]["supervised"] == 1
    assert rows[1]["supervised"] == 0 and rows[2]["labels"] == [7]
    batched = encode.batches(spark.range(50).select((F.col("id") * 7 % 50).alias("x")), [F.col("x")], 8).collect()
    assert {(r["x"], r["batch"]) for r in batched} == {(i, i // 8) for i in range(50)}
    offsets = spark.createDataFrame([([(0, 3), (3, 6), (6, 9)],)], "o array<struct<start: int, end: int>>")
    assert offsets.select(encode.prompt_boundary(F.col("o"), F.lit(5)).alias("n")).first()["n"] == 2


@pytest.mark.parametrize("bad", ['{"answer": "a", "answer": "b"}', '{"answer": NaN}', '{"answer": 1e999}', '{"answer": "a"} x', "", "[", '{"answer": Infinity}'])
def test_strict_json(bad):
    with pytest.raises(ValueError):
        evaluate.strict_json(bad)


CHOICES = ["REFUSE", "a", "a, b", "b", "c"]


def test_scores_by_hand(spark):
    items = [("1", "a, b", '{"answer": "a, b"}', None), ("2", "a", '{"answer": "b"}', None), ("3", "REFUSE", '{"answer": "a"}', None), ("4", "a, b", '{"answer": "b, a"}', None), ("5", "c", None, "timeout")]
    golden = spark.createDataFrame([(i, e, CHOICES, ["s0", "all"] if i < "3" else ["all"]) for i, e, _, _ in items], "id string, expected string, choices array<string>, slices array<string>")
    outputs = spark.createDataFrame([(i, raw, error) for i, _, raw, error in items], "id string, raw string, error string")
    scores = evaluate.score_items(golden, outputs)
    got = {r["id"]: (r["valid"], r["correct"], r["tp"], r["fp"], r["fn"], r["support"]) for r in scores.collect()}
    assert got == {"1": (True, True, 2, 0, 0, 2), "2": (True, False, 0, 1, 1, 1), "3": (True, False, 0, 1, 0, 0), "4": (False, False, 0, 0, 2, 2), "5": (False, False, 0, 0, 1, 1)}
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    m = evaluate.metrics(scores, labels).first()
    assert (m["n"], m["correct"], m["valid"], m["errors"]) == (5, 1, 3, 1) and m["micro_f1"] == pytest.approx(4 / (4 + 2 + 4))
    per = {r["label"]: r["f1"] for r in evaluate.per_label(scores, labels).collect()}
    assert m["macro_f1"] == pytest.approx(sum(per.values()) / 3) and per["c"] == 0
    assert {r["slice"]: r["n"] for r in evaluate.by_slice(scores, labels).collect()} == {"s0": 2, "all": 5}


@pytest.mark.parametrize(("choices", "bad"), [(CHOICES, False), (["a"], True), (["REFUSE"], True), (["REFUSE", "b, a"], True), (["REFUSE", "a", "a"], True), (["REFUSE", "A"], True), (["REFUSE", "a, a"], True), ([], True), (["REFUSE", " a"], True)])
def test_catalogues(spark, choices, bad):
    df = spark.createDataFrame([(choices,)], "c array<string>")
    assert df.select(evaluate.malformed_choices(F.col("c")).alias("x")).first()["x"] is bad


def gate(spark, change):
    m = {"n": 60, "correct": 50, "valid": 60, "errors": 0, "accuracy": 0.8, "format_rate": 1.0, "micro_f1": 0.8, "macro_f1": 0.7}
    keys = list(m)
    schema = "n long, correct long, valid long, errors long, accuracy double, format_rate double, micro_f1 double, macro_f1 double, model string"
    overall = [{**m, "model": "baseline"}, {**m, **change.get("overall", {}), "model": "candidate"}]
    slices = [{**m, "model": x, "slice": s, **(change.get("slice", {}) if x == "candidate" and s == "s1" else {})} for x in ("baseline", "candidate") for s in ("s1", "s2", "s3") if not (x == "candidate" and s == change.get("without"))]
    behavioral = {**m, "correct": 60, **change.get("behavioral", {})}
    make = lambda rows, extra: spark.createDataFrame([tuple(r[k] for k in [*keys, "model", *extra]) for r in rows], schema + "".join(f", {e} string" for e in extra))
    found = evaluate.gate(make(overall, []), make(slices, ["slice"]), make([{**behavioral, "model": "x"}], []).drop("model"), ["s1"])
    return {r["reason"] for r in found.collect()}


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None),
        ({"overall": {"accuracy": 0.9}}, None),
        ({"overall": {"accuracy": 0.79}}, "overall: accuracy fell"),
        ({"overall": {"macro_f1": float("nan")}}, "overall: macro_f1 fell"),
        ({"overall": {"micro_f1": None}}, "overall: micro_f1 fell"),
        ({"overall": {"errors": 1}}, "candidate: generation errors"),
        ({"overall": {"n": 49}}, "candidate: fewer than 50 items"),
        ({"slice": {"micro_f1": 0.1}}, "slice s1: micro_f1 fell"),
        ({"without": "s1"}, "slice s1: accuracy fell"),
        ({"without": "s2"}, "candidate: fewer than 3 slices"),
        ({"behavioral": {"correct": 59}}, "behavioral cases not all passed"),
    ],
)
def test_gate_fails_closed(spark, change, reason):
    found = gate(spark, change)
    assert (reason in found) if reason else not found


def test_threshold_gate(spark):
    metrics = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "metric string, value double")
    limits = {"ra": ("a", "min", 1.0), "rb": ("b", "max", 9.0), "rc": ("c", "min", 0.0), "rd": ("a", "max", 0.5)}
    assert {r["rule"] for r in quality.violations(metrics, limits).collect()} == {"rb", "rc", "rd"}
    with pytest.raises(ValueError, match="limits: rb"):
        quality.require(quality.violations(metrics, limits), "limits")


def test_degenerate_set_breaks_the_diversity_gate(spark):
    rows = spark.range(1200).select(F.col("id").alias("seq"), F.lit("one").alias("system"), F.lit("g").alias("grp"), F.lit("text").alias("description"), F.lit("same").alias("answer"), F.array(F.lit("x")).alias("labels"))
    found = {r["rule"] for r in quality.violations(quality.diversity(rows), quality.DIVERSITY_LIMITS).collect()}
    assert found == set(quality.DIVERSITY_LIMITS) - {"min_examples"}
    tie = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b")], "seq long, g string")
    assert quality.largest(tie, "g", "seq").first()["name"] == "b"  # of equal ones the first met


@pytest.mark.parametrize("capacity", [0, 1, 3])
def test_lru(spark, capacity):
    rng = random.Random(capacity)
    rows = [(i, f"p{rng.randrange(3)}", f"x{rng.randrange(6)}") for i in range(300)]
    caches, want = {}, {}
    for i, k, x in rows:
        c = caches.setdefault(k, OrderedDict())
        want[i] = x in c
        c.pop(x, None)
        c[x] = 1
        while len(c) > capacity:
            c.popitem(last=False)
    got = requests.lru_hits(spark.createDataFrame(rows, "i long, k string, x string"), "k", ["i"], "x", capacity)
    assert {r["i"]: r["hit"] for r in got.collect()} == want


def test_admission_queue(spark):
    """Against an event-driven simulation."""
    rng = random.Random(9)
    rows = [(i, "s", round(i * 0.4 + rng.random(), 3), rng.choice([0.2, 1.0, 6.0])) for i in range(200)]
    rows.sort(key=lambda r: (r[2], r[0]))
    running, waiting, timeout, limit = [], [], 2.5, 3
    want, started = {}, {}

    def advance(until):
        while True:
            finish = running[0] if running else float("inf")
            leave = waiting[0][0] + timeout if waiting else float("inf")
            t = min(finish, leave)
            if t > until:
                return
            if finish <= leave:
                heapq.heappop(running)
                if waiting:
                    arrived, i, s = waiting.pop(0)
                    started[i] = t - arrived
                    heapq.heappush(running, t + s)
            else:
                _, i, _ = waiting.pop(0)
                want[i] = "queue_timeout"

    for i, _, t, s in rows:
        advance(t)
        if not running:
            started[i] = 0.0
            heapq.heappush(running, t + s)
        elif len(waiting) >= limit:
            want[i] = "queue_full"
        else:
            waiting.append((t, i, s))
    advance(float("1e9"))
    want |= dict.fromkeys(started, "served")
    got = requests.admission(spark.createDataFrame(rows, "id long, s string, t double, w double"), "s", "t", "w", waiting=limit, timeout=timeout).collect()
    assert {r["id"]: r["outcome"] for r in got} == want
    assert all(r["queue_seconds"] == pytest.approx(started[r["id"]], abs=1e-6) for r in got if r["outcome"] == "served")


def test_accounting_and_patterns(spark):
    rows = spark.createDataFrame([(o,) for o in ("completed", *requests.OUTCOMES)], "o string")
    r = requests.accounting(rows, "o").first()
    assert (r["planned"], r["sent"], r["completed"]) == (8, 7, 2) and r["unsent_fraction"] == 1 / 8
    nothing = requests.accounting(rows.where("o = 'unsent'"), "o").first()
    assert nothing["error_fraction"] is None
    schedule = requests.open_loop_schedule(spark, 120, 2, 4, True)
    assert schedule.count() == 240 and schedule.where("client = 0").count() == 192 and schedule.select("client").distinct().count() == 4
    df = spark.createDataFrame([(["i", "p", "p", "f", "x", "i"],), (["p", "i", "f"],)], "s array<string>")
    assert [r["y"] for r in df.select(requests.follows(F.col("s"), ["i", "p", "f", "i"]).alias("y")).collect()] == [True, False]
    d = requests.distribution(spark.createDataFrame([(float("nan"),), (None,), (float("inf"),)], "v double"), F.col("v")).first()
    assert d["count"] == 0 and d["p95"] is None


def test_strict_json_in_the_jvm(spark):
    """Each verdict is that of the strict reader, whatever tries to get out of the wrapping."""
    good = ['{"a": 1}', "[]", " [1, 2.5e3] ", '"x"', "null", "true", "-0", "1", '{"a": {"a": [{"a": 1}]}}', '"\\u00e9\\n"', '"é 😀"', "\n{}\t", '{"x": 1}', "1e99", '"' + "long " * 50_000 + '"', "[" * 400 + "]" * 400, "9" * 299, '{"": 1}']
    bad = ["", " ", "{", '{"a": 1} x', '{"a": 1}{}', "1, 2", '1, "b": 2', '1} , {"y": 2', "1]", '{"a": 1, "a": 2}', '{"b": {"c": 1, "c": 1}}', "NaN", "[Infinity]", "-Infinity", "1e999", "[1e400]", "01", "+1", "1.", ".5", "'a'", "{a: 1}", "[1,]", '{"a": 1,}', "// c\n1", '"a\tb"'.replace("\\t", "\t"), "nul", '{"a"}', "\ufeff1", '1,"' + "0" * 64 + '":1}', "True", "[1 2]"]
    texts = [*good, *bad, None, '"\\ud800"', "9" * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", evaluate.is_strict_json(F.col("t")).alias("ok")).collect()

    def plain(t):
        try:
            evaluate.strict_json(t)
        except (ValueError, RecursionError):
            return False
        return True

    assert all(plain(t) for t in good) and not any(plain(t) for t in bad)
    assert {texts[r["i"]]: r["ok"] for r in rows} == {t: None if t is None else plain(t) for t in texts}


def test_minhash_is_the_rule_and_runs_in_batches(spark):
    """Each minimum by a plain loop, for sets beyond a stretch too, and no lambda over the elements in the plan."""
    rng = random.Random(4)
    sets = {i: sorted({rng.randint(-(2**63), 2**63 - 1) for _ in range(n)}) for i, n in enumerate([0, 1, 7, 40_000, 0, 300, 2])}
    signed = dedup.minhash(spark.createDataFrame(list(sets.items()), "id long, s array<long>").repartition(1).orderBy("id"), 16)
    want = {i: [min((x % 2**32 * a + b) % dedup.PRIME for x in s) if s else None for a, b in dedup.coefficients(16)] for i, s in sets.items()}
    assert {r["id"]: r["signature"] for r in signed.collect()} == want
    assert "lambdafunction" not in signed._jdf.queryExecution().optimizedPlan().toString()


def test_prefixes_are_made_without_a_shuffle(spark, monkeypatch):
    """The similarity join is exact where most shingles are frequent, and the prefixes of sets come from their own task."""
    monkeypatch.setattr(dedup, "ORDER_LEAST", 3)
    sets = random_sets(91)
    sets = [s | {777, 778, 779} for s in sets]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8}
    got = {(r["a"], r["b"]) for r in dedup.similar_pairs(frame(spark, sets), 0.8).collect()}
    assert got == want != set()
    prefix = dedup._ordered_prefixes(frame(spark, sets), 0.8)
    assert "Exchange" not in prefix._jdf.queryExecution().executedPlan().toString()
    order = {h: k for k, h in enumerate(dedup._frequent(frame(spark, sets)).tolist(), 1)}
    assert {777, 778, 779} <= set(order)
    for i, s in enumerate(sets):
        ranked = sorted(s, key=lambda h: (order.get(h, 0), h))
        keep = len(s) - -(-len(s) * 8 // 10) + 1 if s else 0
        assert {r["h"] for r in prefix.where(F.col("id") == i).collect()} == set(ranked[:keep]) if i < 5 else True


@pytest.mark.parametrize("name", ["near_dup_pairs", "minhash_pairs"])
def test_every_document_is_in_a_class(spark, tmp_path, name):
    """Copies of a text, and texts without words, are members too; as SQL has it."""
    from tessera.plans import curation
    from tests.compare import differences, duck_rows

    body = "one two three four five six seven eight nine ten"
    texts = [body, body.upper(), f"  {body}", body.replace(" ", ", "), "other words of no one else", "!", "?!", "!", "Other  words of no one else"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.asDict() for r in getattr(curation, name)(spark, str(tmp_path)).collect()]
    assert differences(got, duck_rows(getattr(curation, name.upper()), str(tmp_path))) is None
    assert sorted((r["a"], r["b"]) for r in got if r["kind"] == "member") == [(0, 1), (0, 2), (0, 3), (4, 8), (5, 6), (5, 7)]
