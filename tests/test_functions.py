import hashlib
import random
import statistics
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import ident, stats, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("  Ａ—b–c  D\n", "a-b-c d"), ("ﬁne", "fine"), ("", ""), (None, None), ("ÉCOLE\t x", "école x")],
)
def test_normalize_text(spark, raw, want):
    assert one(spark, text.normalize_text, raw) == want


def test_groups_and_sources(spark):
    assert one(spark, text.normalize_group, "Topic — 2025 | alias") == "topic - 2025"
    assert one(spark, text.normalize_source, None) == ""
    assert one(spark, text.normalize_source, " é  B ") == "é B"
    assert one(spark, text.normalize_answer, " STRASSE  Straße ") == "strasse strasse"


def test_options_lose_order_and_numbers_only_in_blocks():
    a = "Which?\n0. Beta  b\n1. alpha\n\nend 2. x"
    b = "which?\n1) Alpha\n2) beta b\nend 2. x"
    assert text.order_options(a) == text.order_options(b) == "which?\nalpha\nbeta b\nend 2. x"
    assert text.order_options("1. only one\nb") == "only one\nb"
    assert text.order_options("2. b\n1. a\n\n2. d\n1. c") == "a\nb\nc\nd"
    assert text.order_options(None) is None


def test_shingles(spark):
    def of(raw, size=4):
        df = spark.createDataFrame([(raw,)], "x string").select(text.words(F.col("x")).alias("w"))
        return set(df.select(text.shingles_of(F.col("w"), size).alias("s")).first()["s"])

    assert of("A b, c! d e a b c d") == {"a b c d", "b c d e", "c d e a", "d e a b", "e a b c"}
    assert of("Слово two") == {"слово two"} and of("") == set() and of(None) == set() and of("a b", 1) == {"a", "b"}
    with pytest.raises(ValueError):
        text.shingles_of(F.col("w"), 0)


def test_personal_data_is_masked_in_order(spark):
    masked, counts = text.mask_personal(F.col("x"))
    raw = "tel +7 (912) 345-67-89, 8 912 345 67 89; a.b@c.de; Дата рождения: 01.02.1990; приказ от 23.11.2021"
    row = spark.createDataFrame([(raw,), (None,)], "x string").select(masked.alias("m"), *[c.alias(k) for k, c in counts.items()]).collect()
    assert row[0].asDict() == {"m": "tel [PHONE], [PHONE]; [EMAIL]; Дата рождения: [DATE]; приказ от 23.11.2021", "phone": 2, "email": 1, "birth_date": 1}
    assert row[1]["m"] is None


def test_labels(spark):
    assert sorted(one(spark, text.label_set, "Drama, ,drama,  Sci  Fi")) == ["drama", "sci fi"] and one(spark, text.label_set, None) == []
    assert one(spark, text.canonical_answer, " b ,A") == "a, b"
    assert one(spark, text.canonical_answer, "a,,b") is None and one(spark, text.canonical_answer, "a, A") is None
    assert one(spark, lambda c: text.map_labels(c, {"a": "z", "b": "z", "c": "y"}), ["c", "b", "a", "q"], "array<string>") == ["y", "z"]


@pytest.mark.parametrize(("raw", "ok"), [("2022-03-01", True), ("2022-3-1", False), ("2022", False), ("2022-02-30", False), ("x2022-03-01", False), (None, False)])
def test_dates_are_exact(spark, raw, ok):
    assert (one(spark, text.iso_date, raw) is not None) is ok


def test_cpu_quantities(spark):
    assert one(spark, text.cpu_cores, "250m") == 0.25 and one(spark, text.cpu_cores, "2") == 2.0


def test_hashes(spark):
    digest = hashlib.sha256(b"abc").hexdigest()
    assert one(spark, lambda c: ident.hex_mod(F.sha2(c, 256), 97), "abc") == int(digest, 16) % 97
    assert one(spark, lambda c: ident.pick(c, ["p", "q", "r"]), "abc") == "pqr"[int(digest, 16) % 3]
    assert one(spark, lambda c: ident.stable_id("m_", c, F.lit("b")), "a") == "m_" + hashlib.sha256("a\x1fb".encode()).hexdigest()
    assert one(spark, lambda c: ident.prefix_cache_key(F.lit(None).cast("string"), c), "x" * 200) == hashlib.sha256(b"x" * 128).hexdigest()


def test_nearest_rank(spark):
    rng = random.Random(2)
    groups = {k: [rng.randrange(20) for _ in range(n)] for k, n in [(0, 1), (1, 10), (2, 57)]}
    groups[1] = list(range(1, 11))
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [(9, None)], "k int, v int")
    want = {k: tuple(sorted(vs)[min(len(vs) - 1, int(q * len(vs)))] for q in (0.1, 0.5, 0.9)) for k, vs in groups.items()}
    assert want[1][2] == 10
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in stats.nearest_rank(df, "v", {"a": 0.1, "b": 0.5, "c": 0.9}, ["k"]).collect()}
    assert got == want
    row = stats.spread(df, "v", ["k"]).where("k = 2").first()
    assert row["mean"] == pytest.approx(statistics.mean(groups[2])) and row["cv"] == pytest.approx(statistics.pstdev(groups[2]) / statistics.mean(groups[2]))
    assert one(spark, lambda c: stats.nearest_rank_of(c, 0.9), [], "array<int>") == 0


@pytest.mark.parametrize(
    ("buckets", "want"),
    [([(0.1, 0), (1.0, 10), ("inf", 10)], 0.55), ([(0.1, 0), (1.0, 0), ("inf", 5)], 1.0), ([(0.1, 0), ("inf", 0)], None), ([(0.1, 4), (1.0, 4), ("inf", 4)], 0.05)],
)
def test_histogram_quantile(spark, buckets, want):
    df = spark.createDataFrame([("k", float(e), n) for e, n in buckets], "k string, le double, count long")
    assert stats.histogram_quantile(df, 0.5, ["k"]).first()["quantile"] == (pytest.approx(want) if want is not None else None)


def test_rules_that_are_easily_taken_for_others(spark):
    """Case folding is no lower-casing, labels are composed, options come before words."""
    assert one(spark, text.canonical_answer, " Straße ,b  b\t") == "b  b, strasse"  # inner white space stays
    assert one(spark, text.canonical_answer, "STRASSE, straße") is None
    assert sorted(one(spark, text.label_set, "Ｄｒａｍａ, a — b,DRAMA,x，y")) == ["a - b", "drama", "x,y"]
    a, b = "Which one?\n1) red fox\n2) blue hen", "Which one?\na. Blue  hen\nb. red fox"
    sets = [one(spark, lambda c: text.shingle_hashes(c, 2), t) for t in (a, b, a.replace("fox", "fox é"), "i. one two")]
    assert sets[0] == sets[1] != sets[2] and sets[3] == one(spark, lambda c: text.shingle_hashes(c, 2), "one two")


def test_outcomes_by_the_first_case_that_holds(spark):
    from pyspark.sql import functions as F

    from tessera.operators.requests import classify

    cases = [
        (429, True, 3, "timeout", "rejected"), (503, False, 0, None, "rejected"), (500, False, 2, None, "error"), (404, True, 0, "timeout", "error"),
        (200, True, 3, "timeout", "timeout"), (None, False, 0, "timeout", "timeout"), (200, True, 3, "reset", "interrupted"), (None, False, 1, "reset", "interrupted"),
        (None, False, 0, "reset", "connection_error"), (200, True, 3, None, "completed"), (200, True, 3, "", "completed"), (200, False, 0, None, "interrupted"),
        (None, None, None, None, "connection_error"), (None, False, 0, "unsent", "unsent"),
    ]
    df = spark.createDataFrame(cases, "status int, completed boolean, chunks int, error string, want string")
    for r in df.withColumn("got", classify(*map(F.col, ("status", "completed", "chunks", "error")))).collect():
        assert r["got"] == r["want"], r


def test_order_statistics(spark):
    import random

    from pyspark.sql import functions as F

    from tessera.functions import stats

    values = [random.Random(4).choice([1, 1, 2, 5, 5, 9, 40, 41]) for _ in range(500)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    s = sorted(v for v in values if v is not None)
    got = stats.nearest_rank(df, "v", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 1.0}).first()
    assert [got[c] for c in "abcd"] == [s[min(len(s) - 1, int(q * len(s)))] for q in (0.0, 0.1, 0.5, 1.0)]
    assert stats.nearest_rank(df.limit(0), "v", {"a": 0.5}).first()["a"] is None
    inf = float("inf")
    buckets = spark.createDataFrame([("x", 1.0, 3), ("x", inf, 4), ("y", 1.0, 0), ("y", 2.0, 2), ("y", inf, 2), ("z", 1.0, 0), ("z", inf, 0)], "k string, le double, count long")
    at = lambda q: {r["k"]: r["quantile"] for r in stats.histogram_quantile(buckets, q, ["k"]).collect()}
    assert at(0.0) == {"x": 0.0, "y": 1.0, "z": None} and at(0.5) == {"x": 2 / 3, "y": 1.5, "z": None}
    numbers = [2.675, 0.125, 0.375, -1.005, 1e300, 0.5, None]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert [r[0] for r in df.select(stats.round_even(F.col("x"), 2)).collect()] == [None if x is None else round(x, 2) for x in numbers]


def test_words_compared_are_those_of_the_line_path(spark):
    """Whatever is left as it is has the words that the line-by-line function gives."""
    rng = random.Random(12)
    parts = ["Das", "straße", "ÉCOLE", "слово", "слово", "語", "１", "ﬁ", "½", "e\u0301", "…", "\xa0", "—", "\n", "\n", "\r\n", "\u2028", "\x1c", " ", " ", "1.", "2)", "а)", "Б.", "٣.", "１．", "x_y", "ſ.", "K)", "İ", "Σ", "\u3000", "가", "\u1100\u1161"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000)] + ["", "1. b\n2. a", "а) б\nб) а", "１. b\n２. a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    ours = {r["i"]: r["w"] for r in df.select("i", text.words(text.comparable(F.col("t"))).alias("w")).collect()}
    lines = spark.createDataFrame([(i, text.order_options(t)) for i, t in enumerate(texts)], "i int, t string")
    assert ours == {r["i"]: r["w"] for r in lines.select("i", text.words(F.col("t")).alias("w")).collect()}


def test_composed_as_the_library_does(spark):
    texts = ["é", "e\u0301", "ﬁ", "…", "Ⅳ", "가", "\u1100\u1161", "a\u0327\u0301", "Ａ", "слово", "\u0951"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.nfkc(F.col("t")).alias("k"), text.nfc(F.col("t")).alias("c"))
    assert all((r["k"], r["c"]) == (unicodedata.normalize("NFKC", r["t"]), unicodedata.normalize("NFC", r["t"])) for r in df.collect())


def test_texts_are_objects_a_slice_at_a_time(spark, monkeypatch):
    """Batches of several slices, some of only nulls, give the same, and no call sees more than a slice."""
    texts = [None if 300 <= i < 900 or i % 7 == 0 else f"Ｅｎ {i}\n2) b\n1) a" for i in range(1300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = {r["i"]: (r["n"], r["c"]) for r in df.select("i", text.nfkc(F.col("t")).alias("n"), text.canonical_options(F.col("t")).alias("c")).collect()}
    assert got == {i: (t and unicodedata.normalize("NFKC", t), text.order_options(t)) for i, t in enumerate(texts)}
    plan = df.select(text.nfkc(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and ", 250" in plan  # an Arrow function, which pandas has no part in


def test_shingle_numbers_are_the_rule_and_run_in_batches(spark):
    """Sorted distinct numbers by a plain loop, for shingles of one md5 block and of many, and no lambda over the words in the plan."""
    rng = random.Random(8)
    words = ["x", "слово", "É", "y" * 70, "z" * 300, "ß_1", "二"]
    texts = [None, "", " !? ", "one", "One, two\nthree", "a b c d", "a b c d a b c d"] + ["; ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    got = rows.select("i", text.shingle_numbers(text.spaced_words(F.col("t")), 4).alias("s"))
    stored = rows.select("i", text.words(F.col("t")).alias("w")).localCheckpoint()
    shingles = {r["i"]: r["s"] for r in stored.select("i", text.shingles_of(F.col("w"), 4).alias("s")).collect()}
    assert {r["i"]: r["s"] for r in got.collect()} == {i: sorted({int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in s}) for i, s in shingles.items()}
    assert "lambdafunction" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_options_are_composed_once(monkeypatch):
    """A text is normalised as a whole, not again line by line; the result is that of normalising each line."""
    rng = random.Random(5)
    parts = ["1) ", "b. ", "2)", "Ａ—b", "–", "‑", "́", "é", "ﬁ", " ", " ", "̸", "Σ", "İ", "\n", "\n", "\r\n", " ", "x", "3.", "한"]
    plain = lambda x: " ".join(unicodedata.normalize("NFKC", x).translate(table).split()).lower()
    table = dict(zip(map(ord, text.DASHES_FROM), text.DASHES_TO, strict=True))

    def by_lines(t):
        runs = []
        for line in unicodedata.normalize("NFKC", t).translate(table).splitlines():
            option = text._OPTION.fullmatch(line)
            kept = plain(option[1] if option else line)
            if not runs or runs[-1][0] is not bool(option):
                runs.append((bool(option), []))
            if kept or option:
                runs[-1][1].append(kept)
        return "\n".join(line for numbered, lines in runs for line in (sorted(lines) if numbered else lines))

    texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(3000)]
    want, calls, normalize = [by_lines(t) for t in texts], [], unicodedata.normalize
    monkeypatch.setattr(text.unicodedata, "normalize", lambda form, t: calls.append(t) or normalize(form, t))
    assert [text.order_options(t) for t in texts] == want
    assert len(calls) == len(texts)
