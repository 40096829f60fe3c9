import re
from math import comb, log

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_rules as Q
from tessera.llm import queries

from .duck import rows, same

SF = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_capitals": len(re.findall("[A-Z]", text)),
    }


def test_measures(spark):
    texts = [None, "", " ", "a", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "a " * 30, "x y " * 3000, "l\nl\n \nl\r\nl\n", "É ß <>|&%$*# #\x0b\x0c\x1f", "one two three four five six seven eight nine one two three four five six seven eight ten", "   x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for r in df.select("i", Q.measures(F.col("text")).alias("m")).collect():
        assert r["m"].asDict() == plain(texts[r["i"]]), texts[r["i"]]


def test_tail_is_binomial(spark):
    cases = [(k, n, a) for a in (0.005, 0.3) for n in (1, 10, 400) for k in range(0, min(6, n))] + [(3000, 100_000, 0.04)]
    for a in {c[2] for c in cases}:
        df = spark.createDataFrame([(k, n) for k, n, b in cases if b == a], "k long, n long")
        for r in df.select("k", "n", Q._tail(F.col("k"), F.col("n"), a).alias("p")).collect():
            if r["n"] <= 400:
                want = log(sum(comb(r["n"], j) * a**j * (1 - a) ** (r["n"] - j) for j in range(r["k"] + 1)))
                assert r["p"] == pytest.approx(want, abs=1e-9)
            else:
                assert -200 < r["p"] < -100  # far below, where probabilities themselves would be lost


def test_query_matches_sql(spark):
    assert same(queries.op2_quality_rules(spark, SF).collect(), rows(queries.ORACLE_SQL["op2_quality_rules"], SF))


def test_query_matches_sql_where_cutoffs_are_active(spark):
    big = "/root/testdata/sf0.1"
    got = queries.op2_quality_rules(spark, big).collect()
    assert sum(not r["kept"] and not r["base_failed"] for r in got) >= 100
    assert same(got, rows(queries.ORACLE_SQL["op2_quality_rules"], big))


def labelled(spark, n=3000):
    good = " ".join(f"word{i}" for i in range(40))
    docs = [(i, good + (" ".join([""] + [f"***{j}" for j in range(20)]) if i % 10 == 0 else ""), ["en", "de", None][i % 3], "x") for i in range(n)] + [(None, good, "en", "x"), (5, None, "fr", "x")]
    labels = [(i, int(i % 10 != 0), 0) for i in range(n)] + [(5, None, 1), (None, 1, 1), (10**9, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, m string"), spark.createDataFrame(labels, "doc_id long, quality int, kept int")


def test_cutoffs_need_enough_labels(spark):
    docs, labels = labelled(spark)
    few = Q.rejected_removed(docs, labels.where("doc_id < 600"))
    assert few.columns == docs.columns and few.count() == 3001  # only the null text goes
    judged = Q.quality_rules(docs, labels, max_false_rejection=0.05)
    out = judged.collect()
    assert len(out) == 3002
    assert {r["doc_id"] for r in out if not r["kept"]} == {i for i in range(3000) if i % 10 == 0} | {5}
    assert Q.rejected_removed(docs, labels, max_false_rejection=0.05).count() == 2701
    assert Q.quality_rules(docs.limit(0), labels.limit(0)).count() == 0
    assert Q.rejected_removed(docs, labels.limit(0)).count() == 3001


def test_false_rejection_is_limited(spark):
    docs, labels = labelled(spark)
    noisy = labels.withColumn("quality", F.when(F.col("doc_id") % 20 == 0, 1).otherwise(F.col("quality")))  # half of those with symbols are good
    assert Q.rejected_removed(docs, noisy, max_false_rejection=0.05).count() == 3001


def cutoffs(docs, labels, **options):
    measured = docs.select(F.col("doc_id").alias("id"), Q.stratum(F.col("lang")).alias("stratum"), Q.measures(F.col("text")).alias("m"))
    return sorted(map(tuple, Q.thresholds(measured, labels.select(F.col("doc_id").alias("id"), "quality"), **options).collect()))


def times(df, n):
    return df.join(df.sparkSession.range(n), how="cross")


def test_repeated_labels_and_rows_are_one_draw(spark):
    docs, labels = labelled(spark)
    few = labels.where("doc_id < 600")
    assert cutoffs(docs, few) == cutoffs(docs, times(few, 10)) == cutoffs(times(docs, 10), few) == []
    enough = cutoffs(docs, labels, max_false_rejection=0.05)
    assert enough and enough == cutoffs(times(docs, 3), times(labels, 3), max_false_rejection=0.05)


def test_contradictory_labels_count_for_nothing(spark):
    docs, labels = labelled(spark)
    both = labels.unionByName(labels.where("doc_id % 2 = 1").withColumn("quality", 1 - F.col("quality")))
    assert cutoffs(docs, both, max_false_rejection=0.1) == cutoffs(docs, labels.where("doc_id % 2 = 0"), max_false_rejection=0.1)
    two_texts = docs.unionByName(docs.where("doc_id % 2 = 1").withColumn("text", F.concat("text", F.lit(" and more words"))))
    assert cutoffs(two_texts, labels, max_false_rejection=0.1) == cutoffs(docs, labels.where("doc_id % 2 = 0"), max_false_rejection=0.1)
