import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import classifier as C
from tessera.llm import queries
from tessera.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in queries.op6_quality_classifier(spark, SF).collect()}
    assert len(rows) == table(spark, SF, "documents").count()
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for k, r in rows.items())
    held = [(rows[k]["predicted"], q) for k, q in labels.items() if rows[k]["held_out"]]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.95


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    a = C.train(docs, labels)
    b = C.train(docs, labels.withColumn("quality", labels["quality"] * (~C.held_out(labels["doc_id"])).cast("int")))
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior


def test_prior_of_a_mixture():
    rng = np.random.default_rng(0)
    for prior in (0.3, 0.6, 0.9):
        p = rng.normal(0, 1, (3000, 5))
        n = int(6000 * prior)
        u = np.vstack([rng.normal(0, 1, (n, 5)), rng.normal(2.5, 1, (6000 - n, 5))])
        u = u[rng.permutation(len(u))]
        ones = lambda x: np.hstack([x, np.ones((len(x), 1))])
        assert C.estimate_prior(ones(p), ones(u)) == pytest.approx(prior, abs=0.06)


def test_risk_is_not_negative_and_model_separates():
    rng = np.random.default_rng(1)
    p = rng.normal(0, 1, (500, C.SIZE))
    u = np.vstack([rng.normal(0, 1, (700, C.SIZE)), rng.normal(1, 1, (300, C.SIZE))])
    m = C.fit(p, u)
    assert m.score(u[:700]).mean() > 0.8 and m.score(u[700:]).mean() < 0.2


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, 1.0, 1), (1, "", 1.0, 1), (1, "", 1.0, 1), (2, "a b c " * 300_000, None, None)], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(1, 1), (None, 1), (1, None), (9, 0)], "doc_id long, quality int")
    out = C.quality_scores(docs, labels).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)
    assert C.quality_scores(docs.limit(0), labels.limit(0)).count() == 0
    assert C.rejected_removed(docs, labels).columns == docs.columns
    a, b = C.features("é\n" * 700_000), C.features("é\n" * 700)  # strips make no difference
    assert np.allclose(a[: C.CLASSES**2], b[: C.CLASSES**2], atol=0.03)


def test_stage_where_labels_cover_all_or_none_is_good(spark):
    good, bad = "a plain sentence about {0} rivers and {0} hills near the town", "$$ {0} !! WIN {0} ## $$ @@ {0}"
    docs = spark.createDataFrame([(i, (good if i % 2 else bad).format(i)) for i in range(400)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality")
    kept = {r["doc_id"] for r in C.rejected_removed(docs, labels).collect()}
    assert sum(k % 2 for k in kept) >= 190 and sum(1 - k % 2 for k in kept) <= 10
    assert C.rejected_removed(docs, labels.selectExpr("doc_id", "0 AS quality")).count() == 400


def plain_features(text):
    """The statistics of features(), a byte and a word at a time; short texts only (one strip)."""
    raw = (text or "").encode()
    kind = lambda b: next((k for k, g in enumerate(C._GROUPS) if b in g), C.CLASSES - 1)
    kinds = [kind(b) for b in raw]
    pairs, single = Counter(zip(kinds, kinds[1:], strict=False)), Counter(kinds)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, m = max(1, len(raw)), max(1, len(words))
    packer = zlib.compressobj(1)
    packed = len(packer.compress(raw)) + len(packer.flush())
    distinct = len(set(words)) / m
    out = [math.sqrt(pairs[a, b] / n) for a in range(C.CLASSES) for b in range(C.CLASSES)] + [math.sqrt(single[a] / n) for a in range(C.CLASSES)]
    out += [math.log1p(len(words)), math.log(packed / n), distinct, math.log(distinct + 1e-3) if words else 0.0, 1 - len(set(lines)) / max(1, len(lines)), n / m / 10]
    return out + [sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / m, math.log1p(n / max(1, len(lines))) / 10]


def test_table_against_brute_force(spark):
    """Which documents the model is fitted on, their statistics and every score, written again; the fit itself is tested below."""
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    x = {k: plain_features(t) for k, t in docs.items()}
    assert all(np.allclose(C.features(docs[k]), v, atol=1e-5) for k, v in x.items())
    fitted = sorted(k for k in docs if zlib.crc32(str(k).encode()) % 4 != 2)
    p = np.array([x[k] for k in fitted if labels.get(k) == 1], np.float32)
    u = np.array([x[k] for k in fitted if k not in labels], np.float32)
    model = C.fit(p, u)
    got = {r["doc_id"]: r["score"] for r in C.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()}
    assert got.keys() == docs.keys()
    for k, v in x.items():
        z = sum(w * min(8.0, max(-8.0, (a - b) / c)) for w, a, b, c in zip(model.weights, v, model.mean, model.scale, strict=True)) + model.bias
        assert abs(got[k] - 1 / (1 + math.exp(-z))) < 2e-3


def test_fit_lowers_the_risk():
    """The non-negative risk, summed row by row, at the fitted weights and around them."""
    rng = np.random.default_rng(3)
    p = rng.normal(0, 1, (400, C.SIZE)).astype(np.float32)
    u = np.vstack([rng.normal(0, 1, (500, C.SIZE)), rng.normal(0.5, 1, (500, C.SIZE))]).astype(np.float32)
    m = C.fit(p, u)

    def risk(w, b):
        z = lambda x: np.clip((x - m.mean) / m.scale, -8, 8) @ w + b
        plus, minus = (lambda t: np.mean(np.log1p(np.exp(-t)))), (lambda t: np.mean(np.log1p(np.exp(t))))
        return m.prior * plus(z(p)) + max(0.0, minus(z(u)) - m.prior * minus(z(p))) + 1.5e-4 * w @ w

    # the fit steps back wherever the second part falls below zero, so it ends near the least risk, not at it
    assert risk(m.weights, m.bias) < 0.1 * risk(np.zeros(C.SIZE), 0.0)
    for k in range(20):
        away = np.random.default_rng(k).normal(0, 1, C.SIZE)
        assert risk(m.weights, m.bias) < risk(away * np.linalg.norm(m.weights) / np.linalg.norm(away), m.bias)


def test_sample_is_the_lowest_hashes(spark):
    from pyspark.sql import functions as F

    from tessera.llm.common import lowest

    rows = spark.range(200_000).select(F.col("id").alias("doc_id"), F.xxhash64("id", F.lit(17)).alias("h"))
    for n in (1, 100, 5000):
        want = rows.orderBy("h", "doc_id").limit(n).collect()
        assert lowest(rows, n, 200_000).collect() == want
        assert 2 * n < lowest(rows, 200_000, 200_000).count() == 200_000


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(i, "plain words about a river and a town " * 9 if i % 2 else "$$ !! ## " * 40, i, 0.5, "h", True) for i in range(200)], "doc_id long, text string, chosen long, score double, h string, positive boolean")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality", "text", "chosen").where("doc_id < 100")
    kept = C.rejected_removed(docs, labels).collect()
    assert kept and kept[0].asDict().keys() == set(docs.columns) and all(r["chosen"] == r["doc_id"] and r["h"] == "h" for r in kept)
