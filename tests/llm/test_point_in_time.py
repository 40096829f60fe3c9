import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm.point_in_time import canonical_nodes, point_in_time

from .duck import rows, same

SF = "/root/testdata/sf0.01"
VERSIONS = "entity string, event long, arrival long, expiry long, version_id long, feature string, t string, version int"


def test_query_matches_sql(spark):
    assert same(queries.op12_point_in_time(spark, SF).collect(), rows(queries.OP12_SQL, SF))


def plain(entity, t, versions):
    if entity is None or t is None:
        return None
    fit = [v for v in versions if v[0] == entity and None not in v[1:4] and max(v[1], v[2]) <= t < v[3]]
    best = max(fit, key=lambda v: (v[1], -v[2], v[4] is not None, v[4] or 0, v[5] is not None, v[5] or ""), default=None)
    return best and (best[1], best[2], best[4], best[5])


def drawn(rng, n, span, longest):
    maybe = lambda x: x if rng.random() > 0.03 else None
    out = []
    for i in range(n):
        entity = rng.choice(["hot", "hot", "a", "b", None])
        event = rng.randint(-span, span)
        out.append((entity, maybe(event), maybe(event + rng.randint(-20, 20)), maybe(event + rng.randint(-5, longest)), maybe(i // 2), rng.choice(["x", "y", None]), "t", 1))
    return out + out[: n // 10]


@pytest.mark.parametrize(("span", "longest", "salt_level"), [(60, 40, 16), (300, 500, 16), (300, 500, 3), (2**40, 2**41, 16)])
def test_brute_force(spark, span, longest, salt_level):
    rng = random.Random(span + longest)
    versions = drawn(rng, 300, span, longest)
    asks = [(i, rng.choice(["hot", "a", "b", "none", None]), rng.choice([None, *range(9)]) and rng.randint(-span, span), "kept", 7) for i in range(200)]
    asks += asks[:20]
    found = point_in_time(
        spark.createDataFrame(asks, "ask long, entity string, t long, feature string, version int"), spark.createDataFrame(versions, VERSIONS), features=["feature"], salt_level=salt_level
    )
    assert found.columns == ["ask", "entity", "t", "feature", "version"]
    rows_ = found.collect()
    assert sorted(r["ask"] for r in rows_) == sorted(a[0] for a in asks)
    for r in rows_:
        assert (r["version"] and tuple(r["version"])) == plain(r["entity"], r["t"], versions)
        assert r["feature"] == "kept"


def test_open_ended_and_extreme_times(spark):
    top = 2**63 - 1
    versions = [("a", -(2**62), -(2**62), top, 1, "x", "", 0), ("a", 5, 5, top, 2, "y", "", 0), ("a", 9, 9, 9, 3, "never", "", 0)]
    asks = [("a", t) for t in (-(2**62) - 1, -(2**62), 0, 4, 5, 10**18, top - 1)]
    found = point_in_time(spark.createDataFrame(asks, "entity string, t long"), spark.createDataFrame(versions, VERSIONS)).collect()
    assert {r["t"]: r["version"] and r["version"]["version_id"] for r in found} == {t: v and v[2] for t in [a[1] for a in asks] for v in [plain("a", t, versions)]}


def test_empty_tables(spark):
    asks, versions = spark.createDataFrame([("a", 1)], "entity string, t long"), spark.createDataFrame([("a", 0, 0, 9, 1, "x", "", 0)], VERSIONS)
    assert [r["version"] for r in point_in_time(asks, versions.limit(0), features=["feature"]).collect()] == [None]
    assert point_in_time(asks.limit(0), versions).count() == 0
    a, b = point_in_time(asks, versions.limit(0), features=["feature"]), point_in_time(asks, versions, features=["feature"])
    assert a.schema.simpleString() == b.schema.simpleString()


def test_nodes_cover_each_second_once(spark):
    rng = random.Random(4)
    spans = [(lo, lo + rng.randint(1, 127)) for lo in (rng.randint(-200, 200) for _ in range(300))]
    df = spark.createDataFrame(spans, "lo long, hi long")
    for lo, hi, nodes in df.select("lo", "hi", canonical_nodes(F.col("lo"), F.col("hi"), 6)).collect():
        covered = sorted(s for x in nodes if x for s in range(x["n"] << x["l"], (x["n"] + 1) << x["l"]))
        assert covered == list(range(lo, hi))
        assert sum(x is not None for x in nodes) <= 2 * (hi - lo).bit_length()


def test_query_by_brute_force_over_one_hot_source(spark, tmp_path):
    """Rows repeated, ids null, a source null, labels without a document."""
    docs = spark.range(300).select(
        F.when(F.col("id") != 7, F.col("id")).alias("doc_id"), F.lit("text").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 50 != 3, "s").alias("source"), F.lit(4).cast("long").alias("n_chars")
    )
    docs.unionAll(docs.limit(40)).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.range(0, 320).select(F.when(F.col("id") != 9, F.col("id")).alias("doc_id"), F.lit(1).alias("quality"))
    labels.unionAll(labels.limit(10)).write.parquet(f"{tmp_path}/labels.parquet")
    found = queries.op12_point_in_time(spark, str(tmp_path)).collect()
    assert len(found) == 330 and {r["status"] for r in found} >= {"none", "fresh"}
    expected = {(r["doc_id"], r["version_id"], r["status"]) for r in rows(queries.OP12_SQL, str(tmp_path))}
    assert {(r["doc_id"], r["version_id"], r["status"]) for r in found} == expected
