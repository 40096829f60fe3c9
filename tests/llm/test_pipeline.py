from collections import defaultdict

import corpus_pipeline
from tessera.llm import classifier, queries
from tessera.llm.common import table

from .duck import rows
from .test_near_copies import plain_components

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF)
        if name != "packing":
            assert result.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        result.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = docs.collect()
    ids = {n: {r["doc_id"] for r in x} for n, x in out.items()}
    assert ids["quality_rules"] == {r["doc_id"] for r in rows(queries.ORACLE_SQL["op2_quality_rules"], SF) if r["kept"]}
    labels = table(spark, SF, "labels")
    kept = spark.read.parquet(str(tmp_path / "quality_rules"))
    scores = {r["doc_id"]: r["predicted"] for r in classifier.quality_scores(kept, labels).collect()}
    assert ids["quality_classifier"] == {k for k, p in scores.items() if p == 1}
    assert ids["simhash_dedup"] == set(plain_components([(r["doc_id"], r["text"]) for r in out["quality_classifier"]]))
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    assert all(r["text"] == texts[r["doc_id"]] for n in list(out)[:3] for r in out[n])
    pieces = defaultdict(int)
    for r in out["packing"]:
        pieces[r["doc_id"]] += r["length"]
        assert len(r["ids"]) == 4 * r["length"]
    assert set(pieces) == ids["simhash_dedup"]
    assert all(pieces[r["doc_id"]] == r["doc_tokens"] for r in out["packing"])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


EDGES = "doc_id long, text string, lang string, source string, n_chars long, cls long, h long, component_id string, c0 string"


def test_stages_over_edges(spark, tmp_path):
    """Nulls in all columns, repeated rows and ids, empty and long texts, clashing columns; then no rows at all."""
    words = [f"word{i}" for i in range(400)]
    text = lambda k, n=60: " ".join(words[(7 * k + i * (k % 5 + 1)) % 400] for i in range(n))
    rows = [(i, text(i), "en" if i % 2 else None, None, 5) for i in range(60)]
    rows += [(3, text(3), "en", "s", None), (3, text(90), "en", "s", 1), (None, text(91), None, None, None), (None, text(91), None, None, None), (None, None, None, None, None), (70, None, "en", "s", 0), (71, "", "en", "s", 0)]
    rows += [(80, text(5) + " more", "de", "s", 1), (81, " ".join(f"a{i}" for i in range(60_000)), "de", "s", 1)]
    docs = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], EDGES)
    labels = spark.createDataFrame([(i, i % 2, 0, "clash") for i in range(40)] + [(None, 1, 0, ""), (5, None, None, "")], "doc_id long, quality int, toxic int, text string")
    labels.write.parquet(f"{tmp_path}/sf/labels.parquet")
    for name, frame in (("rows", docs), ("none", docs.limit(0))):
        kept = frame
        for stage, of in corpus_pipeline.STAGES:
            before = kept
            result = of(spark, kept, f"{tmp_path}/sf")
            result.write.parquet(f"{tmp_path}/{name}/{stage}")
            kept = spark.read.parquet(f"{tmp_path}/{name}/{stage}")
            if stage != "packing":
                assert kept.columns == docs.columns
                assert kept.exceptAll(before).isEmpty()
        assert (kept.count() > 0) == (name == "rows")
    rules = spark.read.parquet(f"{tmp_path}/rows/quality_rules").collect()
    assert {r["doc_id"] for r in rules} >= {3, None, 80} and all(r["text"] for r in rules)
    near = spark.read.parquet(f"{tmp_path}/rows/simhash_dedup").collect()
    scored = spark.read.parquet(f"{tmp_path}/rows/quality_classifier").collect()
    known = [(r["doc_id"], r["text"]) for r in scored if r["doc_id"] not in (3, None)]
    if not any(r["doc_id"] in (3, None) for r in scored):
        assert sorted(r["doc_id"] for r in near) == sorted(set(plain_components(known)))
    assert sum(r["doc_id"] is None for r in near) == sum(r["doc_id"] is None for r in scored)
