import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm.fill_in_middle import DELIMITER, ESCAPE, fill_in_middle, restored

from .duck import rows, same

SF = "/root/testdata/sf0.01"


def plain(key, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return (len(units), "plain", text, None, None)
    if h4 % 100 < 20:
        return (len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m))
    return (len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


def test_query_matches_sql(spark):
    assert same(queries.op13_fill_in_middle(spark, SF).collect(), rows(queries.OP13_SQL, SF))


def check(spark, texts):
    keys = list(range(len(texts)))
    df = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in zip(keys, texts, strict=True)], "doc_id long, text string, form string, n int, output string")
    made = fill_in_middle(df, seed=3).withColumn("back", restored(F.col("output"), F.col("form")))
    for r in made.collect():
        k = r["doc_id"]
        assert tuple(r)[1:6] == plain(k, texts[k], 3)
        assert r["back"] == (texts[k] or "")


def test_brute_force(spark):
    rng = random.Random(2)
    parts = ["a", "Bc", "z9", DELIMITER, ESCAPE, ESCAPE + "0", ESCAPE + "1", "é", "😀", "\n", "\r", "\0", " ", "<", ">", "<P", "S>", "<S", "$1", "\\", "ﬀ", " "]
    texts = [None, "", "a", DELIMITER, ESCAPE, "<P>", "x<M>y", "ab" * 200_000, "é" * 100_000, (DELIMITER + ESCAPE) * 5_000]
    check(spark, texts + ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(1500)])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=30, max_size=60))
def test_any_text(spark, texts):
    check(spark, texts)


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, "some text"), (5, "twice"), (5, "twice"), (6, None)], "doc_id long, text string")
    found = sorted(map(tuple, fill_in_middle(df).collect()), key=str)
    assert found == sorted([(k, *plain(k, t)) for k, t in [(None, "some text"), (5, "twice"), (5, "twice"), (6, None)]], key=str)
    assert fill_in_middle(df.limit(0)).count() == 0
    assert {r["form"] for r in fill_in_middle(df.where("text IS NOT NULL"), plain_percent=0, spm_percent=100).collect()} == {"spm"}


def test_plan_has_no_shuffle_and_no_python(spark):
    plan = fill_in_middle(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
