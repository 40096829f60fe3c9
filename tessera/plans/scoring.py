"""Queries of answer evaluation, gates and run tables, with their SQL.

Golden items, outputs and training runs are derived from documents and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import evaluate, ranges
from tessera.session import cut, table

TAXONOMY = ["brief", "clean", "long", "plain", "rare"]
#: combinations are written in order, joined by ', '
CHOICES = sorted({", ".join(x for x in TAXONOMY if x in c) for c in (["brief"], ["brief", "clean"], ["clean"], ["clean", "long"], ["long"], ["long", "plain"], ["plain"], ["brief", "plain"])} | {evaluate.REFUSE})


def _expected(quality: str = "quality", n: str = "n_chars") -> Column:
    return F.when(F.col("toxic") == 1, evaluate.REFUSE).when((F.col(quality) == 1) & (F.col(n) > 2500), "clean, long").when(F.col(quality) == 1, "clean").when(F.col(n) > 2500, "long").otherwise("brief")


def _golden(spark, sf) -> DataFrame:
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = d.join(labels, "doc_id")
    slices = F.array(F.concat(F.lit("lang:"), F.col("lang")), F.when(F.col("n_chars") > 2500, "size:large").otherwise("size:small"), F.lit("all"))
    return rows.select(F.col("doc_id").alias("id"), _expected().alias("expected"), F.array(*map(F.lit, CHOICES)).alias("choices"), slices.alias("slices"), F.col("source").alias("group_id"), "text")


_GOLDEN = """
g AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'REFUSE' WHEN quality = 1 AND n_chars > 2500 THEN 'clean, long' WHEN quality = 1 THEN 'clean' WHEN n_chars > 2500 THEN 'long' ELSE 'brief' END AS expected,
             ['lang:' || lang, CASE WHEN n_chars > 2500 THEN 'size:large' ELSE 'size:small' END, 'all'] AS slices
      FROM documents JOIN labels USING (doc_id))
"""


def _outputs(golden: DataFrame, seed: int) -> DataFrame:
    """Answers of a model that is right, wrong, out of form, or fails, by the id."""
    k = (F.col("id") / 2 + seed).cast("long") % 11
    answer = F.when(k < 5, F.col("expected")).when(k == 5, "long, plain").when(k == 6, "clean").when(k == 7, "plain, long").otherwise("brief, plain")
    quoted = F.concat(F.lit('{"answer": "'), answer, F.lit('"}'))
    raw = F.when(k == 8, F.concat(F.lit('{"answer": "brief", '), F.substring(quoted, 2, 999))).when(k == 9, answer).otherwise(quoted)
    return golden.select("id", F.when(k != 10, raw).alias("raw"), F.when(k == 10, "timeout").alias("error"))


def _outputs_sql(name: str, seed: int, source: str = "g") -> str:
    return f"""
k_{name} AS (SELECT *, (id // 2 + {seed}) % 11 AS k FROM {source}),
a_{name} AS (SELECT *, CASE WHEN k < 5 THEN expected WHEN k = 5 THEN 'long, plain' WHEN k = 6 THEN 'clean' WHEN k = 7 THEN 'plain, long' ELSE 'brief, plain' END AS answer FROM k_{name}),
v_{name} AS (SELECT id, expected, slices, k = 10 AS failed, CASE WHEN k < 8 THEN answer END AS parsed, k < 8 AND k <> 7 AND list_contains([{", ".join(f"'{c}'" for c in CHOICES)}], answer) AS valid FROM a_{name}),
l_{name} AS (SELECT *, CASE WHEN expected = 'REFUSE' THEN [] ELSE string_split(expected, ', ') END AS e, CASE WHEN NOT valid OR parsed = 'REFUSE' THEN [] ELSE string_split(parsed, ', ') END AS p FROM v_{name}),
{name} AS (SELECT *, valid AND parsed = expected AS correct, len(list_intersect(e, p)) AS tp, len(p) - len(list_intersect(e, p)) AS fp, len(e) - len(list_intersect(e, p)) AS fn, len(e) AS support FROM l_{name})
"""


def _scores(spark, sf, seed: int) -> DataFrame:
    golden = _golden(spark, sf)
    return cut(evaluate.score_items(golden.drop("text", "group_id"), _outputs(golden, seed)))


def _labels(spark) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ["brief", "clean", "long", "plain"]], "label string")


def score_items(spark, sf):
    return _scores(spark, sf, 0).select("id", "parsed", "valid", "correct", "tp", "fp", "fn", "support")


SCORE_ITEMS = f"WITH {_GOLDEN}, {_outputs_sql('s', 0)} SELECT id, parsed, valid, correct, tp, fp, fn, support FROM s"
_METRICS = ["n", "correct", "valid", "errors", "tp", "fp", "fn", "support"]
_SHARES = ["accuracy", "format_rate", "micro_f1", "macro_f1"]


def score_overall(spark, sf):
    return evaluate.metrics(_scores(spark, sf, 0), _labels(spark)).select(*_METRICS, *[F.round(c, 6).alias(c) for c in _SHARES])


def _per_label_sql(name: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    source = f"(SELECT *, unnest(slices) AS slice FROM {name})" if keys else name
    return f"""
SELECT {k}label, count(*) FILTER (ie AND ip) AS tp, count(*) FILTER (NOT ie AND ip) AS fp, count(*) FILTER (ie AND NOT ip) AS fn, count(*) FILTER (ie) AS support
FROM (SELECT {k}label, list_contains(e, label) AS ie, list_contains(p, label) AS ip FROM {source}, (VALUES ('brief'), ('clean'), ('long'), ('plain')) t(label)) GROUP BY ALL
"""


def _metrics_sql(name: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    source = f"(SELECT *, unnest(slices) AS slice FROM {name})" if keys else name
    group = f"GROUP BY {keys}" if keys else ""
    join = f"USING ({keys})" if keys else "ON true"
    return f"""
SELECT {k}n, correct, valid, errors, tp, fp, fn, support, round(correct / n, 6) AS accuracy, round(valid / n, 6) AS format_rate, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS micro_f1, round(macro, 6) AS macro_f1
FROM (SELECT {k}count(*) AS n, count(*) FILTER (correct) AS correct, count(*) FILTER (valid) AS valid, count(*) FILTER (failed) AS errors, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(support) AS support FROM {source} {group}) a
JOIN (SELECT {k}avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS macro FROM ({_per_label_sql(name, keys)}) {group}) b {join}
"""


SCORE_OVERALL = f"WITH {_GOLDEN}, {_outputs_sql('s', 0)} {_metrics_sql('s')}"


def score_slices(spark, sf):
    return evaluate.by_slice(_scores(spark, sf, 0), _labels(spark)).select("slice", *_METRICS, *[F.round(c, 6).alias(c) for c in _SHARES])


SCORE_SLICES = f"WITH {_GOLDEN}, {_outputs_sql('s', 0)} {_metrics_sql('s', 'slice')}"


def score_per_label(spark, sf):
    return evaluate.per_label(_scores(spark, sf, 0), _labels(spark)).select("label", "tp", "fp", "fn", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


SCORE_PER_LABEL = f"""
WITH {_GOLDEN}, {_outputs_sql('s', 0)}
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM ({_per_label_sql('s')})
"""


def answer_diff(spark, sf):
    return evaluate.answer_diff(_scores(spark, sf, 0), _scores(spark, sf, 3))


ANSWER_DIFF = f"""
WITH {_GOLDEN}, {_outputs_sql('s', 0)}, {_outputs_sql('c', 3)}
SELECT s.id, CASE WHEN c.correct THEN 'improved' ELSE 'regressed' END AS change FROM s JOIN c USING (id) WHERE s.correct <> c.correct
"""


def outputs_match(spark, sf):
    """Ids that only one side has, outputs lacking every thirteenth and having some of their own."""
    golden = _golden(spark, sf).select("id")
    outputs = golden.where("id % 13 <> 0").unionAll(golden.where("id % 17 = 0").select((F.col("id") + 10_000_000).alias("id")))
    return evaluate.unmatched(golden, outputs)


OUTPUTS_MATCH = f"WITH {_GOLDEN} SELECT id, 'golden' AS side FROM g WHERE id % 13 = 0 UNION ALL SELECT id + 10000000, 'output' FROM g WHERE id % 17 = 0"


def _behavioral(golden: DataFrame) -> DataFrame:
    """Cases of a set of their own, each paired with the golden item that it asks again in another form."""
    kind = F.when(F.col("id") % 3 == 0, "format").when(F.col("id") % 3 == 1, "paraphrase").otherwise("joke")
    rows = golden.where("id % 20 = 0").select((F.col("id") + 1_000_000).alias("id"), "group_id", F.concat(F.lit("again: "), "text").alias("input"), "expected", "choices", "slices")
    return rows.withColumn("type", kind).withColumn("paired_with", (F.col("id") - 1_000_000).cast("string"))


def quality_gate(spark, sf):
    """Why the candidate of seed 3 may not replace the baseline of seed 0."""
    labels = _labels(spark)
    models = {"baseline": _scores(spark, sf, 0), "candidate": _scores(spark, sf, 3)}
    overall = [evaluate.metrics(s, labels).withColumn("model", F.lit(m)) for m, s in models.items()]
    slices = [evaluate.by_slice(s, labels).withColumn("model", F.lit(m)) for m, s in models.items()]
    cases = _behavioral(_golden(spark, sf))
    behavioral = evaluate.metrics(cut(evaluate.score_items(cases.select("id", "expected", "choices", "slices"), _outputs(cases, 3))), labels)
    return evaluate.gate(overall[0].unionByName(overall[1]), slices[0].unionByName(slices[1]), behavioral, ["lang:en", "size:large", "lang:xx"])


QUALITY_GATE = f"""
WITH {_GOLDEN}, gb AS (SELECT id + 1000000 AS id, expected, slices FROM g WHERE id % 20 = 0), {_outputs_sql('s', 0)}, {_outputs_sql('c', 3)}, {_outputs_sql('bc', 3, 'gb')}, mb AS ({_metrics_sql('s')}), mc AS ({_metrics_sql('c')}), sb AS ({_metrics_sql('s', 'slice')}), sc AS ({_metrics_sql('c', 'slice')}),
bh AS (SELECT count(*) AS n, count(*) FILTER (correct) AS correct, count(*) FILTER (valid) AS valid, count(*) FILTER (failed) AS errors FROM bc)
SELECT 'overall: ' || m || ' fell' AS reason FROM (SELECT unnest(['accuracy', 'format_rate', 'micro_f1', 'macro_f1']) AS m, unnest([mc.accuracy < mb.accuracy, mc.format_rate < mb.format_rate, mc.micro_f1 < mb.micro_f1, mc.macro_f1 < mb.macro_f1]) AS bad FROM mb, mc) WHERE bad
UNION ALL SELECT 'slice ' || slice || ': ' || m || ' fell' FROM (SELECT slice, unnest(['accuracy', 'micro_f1']) AS m, unnest([NOT coalesce(sc.accuracy >= sb.accuracy, false), NOT coalesce(sc.micro_f1 >= sb.micro_f1, false)]) AS bad FROM (VALUES ('lang:en'), ('size:large'), ('lang:xx')) q(slice) LEFT JOIN sb USING (slice) LEFT JOIN sc USING (slice)) WHERE bad
UNION ALL SELECT 'baseline: generation errors' FROM mb WHERE errors > 0 UNION ALL SELECT 'candidate: generation errors' FROM mc WHERE errors > 0
UNION ALL SELECT 'baseline: fewer than 50 items' FROM mb WHERE n < 50 UNION ALL SELECT 'candidate: fewer than 50 items' FROM mc WHERE n < 50
UNION ALL SELECT 'baseline: fewer than 3 slices' FROM (SELECT count(*) AS k FROM sb) WHERE k < 3 UNION ALL SELECT 'candidate: fewer than 3 slices' FROM (SELECT count(*) AS k FROM sc) WHERE k < 3
UNION ALL SELECT 'behavioral cases not all passed' FROM bh WHERE n < 3 OR correct <> n OR valid <> n OR errors > 0
"""


def golden_contract(spark, sf):
    golden = _golden(spark, sf).withColumn("input", F.col("text"))
    behavioral = _behavioral(golden)
    training = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select(F.col("text").alias("input"), F.concat(F.col("source"), F.lit("-t")).alias("group_id"))
    as_text = lambda df: df.withColumn("id", F.col("id").cast("string"))
    return evaluate.golden_contract(as_text(golden), as_text(behavioral), training, lambda c: F.lower(text.squeeze(c)))


GOLDEN_CONTRACT = r"""
WITH g AS (SELECT doc_id AS id, source AS grp, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS k FROM documents JOIN labels USING (doc_id)),
b AS (SELECT id + 1000000 AS id, grp, lower('again: ') || k AS k FROM g WHERE id % 20 = 0), t AS (SELECT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
r AS (
SELECT 'fewer than 50 golden items' AS reason, (SELECT count(*) FROM g) AS items, (SELECT count(*) FROM g) < 50 AS bad
UNION ALL SELECT 'a kind of behavioral case is missing', (SELECT count(DISTINCT CASE WHEN id % 3 IN (0, 1) THEN id % 3 END) FROM b), true
UNION ALL SELECT 'unknown kind of behavioral case', (SELECT count(*) FROM b WHERE id % 3 = 2), (SELECT count(*) FROM b WHERE id % 3 = 2) > 0
UNION ALL SELECT 'repeated golden inputs', (SELECT count(*) FROM (SELECT k FROM g GROUP BY k HAVING count(*) > 1)), (SELECT count(*) FROM (SELECT k FROM g GROUP BY k HAVING count(*) > 1)) > 0
UNION ALL SELECT 'inputs or groups shared with training', (SELECT count(DISTINCT id) FROM (SELECT id, k FROM g UNION ALL SELECT id, k FROM b) WHERE k IN (SELECT k FROM t)), (SELECT count(*) FROM (SELECT id, k FROM g UNION ALL SELECT id, k FROM b) WHERE k IN (SELECT k FROM t)) > 0)
SELECT reason, items FROM r WHERE bad
"""


def _runs(spark, sf) -> DataFrame:
    """A sweep: one run per supplier, with losses from its balance."""
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("run_id"), (F.col("s_suppkey") % 6).alias("config"), F.lit(2.5).alias("base_loss"), (F.abs("s_acctbal") % 997 / 400).alias("final_loss"))


def best_run(spark, sf):
    """The best finished run of each configuration, the smallest id of equal ones, where its loss ratio is low enough."""
    r = _runs(spark, sf).where(F.col("final_loss") / F.col("base_loss") <= 0.9)
    return r.groupBy("config").agg(F.min(F.struct(F.round("final_loss", 6).alias("final_loss"), "run_id")).alias("b")).select("config", "b.final_loss", "b.run_id")


BEST_RUN = """
WITH r AS (SELECT s_suppkey AS run_id, s_suppkey % 6 AS config, round(abs(s_acctbal) % 997 / 400, 6) AS final_loss, abs(s_acctbal) % 997 / 400 / 2.5 AS ratio FROM supplier)
SELECT config, final_loss, run_id FROM r WHERE ratio <= 0.9 QUALIFY row_number() OVER (PARTITION BY config ORDER BY final_loss, run_id) = 1
"""


def sweep_gate(spark, sf):
    """Why the sweep is no fair comparison: more than one run per configuration, unequal base losses."""
    r = _runs(spark, sf)
    by = r.groupBy("config").agg(F.count("*").alias("k"), (F.max("base_loss") - F.min("base_loss")).alias("gap"))
    return by.select("config", F.explode(F.filter(F.array(F.when(F.col("k") != 1, F.lit("more than one run")), F.when(F.col("gap") > 1e-6, F.lit("unequal base losses"))), lambda x: x.isNotNull())).alias("reason"))


SWEEP_GATE = "SELECT s_suppkey % 6 AS config, 'more than one run' AS reason FROM supplier GROUP BY 1 HAVING count(*) <> 1"


def weighted_loss(spark, sf):
    """Mean loss by tokens: sum(loss * tokens) / sum(tokens)."""
    d = table(spark, sf, "documents").select("lang", ((F.col("doc_id") % 100) / 25.0).alias("loss"), (F.length("text") % 50 + 1).alias("tokens"))
    return d.groupBy("lang").agg(F.round(F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens"), 6).alias("loss"), F.sum("tokens").alias("tokens"))


WEIGHTED_LOSS = "SELECT lang, round(sum((doc_id % 100) / 25.0 * (length(text) % 50 + 1)) / sum(length(text) % 50 + 1), 6) AS loss, sum(length(text) % 50 + 1) AS tokens FROM documents GROUP BY lang"


def loss_curves(spark, sf):
    """Per user a curve of values: steps that do not rise, and means of its first and last fifth."""
    placed = ranges.ranged(table(spark, sf, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"])
    seen = ranges.carried(placed, ["user_id"], ["ts", "event_id"], previous={"before": F.col("event_id")}, total={"i": F.lit(1)})
    lengths = placed.groupBy("user_id").agg(F.count("*").alias("n"))
    rows = seen.join(lengths, "user_id").select("user_id", "value", (F.col("event_id") - F.col("before")).alias("step"), "i", "n")
    fifth = F.greatest(F.lit(1), F.floor(F.col("n") / 5))
    return rows.groupBy("user_id").agg(F.count_if(F.col("step") <= 0).alias("not_rising"), F.round(F.avg(F.when(F.col("i") <= fifth, F.col("value"))), 6).alias("head"), F.round(F.avg(F.when(F.col("i") > F.col("n") - fifth, F.col("value"))), 6).alias("tail"))


LOSS_CURVES = """
WITH r AS (SELECT user_id, value, event_id - lag(event_id) OVER w AS step, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) FILTER (step <= 0) AS not_rising, round(avg(value) FILTER (i <= greatest(1, n // 5)), 6) AS head, round(avg(value) FILTER (i > n - greatest(1, n // 5)), 6) AS tail FROM r GROUP BY user_id
"""


def parameter_table(spark, sf):
    """Parameters by kind of module with their share, and those of low-rank adapters r (in + out), over parts as modules."""
    p = table(spark, sf, "part").select(F.regexp_extract("p_type", r"(\w+)$", 1).alias("kind"), (F.col("p_size") * 64).cast("long").alias("rows"), (F.col("p_partkey") % 7 * 32 + 32).cast("long").alias("cols"))
    total = F.sum(F.sum(F.col("rows") * F.col("cols"))).over(Window.partitionBy())
    return p.groupBy("kind").agg(F.count("*").alias("modules"), F.sum(F.col("rows") * F.col("cols")).alias("parameters"), F.sum(8 * (F.col("rows") + F.col("cols"))).alias("adapter"), F.round(F.sum(F.col("rows") * F.col("cols")) / total, 6).alias("share"))


PARAMETER_TABLE = r"""
WITH p AS (SELECT regexp_extract(p_type, '(\w+)$', 1) AS kind, CAST(p_size * 64 AS BIGINT) AS r, CAST(p_partkey % 7 * 32 + 32 AS BIGINT) AS c FROM part)
SELECT kind, count(*) AS modules, sum(r * c) AS parameters, sum(8 * (r + c)) AS adapter, round(sum(r * c) / (SELECT sum(r * c) FROM p), 6) AS share FROM p GROUP BY kind
"""


def consumption(spark, sf):
    """What training consumed: rows by language and label count, unique and total."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    seen = d.select("doc_id", "lang", (F.col("quality") + F.col("toxic")).alias("labels"), F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("epoch"))
    return seen.groupBy("lang", "labels").agg(F.count("*").alias("total"), F.count_distinct("doc_id").alias("unique_rows"))


CONSUMPTION = "SELECT lang, quality + toxic AS labels, sum(doc_id % 3 + 1) AS total, count(*) AS unique_rows FROM documents JOIN labels USING (doc_id) GROUP BY ALL"


def train_time(spark, sf):
    """Hours of three epochs at a measured speed, and optimiser steps by ceiling division."""
    tokens = F.sum(F.size(F.split("text", " ")))
    return table(spark, sf, "documents").agg(tokens.alias("tokens"), F.round(tokens * 3 / 42.69 / 3600, 6).alias("hours"), (F.ceil(F.count("*") / 8) * 3).cast("long").alias("steps"))


TRAIN_TIME = "SELECT sum(len(string_split(text, ' '))) AS tokens, round(sum(len(string_split(text, ' '))) * 3 / 42.69 / 3600, 6) AS hours, CAST(ceil(count(*) / 8) * 3 AS BIGINT) AS steps FROM documents"

QUERIES = {
    "score_items": score_items, "score_overall": score_overall, "score_slices": score_slices, "score_per_label": score_per_label, "answer_diff": answer_diff, "outputs_match": outputs_match,
    "quality_gate": quality_gate, "golden_contract": golden_contract, "best_run": best_run, "sweep_gate": sweep_gate, "weighted_loss": weighted_loss, "loss_curves": loss_curves,
    "parameter_table": parameter_table, "consumption": consumption, "train_time": train_time,
}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
