"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules are fixed.  On top of them, four rules reject a document whose share of
something (in thousandths) exceeds a cutoff, chosen per stratum from labelled
holdouts.  For a stratum with n good documents (label 1, not failed by the base
rules) of which a cutoff rejects k, the exact binomial tail P(Bin(n, a) <= k) is the
p-value of "this cutoff falsely rejects a share of a or more".  Cutoffs are tested
from the most lenient on and testing stops at the first that is not significant
(fixed sequence, no further correction within a rule); the level is delta divided by
the number of strata and rules (Bonferroni), and a is the allowed share divided by
the number of rules.  So with probability 1 - delta no stratum loses more than
``max_false_rejection`` of its good documents to these rules.  Among the certified
cutoffs the one that rejects most bad less good holdouts is taken, the most lenient
of equals; where none is certified, or none gains, the rule is off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, let, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: cutoffs in thousandths, ascending
GRID = (10, 20, 30, 40, 50, 60, 80, 100, 120, 150, 200, 250, 300, 400, 500, 700, 900)
#: rule -> (count, of)
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
}
MAX_FALSE_REJECTION = 0.02
DELTA = 0.1
#: more strata than this are joined instead of broadcast
BROADCAST_STRATA = 10_000


def _repeat_words(w: Column) -> Column:
    """Words in windows of 8 that occur twice or more in the words ``w``; n log n in their number."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 7), lambda i: F.xxhash64(F.slice(w, i, F.lit(8))))

    def twice(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(p: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
            at = F.sort_array(F.transform(F.filter(p, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda s, i: F.struct((i + 8).alias("end"), (s["n"] + i + 8 - F.greatest(i, s["end"])).alias("n"))
            return F.aggregate(at, start, step, lambda s: s["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(placed, covered))

    return F.when(F.size(w) < 9, 0).otherwise(let(hashes, twice))


def measures(text: Column) -> Column:
    """A struct of whole-text counts, all long: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals.

    A null text has none of anything.  Windows are compared by 64-bit hash."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x)).alias("chars"), _repeat_words(w).alias("repeat")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    whole = let(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda s: F.struct(
            s["w"]["n"].cast("long").alias("n_words"),
            s["w"]["chars"].cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            s["l"]["n"].cast("long").alias("n_lines"),
            s["l"]["dup"].cast("long").alias("n_dup_lines"),
            s["w"]["repeat"].cast("long").alias("n_repeat_words"),
            F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        ),
    )
    return whole


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def _tail(k: Column, n: Column, a: float) -> Column:
    """ln P(Bin(n, a) <= k) for k < a n, summed in logarithms."""
    first = n * F.log1p(F.lit(-a))
    odds = F.log(F.lit(a / (1 - a)))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] + F.log((n - j + 1) / j) + odds
        high = F.greatest(term, s["sum"])
        return F.struct(term.alias("term"), (high + F.log(F.exp(term - high) + F.exp(s["sum"] - high))).alias("sum"))

    more = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), F.struct(first.alias("term"), first.alias("sum")), step, lambda s: s["sum"])
    return F.when(k == 0, first).otherwise(more)


def thresholds(measured: DataFrame, labels: DataFrame, *, grid=GRID, max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """``(stratum, symbols, dup_lines, repeats, capitals)``: the cutoffs in thousandths, null where a rule is off.

    ``measured(id, stratum, m)``; ``labels(id, quality)`` with quality 1 good, 0 bad, others and null unused.

    The bound is for independent draws, so an id is one draw, however often its label or its row is repeated.  An id with labels of both kinds
    is none, and neither is one whose rows differ in stratum or measures, as the label doesn't say which of them it is for."""
    agreed = labels.where("id IS NOT NULL AND quality IN (0, 1)").groupBy("id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    row = F.struct("stratum", "m")
    drawn = measured.join(agreed, "id").groupBy("id", "quality").agg(F.min(row).alias("row"), F.max(row).alias("other")).where("row = other")
    known = (
        drawn.select("quality", "row.*")
        .where(~base_failed(F.col("m")))
        .select("stratum", "quality", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _passed(grid, F.col("m")[a], F.col("m")[b]).alias("passed")) for r, (a, b) in RULES.items()])).alias("r"))
        .groupBy("stratum", "quality", "r.rule", "r.passed")
        .count()
    )
    cells = known.groupBy("stratum", "rule").agg(
        F.sum(F.when(F.col("quality") == 1, F.col("count")).otherwise(0)).alias("n"),
        F.collect_list(F.struct("quality", "passed", "count")).alias("counts"),  # at most 2 x (cutoffs + 1) entries
    )
    from_cutoff = lambda q: lambda j: F.aggregate(F.filter("counts", lambda c: (c["quality"] == q) & (c["passed"] >= j)), F.lit(0).cast("long"), lambda s, c: s + c["count"])
    tried = cells.select("stratum", "rule", "n", F.posexplode(F.array(*map(F.lit, grid))).alias("j", "cutoff"), "counts").select(
        "stratum", "rule", "n", "cutoff", from_cutoff(1)(F.col("j") + 1).alias("k"), from_cutoff(0)(F.col("j") + 1).alias("bad")
    )
    a = max_false_rejection / len(RULES)
    strata = measured.sparkSession.range(1).select(F.lit(0).alias("_")).crossJoin(cells.agg(F.greatest(F.count_distinct("stratum"), F.lit(1)).alias("strata")))
    certified = (
        tried.join(F.broadcast(strata), F.lit(True))  # one row
        .where(F.when(F.col("k") < F.col("n") * a, _tail(F.col("k"), F.col("n"), a) <= F.log(F.lit(delta / len(RULES)) / F.col("strata"))).otherwise(False))
        .where("bad > k")
    )
    best = certified.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(F.col("bad") - F.col("k"), "cutoff")).alias("cutoff"))
    return best.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))


def _passed(grid, count: Column, of: Column) -> Column:
    """How many cutoffs a document exceeds."""
    return sum((F.when(1000 * count > c * of, 1).otherwise(0) for c in grid), F.lit(0))


def stratum(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(""))


def _kept(m: Column) -> Column:
    """The verdict on measures ``m``, next to the columns of cutoffs."""
    fails = [F.coalesce(1000 * m[a] > F.col(r) * m[b], F.lit(False)) for r, (a, b) in RULES.items()]
    return ~(base_failed(m) | fails[0] | fails[1] | fails[2] | fails[3])


def _with_cutoffs(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    c = cut(cutoffs.withColumnRenamed("stratum", "__stratum"))
    small = c.count() <= BROADCAST_STRATA
    return rows.join(F.broadcast(c) if small else c, F.col("stratum") == F.col("__stratum"), "left")


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: ``(doc_id, m, base_failed, kept)``; repeated rows and null ids are judged like any other.

    Rows of ``labels`` without a document, and the reverse, have no part in the
    thresholds; repeated labels count once, contradictory ones not at all; without labels only the base rules hold."""
    measured = cut(docs.select(F.col("doc_id").alias("id"), stratum(F.col("lang")).alias("stratum"), measures(F.col("text")).alias("m")))
    cutoffs = thresholds(measured, labels.select(F.col("doc_id").alias("id"), "quality"), **options)
    return _with_cutoffs(measured, cutoffs).select(F.col("id").alias("doc_id"), "m", base_failed(F.col("m")).alias("base_failed"), _kept(F.col("m")).alias("kept"))


def rejected_removed(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that the rules reject; all columns stay.

    Rows are written once with their measures; the thresholds read the measures alone."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    row = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    rows = written(docs.select(row.alias("row"), F.col("doc_id").alias("id"), stratum(F.col("lang")).alias("stratum"), measures(F.col("text")).alias("m")))
    cutoffs = thresholds(rows.select("id", "stratum", "m"), labels.select(F.col("doc_id").alias("id"), "quality"), **options)
    return _with_cutoffs(rows, cutoffs).where(_kept(F.col("m"))).select(*[F.col(f"row.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True)])
