"""Queries of the curation pipeline over documents, conversations and benchmark, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ident, stats, text
from tessera.operators import dedup, quality, sampling, split
from tessera.operators.similarity_index import SimilarityIndex
from tessera.session import cut, own_folder, spread, table

THRESHOLD = 0.85
BENCHMARK_SHARE = 0.5
VARIANTS = ["Answer briefly.", "Answer with the label only.", "Name the label.", "Label the text.", "Give one label.", "Choose a label.", "State the label."]
RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}
EXCLUDED_LABELS = ["es"]
ALIASES = {"en": "english", "de": "german", "fr": "french"}

# the SQL counterpart of functions.text.normalize_text
_NORM = "lower(trim(regexp_replace(translate({0}, '—–‑' || chr(160), '--- '), '\\s+', ' ', 'g')))"
_WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')"


def norm(column: str) -> str:
    return _NORM.format(column)


def sql_words(column: str) -> str:
    return _WORDS.format(column)


def sql_shingles(w: str, k: int = 4) -> str:
    return f"CASE WHEN len({w}) >= {k} THEN list_distinct(list_transform(range(1, len({w}) - {k - 2}), lambda i: array_to_string(list_slice({w}, i, i + {k - 1}), ' '))) WHEN len({w}) > 0 THEN [array_to_string({w}, ' ')] ELSE [] END"


_LINES = "string_split_regex(coalesce({0}, ''), '\\r\\n|[\\n\\r\\v\\f\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
_IS_OPTION = "'(?i)^\\s*(?:\\d+|[a-zа-я])\\s*[.)]\\s*(\\S.*)$'"


def canonical(name: str, source: str, key: str, text: str = "text") -> str:
    """CTEs that end in ``name(key, t)``: the texts with their lines normalised and runs of numbered options sorted."""
    lines = _LINES.format(text)
    return f"""
{name}_l AS (SELECT {key} AS key, unnest({lines}) AS line, generate_subscripts({lines}, 1) AS i FROM {source}),
{name}_o AS (SELECT key, i, line, CASE WHEN regexp_matches(line, {_IS_OPTION}) THEN regexp_extract(line, {_IS_OPTION}, 1) END AS o FROM {name}_l),
{name}_r AS (SELECT key, i, o IS NOT NULL AS numbered, {norm('coalesce(o, line)')} AS t, sum(CASE WHEN o IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY i) AS run FROM {name}_o),
{name} AS (SELECT key, coalesce(string_agg(t, chr(10) ORDER BY run, numbered, CASE WHEN numbered THEN t ELSE '' END, i) FILTER (numbered OR t <> ''), '') AS t FROM {name}_r GROUP BY key)"""


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def label_array() -> Column:
    """Labels of a document: its language, a length band, and whether its id is even."""
    band = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long")
    return F.filter(F.array(F.col("lang"), band, F.when(F.col("doc_id") % 2 == 0, "even")), lambda x: x.isNotNull())


LABELS_SQL = "list_filter([lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END, CASE WHEN doc_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)"


# -- scalar text functions


def normalize_documents(spark, sf):
    rows = docs(spark, sf).select("doc_id", text.normalize_text(F.col("text")).alias("norm"), text.normalize_group(F.concat("source", F.lit("  | "), "lang")).alias("grp"))
    return rows


NORMALIZE_DOCUMENTS = f"SELECT doc_id, {norm('text')} AS norm, {norm('source')} AS grp FROM documents"


def source_text_digests(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(text.normalize_source(F.col("text")), 256).alias("digest"))


SOURCE_TEXT_DIGESTS = r"SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(coalesce(text, '')), '\s+', ' ', 'g'))) AS digest FROM documents"


def casefold_digests(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(text.normalize_answer(F.col("text")), 256).alias("digest"))


CASEFOLD_DIGESTS = r"SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS digest FROM documents"


def option_digests(spark, sf):
    """Texts with three numbered lines in front, in two orders, one alone: digests of their canonical forms."""
    numbered = F.concat(F.lit("2) beta\n1) Alpha  x\nc. gamma\n\n7) alone\n"), F.col("text"))
    swapped = F.concat(F.lit("1. alpha x\nB) gamma\n2. Beta\n\n\n1) alone\n"), F.col("text"))
    digest = lambda t: F.sha2(text.canonical_options(t), 256)
    return docs(spark, sf).select("doc_id", digest(numbered).alias("digest"), digest(swapped).alias("swapped"))


OPTION_DIGESTS = f"""
WITH v AS (SELECT doc_id, '2) beta' || chr(10) || '1) Alpha  x' || chr(10) || 'c. gamma' || chr(10) || chr(10) || '7) alone' || chr(10) || text AS text FROM documents),
{canonical('c', 'v', 'doc_id')} SELECT key AS doc_id, sha256(t) AS digest, sha256(t) AS swapped FROM c
"""


def shingle_counts(spark, sf):
    return dedup.shingle_sets(docs(spark, sf), "doc_id", F.col("text")).select(F.col("id").alias("doc_id"), "n")


SHINGLE_COUNTS = f"WITH {canonical('c', 'documents', 'doc_id')}, w AS (SELECT key AS doc_id, {sql_words('t')} AS w FROM c) SELECT doc_id, CAST(len({sql_shingles('w')}) AS BIGINT) AS n FROM w"


def label_functions(spark, sf):
    d = docs(spark, sf).withColumn("raw", F.concat_ws(",", "lang", F.lit(" EN "), "source", F.lit("Ｅｎ —  x"), F.lit("")))
    return d.select(
        "doc_id",
        F.array_join(F.array_sort(text.label_set(F.col("raw"))), "|").alias("labels"),
        text.canonical_answer(F.concat_ws(" , ", "source", "lang", F.lit("Straße  Nr"))).alias("answer"),
        F.array_join(text.map_labels(text.label_set(F.col("raw")), ALIASES), "|").alias("mapped"),
        text.iso_date(F.format_string("2%03d-%02d-%02d", (F.col("doc_id") % 30).cast("int"), (F.col("doc_id") % 14).cast("int"), (F.col("doc_id") % 33).cast("int"))).alias("day"),
    )


LABEL_FUNCTIONS = """
SELECT doc_id,
       array_to_string(list_sort(list_distinct([lower(lang), 'en', lower(source), 'en - x'])), '|') AS labels,
       array_to_string(list_sort([lower(source), lower(lang), 'strasse  nr']), ', ') AS answer,
       array_to_string(list_sort(list_distinct(list_filter(list_transform([lang, 'en'], lambda x: CASE x WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' END), lambda x: x IS NOT NULL))), '|') AS mapped,
       try_cast(printf('2%03d-%02d-%02d', doc_id % 30, doc_id % 14, doc_id % 33) AS DATE) AS day
FROM documents
"""


def stable_ids(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", ident.stable_id("row_", F.col("c_name"), F.col("c_mktsegment")).alias("id"))


STABLE_IDS = "SELECT c_custkey, 'row_' || sha256(c_name || chr(31) || c_mktsegment) AS id FROM customer"


def prompt_pick(spark, sf):
    key = F.concat(F.lit("doc-"), F.col("doc_id"))
    return docs(spark, sf).select("doc_id", ident.pick(key, VARIANTS).alias("prompt"), ident.hex_mod(F.sha2(key, 256), 1009).alias("bucket"))


PROMPT_PICK = f"""
WITH h AS (SELECT doc_id, list_transform(string_split(sha256('doc-' || doc_id), ''), lambda x: CAST(strpos('0123456789abcdef', x) - 1 AS BIGINT)) AS d FROM documents)
SELECT doc_id, ([{", ".join(f"'{v}'" for v in VARIANTS)}])[1 + list_reduce(d, lambda a, x: (a * 16 + x) % {len(VARIANTS)})] AS prompt,
       list_reduce(d, lambda a, x: (a * 16 + x) % 1009) AS bucket
FROM h
"""


# -- filters and counts


def length_filter(spark, sf):
    n = F.length("text")
    return docs(spark, sf).where(n.between(30, 4000) & (F.length("source") >= 2)).select("doc_id", n.cast("long").alias("n"))


LENGTH_FILTER = "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE length(text) BETWEEN 30 AND 4000 AND length(source) >= 2"


def reject_reasons(spark, sf):
    """How many rows each reason hits; a row may have several, an unknown label alone drops none."""
    d = docs(spark, sf)
    day = F.format_string("2%03d-%02d-%02d", (F.col("doc_id") % 30).cast("int"), (F.col("doc_id") % 14).cast("int"), (F.col("doc_id") % 33).cast("int"))
    flags = d.select(
        (F.length(F.trim("text")) < 200).alias("without_description"),
        (F.col("n_chars") % 11 == 0).alias("without_labels"),
        text.iso_date(day).isNull().alias("invalid_date"),
        F.arrays_overlap(F.array("lang"), F.array(*map(F.lit, EXCLUDED_LABELS))).alias("wrong_type"),
        (F.size(text.map_labels(F.array("lang"), ALIASES)) == 0).alias("unknown_label"),
        (F.trim("source") == "").alias("missing_identity"),
    )
    dropping = F.col("without_description") | F.col("without_labels") | F.col("invalid_date") | F.col("wrong_type") | F.col("missing_identity")
    names = flags.columns
    one = flags.agg(*[F.count_if(c).alias(c) for c in names], F.count_if(~dropping).alias("kept"), F.count("*").alias("scanned"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("reason"), F.col(c).alias("rows")) for c in [*names, "kept", "scanned"]])).alias("r")).select("r.reason", "r.rows")


REJECT_REASONS = """
WITH f AS (
    SELECT length(trim(text)) < 200 AS without_description, n_chars % 11 = 0 AS without_labels,
           try_cast(printf('2%03d-%02d-%02d', doc_id % 30, doc_id % 14, doc_id % 33) AS DATE) IS NULL AS invalid_date,
           lang = 'es' AS wrong_type, lang NOT IN ('en', 'de', 'fr') AS unknown_label, trim(source) = '' AS missing_identity
    FROM documents
), c AS (
    SELECT count(*) FILTER (without_description) AS without_description, count(*) FILTER (without_labels) AS without_labels, count(*) FILTER (invalid_date) AS invalid_date,
           count(*) FILTER (wrong_type) AS wrong_type, count(*) FILTER (unknown_label) AS unknown_label, count(*) FILTER (missing_identity) AS missing_identity,
           count(*) FILTER (NOT (without_description OR without_labels OR invalid_date OR wrong_type OR missing_identity)) AS kept, count(*) AS scanned
    FROM f
)
UNPIVOT c ON without_description, without_labels, invalid_date, wrong_type, unknown_label, missing_identity, kept, scanned INTO NAME reason VALUE rows
"""


def pii_mask(spark, sf):
    masked, counts = text.mask_personal(F.col("text"))
    return docs(spark, sf).select("doc_id", F.sha2(masked, 256).alias("digest"), *[c.alias(k) for k, c in counts.items()])


def _pii_sql(source: str, keys: str) -> str:
    quote = lambda p: p.replace("'", "''")
    phone, email, birth = map(quote, (text.PHONE, text.EMAIL, "(?i)" + text.BIRTH_DATE))
    return f"""
WITH a AS (SELECT {keys}, text AS t0, regexp_replace(text, '{phone}', '[PHONE]', 'g') AS t1 FROM {source}),
b AS (SELECT *, regexp_replace(t1, '{email}', '[EMAIL]', 'g') AS t2 FROM a),
c AS (SELECT *, regexp_replace(t2, '{birth}', '\\1[DATE]', 'g') AS t3 FROM b),
p AS (SELECT {keys}, t3, CAST(len(regexp_extract_all(t0, '{phone}')) AS BIGINT) AS phone, CAST(len(regexp_extract_all(t1, '{email}')) AS BIGINT) AS email, CAST(len(regexp_extract_all(t2, '{birth}')) AS BIGINT) AS birth_date FROM c)
"""


PII_MASK = _pii_sql("documents", "doc_id") + "SELECT doc_id, sha256(t3) AS digest, phone, email, birth_date FROM p"


def pii_counts(spark, sf):
    """Hits by role and kind, all pairs, and the rows touched."""
    turns = table(spark, sf, "conversations")
    # an address in every fifth turn, so that there is something to find
    rows = turns.select("role", F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.concat("text", F.lit(" mail a.b@example.org"))).otherwise(F.col("text")).alias("text"))
    _, counts = text.mask_personal(F.col("text"))
    by = rows.select("role", *[c.alias(k) for k, c in counts.items()]).groupBy("role").agg(*[F.struct(F.sum(k).alias("hits"), F.count_if(F.col(k) > 0).alias("rows")).alias(k) for k in counts])
    return by.select("role", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}.hits").alias("hits"), F.col(f"{k}.rows").alias("rows")) for k in counts])).alias("x")).select("role", "x.*")


PII_COUNTS = (
    _pii_sql("(SELECT role, CASE WHEN (conv_id + turn) % 5 = 0 THEN text || ' mail a.b@example.org' ELSE text END AS text FROM conversations)", "role")
    + " ".join(["SELECT role, kind, hits, rows FROM (", " UNION ALL ".join(f"SELECT role, '{k}' AS kind, CAST(sum({k}) AS BIGINT) AS hits, count(*) FILTER ({k} > 0) AS rows FROM p GROUP BY role" for k in ("phone", "email", "birth_date")), ")"])
)


def label_histogram(spark, sf):
    """Rows with each label and their share of all rows."""
    d = docs(spark, sf).select("doc_id", label_array().alias("labels"))
    total = d.agg(F.count("*").alias("total"))
    counts = d.select(F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(F.count("*").alias("rows"))
    return counts.join(F.broadcast(total), F.lit(True)).select("label", "rows", F.round(F.col("rows") / F.col("total"), 6).alias("share"))


LABEL_HISTOGRAM = f"SELECT label, count(*) AS rows, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM (SELECT doc_id, unnest({LABELS_SQL}) AS label FROM documents) GROUP BY label"


def frequent_labels(spark, sf):
    """Documents with the labels of at least 150 documents; without one they go."""
    d = cut(docs(spark, sf).select("doc_id", F.explode(F.array_distinct(label_array())).alias("label")))
    common = d.groupBy("label").agg(F.count("*").alias("c")).where("c >= 150").select("label")
    return d.join(common, "label").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("label")), "|").alias("labels"))


FREQUENT_LABELS = f"""
WITH e AS (SELECT doc_id, unnest({LABELS_SQL}) AS label FROM documents), c AS (SELECT label FROM e GROUP BY label HAVING count(*) >= 150)
SELECT doc_id, string_agg(label, '|' ORDER BY label) AS labels FROM e JOIN c USING (label) GROUP BY doc_id
"""


def blocklist(spark, sf):
    """Documents whose id and language no list has; the lists are a benchmark's ids and fixed labels."""
    listed = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    return docs(spark, sf).join(listed, "doc_id", "left_anti").where(~F.arrays_overlap(F.array("lang"), F.array(*map(F.lit, EXCLUDED_LABELS)))).select("doc_id", "lang")


BLOCKLIST = "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark) AND lang <> 'es'"


# -- duplicates


def exact_dedup(spark, sf):
    """The flagship: documents by normalised text, the first by id stays."""
    return dedup.duplicate_marks(docs(spark, sf), text.normalize_text(F.col("text")), "doc_id")


EXACT_DEDUP = f"SELECT doc_id, row_number() OVER (PARTITION BY {norm('text')} ORDER BY doc_id) > 1 AS is_duplicate FROM documents"


def keyed_dedup(spark, sf):
    d = docs(spark, sf).select("doc_id", F.concat_ws("-", "source", F.col("doc_id") % 7).alias("key"), "text")
    return dedup.keyed_first(d, "key", [F.col("text"), F.col("doc_id").cast("string")]).select("key", "doc_id")


KEYED_DEDUP = "SELECT source || '-' || (doc_id % 7) AS key, arg_min(doc_id, sha256(text || chr(31) || doc_id)) AS doc_id FROM documents GROUP BY 1"


def clean_metrics(spark, sf):
    """Counters of the cleaning steps and the spread of what is left, as metrics."""
    kept = docs(spark, sf).select("doc_id", "text", "source", F.length("text").alias("n"))
    marked = cut(dedup.exact_duplicates(kept, text.normalize_text(F.col("text")), "doc_id").select("doc_id", "source", "n", "is_duplicate", F.col("n").between(30, 4000).alias("fits")))
    counts = marked.agg(F.count("*").alias("rows_in"), F.count_if(~F.col("fits")).alias("dropped_length"), F.count_if(F.col("fits") & F.col("is_duplicate")).alias("dropped_exact"), F.count_if(F.col("fits") & ~F.col("is_duplicate")).alias("rows_out"), F.count_distinct("source").alias("groups"))
    out = stats.spread(marked.where("fits AND NOT is_duplicate"), "n")
    one = counts.crossJoin(out)  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in one.columns])).alias("m")).select("m.*")


CLEAN_METRICS = f"""
WITH m AS (SELECT source, length(text) AS n, length(text) BETWEEN 30 AND 4000 AS fits, row_number() OVER (PARTITION BY {norm('text')} ORDER BY doc_id) > 1 AS dup FROM documents),
s AS (SELECT list_sort(list(n)) AS l, avg(n) AS mean, stddev_pop(n) AS sd, min(n) AS lo, max(n) AS hi FROM m WHERE fits AND NOT dup),
c AS (SELECT count(*) AS rows_in, count(*) FILTER (NOT fits) AS dropped_length, count(*) FILTER (fits AND dup) AS dropped_exact, count(*) FILTER (fits AND NOT dup) AS rows_out, count(DISTINCT source) AS groups FROM m),
p AS (SELECT *, l[least(len(l), floor(0.1 * len(l)) + 1)::INT] AS p10, l[least(len(l), floor(0.5 * len(l)) + 1)::INT] AS p50, l[least(len(l), floor(0.9 * len(l)) + 1)::INT] AS p90, l[least(len(l), floor(0.99 * len(l)) + 1)::INT] AS p99 FROM s)
SELECT metric, round(CAST(value AS DOUBLE), 6) AS value FROM (
SELECT unnest(['rows_in','dropped_length','dropped_exact','rows_out','groups','p10','p50','p90','p99','ratio_p90_p10','mean','cv','min','max']) AS metric,
       unnest([rows_in::DOUBLE, dropped_length, dropped_exact, rows_out, groups, p10, p50, p90, p99, p90 / greatest(p10, 1), mean, sd / mean, lo, hi]) AS value FROM c, p)
"""


def _key() -> Column:
    return F.sha2(F.coalesce(text.normalize_text(F.col("text")), F.lit("")), 256).alias("key")


def _copies(keyed: DataFrame) -> DataFrame:
    """``(id, first)`` of texts whose key an earlier one of ``keyed(id, key)`` has."""
    first = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1")
    return cut(keyed.join(first, "key").where("id <> first").select("id", "first"))


def _near_classes(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs and members of classes of distinct texts, as dedup.similar_classes() has them, and copies of texts; neither texts nor their sets are written down."""
    rows, s = docs(spark, sf).withColumnRenamed("doc_id", "id"), text.shingle_hashes(F.col("text"), 4).alias("s")
    sets = lambda ids: rows.join(ids, "id", "left_semi").select("id", s)
    marks = cut(dedup.set_marks(rows.select("id", _key(), s), THRESHOLD, "key"))
    copies = _copies(marks.select("id", "key"))
    return *dedup.classes_of(marks.join(dedup._small(copies.select("id")), "id", "left_anti"), sets, THRESHOLD), copies


def _with_members(pairs: DataFrame, members: DataFrame, copies: DataFrame) -> DataFrame:
    """Pairs between classes and who belongs to a class, but for the one it is named by, in one table; a copy of a text is in its class."""
    found = pairs.select(F.lit("pair").alias("kind"), "a", "b", F.round("jaccard", 6).alias("jaccard"))
    of_copies = copies.join(members.withColumnRenamed("id", "first"), "first").select("id", "class")
    every = members.where("id <> class").select("id", "class").unionAll(of_copies)
    return found.unionByName(every.select(F.lit("member").alias("kind"), F.col("class").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard")))


def near_dup_pairs(spark, sf):
    """Similar pairs between classes of equal shingles, and the members of each, every document: copies are not paired with each other."""
    return _with_members(*_near_classes(spark, sf))


_SETS_SQL = f"""
n AS (SELECT doc_id, text, row_number() OVER (PARTITION BY {norm('text')} ORDER BY doc_id) AS r FROM documents), n1 AS (SELECT * FROM n WHERE r = 1),
{canonical('oc', 'n1', 'doc_id')},
w AS (SELECT key AS doc_id, {sql_words('t')} AS w FROM oc),
s AS (SELECT doc_id, {sql_shingles('w')} AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s)
"""
# members of classes, copies of a text among them; the table has the classes of distinct texts
_MEMBERS_SQL = f"SELECT 'member', class, x.doc_id, 1.0 FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {norm('text')}) AS first FROM documents) x JOIN {{0}} y ON y.doc_id = x.first WHERE x.doc_id <> class"
_ALL_NEAR_PAIRS = f"""
WITH {_SETS_SQL},
c AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id AND y.n >= 0.84 * x.n AND x.n >= 0.84 * y.n GROUP BY ALL)
SELECT a, b, round(k / (na + nb - k), 6) AS jaccard FROM c WHERE k / (na + nb - k) >= {THRESHOLD}
UNION ALL SELECT x.doc_id, y.doc_id, 1.0 FROM s x JOIN s y ON len(x.s) = 0 AND len(y.s) = 0 AND x.doc_id < y.doc_id
"""


NEAR_DUP_PAIRS = f"""
WITH p AS ({_ALL_NEAR_PAIRS}), m AS (WITH {_SETS_SQL} SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS class FROM s)
SELECT 'pair' AS kind, a, b, jaccard FROM p WHERE a IN (SELECT class FROM m) AND b IN (SELECT class FROM m) UNION ALL {_MEMBERS_SQL.format('m')}
"""


def near_dup_greedy(spark, sf):
    """Documents a scan by id drops for a kept earlier neighbour."""
    pairs, members, _ = _near_classes(spark, sf)
    return dedup.dropped_of(pairs, members).select(F.col("id").alias("doc_id"))


# the scan itself, a document with an earlier neighbour at a time
NEAR_DUP_GREEDY = f"""
WITH RECURSIVE p AS MATERIALIZED ({_ALL_NEAR_PAIRS}),
q AS MATERIALIZED (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS k FROM p GROUP BY b),
g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone
      UNION ALL SELECT q.k, CASE WHEN len(list_filter(q.earlier, lambda a: NOT list_contains(g.gone, a))) > 0 THEN list_append(g.gone, q.b) ELSE g.gone END FROM g JOIN q ON q.k = g.k + 1)
SELECT unnest(gone) AS doc_id FROM (SELECT gone FROM g ORDER BY k DESC LIMIT 1)
"""


def near_dup_batches(spark, sf):
    """What near_dup_greedy drops, found in two batches: the later documents meet the stored index of the earlier ones."""
    rows = docs(spark, sf).select("doc_id", "text")
    copies = cut(dedup.duplicate_marks(rows, text.normalize_text(F.col("text")), "doc_id").where("is_duplicate").select("doc_id").distinct())
    first = rows.join(dedup._small(copies), "doc_id", "left_anti")  # the texts stay where they are
    middle = first.agg(F.avg("doc_id")).first()[0] or 0.0
    name = f"near_{uuid.uuid4().hex}"
    index = SimilarityIndex(spark, name, f"{own_folder(spark, 'index')}/{name}", THRESHOLD)
    dropped = [index.add(first.where(part), "doc_id", F.col("text"))[2] for part in (F.col("doc_id") <= middle, F.col("doc_id") > middle)]
    return dropped[0].unionAll(dropped[1]).select(F.col("id").alias("doc_id"))


NEAR_DUP_BATCHES = NEAR_DUP_GREEDY


def _numbered_sets(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(id, s, n) of distinct texts with shingles as 32-bit numbers from md5, which SQL can follow, and (id, first) of their copies."""
    copies = _copies(cut(docs(spark, sf).select(F.col("doc_id").alias("id"), _key())))
    first = docs(spark, sf).withColumnRenamed("doc_id", "id").join(dedup._small(copies.select("id")), "id", "left_anti")
    sets = first.select("id", text.shingle_numbers(text.spaced_words(text.comparable(F.col("text"))), 4).alias("s"))
    return cut(sets).withColumn("n", F.size("s").cast("long")), copies


def minhash_signatures(spark, sf):
    """Digests of the 64 minima of each distinct text."""
    return dedup.minhash(_numbered_sets(spark, sf)[0]).select(F.col("id").alias("doc_id"), F.sha2(F.array_join("signature", ","), 256).alias("digest"))


def minhash_pairs(spark, sf):
    """Pairs that agree on a MinHash band, verified, between classes of equal sets, and the members of each, every document: LSH proposes, the sets decide."""
    sets, copies = _numbered_sets(spark, sf)
    classes, members = dedup.equal_classes(sets)
    candidates = dedup.minhash_candidates(cut(dedup.minhash(classes)))
    for side in "ab":
        candidates = candidates.join(classes.select(F.col("id").alias(side), F.col("n").alias(f"n{side}")), side)
    return _with_members(dedup._verified(candidates, classes, classes, THRESHOLD), members, copies)


_MINIMA = ", ".join(f"list_min(list_transform(u, lambda x: (x * {a} + {b}) % {dedup.PRIME}))" for a, b in dedup.coefficients(64))
_SIGNATURES = f"""
{_SETS_SQL.rsplit("e AS (", 1)[0]}
u AS (SELECT doc_id, list_distinct(list_transform(s, lambda x: CAST('0x' || md5(x)[1:8] AS BIGINT))) AS u FROM s),
m AS (SELECT doc_id, u, [{_MINIMA}] AS m FROM u)
"""
MINHASH_SIGNATURES = f"WITH {_SIGNATURES} SELECT doc_id, sha256(array_to_string(m, ',')) AS digest FROM m"
MINHASH_PAIRS = f"""
WITH {_SIGNATURES}, k AS (SELECT doc_id, u, m, min(doc_id) OVER (PARTITION BY list_sort(u)) AS class FROM m), r AS (SELECT * FROM k WHERE doc_id = class),
b AS (SELECT doc_id, unnest(range(16)) AS band, m FROM r), c AS (SELECT doc_id, band, m[band * 4 + 1 : band * 4 + 4] AS cell FROM b),
p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM c x JOIN c y ON x.band = y.band AND x.cell = y.cell AND x.doc_id < y.doc_id),
j AS (SELECT a, b, len(list_intersect(x.u, y.u)) AS k, len(x.u) + len(y.u) AS n FROM p JOIN r x ON x.doc_id = a JOIN r y ON y.doc_id = b)
SELECT 'pair' AS kind, a, b, round(k / (n - k), 6) AS jaccard FROM j WHERE k / (n - k) >= {THRESHOLD} UNION ALL {_MEMBERS_SQL.format('k')}
"""


def _sets_of(spark, sf, name, key):
    return dedup.shingle_sets(spread(table(spark, sf, name)), key, F.col("text"))


def contamination_report(spark, sf):
    """Documents against the benchmark: shared ids, texts, groups, and pairs that are nearly the same."""
    def side(rows: DataFrame, id_col: str, group: Column) -> DataFrame:
        """Key, group and shingles from one read of the texts."""
        digest = lambda c: F.sha2(c, 256)
        read = rows.select(F.col(id_col).alias("id"), digest(text.normalize_text(F.col("text"))).alias("key"), digest(text.normalize_group(group)).alias("grp"), text.shingle_hashes(F.col("text"), 4).alias("s"))
        return cut(read).withColumn("n", F.size("s").cast("long"))

    left = side(docs(spark, sf), "doc_id", F.concat_ws("|", "text", "lang"))
    right = side(spread(table(spark, sf, "benchmark")), "item_id", F.col("text"))
    count = lambda rows, name: rows.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    both = lambda c: left.select(c).join(right.select(c).distinct(), c, "left_semi").distinct()
    near = dedup.cross_similar_pairs(left, right, THRESHOLD)
    return count(both("id"), "ids").unionAll(count(both("key"), "texts")).unionAll(count(both("grp"), "groups")).unionAll(count(near, "near_pairs"))


CONTAMINATION_REPORT = f"""
WITH l AS (SELECT doc_id AS id, {norm('text')} AS k, {norm("split_part(text, '|', 1)")} AS g FROM documents), r AS (SELECT item_id AS id, {norm('text')} AS k, {norm("split_part(text, '|', 1)")} AS g FROM benchmark),
{canonical('lc', 'documents', 'doc_id')}, {canonical('rc', 'benchmark', 'item_id')},
lw AS (SELECT key AS id, {sql_words('t')} AS w FROM lc), rw AS (SELECT key AS id, {sql_words('t')} AS w FROM rc),
ls AS (SELECT id, {sql_shingles('w')} AS s FROM lw), rs AS (SELECT id, {sql_shingles('w')} AS s FROM rw),
le AS (SELECT id, len(s) AS n, unnest(s) AS h FROM ls), re AS (SELECT id, len(s) AS n, unnest(s) AS h FROM rs),
c AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM le x JOIN re y ON x.h = y.h GROUP BY ALL)
SELECT 'ids' AS metric, count(*) AS value FROM (SELECT id FROM l INTERSECT SELECT id FROM r)
UNION ALL SELECT 'texts', count(*) FROM (SELECT k FROM l INTERSECT SELECT k FROM r)
UNION ALL SELECT 'groups', count(*) FROM (SELECT g FROM l INTERSECT SELECT g FROM r)
UNION ALL SELECT 'near_pairs', (SELECT count(*) FROM c WHERE k / (na + nb - k) >= {THRESHOLD}) + (SELECT count(*) FROM ls, rs WHERE len(ls.s) = 0 AND len(rs.s) = 0)
"""


def contamination_containment(spark, sf):
    """Benchmark items of whose shingles a document has at least half (an extension: containment, not Jaccard)."""
    found = dedup.contained_pairs(_sets_of(spark, sf, "benchmark", "item_id"), _sets_of(spark, sf, "documents", "doc_id"), BENCHMARK_SHARE)
    return found.select(F.col("a").alias("item_id"), F.col("b").alias("doc_id"), F.round("share", 6).alias("share"))


CONTAMINATION_CONTAINMENT = f"""
WITH {canonical('lc', 'documents', 'doc_id')}, {canonical('rc', 'benchmark', 'item_id')},
lw AS (SELECT key AS doc_id, {sql_words('t')} AS w FROM lc), rw AS (SELECT key AS item_id, {sql_words('t')} AS w FROM rc),
le AS (SELECT doc_id, unnest({sql_shingles('w')}) AS h FROM lw), rs AS (SELECT item_id, {sql_shingles('w')} AS s FROM rw), re AS (SELECT item_id, len(s) AS n, unnest(s) AS h FROM rs)
SELECT item_id, doc_id, round(count(*) / n, 6) AS share FROM le JOIN re USING (h) GROUP BY item_id, doc_id, n HAVING count(*) / n >= {BENCHMARK_SHARE}
"""


def leak_join(spark, sf):
    """Held-out rows, every fourth, whose text or group is among the training rows, all others."""
    d = docs(spark, sf).select("doc_id", "text", F.concat_ws("-", "source", F.floor(F.col("doc_id") / 3) % 50).alias("grp"))
    found = dedup.leaks(d.where("doc_id % 4 = 0"), d.where("doc_id % 4 <> 0"), text.normalize_text(F.col("text")), "grp")
    return found.select("doc_id")


LEAK_JOIN = f"""
WITH d AS (SELECT doc_id, {norm('text')} AS k, source || '-' || ((doc_id // 3) % 50) AS g FROM documents)
SELECT doc_id FROM d WHERE doc_id % 4 = 0 AND (k IN (SELECT k FROM d WHERE doc_id % 4 <> 0) OR g IN (SELECT g FROM d WHERE doc_id % 4 <> 0))
"""


# -- samples and splits


def hash_prefix_sample(spark, sf):
    return sampling.hash_prefix(docs(spark, sf).select("doc_id", "lang"), "doc_id", 120)


HASH_PREFIX_SAMPLE = "SELECT doc_id, lang FROM documents ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id LIMIT 120"


def audit_sample(spark, sf):
    """A salted hash sample, listed in its original order with positions."""
    from pyspark.sql import Window

    picked = sampling.hash_prefix(docs(spark, sf).select("doc_id", "source"), "doc_id", 50, "audit-7|")
    return picked.withColumn("position", F.row_number().over(Window.orderBy("doc_id")).cast("long"))  # 50 rows


AUDIT_SAMPLE = "SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS position FROM (SELECT * FROM documents ORDER BY sha256('audit-7|' || doc_id), doc_id LIMIT 50)"

_STRATA = [f"{lang}-{band}" for lang in ("de", "en", "fr") for band in ("long", "medium")]


def _stratum() -> Column:
    return F.concat_ws("-", "lang", F.when(F.col("n_chars") < 1500, "medium").otherwise("long"))


def stratified_sample(spark, sf):
    quota = sampling.quotas(50, _STRATA, seed=5)
    return sampling.stratified(docs(spark, sf).select("doc_id", "lang", "n_chars"), _stratum(), "doc_id", quota, "5|train").select("stratum", "doc_id", F.col("position").cast("long").alias("position"))


STRATIFIED_SAMPLE = f"""
WITH q(stratum, quota) AS (VALUES {", ".join(f"('{s}', {n})" for s, n in sorted(sampling.quotas(50, _STRATA, seed=5).items()))}),
d AS (SELECT doc_id, lang || '-' || CASE WHEN n_chars < 1500 THEN 'medium' ELSE 'long' END AS stratum FROM documents),
r AS (SELECT stratum, doc_id, row_number() OVER (PARTITION BY stratum ORDER BY sha256('5|train|' || stratum || '|' || doc_id), doc_id) AS position FROM d)
SELECT stratum, doc_id, position FROM r JOIN q USING (stratum) WHERE position <= quota
"""


def order_strata(spark, sf):
    """An equal sample per era and priority of orders."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat_ws("|", F.when(F.year("o_orderdate") < 1995, "early").otherwise("late"), "o_orderpriority").alias("s"))
    strata = [f"{e}|{p}" for e in ("early", "late") for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]
    return sampling.stratified(o, F.col("s"), "o_orderkey", dict.fromkeys(strata, 15), "golden").select("stratum", "o_orderkey")


ORDER_STRATA = """
WITH o AS (SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1995 THEN 'early' ELSE 'late' END || '|' || o_orderpriority AS stratum FROM orders)
SELECT stratum, o_orderkey FROM o QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY sha256('golden|' || stratum || '|' || o_orderkey), o_orderkey) <= 15
"""


def _split_rows(spark, sf):
    """Documents in splits by a hash of their source and id band."""
    grp = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 5) % 8)
    bucket = ident.hex_mod(F.sha2(grp, 256), 10)
    return docs(spark, sf).select("doc_id", grp.alias("grp"), F.when(bucket < 8, "train").when(bucket == 8, "val").otherwise("test").alias("split"), label_array().alias("labels"))


_SPLIT_SQL = f"""
g AS (SELECT doc_id, source || '-' || ((doc_id // 5) % 8) AS grp, {LABELS_SQL} AS labels FROM documents),
h AS (SELECT *, list_reduce(list_transform(string_split(sha256(grp), ''), lambda x: CAST(strpos('0123456789abcdef', x) - 1 AS BIGINT)), lambda a, x: (a * 16 + x) % 10) AS b FROM g),
r AS (SELECT doc_id, grp, CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'val' ELSE 'test' END AS split, labels FROM h)
"""


def group_split_drift(spark, sf):
    out = split.drift(_split_rows(spark, sf), "split", "labels")
    return out.select("split", F.round("total_variation", 6).alias("total_variation"), F.round("max_prevalence_delta", 6).alias("max_prevalence_delta"), "largest_delta_label", "missing_in_train")


GROUP_SPLIT_DRIFT = f"""
WITH {_SPLIT_SQL},
n AS (SELECT split, count(*) AS rows FROM r GROUP BY split), e AS (SELECT split, unnest(labels) AS label FROM r),
k AS (SELECT split, label, count(*) AS c FROM e GROUP BY split, label), c AS (SELECT *, c / sum(c) OVER (PARTITION BY split) AS share FROM k),
w AS (SELECT c.split, label, c, share, c / rows AS prevalence FROM c JOIN n USING (split)),
grid AS (SELECT s.split, l.label FROM (VALUES ('val'), ('test')) s(split), (SELECT DISTINCT label FROM e) l WHERE s.split IN (SELECT split FROM n)),
j AS (SELECT grid.split, grid.label, coalesce(w.c, 0) AS c, coalesce(w.share, 0) AS share, coalesce(w.prevalence, 0) AS p, coalesce(t.c, 0) AS tc, coalesce(t.share, 0) AS ts, coalesce(t.prevalence, 0) AS tp
      FROM grid LEFT JOIN w USING (split, label) LEFT JOIN (SELECT * FROM w WHERE split = 'train') t ON t.label = grid.label)
SELECT split, round(sum(abs(share - ts)) / 2, 6) AS total_variation, round(max(abs(p - tp)), 6) AS max_prevalence_delta,
       (list(label ORDER BY abs(p - tp) DESC, label))[1] AS largest_delta_label, count(*) FILTER (c > 0 AND tc = 0) AS missing_in_train
FROM j GROUP BY split
"""


def split_overlap(spark, sf):
    """Sources that splits by id share: what a split by whole groups must not have."""
    rows = _split_rows(spark, sf).withColumn("src", F.substring_index("grp", "-", 1))
    return split.overlaps(rows, "split", "src")


SPLIT_OVERLAP = f"""
WITH {_SPLIT_SQL}, p AS (SELECT DISTINCT split, split_part(grp, '-', 1) AS s FROM r)
SELECT a.split AS "left", b.split AS "right", count(*) AS shared_groups FROM p a JOIN p b ON a.s = b.s AND a.split < b.split GROUP BY ALL
"""


SEED, ATTEMPTS = 42, 512


def split_search(spark, sf):
    """The best of 512 seeded assignments of whole groups, with its score."""
    rows = docs(spark, sf).select(F.concat_ws("-", "source", F.floor(F.col("doc_id") / 5) % 5).alias("grp"), label_array().alias("labels"))
    found = split.search(rows, "grp", "labels", RATIOS, SEED, ATTEMPTS)
    return found.select("group", "split", "attempt", F.round("score", 9).alias("score"), F.round("max_total_variation", 9).alias("max_total_variation"))


def _off(split: str, gained: str) -> str:
    """What a split's squared relative error becomes by ``gained`` rows, less what it is."""
    goal = f"(total * {RATIOS[split]})"
    return f"(({split} + {gained} - {goal}) / {goal}) * (({split} + {gained} - {goal}) / {goal}) - (({split} - {goal}) / {goal}) * (({split} - {goal}) / {goal})"


# the anchors, one a step; then a group of each attempt at a step; then the scores of all attempts
SPLIT_SEARCH = f"""
WITH RECURSIVE d AS (SELECT source || '-' || ((doc_id // 5) % 5) AS grp, [lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END] || CASE WHEN doc_id % 2 = 0 THEN ['even'] ELSE [] END AS labels FROM documents),
l AS MATERIALIZED (SELECT grp, label, count(*) AS c FROM (SELECT grp, unnest(labels) AS label FROM d) WHERE label IS NOT NULL GROUP BY ALL),
z AS MATERIALIZED (SELECT grp, n, sum(n) OVER () AS total, coalesce(labs, []) AS labs FROM (SELECT grp, count(*) AS n FROM d GROUP BY grp) LEFT JOIN (SELECT grp, list(label) AS labs FROM l GROUP BY grp) USING (grp)),
cov AS (SELECT CAST(NULL AS VARCHAR) AS grp, (SELECT list(DISTINCT label) FROM l) AS missing
        UNION ALL SELECT b.grp, list_filter(b.missing, lambda x: NOT list_contains(b.labs, x))
        FROM (SELECT missing, arg_min(z.grp, row(-len(list_intersect(missing, labs)), n, z.grp)) AS grp, arg_min(labs, row(-len(list_intersect(missing, labs)), n, z.grp)) AS labs FROM cov, z WHERE len(missing) > 0 GROUP BY missing) b),
anchors AS MATERIALIZED (SELECT grp FROM cov WHERE grp IS NOT NULL),
o AS MATERIALIZED (SELECT a AS attempt, grp, n, total, row_number() OVER (PARTITION BY a ORDER BY sha256('{SEED}|' || a || '|' || grp), grp) AS k, count(*) OVER (PARTITION BY a) AS m FROM z, range({ATTEMPTS}) t(a) WHERE grp NOT IN (SELECT grp FROM anchors)),
p AS (SELECT a AS attempt, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS grp, CAST('' AS VARCHAR) AS split, (SELECT CAST(sum(n) AS DOUBLE) FROM z JOIN anchors USING (grp)) AS train, 0.0::DOUBLE AS val, 0.0::DOUBLE AS test FROM range({ATTEMPTS}) t(a)
      UNION ALL SELECT attempt, k, grp, split, train + CASE split WHEN 'train' THEN n ELSE 0 END, val + CASE split WHEN 'val' THEN n ELSE 0 END, test + CASE split WHEN 'test' THEN n ELSE 0 END
      FROM (SELECT *, CASE WHEN fill AND val > 0 THEN 'test' WHEN fill AND test > 0 THEN 'val' WHEN NOT fill AND et <= ev AND et <= es THEN 'train' WHEN ev <= es THEN 'val' ELSE 'test' END AS split
            FROM (SELECT p.attempt, o.k, o.grp, o.n, train, val, test, o.m - p.k = (CASE WHEN val = 0 THEN 1 ELSE 0 END + CASE WHEN test = 0 THEN 1 ELSE 0 END) AS fill,
                         {_off("train", "o.n")} AS et, {_off("val", "o.n")} AS ev, {_off("test", "o.n")} AS es
                  FROM p JOIN o ON o.attempt = p.attempt AND o.k = p.k + 1))),
w AS MATERIALIZED (SELECT attempt, grp, split FROM p WHERE k > 0 UNION ALL SELECT a, grp, 'train' FROM anchors, range({ATTEMPTS}) t(a)),
sizes AS (SELECT attempt, split, sum(n) AS n, any_value(total) AS total FROM w JOIN z USING (grp) GROUP BY ALL),
c AS (SELECT attempt, split, label, sum(c) AS c FROM w JOIN l USING (grp) GROUP BY ALL), sh AS (SELECT *, c / sum(c) OVER (PARTITION BY attempt, split) AS share FROM c),
grid AS (SELECT DISTINCT attempt, label, s.split FROM c, (VALUES ('val'), ('test')) s(split)),
v AS (SELECT g.attempt, g.split, sum(abs(coalesce(a.share, 0) - coalesce(b.share, 0))) / 2 AS tv, count(*) FILTER (a.c > 0 AND b.c IS NULL) AS absent
      FROM grid g LEFT JOIN sh a ON a.attempt = g.attempt AND a.split = g.split AND a.label = g.label LEFT JOIN sh b ON b.attempt = g.attempt AND b.split = 'train' AND b.label = g.label GROUP BY ALL),
e AS (SELECT attempt, sum(abs(n - total * CASE split WHEN 'train' THEN {RATIOS["train"]} WHEN 'val' THEN {RATIOS["val"]} ELSE {RATIOS["test"]} END)) / any_value(total) AS off FROM sizes GROUP BY attempt),
best AS (SELECT attempt, score, tv FROM (SELECT attempt, 1000 * sum(absent) + 4 * any_value(off) + sum(tv) AS score, max(tv) AS tv FROM v JOIN e USING (attempt) GROUP BY attempt) ORDER BY round(score, 10), attempt LIMIT 1)
SELECT grp AS "group", split, attempt, round(CAST(score AS DOUBLE), 9) AS score, round(CAST(tv AS DOUBLE), 9) AS max_total_variation FROM w JOIN best USING (attempt)
"""


# -- diversity


def _diverse(spark, sf):
    return docs(spark, sf).select(
        F.col("doc_id").alias("seq"), F.col("lang").alias("system"), F.col("source").alias("grp"), F.col("text").alias("description"), F.concat_ws(", ", label_array()).alias("answer"), label_array().alias("labels")
    )


def diversity_metrics(spark, sf):
    return quality.diversity(_diverse(spark, sf)).select("metric", F.round("value", 6).alias("value"))


DIVERSITY_METRICS = f"""
WITH d AS (SELECT doc_id, lang, source, length(text) AS dl, array_to_string({LABELS_SQL}, ', ') AS a, {LABELS_SQL} AS labels FROM documents),
n AS (SELECT count(*) AS n, count(DISTINCT lang) AS sp, count(DISTINCT source) AS g, count(DISTINCT a) AS an, count(*) FILTER (len(labels) > 1) AS multi, list_sort(list(length(a))) AS al, list_sort(list(dl)) AS dls FROM d),
gc AS (SELECT max(c) AS c FROM (SELECT count(*) AS c FROM d GROUP BY source)), lc AS (SELECT max(c) AS c, count(*) AS k FROM (SELECT count(*) AS c FROM (SELECT unnest(labels) AS l FROM d) GROUP BY l)),
mc AS (SELECT max(c) AS c FROM (SELECT count(*) AS c FROM d GROUP BY length(a)))
SELECT metric, round(CAST(value AS DOUBLE), 6) AS value FROM (SELECT
unnest(['examples','system_prompts','groups','largest_group_share','answer_len_ratio','same_length_share','duplicate_answer_share','labels','largest_label_share','multilabel_share','description_len_ratio']) AS metric,
unnest([n::DOUBLE, sp, g, gc.c / n, al[least(n, floor(0.9 * n) + 1)::INT] / greatest(1, al[least(n, floor(0.1 * n) + 1)::INT]), mc.c / n, (n - an) / n, lc.k, lc.c / n, multi / n, dls[least(n, floor(0.9 * n) + 1)::INT] / greatest(1, dls[least(n, floor(0.1 * n) + 1)::INT])]) AS value
FROM n, gc, lc, mc)
"""


def diversity_violations(spark, sf):
    return quality.violations(quality.diversity(_diverse(spark, sf)), quality.DIVERSITY_LIMITS).select("rule", "metric", F.round("value", 6).alias("value"), "threshold")


DIVERSITY_VIOLATIONS = f"""
WITH lim(rule, metric, kind, threshold) AS (VALUES {", ".join(f"('{r}', '{m}', '{k}', CAST({t} AS DOUBLE))" for r, (m, k, t) in quality.DIVERSITY_LIMITS.items())}), met AS ({DIVERSITY_METRICS})
SELECT rule, metric, value, threshold FROM lim JOIN met USING (metric) WHERE (kind = 'min' AND value < threshold) OR (kind = 'max' AND value > threshold)
"""

QUERIES = {
    "exact_dedup": exact_dedup, "normalize_documents": normalize_documents, "source_text_digests": source_text_digests, "casefold_digests": casefold_digests,
    "option_digests": option_digests, "shingle_counts": shingle_counts, "label_functions": label_functions, "stable_ids": stable_ids, "prompt_pick": prompt_pick,
    "length_filter": length_filter, "reject_reasons": reject_reasons, "pii_mask": pii_mask, "pii_counts": pii_counts, "label_histogram": label_histogram,
    "frequent_labels": frequent_labels, "blocklist": blocklist, "keyed_dedup": keyed_dedup, "clean_metrics": clean_metrics, "near_dup_pairs": near_dup_pairs,
    "near_dup_greedy": near_dup_greedy, "near_dup_batches": near_dup_batches, "minhash_signatures": minhash_signatures, "minhash_pairs": minhash_pairs, "contamination_report": contamination_report, "contamination_containment": contamination_containment,
    "leak_join": leak_join, "hash_prefix_sample": hash_prefix_sample, "audit_sample": audit_sample, "stratified_sample": stratified_sample, "order_strata": order_strata,
    "group_split_drift": group_split_drift, "split_overlap": split_overlap, "split_search": split_search, "diversity_metrics": diversity_metrics, "diversity_violations": diversity_violations,
}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
