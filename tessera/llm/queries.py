"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, classifier, embedding_dedup, fill_in_middle, language_id, packing, point_in_time, quality_rules, quality_rules_sql, simhash, token_counts, tokens, url_filter, warc
from tessera.llm.common import table, written


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What formatted conversations say, from their text and spans alone."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for batch in batches:
        rows = []
        for key, text, spans in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "spans")), strict=True):
            turns = chat.read_turns(text)
            loss = "".join(chat.unescape(text[s["start"] : s["end"]]) for s in spans)
            rows.append((key, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for c, n in zip(zip(*rows, strict=True), [c.split()[0] for c in READ_BACK.split(", ")], strict=True)],
                names=[c.split()[0] for c in READ_BACK.split(", ")],
            )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    one = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return chat.format_conversations(turns.unionByName(one)).mapInArrow(read_back, READ_BACK)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job stores the documents with their trees; another reads them and makes four edits: a cut, an insertion, a letter within a word, a new ending."""
    docs = table(spark, sf_dir, "documents")
    trees = written(token_counts.token_trees(docs), "zstd")
    n = F.length(F.coalesce("text", F.lit("")))
    at = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), n + 1)
    edit = lambda start, end, text: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(text).alias("text"))
    edits = F.array(edit(at(1), at(1) + 40, ""), edit(at(2), at(2), " [note 1] "), edit(at(3), at(3), "x"), edit(n - 10, F.lit(None), "\nEnd."))
    return token_counts.counts_of(token_counts.edit_trees(trees, edits))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = table(spark, sf_dir, "documents").select("doc_id", tokens.encode_column(F.col("text")).alias("ids"))
    decoded = encoded.select("doc_id", "ids", tokens.decode_column(F.col("ids")).alias("bytes"))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


#: (verdict, host, path prefix)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP10_SQL = r"""
WITH rest AS (
    SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages
), hosts AS (
    SELECT page_id, coalesce(regexp_extract(r, '^[^/?#]*'), '') AS h, coalesce(r, '') AS r FROM rest
), split AS (
    SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path
    FROM hosts
), rules(verdict, h, p) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
    SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
    FROM split, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fits USING (page_id)
"""


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as archives in the shared folder and says of each what its record says."""
    read = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")), payload=False).where("record_type IN ('response', 'revisit')")
    return read.select(warc.row_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.row_id(F.col("refers_to")).alias("refers_to"))


def op12_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as versions of their source, with times drawn from their ids; labels as questions."""
    draw = lambda i: F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 8 * i + 1, 8), 16, 10).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    event = draw(0) % 20000
    versions = docs.select("doc_id", "source", event.alias("event"), (event - 60 + draw(1) % 300).alias("arrival"), (event + draw(2) % 900).alias("expiry"), "n_chars", "lang")
    sources = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("source").alias("source"))  # one for each id, also where rows repeat it
    questions = table(spark, sf_dir, "labels").select("doc_id", (draw(3) % 20000).alias("t")).join(sources, "doc_id", "left")
    found = point_in_time.point_in_time(questions, versions, entity="source", version_id="doc_id", features=["n_chars", "lang"])
    age = F.col("t") - F.col("version.event")
    status = F.when(F.col("version").isNull(), "none").when(age > 60, "stale").otherwise("fresh")
    fresh = lambda name: F.when(F.col("status") == "fresh", F.col(f"version.{name}")).alias(name)
    return found.withColumn("status", status).select("doc_id", "t", F.col("version.version_id").alias("version_id"), age.alias("age"), "status", fresh("n_chars"), fresh("lang"))


OP12_SQL = """
WITH drawn AS (
    SELECT doc_id, source, n_chars, lang, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents
), versions AS (
    SELECT doc_id, source, n_chars, lang, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 20000 AS event,
           CAST('0x' || substr(h, 9, 8) AS BIGINT) % 300 AS b, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 900 AS c
    FROM drawn
), asked AS (
    SELECT row_number() OVER () AS ask, l.doc_id, d.source, CAST('0x' || substr(sha256(CAST(l.doc_id AS VARCHAR)), 25, 8) AS BIGINT) % 20000 AS t
    FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id
), ranked AS (
    SELECT ask, a.doc_id, t, v.doc_id AS version_id, t - event AS age, n_chars, lang,
           row_number() OVER (PARTITION BY ask ORDER BY event DESC, event - 60 + b, v.doc_id DESC) AS k
    FROM asked a LEFT JOIN versions v ON v.source = a.source AND event <= t AND event - 60 + b <= t AND t < event + c
)
SELECT doc_id, t, version_id, age, CASE WHEN version_id IS NULL THEN 'none' WHEN age > 60 THEN 'stale' ELSE 'fresh' END AS status,
       CASE WHEN age <= 60 THEN n_chars END AS n_chars, CASE WHEN age <= 60 THEN lang END AS lang
FROM ranked WHERE k = 1
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    text = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


OP13_SQL = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), cut AS (
    SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
           CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
           CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM drawn
), formed AS (
    SELECT doc_id, text, units, len(units) AS n,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
           least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b
    FROM cut
), parts AS (
    SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s
    FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash": op3_simhash,
    "op4_chat_format": op4_chat_format,
    "op5_token_counts": op5_token_counts,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_language_id": op9_language_id,
    "op10_url_filter": op10_url_filter,
    "op11_warc": op11_warc,
    "op12_point_in_time": op12_point_in_time,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality_rules_sql.SQL,
    "op10_url_filter": OP10_SQL,
    "op12_point_in_time": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
