"""Queries of encoding, sampling views and packing over conversations and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ident, text
from tessera.operators import encode, packing
from tessera.session import cut, spread, table

LIMIT = 320
#: pieces of one document are numbered below this
PIECES = 1 << 20
WORD = r"(?U)\s+"


def _exchanges(turns: DataFrame) -> DataFrame:
    """``turns`` with the next turn of the conversation and the last system prompt so far."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    system = F.last(F.when(F.col("role") == "system", F.col("text")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return turns.select("conv_id", "turn", "role", "text", F.lead("role").over(by).alias("next_role"), F.lead("text").over(by).alias("next_text"), F.lag("role").over(by).alias("last_role"), system.alias("system"))


def _examples(spark, sf) -> DataFrame:
    """One example per exchange: a user's turn and the assistant's that follows it, under the last system prompt before them, if any."""
    e = _exchanges(table(spark, sf, "conversations")).where("role = 'user' AND next_role = 'assistant' AND text IS NOT NULL AND next_text IS NOT NULL")
    return e.select("conv_id", "turn", F.col("text").alias("user"), F.col("next_text").alias("assistant"), "system")


_EXCHANGES = """
y AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text, lag(role) OVER w AS last_role,
      last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
"""
_EXAMPLES = f"""{_EXCHANGES},
x AS (SELECT conv_id, turn, text AS u, next_text AS a, s FROM y WHERE role = 'user' AND next_role = 'assistant' AND text IS NOT NULL AND next_text IS NOT NULL)
"""


def unused_turns(spark, sf):
    """Turns that are in no example, with the reason: with those of the examples and system prompts they are all turns."""
    e = _exchanges(table(spark, sf, "conversations")).where("role IS NULL OR role <> 'system'")
    reason = (
        F.when(F.col("role").isNull() | ~F.col("role").isin("user", "assistant"), "other role")
        .when((F.col("role") == "user") & ~F.coalesce(F.col("next_role") == "assistant", F.lit(False)), "no answer")
        .when((F.col("role") == "assistant") & ~F.coalesce(F.col("last_role") == "user", F.lit(False)), "no question")
        .when(F.col("text").isNull(), "no text")
    )
    return e.select("conv_id", "turn", reason.alias("reason")).where("reason IS NOT NULL")


UNUSED_TURNS = f"""
WITH {_EXCHANGES} SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') OR role IS NULL THEN 'other role' WHEN role = 'user' AND next_role IS DISTINCT FROM 'assistant' THEN 'no answer'
WHEN role = 'assistant' AND last_role IS DISTINCT FROM 'user' THEN 'no question' ELSE 'no text' END AS reason FROM y
WHERE role IS DISTINCT FROM 'system' AND (role IS NULL OR text IS NULL OR NOT (role = 'user' AND next_role IS NOT DISTINCT FROM 'assistant' OR role = 'assistant' AND last_role IS NOT DISTINCT FROM 'user'))
"""


def chat_examples(spark, sf):
    e = _examples(spark, sf)
    messages = encode.build_example(F.coalesce("system", F.lit(encode.DEFAULT_SYSTEM)), F.col("user"), F.col("assistant"))
    rows = e.select("conv_id", "turn", messages.alias("m"))
    return rows.select("conv_id", "turn", F.format_string("release_year:%d", (F.lit(1990) + F.col("conv_id") % 30).cast("int")).alias("topic"), F.sha2(F.array_join(F.transform("m", lambda x: F.concat_ws("\n", x["role"], x["content"])), "\n"), 256).alias("digest"), F.size("m").cast("long").alias("n"))


CHAT_EXAMPLES = f"WITH {_EXAMPLES} SELECT conv_id, turn, 'release_year:' || (1990 + conv_id % 30) AS topic, sha256('system' || chr(10) || coalesce(s, '{encode.DEFAULT_SYSTEM}') || chr(10) || 'user' || chr(10) || u || chr(10) || 'assistant' || chr(10) || a) AS digest, CAST(3 AS BIGINT) AS n FROM x"


def role_contract(spark, sf):
    """Conversations that are no system-user-assistant example, with the reason."""
    turns = table(spark, sf, "conversations")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    rows = turns.groupBy("conv_id").agg(ordered.alias("messages")).withColumn("topic", F.when(F.col("conv_id") % 10 != 0, "t"))
    return encode.role_contract(rows, "conv_id").select(F.col("id").alias("conv_id"), "reason")


ROLE_CONTRACT = """
WITH g AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) FILTER (coalesce(trim(text), '') = '') AS blank FROM conversations GROUP BY conv_id)
SELECT conv_id, 'wrong roles' AS reason FROM g WHERE roles <> 'system,user,assistant' UNION ALL SELECT conv_id, 'blank content' FROM g WHERE blank > 0 UNION ALL SELECT conv_id, 'blank topic' FROM g WHERE conv_id % 10 = 0
"""


def _lengths(spark, sf) -> DataFrame:
    e = _examples(spark, sf)
    words = lambda c: encode.whitespace_tokens(F.col(c))
    return e.select("conv_id", "turn", words("user").alias("p"), words("assistant").alias("a"))


_TOKENS = f"""{_EXAMPLES}, t AS (SELECT conv_id, turn, list_filter(string_split_regex(u, '\\s+'), lambda w: w <> '') AS p, list_filter(string_split_regex(a, '\\s+'), lambda w: w <> '') AS a FROM x)"""


def token_stats(spark, sf):
    """Lengths as truncated linear percentiles, supervised and truncated counts; rows without supervision count here still."""
    rows = _lengths(spark, sf).select((F.size("p") + F.size("a")).alias("n"), F.size("p").alias("p"))
    kept = F.least(F.col("n"), F.lit(LIMIT))
    one = rows.agg(
        F.count("*").alias("rows"),
        F.sum("n").alias("tokens"),
        F.sum(F.greatest(kept - F.col("p"), F.lit(0))).alias("supervised"),
        F.count_if(F.col("n") > LIMIT).alias("truncated"),
        *[F.percentile("n", F.lit(q)).cast("long").alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)],
        F.max("n").cast("long").alias("max"),
        F.round(F.avg("n"), 1).alias("mean"),
    )
    return one.withColumn("ceil_steps", F.ceil(F.col("rows") / 8).cast("long"))


TOKEN_STATS = f"""
WITH {_TOKENS}, r AS (SELECT len(p) + len(a) AS n, len(p) AS p FROM t)
SELECT count(*) AS rows, sum(n) AS tokens, sum(greatest(least(n, {LIMIT}) - p, 0)) AS supervised, count(*) FILTER (n > {LIMIT}) AS truncated,
       CAST(trunc(quantile_cont(n, 0.5)) AS BIGINT) AS p50, CAST(trunc(quantile_cont(n, 0.9)) AS BIGINT) AS p90, CAST(trunc(quantile_cont(n, 0.99)) AS BIGINT) AS p99, max(n) AS max, round(avg(n), 1) AS mean, CAST(ceil(count(*) / 8) AS BIGINT) AS ceil_steps FROM r
"""


def _encoded(spark, sf) -> DataFrame:
    """Ids are token lengths, which SQL can follow too."""
    ids = lambda c: F.transform(c, lambda w: F.length(w))
    rows = cut(_lengths(spark, sf).select("conv_id", "turn", ids("p").alias("p"), ids("a").alias("a")))
    return rows.select("conv_id", "turn", encode.encode_pair(F.col("p"), F.col("a"), 120).alias("e")).select("conv_id", "turn", "e.*")


def mask_and_truncate(spark, sf):
    """Rows that keep a supervised token, with digests of their ids and labels."""
    e = _encoded(spark, sf).where("supervised > 0")
    return e.select("conv_id", "turn", F.array_join("input_ids", ",").alias("ids"), F.array_join("labels", ",").alias("labels"), "truncated", F.col("supervised").cast("long").alias("supervised"))


_ENCODED = f"""{_TOKENS}, e AS (SELECT conv_id, turn, list_transform(p, lambda w: length(w)) AS p, list_transform(a, lambda w: length(w)) AS a FROM t),
f AS (SELECT conv_id, turn, list_slice(list_concat(p, a), 1, 120) AS ids, least(len(p), 120) AS m, len(p) + len(a) AS n FROM e),
k AS (SELECT conv_id, turn, ids, list_transform(ids, lambda x, i: CASE WHEN i <= m THEN -100 ELSE x END) AS labels, n > 120 AS truncated, len(ids) - m AS supervised FROM f)
"""
MASK_AND_TRUNCATE = f"WITH {_ENCODED} SELECT conv_id, turn, array_to_string(ids, ',') AS ids, array_to_string(labels, ',') AS labels, truncated, CAST(supervised AS BIGINT) AS supervised FROM k WHERE supervised > 0"


def encoded_rows_valid(spark, sf):
    """Which encoded rows hold the invariants of training rows."""
    e = _encoded(spark, sf)
    return e.select("conv_id", "turn", encode.valid_row(F.col("input_ids"), F.col("attention_mask"), F.col("labels")).alias("valid"))


ENCODED_ROWS_VALID = f"WITH {_ENCODED} SELECT conv_id, turn, len(ids) > 0 AND supervised > 0 AS valid FROM k"


def pad_batches(spark, sf):
    """Batches of eight by length, padded left to the longest of each batch."""
    e = _encoded(spark, sf).where("supervised > 0").select("conv_id", "turn", "input_ids", "attention_mask", "labels", F.size("input_ids").alias("n"))
    placed = encode.batches(e, [F.col("n"), F.col("conv_id"), F.col("turn")], 8)
    padded = encode.pad(placed, "batch", {"input_ids": 99, "attention_mask": 0, "labels": encode.IGNORED}, "left")
    return padded.select("conv_id", "turn", "batch", F.size("input_ids").cast("long").alias("width"), F.array_join("input_ids", ",").alias("ids"), F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).cast("long").alias("ones"), F.array_join("labels", ",").alias("labels"))


PAD_BATCHES = f"""
WITH {_ENCODED}, o AS (SELECT *, len(ids) AS n, (row_number() OVER (ORDER BY len(ids), conv_id, turn) - 1) // 8 AS batch FROM k WHERE supervised > 0), w AS (SELECT *, max(n) OVER (PARTITION BY batch) AS width FROM o)
SELECT conv_id, turn, batch, CAST(width AS BIGINT) AS width, array_to_string(list_concat(list_transform(range(width - n), lambda i: 99), ids), ',') AS ids, CAST(n AS BIGINT) AS ones, array_to_string(list_concat(list_transform(range(width - n), lambda i: -100), labels), ',') AS labels FROM w
"""


def lexical_summary(spark, sf):
    """Whitespace tokens of documents, capped at 256 each."""
    n = F.size(encode.whitespace_tokens(F.col("text")))
    return spread(table(spark, sf, "documents")).select("lang", n.alias("n")).groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.least("n", F.lit(256))).alias("tokens"), F.count_if(F.col("n") > 256).alias("truncated"))


LEXICAL_SUMMARY = r"""
WITH t AS (SELECT lang, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS n FROM documents)
SELECT lang, count(*) AS rows, sum(least(n, 256)) AS tokens, count(*) FILTER (n > 256) AS truncated FROM t GROUP BY lang
"""


def _packed(spark, sf) -> DataFrame:
    """Whole documents: longer ones are cut into pieces of LIMIT words, an empty one is a piece of none."""
    n = F.size(encode.whitespace_tokens(F.col("text"))).cast("long")
    words = spread(table(spark, sf, "documents")).select("doc_id", n.alias("n"))
    last = F.greatest(F.ceil(F.col("n") / LIMIT), F.lit(1)).cast("long") - 1
    pieces = words.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("j"))
    rows = pieces.select((F.col("doc_id") * PIECES + F.col("j")).alias("piece"), F.least(F.lit(LIMIT), F.col("n") - F.col("j") * LIMIT).alias("n"))
    return packing.pack_first_fit(rows, "piece", "n", LIMIT)


def pack_ffd(spark, sf):
    """First-fit-decreasing bins of all pieces of documents."""
    return _packed(spark, sf)


# a length at a time over all bins that could be needed (of any two neighbours one is more than half full): what
# fits into each bin, and how much the bins before it take
_BINS = f"""
w AS (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS n FROM documents),
d AS (SELECT doc_id, n, unnest(range(greatest(CAST(ceil(n / {LIMIT}) AS BIGINT), 1))) AS j FROM w),
o AS (SELECT doc_id * {PIECES} + j AS id, CAST(least({LIMIT}, n - j * {LIMIT}) AS BIGINT) AS n FROM d),
i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY n ORDER BY id) - 1 AS r FROM o),
h AS MATERIALIZED (SELECT n, count(*) AS c, row_number() OVER (ORDER BY n DESC) AS k FROM o GROUP BY n),
f AS (SELECT CAST(0 AS BIGINT) AS k, bin, CAST({LIMIT} AS BIGINT) AS room, CAST(0 AS BIGINT) AS items, CAST(0 AS BIGINT) AS put, CAST(0 AS BIGINT) AS before
      FROM (SELECT unnest(range(CAST(2 * sum(n) // {LIMIT} + 2 AS BIGINT))) AS bin FROM o)
      UNION ALL SELECT k, bin, room - put * n, items + put, put, before
      FROM (SELECT k, bin, room, items, n, before, greatest(least(fits, c - before), 0) AS put
            FROM (SELECT h.k, f.bin, f.room, f.items, h.n, h.c, CASE WHEN h.n = 0 THEN h.c ELSE f.room // h.n END AS fits,
                         CAST(coalesce(sum(CASE WHEN h.n = 0 THEN h.c ELSE f.room // h.n END) OVER (ORDER BY f.bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
                  FROM f JOIN h ON h.k = f.k + 1))),
b AS (SELECT f.bin, f.items - f.put + i.r - f.before AS position, i.id, i.n AS length
      FROM f JOIN h USING (k) JOIN i ON i.n = h.n AND i.r >= f.before AND i.r < f.before + f.put WHERE f.put > 0)
"""
PACK_FFD = f"WITH RECURSIVE {_BINS} SELECT bin, position, id, length FROM b"


def pack_report(spark, sf):
    bins = _packed(spark, sf).groupBy("bin").agg(F.sum("length").alias("used"), F.count("*").alias("items"))
    return bins.agg(F.sum("items").alias("items"), F.count("*").alias("bins"), F.round(F.sum("used") / (F.count("*") * LIMIT), 6).alias("fill"), F.max("items").alias("max_items"), F.ceil(F.sum("items") / 8).cast("long").alias("steps_before"), F.ceil(F.count("*") / 8).cast("long").alias("steps")).withColumn("steps_saved", F.round(1 - F.col("steps") / F.col("steps_before"), 4))


PACK_REPORT = f"""
WITH RECURSIVE {_BINS}, s AS (SELECT sum(length) AS used, count(*) AS items FROM b GROUP BY bin)
SELECT sum(items) AS items, count(*) AS bins, round(sum(used) / (count(*) * {LIMIT}), 6) AS fill, max(items) AS max_items, CAST(ceil(sum(items) / 8) AS BIGINT) AS steps_before, CAST(ceil(count(*) / 8) AS BIGINT) AS steps, round(1 - ceil(count(*) / 8) / ceil(sum(items) / 8), 4) AS steps_saved FROM s
"""


def prefix_cache_keys(spark, sf):
    e = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    return e.select("conv_id", ident.prefix_cache_key(F.when(F.col("conv_id") % 2 == 0, F.col("first")), F.concat(F.lit("p:"), F.col("first"))).alias("key"))


PREFIX_CACHE_KEYS = "WITH e AS (SELECT conv_id, arg_min(text, turn) AS f FROM conversations GROUP BY conv_id) SELECT conv_id, sha256(CASE WHEN conv_id % 2 = 0 THEN f ELSE substr('p:' || f, 1, 128) END) AS key FROM e"


def training_view(spark, sf):
    """Records of whole conversations: the system prompt replaced, the one user message, and all labels of the final answer as JSON.

    A conversation has no record, but a reason, unless it has exactly one user message, which isn't blank, and ends with the assistant's, whose labels are neither empty nor repeated."""
    turns = table(spark, sf, "conversations")
    by = turns.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("users"), F.max(F.when(F.col("role") == "user", F.col("text"))).alias("user"), F.max_by("role", "turn").alias("last"), F.max_by("text", "turn").alias("final")
    )  # where there is one user message, the largest is that one
    e = by.withColumn("answer", F.when(F.col("last") == "assistant", text.canonical_answer(F.coalesce("final", F.lit("")))))
    written = F.to_json(F.array("answer"))
    answer = F.concat(F.lit('{"answer": '), F.substring(written, F.lit(2), F.length(written) - 2), F.lit("}"))
    record = F.array_join(F.transform(encode.build_example(F.lit("Answer as JSON."), F.col("user"), answer), lambda m: F.concat(m["role"], F.lit(": "), m["content"])), " | ")
    blank = F.coalesce(F.regexp_replace("user", r"(?U)[\s\x1c-\x1f]+", "") == "", F.lit(True))
    reason = F.when((F.col("users") != 1) | blank, "not one user message").when(F.coalesce(F.col("last") != "assistant", F.lit(True)), "no final answer").when(F.col("answer").isNull(), "empty or repeated labels")
    rows = e.withColumn("reason", reason)
    good = F.col("reason").isNull()
    return rows.select("conv_id", "reason", F.when(good, F.sha2(record, 256)).alias("record_sha256"), F.when(good, F.length("answer").cast("long")).alias("answer_chars"), F.when(good, F.length("user") > 400).alias("long_description"))


TRAINING_VIEW = """
WITH u AS (SELECT conv_id, text FROM conversations WHERE role = 'user' QUALIFY count(*) OVER (PARTITION BY conv_id) = 1 AND regexp_replace(coalesce(text, ''), '[\\s\\x1c-\\x1f]+', '', 'g') <> ''),
l AS (SELECT conv_id, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
p AS (SELECT l.conv_id, u.text AS u, l.role, list_transform(string_split(replace(lower(coalesce(l.text, '')), 'ß', 'ss'), ','), lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS parts FROM l LEFT JOIN u USING (conv_id)),
r AS (SELECT conv_id, u, CASE WHEN u IS NULL THEN 'not one user message' WHEN role IS DISTINCT FROM 'assistant' THEN 'no final answer' WHEN list_contains(parts, '') OR len(list_distinct(parts)) < len(parts) THEN 'empty or repeated labels' END AS reason, array_to_string(list_sort(parts), ', ') AS answer FROM p)
SELECT conv_id, reason, CASE WHEN reason IS NULL THEN sha256('system: Answer as JSON. | user: ' || u || ' | assistant: {"answer": ' || CAST(to_json(answer) AS VARCHAR) || '}') END AS record_sha256,
       CASE WHEN reason IS NULL THEN length(answer) END AS answer_chars, CASE WHEN reason IS NULL THEN length(u) > 400 END AS long_description FROM r
"""


def chat_text(spark, sf):
    """Chat text by a template of our own, and whether what is read back between the prompt and the first end mark after it is the answer."""
    e = _examples(spark, sf)
    prompt = F.concat(F.lit("<|system|>S<|end|><|user|>"), "user", F.lit("<|end|><|assistant|>"))
    rows = e.select("conv_id", "turn", "assistant", prompt.alias("prompt"), F.concat(prompt, "assistant", F.lit("<|end|>")).alias("body"))
    answer = F.substring_index(F.substring("body", F.length("prompt") + 1, F.length("body")), "<|end|>", 1)
    return rows.select("conv_id", "turn", F.sha2("body", 256).alias("digest"), (answer == F.col("assistant")).alias("exact_suffix"), F.length("prompt").cast("long").alias("prompt_chars"))


CHAT_TEXT = f"""
WITH {_EXAMPLES} SELECT conv_id, turn, sha256('<|system|>S<|end|><|user|>' || u || '<|end|><|assistant|>' || a || '<|end|>') AS digest, NOT contains(a, '<|end|>') AS exact_suffix,
CAST(length('<|system|>S<|end|><|user|>' || u || '<|end|><|assistant|>') AS BIGINT) AS prompt_chars FROM x
"""

QUERIES = {
    "chat_examples": chat_examples, "unused_turns": unused_turns, "role_contract": role_contract, "token_stats": token_stats, "mask_and_truncate": mask_and_truncate, "encoded_rows_valid": encoded_rows_valid,
    "pad_batches": pad_batches, "lexical_summary": lexical_summary, "pack_ffd": pack_ffd, "pack_report": pack_report, "prefix_cache_keys": prefix_cache_keys, "training_view": training_view, "chat_text": chat_text,
}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
