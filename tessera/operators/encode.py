"""Chat examples, prompt masks, truncation and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranges import ranked

IGNORED = -100
DEFAULT_SYSTEM = "You are a helpful assistant."


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_example(system: Column, user: Column, assistant: Column) -> Column:
    return F.array(message("system", system), message("user", user), message("assistant", assistant))


def role_contract(examples: DataFrame, id_col: str = "id", topic: str = "topic", messages: str = "messages") -> DataFrame:
    """``(id, reason)`` of each breach: blank id or topic, other roles than system, user, assistant in this order, blank content."""
    roles = F.transform(messages, lambda m: m["role"])
    wanted = F.array(*map(F.lit, ("system", "user", "assistant")))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    checks = {
        "blank id": blank(F.col(id_col).cast("string")),
        "blank topic": blank(F.col(topic).cast("string")),
        "wrong roles": ~F.coalesce(roles == wanted, F.lit(False)),
        "blank content": F.exists(F.coalesce(messages, F.array()), lambda m: blank(m["content"])),
    }
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]), lambda x: x.isNotNull())
    return examples.select(F.col(id_col).alias("id"), F.explode(found).alias("reason"))


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def token_ids(tokens: Column, vocabulary: int = 32_000) -> Column:
    """Ids of tokens by hash: deterministic, without a vocabulary file."""
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(vocabulary)).cast("int"))


def encode_pair(prompt: Column, answer: Column, limit: int) -> Column:
    """input_ids, attention_mask and labels of prompt and answer ids, cut at ``limit``; the prompt is masked."""
    full = F.concat(prompt, answer)
    ids = F.slice(full, 1, limit)
    masked = F.least(F.size(prompt), F.size(ids))
    labels = F.concat(F.array_repeat(F.lit(IGNORED), masked), F.slice(full, masked + 1, F.size(ids) - masked))
    return F.struct(
        ids.alias("input_ids"),
        F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"),
        labels.alias("labels"),
        F.size(full).alias("full_len"),
        F.size(prompt).alias("prompt_len"),
        F.size(answer).alias("answer_len"),
        (F.size(full) > limit).alias("truncated"),
        (F.size(ids) - masked).alias("supervised"),
    )


def prompt_boundary(offsets: Column, boundary: Column) -> Column:
    """Tokens of the prompt: those before the first whose start is at or past the boundary (character offsets)."""
    return F.size(F.filter(offsets, lambda o: o["start"] < boundary))


def valid_row(input_ids: Column, mask: Column, labels: Column) -> Column:
    """Equal non-zero lengths, a mask of 0 and 1, labels masked or equal to the id, at least one supervised."""
    same = (F.size(input_ids) == F.size(mask)) & (F.size(mask) == F.size(labels)) & (F.size(input_ids) > 0)
    bits = F.forall(mask, lambda m: m.isin(0, 1))
    match = F.forall(F.zip_with(input_ids, labels, lambda i, x: (x == IGNORED) | (x == i)), lambda ok: ok)
    return F.coalesce(same & bits & match & F.exists(labels, lambda x: x != IGNORED), F.lit(False))


def batches(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """``rows`` with ``batch``: their rank by ``order``, in batches of ``size``."""
    return ranked(rows, order).withColumn("batch", F.floor(F.col("rank") / F.lit(size)))


def pad(rows: DataFrame, batch: str, columns: dict[str, int], side: str = "right") -> DataFrame:
    """The array ``columns`` (name -> padding) filled up to the longest of each batch."""
    if side not in ("left", "right"):
        raise ValueError("side is left or right")
    first = next(iter(columns))
    width = F.max(F.size(first)).over(Window.partitionBy(batch))
    out = rows.withColumn("__width", width)
    for name, value in columns.items():
        fill = F.array_repeat(F.lit(value), F.col("__width") - F.size(name))
        out = out.withColumn(f"__{name}", F.concat(fill, F.col(name)) if side == "left" else F.concat(F.col(name), fill))
    return out.drop("__width", *columns).withColumnsRenamed({f"__{name}": name for name in columns})
