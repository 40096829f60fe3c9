"""Stable identifiers and order by hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u001f"


def stable_id(prefix: str, *parts: Column, separator: str = SEPARATOR) -> Column:
    """prefix + sha256 of the parts joined by the separator."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws(separator, *parts), 256))


def hex_mod(digest: Column, n: int) -> Column:
    """A hexadecimal string of any length, as a number modulo n, folded digit by digit."""
    if n < 1:
        raise ValueError("the modulus is at least 1")
    digits = F.transform(F.split(digest, ""), lambda d: F.conv(d, 16, 10).cast("long"))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0).cast("long"), lambda a, d: (a * 16 + d) % n)


def pick(key: Column, variants: list[str]) -> Column:
    """One of the variants, by sha256 of the key."""
    return F.get(F.array(*map(F.lit, variants)), hex_mod(F.sha2(key, 256), len(variants)).cast("int"))


def hash_rank(*parts: Column) -> Column:
    """The key of a hash order: sha256 of the parts joined by bars."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def prefix_cache_key(first_message: Column, prompt: Column) -> Column:
    """sha256 of the first message, or of the first 128 characters of the prompt without one."""
    return F.sha2(F.coalesce(first_message, F.substring(prompt, 1, 128)), 256)
