"""SimHash near-duplicate detection by pigeonhole blocks.

Fingerprint: a text is lower-cased (A-Z only) and cut at ``[\\x20\\x09-\\x0D]+``
into words; its ``shingle``-word shingles, repeats included, are hashed (XXH64,
seed 42); a fingerprint bit is 1 where over half of the hashes have it.  A text
with fewer words than a shingle has one shingle, the whole sequence; a text
without words, and a null text, has fingerprint zero.

Search: fingerprints at ``max_bits`` = 3 or fewer differing bits.  64 bits are cut
into four blocks of 16 and the other 48 of each choice into four of 12; three
differences leave one block of each kind untouched, so close pairs agree on one of
16 keys of 28 bits.  The expected number of strangers that share a key is n / 2^28.

Only distinct fingerprints are searched.  A key's fingerprints are compared in
tiles of ``TILE``: a key with more is dealt out as pairs of tiles, so no task holds
more than two tiles of one key, and a tile (pair) gives a spanning forest of its
links, not the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, cut, roots

TILE = 1024
MAX_BITS = 3


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; a text with fewer words has one, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.empty(n, np.int64)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    h64 = xxhash.xxh64_intdigest
    last = n - shingle + 1
    return np.fromiter(
        (h64(joined[a:b], 42) for a, b in zip(starts[:last].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, last
    )


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    hashes = shingle_hashes(text, shingle)
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long with the same bits."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _keys(fp: str) -> Column:
    """The 16 keys of a fingerprint: (number of the key << 28) | its 28 bits."""
    out = []
    for i in range(4):
        for j in range(4):
            left = [k for k in range(4) if k != i]
            # the 48 bits outside block i, in order; their sub-block j has bits 12j .. 12j+11
            rest = " | ".join(f"((shiftrightunsigned({fp}, {16 * k}) & 65535L) << {16 * p})" for p, k in enumerate(left))
            out.append(f"({(i * 4 + j)}L << 28) | ((shiftrightunsigned({fp}, {16 * i}) & 65535L) << 12) | (shiftrightunsigned({rest}, {12 * j}) & 4095L)")
    return F.expr(f"array({', '.join(out)})")


def _close(x: np.ndarray, y: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of x and y that differ in at most ``bits`` bits, in strips of bounded size."""
    out = []
    for k in range(0, len(x), 256):
        i, j = np.nonzero(np.bitwise_count(x[k : k + 256, None] ^ y[None, :]) <= bits)
        out.append((i + k, j))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _forest(bits: int):
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [np.empty((0, 2), np.int64)]
            pairs = [x for x in batch["fps"] if len(x) == 2]
            if pairs:  # nearly all keys: done at once
                p = np.stack(pairs).astype(np.int64)
                got.append(p[np.bitwise_count((p[:, 0] ^ p[:, 1]).view(np.uint64)) <= bits])
            for fps in batch["fps"]:
                if len(fps) > 2:
                    x = np.unique(np.asarray(fps, np.int64))
                    a, b = _close(x.view(np.uint64), x.view(np.uint64), bits)
                    root = roots(len(x), a[a < b], b[a < b])
                    off = np.nonzero(root != np.arange(len(x)))[0]
                    got.append(np.stack([x[off], x[root[off]]], axis=1))
            e = np.concatenate(got)
            yield pd.DataFrame({"a": e[:, 0], "b": e[:, 1]})

    return links


def links(fps: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` whose components are those of "at most ``max_bits`` bits apart".

    ``fps(fp)``: distinct fingerprints.  Every pair that links shares a key and
    meets in one tile or pair of tiles of it, where a spanning forest is kept."""
    if not 0 <= max_bits <= 3:
        raise ValueError("16 keys of two blocks each cover at most 3 bits")
    keyed = fps.select("fp", F.explode(_keys("fp")).alias("key"))
    # partial sums first: a hot key is a few rows here
    count = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = keyed.join(count, "key")
    tiles = F.ceil(F.col("c") / tile).cast("int")
    dealt = (
        shared.withColumn("t", tiles)
        .withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("t")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
        .select("fp", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    )
    groups = dealt.groupBy("key", "lo", "hi").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps")
    return groups.mapInPandas(_forest(max_bits), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``(<id_col>, fp, component_id)``.

    ``component_id`` is the smallest id reachable over links of at most
    ``max_bits`` bits, itself included.  Null ids never name a component: rows
    with one get the smallest id of their component, or null if it has none.
    Repeated ids each get a row; an empty table gives an empty result.  Other
    columns of ``docs`` are not read."""
    return _components(docs, id_col, text_col, shingle, max_bits).drop("root")


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    ids = cut(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle).alias("fp")))
    classes = cut(ids.groupBy("fp").agg(F.min("id").alias("low")))
    comps = cut(connected_components(links(classes.select("fp"), max_bits)))
    named = classes.join(comps, classes["fp"] == comps["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = cut(named.join(lows, "root").select("fp", "component_id", "root"))
    # (id, fp) rows only; a hot fingerprint's rows are a skewed side that adaptive execution splits
    return ids.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "root")


def near_duplicates_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component left, the one with the smallest id.

    All columns stay as they are.  Rows without an id stay.  Rows that repeat an id are
    told apart by their fingerprints: each counts in its own component, and where the
    smallest id of a component is on several of its rows, one of them stays; different
    texts that share an id but no component all stay."""
    found = cut(_components(docs, id_col, text_col, **options))
    return representatives(docs, found, "fp", fingerprint_column(F.col(text_col), options.get("shingle", 3)), id_col)


def representatives(docs: DataFrame, found: DataFrame, kind: str, of_text: Column, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that name their component in ``found(<id_col>, <kind>, component_id, root)``.

    ``of_text`` gives the ``kind`` of a row of ``docs``, by which rows that repeat an id are told apart.
    Components that such rows name with one id differ by ``root``."""
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    repeated = cut(found.groupBy(id_col).count().where(F.col("count") > 1).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__again")))
    if repeated.isEmpty():
        return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
    on = docs[id_col] == repeated["__again"]
    alone = docs.join(repeated, on, "left_anti")
    alone = alone.join(gone, alone[id_col] == F.col("__gone"), "left_anti")
    first = found.join(repeated, found[id_col] == F.col("__again")).where(F.col("component_id") == F.col("__again"))
    first = first.groupBy("__again", "root").agg(F.min(kind).alias("__first")).drop("root")
    rows = docs.join(repeated, on, "left_semi").withColumn("__kind", of_text)
    kept = rows.join(first, (rows[id_col] == first["__again"]) & (rows["__kind"] == first["__first"])).dropDuplicates([id_col, "__kind"]).select(*docs.columns)
    return alone.unionByName(kept)
