"""Near copies by word shingles: SimHash with pigeonhole blocks, then the similarity itself.

Two texts are near copies where the sets of their ``size`` = 5-word shingles (words as
in ``simhash``; fewer words: the whole sequence; none: the empty set) have a Jaccard
similarity of ``least`` = 0.8 or more; two empty sets are alike.

A set of shingles has a fingerprint of 256 bits, each 1 where over half of its shingles
have it.  At a similarity of 0.8 a bit differs with probability 0.15, about 39 bits in
all, too many for blocks that are sure to be untouched: blocks of ``b`` bits are drawn
from all 256, 5.5 / 0.85^b of them.  Were they independent a pair at 0.8 would share one with
probability ``1 - e^-5.5``; as they share bits it is less (README has what was measured),
and more for nearer pairs.  ``b`` is 8, and grows with the number of
texts so that a block's value is shared by some thousand strangers at any size: short blocks are few, and
what is shuffled is a row of 48 bytes for each block of a text.  What shares a
block is compared by Hamming distance: at most ``SURE`` bits link at once (at 0.8 that many
or fewer has a probability below 1e-5), up to ``OPEN`` bits are decided on the sets.

Equal sets are one class, compared once.  The members of a block's value are compared in
tiles, each pair that is open in the first block it shares; a tile gives spanning forests,
never all of its pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, cut, roots, written
from tessera.llm.simhash import representatives, shingle_hashes

BITS = 256
SURE = 12
OPEN = 60
TILE = 2048
#: pairs of a tile that are decided before it is asked again which are still apart
STEP = 4096
#: classes whose texts are asked for, some 16 bytes each, are broadcast to the texts up to this number; more are joined with them
BROADCAST_CLASSES = 200_000


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text, size))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The 256 bits of a set of hashes, as four words."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        x = hashes[k : k + (1 << 14), None] ^ _seeds()[None, :]
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


@functools.cache
def _seeds() -> np.ndarray:
    return np.random.default_rng(1).integers(0, 2**64, BITS // 64, np.uint64)


@functools.cache
def _weights(width: int, blocks: int) -> np.ndarray:
    """A column for each block: 2^j where the block's j-th bit is."""
    rng = np.random.default_rng(2)
    w = np.zeros((BITS, blocks))
    for k in range(blocks):
        w[rng.choice(BITS, width, replace=False), k] = 2.0 ** np.arange(width)
    return w


def block_values(words: np.ndarray, width: int, blocks: int) -> np.ndarray:
    """The values of the blocks of fingerprints ``words`` (n x 4), with their numbers above them."""
    bits = np.unpackbits(np.ascontiguousarray(words, "<u8").view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
    values = (bits.astype(np.float64) @ _weights(width, blocks)).astype(np.int64)
    return values + (np.arange(blocks, dtype=np.int64) << width)


def plan(n: int) -> tuple[int, int]:
    """Bits of a block and number of blocks for ``n`` texts."""
    width = min(40, max(8, math.ceil(math.log2(max(1, n))) - 10))
    return width, math.ceil(5.5 / 0.85**width)


def _described(text: Column, size: int) -> Column:
    @F.pandas_udf("struct<cls: long, fp: binary>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, size) for t in texts]
        return pd.DataFrame({"cls": pd.Series([_class(s.tobytes()) for s in sets], dtype="int64"), "fp": [wide_fingerprint(s).tobytes() for s in sets]})

    return of(text)


def _words(fps) -> np.ndarray:
    return np.frombuffer(b"".join(fps), "<u8").reshape(-1, BITS // 64)


def _near(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j of at most ``most`` differing bits with their distances, in strips of bounded size."""
    out = []
    for k in range(0, len(x), 128):
        d = np.zeros((min(128, len(x) - k), len(x)), np.int32)
        for w in range(x.shape[1]):
            d += np.bitwise_count(x[k : k + 128, w, None] ^ x[None, :, w])
        i, j = np.nonzero(d <= most)
        later = i + k < j
        out.append((i[later] + k, j[later], d[i[later], j[later]]))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3))


def _blocked(width: int, blocks: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 4096):
                part = batch.iloc[k : k + 4096]
                values = block_values(_words(part["fp"]), width, blocks)
                yield pd.DataFrame({"key": values.ravel(), "cls": part["cls"].repeat(blocks).to_numpy(), "fp": part["fp"].repeat(blocks).to_numpy()})

    return run


def _compared(width: int, blocks: int):
    """For each tile a spanning forest of its sure links, ``(a, b)``, and the members of open pairs, ``(key, lo, hi, a, fp)``."""

    def tile(key: int, lo: int, hi: int, cls: np.ndarray, fps: list) -> pd.DataFrame | None:
        x = _words(fps)
        i, j, d = _near(x, OPEN)
        if not len(i):
            return None
        sure = d <= SURE
        root = roots(len(x), i[sure], j[sure])
        off = np.nonzero(root != np.arange(len(x)))[0]
        i, j = i[~sure], j[~sure]
        apart = root[i] != root[j]
        first = first_shared(x, i[apart], j[apart]) == (key >> width)
        members = np.unique(np.concatenate([i[apart][first], j[apart][first]]))
        n, m = len(off), len(members)
        return pd.DataFrame(
            {
                "key": pd.array([None] * n + [key] * m, "Int64"),
                "lo": pd.array([None] * n + [lo] * m, "Int32"),
                "hi": pd.array([None] * n + [hi] * m, "Int32"),
                "a": np.concatenate([cls[off], cls[members]]),
                "b": pd.array([*cls[root[off]].tolist(), *[None] * m], "Int64"),
                "fp": [None] * n + [fps[k] for k in members],
            }
        )

    def first_shared(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        values = block_values(x, width, blocks)
        out = np.empty(len(i), np.int64)
        for k in range(0, len(i), 4096):
            out[k : k + 4096] = (values[i[k : k + 4096]] == values[j[k : k + 4096]]).argmax(axis=1)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for key, lo, hi, rows in zip(batch["key"], batch["lo"], batch["hi"], batch["rows"], strict=True):
                got = tile(key, lo, hi, np.array([r["cls"] for r in rows], np.int64), [r["fp"] for r in rows])
                if got is not None:
                    found.append(got)
            if found:
                yield pd.concat(found, ignore_index=True)

    return run


def _decided(least: float):
    """For each tile a spanning forest of the links among the members of its open pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rows in batch["rows"]:
                cls = [r["cls"] for r in rows]
                sets = [np.frombuffer(r["shingles"], "<u8") for r in rows]
                i, j, d = _near(_words([r["fp"] for r in rows]), OPEN)
                root = list(range(len(rows)))

                def top(k: int) -> int:
                    while root[k] != k:
                        root[k] = root[root[k]]
                        k = root[k]
                    return k

                order = np.argsort(d, kind="stable")
                i, j = i[order], j[order]
                for k in range(0, len(i), STEP):  # nearest pairs first; those that have come together meanwhile are passed over at once
                    now = np.array([top(m) for m in range(len(rows))])
                    apart = now[i[k : k + STEP]] != now[j[k : k + STEP]]
                    for a, b in zip(i[k : k + STEP][apart].tolist(), j[k : k + STEP][apart].tolist(), strict=True):
                        p, q = top(a), top(b)
                        if p != q and similar(sets[a], sets[b], least):
                            root[max(p, q)] = min(p, q)
                            out.append((cls[a], cls[b]))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common >= least * (len(both) - common)


def _tiles(rows: DataFrame, tile: int) -> DataFrame:
    """``rows(key, ...)`` dealt out as ``(key, lo, hi, rows)``: all members of a key, or pairs of tiles of a hot one."""
    hot = written(rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > tile))
    data = [c for c in rows.columns if c != "key"]
    dealt = (
        rows.join(hot, "key", "left")
        .withColumn("t", F.coalesce(F.ceil(F.col("c") / tile), F.lit(1)).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("t")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
        .select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), F.struct(*data).alias("row"))
    )
    return dealt.groupBy("key", "lo", "hi").agg(F.collect_list("row").alias("rows")).where("size(rows) > 1")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: ``(<id_col>, cls, component_id)``; rows with equal sets of shingles share ``cls``.

    ``component_id`` is the smallest id reachable over links of near copies, itself
    included.  Null texts are empty.  Null ids never name a component: rows with one
    get the smallest id of their component, or null if it has none.  Repeated ids each
    get a row; an empty table gives an empty result.  Other columns are not read."""
    return _components(docs, id_col, text_col, size, least, tile).drop("root")


def _components(docs: DataFrame, id_col: str, text_col: str, size: int, least: float, tile: int) -> DataFrame:
    ids = written(docs.select(F.col(id_col).alias("id"), _described(F.col(text_col), size).alias("d")).select("id", "d.cls", "d.fp"))
    classes = written(ids.groupBy("cls").agg(F.min("id").alias("low"), F.first("fp").alias("fp")))
    width, blocks = plan(classes.count())
    keyed = classes.select("cls", "fp").mapInPandas(_blocked(width, blocks), "key long, cls long, fp binary")
    compared = written(_tiles(keyed, tile).mapInPandas(_compared(width, blocks), "key long, lo int, hi int, a long, b long, fp binary"))
    links = compared.where("key IS NULL").select("a", "b")
    members = compared.where("key IS NOT NULL").select("key", "lo", "hi", F.col("a").alias("cls"), "fp")
    asked = written(members.select("cls").distinct())
    if many := asked.count():
        lows = written(classes.join(asked, "cls").select(F.col("low").alias("__low"), "cls"))
        lows = F.broadcast(lows) if many <= BROADCAST_CLASSES else lows
        # the texts of classes asked for: by the smallest id, and by class where ids are null or repeat
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(lows, F.col("id").eqNullSafe(F.col("__low")))
        sets = texts.select("cls", _packed(F.col("text"), size).alias("shingles"))
        sets = sets.where(F.col("cls") == _class_of(F.col("shingles"))).groupBy("cls").agg(F.first("shingles").alias("shingles"))
        full = members.join(sets, "cls").groupBy("key", "lo", "hi").agg(F.collect_list(F.struct("cls", "fp", "shingles")).alias("rows"))
        links = links.unionByName(written(full.select("rows").mapInPandas(_decided(least), "a long, b long")))
    comps = cut(connected_components(links))
    named = classes.join(comps, classes["cls"] == comps["node"], "left").select("cls", "low", F.coalesce("component", "cls").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_class = written(named.join(lowest, "root").select("cls", "component_id", "root"))
    return ids.select("id", "cls").join(by_class, "cls").select(F.col("id").alias(id_col), "cls", "component_id", "root")


def near_copies_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, tile: int = TILE) -> DataFrame:
    """``docs`` with one document of each component left, the one with the smallest id.

    All columns stay as they are.  Rows without an id stay.  Rows that repeat an id are
    told apart by their sets of shingles, as in ``simhash.near_duplicates_removed``."""
    found = written(_components(docs, id_col, text_col, size, least, tile))
    return representatives(docs, found, "cls", _class_of(_packed(F.col(text_col), size)), id_col)


def _packed(text: Column, size: int) -> Column:
    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, size).tobytes() for t in texts])

    return of(text)


def _class(shingles: bytes) -> int:
    """The class of a set of shingles, as a signed long: XXH3 of the sorted hashes, zero for the empty set."""
    h = xxhash.xxh3_64_intdigest(shingles) if shingles else 0
    return h - (h >> 63 << 64)


def _class_of(shingles: Column) -> Column:
    @F.pandas_udf("long")
    def of(sets: pd.Series) -> pd.Series:
        return pd.Series([_class(s) for s in sets], dtype="int64")

    return of(shingles)
