"""Exact, keyed and near-duplicate removal, similarity joins and contamination counts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import let, shingle_hashes
from tessera.session import bound_batches, cut


def check_threshold(t: float) -> float:
    if isinstance(t, bool) or not isinstance(t, int | float) or not 0 < t <= 1:
        raise ValueError(f"a similarity threshold lies in (0, 1], not {t!r}")
    return float(t)


def duplicate_marks(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """``(<order>, is_duplicate)``: true for all but the first row, by ``order``, of each key; a null key is empty.

    The key is taken once, as a digest, and only digests are shuffled.  The first of
    each comes from a grouped minimum, partly summed before the shuffle: a key with
    very many rows is no trouble."""
    keyed = cut(rows.select(order, F.sha2(F.coalesce(key, F.lit("")), 256).alias("__key")))
    first = cut(keyed.groupBy("__key").agg(F.min(order).alias("__first"), F.count("*").alias("__n")).where("__n > 1"))  # keys met once have no part in the join
    marked = keyed.join(first, "__key", "left")
    return marked.select(order, F.coalesce(F.col(order) != F.col("__first"), F.lit(False)).alias("is_duplicate"))


#: rows of some bytes up to which a side is broadcast
BROADCAST_ROWS = 1_000_000


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, which are written down and narrow, with a broadcast where they are few, so that the wide side of a join is not shuffled."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def exact_duplicates(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """``rows`` with ``is_duplicate``; ``order`` identifies a row.  The ids of duplicates are joined, not the texts."""
    gone = cut(duplicate_marks(rows, key, order).where("is_duplicate").select(F.col(order).alias("__gone")).distinct())
    joined = rows.join(_small(gone), F.col(order) == F.col("__gone"), "left")
    return joined.withColumn("is_duplicate", F.col("__gone").isNotNull()).drop("__gone")


def keyed_first(rows: DataFrame, key: str, content: list[Column]) -> DataFrame:
    """One row per key, the one whose content hash is smallest: the order of the input plays no part."""
    digest = F.sha2(F.concat_ws("\u001f", *content), 256)
    packed = F.struct(digest.alias("__digest"), F.struct(*rows.columns).alias("row"))
    return rows.groupBy(F.col(key).alias("__k")).agg(F.min_by(packed, digest).alias("p")).select("p.row.*")


def shingle_sets(rows: DataFrame, id_col: str, text: Column, size: int = 4) -> DataFrame:
    """``(id, s, n)``: distinct shingles as sorted 64-bit hashes and their number; cut off from the text."""
    return cut(rows.select(F.col(id_col).alias("id"), shingle_hashes(text, size).alias("s"))).withColumn("n", F.size("s").cast("long"))


def _prefixes(sets: DataFrame, common: DataFrame, threshold: float) -> DataFrame:
    """Of the rarest n - ceil(t n) + 1 shingles of each set those that are in ``common``: two sets that are similar share one of them.

    Shingles of one set only come first in the order and need no place in it: they are
    counted, not sorted."""
    ranked = sets.select("id", "n", F.explode("s").alias("h")).join(_small(common), "h")
    mine = Window.partitionBy("id")
    position = F.row_number().over(mine.orderBy("f", "h")) + F.col("n") - F.count("*").over(mine)
    return ranked.withColumn("p", position).where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).select("id", "n", "h", "f")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - shared
    return F.when(whole == 0, 1.0).otherwise(shared / whole)


#: rows of one key in a tile
TILE = 4096


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], place: str, tile: int = TILE, count: str | None = None) -> DataFrame:
    """``left`` and ``right`` joined on ``keys``; those that many rows have are dealt out.

    ``count`` is a column of both with the rows that a key has, where it is known; it goes.

    Rows of ``right`` with a key go to tiles of about ``tile`` by a hash of ``place``, a
    column of theirs, and each row of ``left`` meets all tiles of its key: no task holds
    more than a tile of a hot key, and nothing is left out."""
    if count:
        left, right = (side.withColumn("__t", F.ceil(F.col(count) / tile).cast("int")).drop(count) for side in (left, right))
    else:
        tiles = right.groupBy(*keys).agg(F.ceil(F.count("*") / tile).cast("int").alias("__t"))
        left, right = left.join(tiles, keys), right.join(tiles, keys)
    right = right.withColumn("__tile", F.pmod(F.xxhash64(place, F.lit(5)), F.col("__t")).cast("int")).drop("__t")
    left = left.withColumn("__tile", F.explode(F.sequence(F.lit(0), F.col("__t") - 1))).drop("__t")
    return left.join(right, [*keys, "__tile"]).drop("__tile")


#: sets, and shingles in them, of a cell's side
CELL_SETS, CELL_SHINGLES = 1 << 10, 1 << 19


def _compared(cells: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, jaccard)`` of cells ``(x, y, e)``, the sets of both sides as ``(id, s)`` and the candidates as ``(a, b)``; a cell is in memory at a time."""

    def run(batches):
        for batch in batches:
            for x, y, e in zip(*(batch.column(c) for c in "xye"), strict=True):
                (left, at, ids), (right, to, others) = ((s.values.to_numpy(), s.offsets.to_numpy(), v.field("id")) for v in (x.values, y.values) for s in [v.field("s")])
                a, b = e.values.field("a"), e.values.field("b")
                ia, ib = pc.index_in(a, value_set=ids).to_numpy(), pc.index_in(b, value_set=others).to_numpy()
                by = np.argsort(ia, kind="stable")
                found = np.empty(len(ia))
                for own in np.split(by, np.flatnonzero(np.diff(ia[by])) + 1):
                    mine = np.sort(left[at[ia[own[0]]] : at[ia[own[0]] + 1]])
                    theirs = np.concatenate([right[to[k] : to[k + 1]] for k in ib[own]])
                    sizes = to[ib[own] + 1] - to[ib[own]]
                    hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs if len(mine) else np.zeros(len(theirs), bool)
                    upto = np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(sizes)])]
                    shared = np.diff(upto)
                    whole = len(mine) + sizes - shared
                    found[own] = np.where(whole == 0, 1.0, shared / np.maximum(whole, 1))
                keep = np.flatnonzero(found >= threshold)
                yield pa.RecordBatch.from_arrays([a.take(pa.array(keep)), b.take(pa.array(keep)), pa.array(found[keep])], names=["a", "b", "jaccard"])

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema["e"].dataType.elementType}
    return cells.select("x", "y", "e").mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}, jaccard double")


#: ``(id, s)``, or what makes it for some ids, so that other sets are not made
Sets = DataFrame | Callable[[DataFrame], DataFrame]


def _verified(candidates: DataFrame, left: Sets, right: Sets, threshold: float) -> DataFrame:
    """Of ``candidates(a, b, na, nb)`` those at least that similar, as ``(a, b, jaccard)``; only sets that have a candidate are made and moved.

    A candidate's place is the smallest a that its b has.  Sets that are alike have one
    in common, so a set is moved about once, not once for each of its candidates; a place
    with many sets is dealt out into cells, which have a bounded number of them."""
    bound_batches(candidates.sparkSession)
    candidates = cut(candidates.select("a", "b", "na", "nb"))
    placed = candidates.join(candidates.groupBy("b").agg(F.min("a").alias("place")), "b")
    ends = [placed.select("place", F.lit(x).alias("side"), F.col(x).cast("string").alias("id"), F.col(f"n{x}").alias("n")) for x in "ab"]
    held = ends[0].unionAll(ends[1]).distinct().groupBy("place").agg(F.ceil(F.greatest(F.sum("n") / CELL_SHINGLES, F.count("*") / CELL_SETS)).cast("int").alias("t"))
    placed = placed.join(_small(cut(held.where("t > 1"))), "place", "left").withColumn("t", F.coalesce("t", F.lit(1)))
    cell = ["place", "ta", "tb"]
    cells = cut(placed.select("place", *[F.pmod(F.xxhash64(x, F.lit(6)), F.col("t")).cast("int").alias(f"t{x}") for x in "ab"], "a", "b"))

    def brought(sets: Sets, sides: str, name: str) -> DataFrame:
        wanted = cells.select(*cell, F.col(sides[0]).alias("id"))
        wanted = cut((wanted.unionAll(cells.select(*cell, F.col(sides[1]).alias("id"))) if sides[1:] else wanted).distinct())
        ids = _small(cut(wanted.select("id").distinct()))
        asked = sets(ids) if callable(sets) else sets.join(ids, "id", "left_semi")
        return asked.select("id", "s").join(_small(wanted), "id").groupBy(*cell).agg(F.collect_list(F.struct("id", "s")).alias(name))

    sets = brought(left, "ab", "x").withColumn("y", F.col("x")) if left is right else brought(left, "a", "x").join(brought(right, "b", "y"), cell)
    return _compared(sets.join(cells.groupBy(*cell).agg(F.collect_list(F.struct("a", "b")).alias("e")), cell), threshold)


def _close_sizes(a: str, b: str, t: float) -> Column:
    return (F.col(b) >= F.ceil(F.col(a) * F.lit(t) - 1e-9)) & (F.col(a) >= F.ceil(F.col(b) * F.lit(t) - 1e-9))


def _copies_of_sets(marks: DataFrame) -> DataFrame:
    """``(id, class)`` of ``marks(id, n, u, v)`` whose n, u and v an earlier one has."""
    first = marks.groupBy("n", "u", "v").agg(F.min("id").alias("class"), F.count("*").alias("c"))
    return cut(marks.join(first.where("c > 1").drop("c"), ["n", "u", "v"]).where("id <> class").select("id", "class"))


def equal_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members): ``(id, s, n)`` with each set once, under the smallest of its ids, and ``(id, class)``.

    Sets are told apart by 128 bits of hashes and their size; the sets themselves are not shuffled where few are copies.  ``sets`` is written down, its ids are distinct."""
    copies = _copies_of_sets(cut(sets.select("id", "n", F.xxhash64("s").alias("u"), F.xxhash64(F.lit(1), "s").alias("v"))))
    classes = sets.join(_small(copies.select("id")), "id", "left_anti")
    return classes, cut(copies.unionAll(classes.select("id", F.col("id").alias("class"))))


#: documents that the order of shingles is made from, and how many of them have a shingle that is frequent
ORDER_SETS, ORDER_LEAST = 10_000, 5


def _frequent(sets: DataFrame) -> np.ndarray:
    """Shingles that come last in the order of all, the most frequent last; of any input the order is right, this one makes prefixes rare.

    Frequencies are those among about ORDER_SETS sets, by hashes of their ids: what is held follows from the two constants, not from the input."""
    n = max(1, sets.count())
    share = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30)) < int(min(1.0, ORDER_SETS / n) * (1 << 30))
    each = sets.where(share).select(F.explode_outer("s").alias("h")).where("h IS NOT NULL")  # explode() would have s made twice, to see whether it is empty
    found = each.groupBy("h").agg(F.count("*").alias("f")).where(F.col("f") >= ORDER_LEAST)
    return found.orderBy("f", "h").select("h").toArrow().column("h").to_numpy()


#: shingles of a set for each that two similar ones must have in common in their prefixes, beyond the first
SHARED_EACH = 64


def _least_shared(n: Column, threshold: float) -> Column:
    """Shingles of its prefix that a set of n has in common with a similar one's, if that demands no fewer."""
    return F.least(F.lit(1) + F.floor(n / SHARED_EACH), F.ceil(n * F.lit(threshold) - 1e-9))


def set_marks(sets: DataFrame, threshold: float, *others: str, order: np.ndarray | None = None) -> DataFrame:
    """``(id, *others, n, u, v, p)`` of ``sets(id, s, *others)``: size, 128 bits of hashes and prefix of each set; row by row, without a shuffle, and not written down.

    The prefix is the first n - ceil(t n) + k shingles by ``order``, or _frequent(), and
    else by hash.  Two similar sets have ceil(t n) shingles in common at least, so the
    first k of these are in both prefixes; k is a bit more than 1 for larger sets, whose
    prefixes are met by chance."""
    last = _frequent(sets) if order is None else order
    by_hash = np.argsort(last, kind="stable")
    known = sets.sparkSession.sparkContext.broadcast((last[by_hash], by_hash.astype(np.int64) + 1))

    def mixed(h: np.ndarray, seed: int) -> np.ndarray:
        x = h.view(np.uint64) + np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def run(batches):
        hashes, places = known.value
        for batch in batches:
            s = batch.column("s")
            h, starts = s.flatten().to_numpy(zero_copy_only=False).astype(np.int64), s.offsets.to_numpy().astype(np.int64)
            starts, n = starts - starts[0], np.diff(starts)
            row = np.repeat(np.arange(len(n)), n)
            place = np.zeros(len(h), np.int64)
            if len(hashes) and len(h):
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                place = np.where(hashes[at] == h, places[at], 0)
            by = np.argsort(row * (len(hashes) + 1) + place, kind="stable")  # a set is sorted by hash
            least = np.ceil(n * threshold - 1e-9).astype(np.int64)
            keep = by[np.arange(len(h)) - np.repeat(starts[:-1], n) < (n - least + np.minimum(1 + n // SHARED_EACH, least))[row]]
            sums = []
            for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
                upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h, seed), dtype=np.uint64)])
                sums.append(pa.array((upto[starts[1:]] - upto[starts[:-1]]).view(np.int64)))
            p = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(n)))]).astype(np.int32)), pa.array(h[keep]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", *others)], pa.array(n), *sums, p], names=["id", *others, "n", "u", "v", "p"])

    kinds = ", ".join(f"{c} {sets.schema[c].dataType.simpleString()}" for c in ("id", *others))
    return sets.select("id", *others, "s").mapInArrow(run, f"{kinds}, n long, u long, v long, p array<long>")


def _ordered_prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """``(id, n, h)``: a row for each shingle of set_marks()'s prefixes."""
    return set_marks(sets, threshold).select("id", "n", F.explode("p").alias("h"))


#: bits that tell whether a shingle is in two prefixes, at most; as many for each such shingle
MET_BITS, MET_EACH = 1 << 27, 16


def _met_prefixes(marks: DataFrame) -> DataFrame:
    """``(h, f, id, n)``: shingles of prefixes ``p`` that others have too, but for chance; f is how many, if more than TILE have it, else 1.

    Counted by 32 of their bits.  What is met is a bitmap of bounded size, so prefixes go
    through it where they are, and only the few that remain are shuffled."""
    met = cut(marks.select(F.explode("p").alias("h")).groupBy(F.shiftright("h", 32).cast("int").alias("g")).agg(F.count("*").alias("f")).where("f > 1"))
    size = min(MET_BITS, max(1 << 15, 1 << (MET_EACH * met.count()).bit_length()))
    x = F.col("g").bitwiseAND(size - 1)
    blocks = met.groupBy(F.shiftright(x, 15).alias("block")).agg(F.bitmap_construct_agg(x.bitwiseAND((1 << 15) - 1).cast("long")).alias("bits")).toArrow()
    bits = np.zeros((size >> 15, 1 << 12), np.uint8)
    for block, part in zip(blocks.column("block").to_pylist(), blocks.column("bits").to_pylist(), strict=True):
        bits[block] = np.frombuffer(part, np.uint8)
    known = marks.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def run(batches):
        for batch in batches:
            p = batch.column("p")
            h = p.flatten().to_numpy(zero_copy_only=False)
            at = (h >> 32) & (size - 1)
            keep = np.flatnonzero(known.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            row = pa.array(np.repeat(np.arange(len(p)), np.diff(p.offsets.to_numpy()))[keep])
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), batch.column("id").take(row), batch.column("n").take(row)], names=["h", "id", "n"])

    rows = marks.select("id", "n", "p").mapInArrow(run, f"h long, id {marks.schema['id'].dataType.simpleString()}, n long")
    hot = cut(met.where(F.col("f") > TILE))
    if hot.isEmpty():
        return rows.withColumn("f", F.lit(1).cast("long"))
    return rows.withColumn("g", F.shiftright("h", 32).cast("int")).join(_small(hot), "g", "left").withColumn("f", F.coalesce("f", F.lit(1))).drop("g")


def classes_of(marks: DataFrame, sets: Sets, threshold: float) -> tuple[DataFrame, DataFrame]:
    """similar_classes() of the ``sets`` that have a row in ``marks``, which are written down; others have no part.

    Sets that have a candidate are asked for again; they need not be stored."""
    copies = _copies_of_sets(marks.select("id", "n", "u", "v"))
    classes = marks.join(_small(copies.select("id")), "id", "left_anti")
    met = _met_prefixes(classes)
    left, right = met.select("h", "f", F.col("id").alias("a"), F.col("n").alias("na")), met.select("h", "f", F.col("id").alias("b"), F.col("n").alias("nb"))
    shared = dealt_join(left, right, ["h"], "b", count="f").where((F.col("a") < F.col("b")) & _close_sizes("na", "nb", threshold)).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    candidates = shared.where(F.col("k") >= F.least(*[_least_shared(F.col(n), threshold) for n in ("na", "nb")]))
    return cut(_verified(candidates, sets, sets, threshold)), cut(copies.unionAll(classes.select("id", F.col("id").alias("class"))))


def similar_classes(sets: DataFrame, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): ``(a, b, jaccard)`` between classes of equal sets at least that similar, a < b, and ``(id, class)``.

    A class is named by its smallest id; empty sets are equal to each other.  Exact:
    prefix filter in one order of shingles, the frequent ones last, length filter, then
    the sets themselves.  Copies are never paired with each other, however many there are."""
    bound_batches(sets.sparkSession)
    t = check_threshold(threshold)
    return classes_of(cut(set_marks(sets, t)), sets, t)


def similar_pairs(sets: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``(a, b, jaccard)`` with a < b: all pairs of ``sets(id, s, n)`` at least that similar, copies written out.

    Their number is the square of a class of copies: where only components, links or
    removals are wanted, similar_classes() has it all without that."""
    pairs, member = similar_classes(sets, threshold)
    ends = member.select(F.col("id").alias("y"), F.col("class").alias("b"))
    across = pairs.join(member.select(F.col("id").alias("x"), F.col("class").alias("a")), "a").join(ends, "b").select("x", "y", "jaccard")
    within = member.select(F.col("id").alias("x"), F.col("class")).join(ends, F.col("class") == F.col("b")).where("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    return across.unionAll(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def near_duplicates(sets: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``(id)`` that a scan in order of ids drops, as greedy_removal() of all pairs would."""
    return dropped_of(*similar_classes(sets, threshold))


def dropped_of(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """``(id)`` that a scan drops, from the pairs and members of similar_classes().

    Of equal sets only the first can stay: if it is dropped for a kept earlier row, so
    are the others, and else they are for it.  So only the first takes part in rounds."""
    return greedy_removal(pairs).unionAll(member.where(F.col("id") != F.col("class")).select("id")).distinct()


#: shingles of one side, eight bytes each, up to which they are broadcast to the other side's
BROADCAST_SHINGLES = 1_000_000


def shared_shingles(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(h, f)``: shingles that are on both sides, and in how many sets; ``right`` is the side with fewer.

    Only what ``right`` has is counted on the left, so what is shuffled follows the smaller side."""
    theirs = cut(right.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("fr")))
    few = theirs.select("h")
    few = F.broadcast(few) if theirs.count() <= BROADCAST_SHINGLES else few
    ours = left.select(F.explode("s").alias("h")).join(few, "h", "left_semi").groupBy("h").agg(F.count("*").alias("fl"))
    return cut(theirs.join(ours, "h").select("h", (F.col("fr") + F.col("fl")).alias("f")))


def cross_similar_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``(a, b, jaccard)``: a of ``left``, b of ``right``, both ``(id, s, n)``, at least that similar; ``right`` is the side with fewer sets."""
    t = check_threshold(threshold)
    common = shared_shingles(left, right)
    a = _prefixes(left, common, t).select("h", "f", F.col("id").alias("a"), F.col("n").alias("na"))
    b = _prefixes(right, common, t).select("h", "f", F.col("id").alias("b"), F.col("n").alias("nb"))
    candidates = dealt_join(b, a, ["h"], "a", count="f").where(_close_sizes("na", "nb", t)).select("a", "b", "na", "nb").distinct()
    empty = left.where("n = 0").select(F.col("id").alias("a"), "n").join(right.where("n = 0").select(F.col("id").alias("b"), "n"), "n").select("a", "b", F.lit(1.0).alias("jaccard"))
    return _verified(candidates, left, right, t).unionAll(empty)


def contained_pairs(items: DataFrame, docs: DataFrame, share: float) -> DataFrame:
    """``(a, b, share)``: sets b of ``docs`` that hold at least that share of the shingles of a, of ``items``; both ``(id, s, n)``.

    A set with that share has one of the rarest n - ceil(share n) + 1 shingles of the item: only by these are they paired, and then counted.  Empty items are in none."""
    t = check_threshold(share)
    prefix = cut(_prefixes(items, shared_shingles(docs, items), t).select("h", F.col("id").alias("a")))
    hits = docs.select(F.col("id").alias("b"), F.explode("s").alias("h")).join(_small(cut(prefix.select("h").distinct())), "h", "left_semi")
    candidates = cut(dealt_join(prefix, hits, ["h"], "b").select("a", "b").distinct())
    met = docs.join(_small(cut(candidates.select(F.col("b").alias("id")).distinct())), "id", "left_semi")
    with_a = candidates.join(items.select(F.col("id").alias("a"), F.col("s").alias("sa"), "n"), "a")
    both = with_a.join(met.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", (F.size(F.array_intersect("sa", "sb")) / F.col("n")).alias("share")).where(F.col("share") >= t)


def minhash(sets: DataFrame, permutations: int = 64) -> DataFrame:
    """``(id, signature)``: the minimum of each of ``permutations`` hashes over the set; nulls for an empty one.

    The low 32 bits x of an element become (a x + b) mod the prime beyond 2^32, with a and
    b from a fixed rule: row by row, without a shuffle."""
    rule = coefficients(permutations)

    @F.arrow_udf("array<bigint>")
    def signatures(s: pa.Array) -> pa.Array:
        sizes = np.diff(s.offsets.to_numpy())
        if s.null_count:
            sizes = np.where(s.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
        x = (s.flatten().to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFFFFFF).astype(np.uint64)
        full = np.nonzero(sizes)[0]
        starts = np.concatenate([[0], np.cumsum(sizes[full])])
        least, i = np.zeros((len(sizes), permutations), np.int64), 0
        while i < len(full):  # a stretch of sets that stays in the cache
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + STRETCH, "right")) - 1)
            part, at = x[starts[i] : starts[j]], starts[i:j] - starts[i]
            for k, (a, b) in enumerate(rule):
                y = part * np.uint64(a) + np.uint64(b)
                y -= y // np.uint64(PRIME) * np.uint64(PRIME)
                least[full[i:j], k] = np.minimum.reduceat(y, at)
            i = j
        mask = np.repeat(sizes == 0, permutations)
        offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * permutations)
        return pa.ListArray.from_arrays(offsets, pa.array(least.ravel(), mask=mask))

    return sets.select("id", signatures("s").alias("signature"))


#: numbers of a stretch of sets
STRETCH = 1 << 15
PRIME = 4_294_967_311


def coefficients(permutations: int) -> list[tuple[int, int]]:
    """The a (odd, below 2^30) and b of each permutation, by a multiplicative rule; products stay below 2^63."""
    return [((k + 1) * 2_654_435_761 % (1 << 30) | 1, (k + 1) * 2_246_822_519 % (1 << 32)) for k in range(permutations)]


def minhash_candidates(signatures: DataFrame, bands: int = 16) -> DataFrame:
    """``(a, b)``, a < b, that agree on a band; a proposal only, to be verified.

    Of equal sets one is enough (equal_classes()): copies agree on all bands, and their pairs are the square of their number."""
    width = F.floor(F.size("signature") / F.lit(bands)).cast("int")
    cells = signatures.where(F.get("signature", F.lit(0)).isNotNull()).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.slice("signature", i * width + 1, width)))).alias("band", "cell"))
    a, b = cells.select(F.col("id").alias("a"), "band", "cell"), cells.select(F.col("id").alias("b"), "band", "cell")
    return dealt_join(a, b, ["band", "cell"], "b").where("a < b").select("a", "b").distinct()


def greedy_removal(pairs: DataFrame) -> DataFrame:
    """``(id)`` dropped by a scan in order that drops a row with a kept earlier neighbour.

    ``pairs(a, b)``, a < b.  Rounds: a row no undecided or kept earlier neighbour is
    left to decide is kept, its later neighbours are dropped; the rounds follow the
    longest chain, not the rows, and only rows with a neighbour take part.  Each round
    decides a row at least, so they end."""
    edges = cut(pairs.select("a", "b").distinct())
    dropped = cut(edges.select(F.col("b").alias("id")).limit(0))
    while not edges.isEmpty():
        # kept: starts an edge and ends none
        kept = edges.select(F.col("a").alias("id")).distinct().join(edges.select(F.col("b").alias("id")), "id", "left_anti")
        gone = cut(edges.join(kept.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        dropped = cut(dropped.unionAll(gone))
        left = edges.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        edges = cut(left.join(kept.withColumnRenamed("id", "a"), "a", "left_anti"))
    return dropped


def first_ids(rows: DataFrame, key: str, id_col: str, k: int, name: str) -> DataFrame:
    """``(key, <name>)``: the ``k`` smallest ids of each key, in order.

    A limit by rank is taken in each task before the shuffle too, so a key leaves a task with at most ``k`` ids."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(id_col))
    few = rows.where(F.col(id_col).isNotNull()).select(key, id_col, place.alias("__place")).where(F.col("__place") <= k)
    return few.groupBy(key).agg(F.array_sort(F.collect_list(id_col)).alias(name))


def key_overlap(left: DataFrame, right: DataFrame, key: Column, left_id: str, right_id: str) -> DataFrame:
    """``(key, left_ids, right_ids)`` for keys on both sides: how many ids each has, and the first three."""
    def grouped(rows: DataFrame, id_col: str, name: str) -> DataFrame:
        keyed = rows.select(key.alias("key"), F.col(id_col).alias("i")).where("key IS NOT NULL")
        counts = keyed.groupBy("key").agg(F.count("*").alias(f"{name}_rows"))
        return counts.join(first_ids(keyed, "key", "i", 3, f"{name}_ids"), "key", "left")

    return grouped(left, left_id, "left").join(grouped(right, right_id, "right"), "key")


def leaks(rows: DataFrame, train: DataFrame, input_key: Column, group: str) -> DataFrame:
    """Rows whose normalised input or whose group is in ``train``: two semi joins, no OR."""
    keyed, seen = rows.withColumn("__input", input_key), train.select(input_key.alias("__input"), F.col(group).alias("__group"))
    by_input = keyed.join(seen.select("__input").distinct(), "__input", "left_semi")
    by_group = keyed.join(seen.select(F.col("__group").alias(group)).distinct(), group, "left_semi").select(by_input.columns)
    return by_input.unionAll(by_group).drop("__input").distinct()
