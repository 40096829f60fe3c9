"""A stored index for similarity joins: a batch of texts is compared with all before it, without reading them again.

Kept in tables: the prefix of each set that the filter needs, bucketed by shingle, the texts, of which only those with a candidate become sets again,
and the order of shingles.  The prefix filter holds for any order that all sets share, so the order is made once, from the first batch, and
stays: shingles that are not in it are the rarest, by hash.  A batch's rows count from when its name is in the log, which is written last;
what a lost run has left has a name that is not."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import shingle_hashes
from tessera.operators import dedup
from tessera.session import bound_batches, cut

#: columns, and what a table is bucketed and sorted by
_TABLES = {
    "sets": ("batch STRING, id BIGINT, n BIGINT, kept BOOLEAN", "id", "id"),
    "texts": ("batch STRING, id BIGINT, text STRING", None, None),
    "prefixes": ("batch STRING, h BIGINT, id BIGINT, n BIGINT", "h", "id"),
    "shingles": ("batch STRING, h BIGINT, f BIGINT", None, None),
}


class SimilarityIndex:
    """Pairs and removals at one threshold, over batches whose ids grow from one to the next.

    ``name`` is the prefix of the tables in the session's catalog, ``folder`` where they lie, shared by all machines; an index
    that exists there is gone on with, in this session or another.  One writer at a time."""

    def __init__(self, spark: SparkSession, name: str, folder: str, threshold: float = 0.85, size: int = 4, buckets: int = 32):
        self.spark, self.name, self.folder = spark, name, folder.rstrip("/")
        self.threshold, self.size, self.buckets = dedup.check_threshold(threshold), size, buckets
        for table, (columns, key, by) in _TABLES.items():
            placed = f"CLUSTERED BY ({key}) SORTED BY ({by}) INTO {buckets} BUCKETS" if key else ""
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_{table} ({columns}) USING parquet OPTIONS (compression 'zstd') {placed} LOCATION '{self.folder}/{table}'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_log (batch STRING, rows BIGINT, last BIGINT) USING parquet LOCATION '{self.folder}/log'")

    def batches(self) -> list[str]:
        """Names of the batches that are in; one row for each is read."""
        self.spark.catalog.refreshTable(f"{self.name}_log")
        return [r["batch"] for r in self.spark.table(f"{self.name}_log").collect()]

    def table(self, table: str, batches: list[str] | None = None) -> DataFrame:
        self.spark.catalog.refreshTable(f"{self.name}_{table}")
        return self.spark.table(f"{self.name}_{table}").where(F.col("batch").isin(self.batches() if batches is None else batches)).drop("batch")

    def _append(self, rows: DataFrame, table: str, batch: str) -> None:
        columns, key, by = _TABLES[table]
        names = [c.split()[0] for c in columns.split(", ")]
        rows = rows.select(*names[1:])
        placed = (rows.repartition(self.buckets, key) if key else rows).withColumn("batch", F.lit(batch)).select(*names)  # the name, equal in all rows, is not shuffled
        writer = placed.write.mode("append").format("parquet")
        (writer.bucketBy(self.buckets, key).sortBy(by) if key else writer).saveAsTable(f"{self.name}_{table}")

    def _order(self, batches: list[str]) -> np.ndarray:
        """The frequent shingles of the first batch, of bounded number, the most frequent last."""
        return self.table("shingles", batches).orderBy("f").select("h").toArrow().column("h").to_numpy()

    def _sets(self, texts: DataFrame) -> DataFrame:
        return texts.select("id", shingle_hashes(F.col("text"), self.size).alias("s"))

    def _met(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """``(a, b, na, nb)``, a of ``old``, b of ``new``: sets that share a prefix shingle and are near in size.

        The index is read by its buckets and not shuffled; shingles that very many of its sets have are dealt out."""
        hot = cut(old.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > dedup.TILE).select("h"))
        left, right = new.select("h", F.col("id").alias("b"), F.col("n").alias("nb")), old.select("h", F.col("id").alias("a"), F.col("n").alias("na"))
        near = dedup._close_sizes("na", "nb", self.threshold)
        if hot.isEmpty():
            return left.join(right, "h").where(near).select("a", "b", "na", "nb")
        plain = left.join(hot, "h", "left_anti").join(right, "h").where(near)
        return plain.select("a", "b", "na", "nb").unionAll(dedup.dealt_join(left.join(hot, "h", "left_semi"), right.join(hot, "h", "left_semi"), ["h"], "a").where(near).select("a", "b", "na", "nb"))

    def add(self, rows: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Adds a batch; ``(pairs, members, dropped)`` that it brings, written down.

        ``pairs(a, b, jaccard)``: at least that similar, b a class of equal sets of this batch, named by its smallest id, and a such a class of this or an earlier batch.
        ``members(id, class)`` of this batch.  ``dropped(id)``: what a scan of all batches in the order of ids drops for a kept earlier row.
        Ids must be distinct and above all before; an empty batch adds nothing."""
        last = self.spark.table(f"{self.name}_log").agg(F.max("last")).first()[0]
        bound_batches(self.spark)
        texts = rows.select(F.col(id_col).alias("id"), text.alias("text"))
        batches, batch = self.batches(), uuid.uuid4().hex
        order = self._order(batches) if batches else dedup._frequent(self._sets(texts))
        marks = cut(dedup.set_marks(self._sets(texts), self.threshold, order=order))
        many, distinct, least, most = marks.agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id")).first()
        if many != distinct or (many and last is not None and least <= last):
            raise ValueError("ids of a batch are distinct and above those of the batches before it")
        within, members = dedup.classes_of(marks, lambda ids: self._sets(texts.join(ids, "id", "left_semi")), self.threshold)
        copies = dedup._small(cut(members.where("id <> class").select("id")))
        classes = marks.join(copies, "id", "left_anti").select("id", "n", "p")
        if not batches:
            self._append(self.spark.createDataFrame(pa.table({"h": order, "f": np.arange(len(order))})), "shingles", batch)
        prefix = classes.select(F.explode("p").alias("h"), "id", "n")
        held, held_texts = self.table("sets", batches), self.table("texts", batches)
        shared = self._met(prefix, self.table("prefixes", batches)).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
        met = shared.where(F.col("k") >= F.least(*[dedup._least_shared(F.col(n), self.threshold) for n in ("na", "nb")]))
        across = dedup._verified(met, *[lambda ids, side=side: self._sets(side.join(ids, "id", "left_semi")) for side in (held_texts, texts)], self.threshold)
        empty = held.where("n = 0").select(F.col("id").alias("a"), "n").join(classes.where("n = 0").select(F.col("id").alias("b"), "n"), "n").select("a", "b", F.lit(1.0).alias("jaccard"))
        across = cut(across.unionAll(empty))
        # rows that an earlier batch kept drop theirs at once; only the others go through the rounds of a scan
        gone = cut(across.join(held.where("kept").select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        left = within.join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti")
        scanned = cut(gone.unionAll(dedup.greedy_removal(left)))
        kept = classes.join(scanned.withColumn("out", F.lit(True)), "id", "left").select("id", "n", F.col("out").isNull().alias("kept"))
        self._append(kept, "sets", batch)
        self._append(texts.join(copies, "id", "left_anti"), "texts", batch)
        self._append(prefix, "prefixes", batch)
        self.spark.createDataFrame([(batch, many, most)], "batch string, rows long, last long").coalesce(1).write.mode("append").format("parquet").saveAsTable(f"{self.name}_log")
        pairs = across.unionByName(within).select("a", "b", "jaccard")
        return pairs, members, scanned.unionAll(members.where("id <> class").select("id")).distinct()
