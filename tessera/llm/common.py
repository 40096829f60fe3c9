"""Shared helpers: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import spread


BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches for Python are held to BATCH_BYTES, whatever the length of a text."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release_memory() -> None:
    """Gives what a Python worker has freed back to the system, as it stays on, idle, beside later tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one whose files make fewer tasks than there are cores is dealt out to all of them."""
    bound_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The files outlive executors; Spark's cleaner removes them with the last reference
    where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: like cut(), for wide rows of which parts are read.

    Columns may have any names: they are stored by position.  The files go when the driver ends."""
    names, spark = df.columns, df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.toDF(*[f"c{i}" for i in range(len(names))]).write.parquet(path, compression=compression)
    gone_at_end(spark, path)
    return spark.read.parquet(path).toDF(*names)


def gone_at_end(spark: SparkSession, path: str) -> None:
    """Has a file or folder that exists deleted when the driver's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, also where ``use`` has lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def below(rows: DataFrame, n: int, total: int) -> DataFrame:
    """The rows whose ``h``, a 64-bit hash, is below a bound that leaves about 2n + 1000 of ``total``.

    Fewer than n of them are left with a chance too small to matter (many standard
    deviations), so the n smallest are among them."""
    share = (2 * n + 1000) / max(1, total)
    return rows if share >= 1 else rows.where(F.col("h") < F.lit(int(-(2**63) + share * 2**64)))


def lowest(rows: DataFrame, n: int, total: int, *ties: str) -> DataFrame:
    """The ``n`` rows with the smallest ``h``, by ``doc_id`` where equal, of about ``total``.

    What is sorted in one place is bounded by n, however many partitions there are."""
    return below(rows, n, total).orderBy("h", *(ties or ("doc_id",))).limit(n)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph ``edges(a, b)`` as ``(node, component)``.

    ``component`` is the smallest node reachable.  Nodes without an edge do not
    appear.  Alternating large-star and small-star rounds (Kiveris et al., 2014):
    each is a grouped minimum and a join, so neither the driver nor a task ever
    holds a component; the rounds, which end at a fixed point, grow with the logarithm
    of the longest path.
    Null ends and self loops are ignored, repeats are merged."""
    e = cut(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    now = state(e)
    while now[0]:
        both = e.select(F.col("u").alias("n"), F.col("v").alias("x")).unionAll(e.select(F.col("v").alias("n"), F.col("u").alias("x")))
        low = both.groupBy("n").agg(F.min("x").alias("m0")).select("n", F.least("n", "m0").alias("m"))
        large = both.where("x > n").join(low, "n").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        # each row (u, v) gives (v, m) and (u, m); those with equal ends go
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v")
            .where("u <> v")
            .distinct()
        )
        e = cut(small)
        before, now = now, state(e)
        if before == now:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable, for n nodes and the links a-b."""
    root = np.arange(n)
    while a.size:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while True:
            jump = root[root]
            if np.array_equal(jump, root):
                break
            root = jump
        if np.array_equal(before, root):
            break
    return root
