"""What the training-data operators share: scratch tables, batch sizes, components.

Scratch tables live below the folder that the cluster names in
``spark.checkpoint.dir``; every executor reads them, so a lost executor costs a
recomputation of the running stage only.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = " \t\n\x0b\x0c\r"
#: The same set in Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


#: Temporary scratch folders of local sessions, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder; a temporary one only in plain local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = _LOCAL.get(context.applicationId) or _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="callweave-"))
    return named


class Scratch:
    """Tables of one operator run, written once and read again.

    What isn't dropped before is deleted when the application ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self._n = 0
        path = self._path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def save(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet and read it again: the lineage ends there."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            path = self._path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let shuffle files of finished steps go: they stay until the driver collects its garbage, which it seldom does."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop_folder(self, name: str) -> None:
        """Delete what else was written below the root."""
        path = self._path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_batches(spark: SparkSession, rows: int = 500, size: str = "2m") -> None:
    """Bound an Arrow batch by rows and bytes, so long texts don't add up.

    Batches are made when results are read, so the session keeps these settings.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: The one thing that a worker process keeps from task to task.
_KEPT: dict[object, object] = {}


def let_go() -> None:
    """Free what the worker keeps from other operators, and give memory that earlier tasks freed back to the system.

    Workers are used again by whatever runs next; without this each holds the
    largest of all that it ever ran.
    """
    import ctypes

    import pyarrow as pa

    if _KEPT:
        _KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def kept_in_worker(key, make):
    """What ``make`` gives, kept in this process until something else is asked for or :func:`let_go` is called."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def crc_mod(column: str, by: int) -> Column:
    """crc32 of an id as text, modulo by."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def whole_groups(batches, keys: int, rows: int = 20_000):
    """(table, starts, ends) of whole groups; rows come sorted by the first ``keys`` columns, whole numbers.

    A table has more than ``rows`` rows only if its last group needs it.
    """
    import numpy as np
    import pyarrow as pa

    def starts_of(table):
        change = np.zeros(max(0, len(table) - 1), bool)
        for i in range(keys):
            c = table.column(i).to_numpy()
            change |= c[1:] != c[:-1]
        return np.concatenate(([0], np.flatnonzero(change) + 1))

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = starts_of(table)
            if len(starts) > 1:
                yield table.slice(0, int(starts[-1])), starts[:-1], starts[1:]
            rest = table.slice(int(starts[-1]))
            # a group that goes on is looked at again only when there is as much more of it
            held, n = rest.to_batches(), 0
    if held and sum(map(len, held)):
        table = pa.Table.from_batches(held).combine_chunks()
        starts = starts_of(table)
        yield table, starts, np.concatenate((starts[1:], [len(table)]))


def _settled_stars(edges: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("n"), F.lit(0).alias("b")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("n").alias("n"), F.max("b").alias("b")).where("n > 1 OR n > 0 AND b > 0").head(1)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components by alternating large and small stars.

    ``edges`` has columns a, b of an orderable type. Returns (node, root) for
    every node of an edge, root being the component's smallest node. Self loops
    keep their node; an empty table gives an empty table. Hubs are met by a
    partial ``min`` and a plain join, which adaptive execution can split.
    """
    pair = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    now = scratch.save(edges.where("a <> b").select(*pair).distinct().select("a", "b"))
    while not _settled_stars(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(small.select("a", F.col("m").alias("b"))).distinct()
        after = scratch.save(small)
        scratch.drop(now)
        now = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return stars.union(roots).union(loops).groupBy("node").agg(F.min("root").alias("root"))


def merged_components(found: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """What :func:`components` makes of the edges that ``found`` came from and more edges.

    Only the roots that the new edges tie together are worked on.
    """
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    root = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    tied = edges.join(root("a"), "a", "left").join(root("b"), "b", "left")
    tied = tied.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct()
    moved = components(tied, scratch).select(F.col("node").alias("root"), F.col("root").alias("to"))
    every = found.unionByName(ends.join(found, "node", "left_anti").withColumn("root", F.col("node")))
    return every.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
