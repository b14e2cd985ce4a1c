"""Line dedup over levelled sorted runs of line hashes.

:class:`LineRuns` is a log-structured store of (line hash, number of documents).
A run is a Parquet table bucketed and sorted by the hash, so all that meets runs
is a merge join that moves neither of them. A new batch is merge-anti-joined with
the lines that the runs already know to be common (nothing needs counting there
any more) and what is left becomes a sorted run of level 0. When a level has
``fanout`` runs they are merged into one run of the next level. A batch meets as
many runs as there are levels, about the logarithm of the number of batches.
Lines are counted before they are shuffled, so a line that stands in a third of
all documents is one row a task.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._support import ASCII_SPACE, Scratch, arrow_batches, let_go

KEY = ["h1", "h2"]
BATCHES, FANOUT = 4, 2
#: Lines that a bucket is to get, and the least and most buckets of a run: each is a file and a task.
LINES_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1_000_000, 2, 4096
#: Up to so many common lines (16 bytes each) go to all executors, beyond they are joined.
BROADCAST_LINES = 200_000


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(ASCII_SPACE.encode()).lower()


class LineRuns:
    """Runs by level, in a folder that a later job can open and add batches to.

    The folder's file ``runs.json`` names the runs that count; it is replaced in one
    step after a batch or a compaction is written, so a job that dies leaves the
    state before it.
    """

    def __init__(self, spark: SparkSession, root: str, min_docs: int, fanout: int = FANOUT, buckets: int = LEAST_BUCKETS):
        self.spark, self.root, self.min_docs, self.fanout = spark, root, min_docs, fanout
        # as many as a batch is dealt to, so that a task writes one file
        self.buckets = spark.range(1).repartition(buckets, "id")._jdf.queryExecution().logical().numPartitions()
        #: (level, name, buckets) of every run, oldest first, and the tables that stand for them.
        self.runs: list[tuple[int, str, int]] = []
        self._tables: dict[str, str] = {}
        if self._fs().exists(self._path("runs.json")):
            self.runs = [tuple(r) for r in json.loads("".join(r.value for r in spark.read.text(f"{root}/runs.json").collect()))]

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit(self, runs: list[tuple[int, str, int]]) -> None:
        fs, aside = self._fs(), self._path(f"runs-{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(runs).encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        over = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, self._path("runs.json"), over)
        gone = {n for _, n, _ in self.runs} - {n for _, n, _ in runs}
        self.runs = runs
        for name in gone:
            self._forget(name)
            fs.delete(self._path(name), True)

    def _forget(self, name: str) -> None:
        if table := self._tables.pop(name, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def close(self) -> None:
        """Forget the tables; their files stay."""
        for name in list(self._tables):
            self._forget(name)

    def _read(self, run: tuple[int, str, int]) -> DataFrame:
        _, name, buckets = run
        if name not in self._tables:
            table = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {table} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {buckets} BUCKETS LOCATION '{self.root}/{name}'")
            self._tables[name] = table
        return self.spark.table(self._tables[name]).hint("merge")

    def _write(self, counts: DataFrame, level: int) -> tuple[int, str, int]:
        name, table = f"level{level}-{uuid.uuid4().hex}", f"line_run_{uuid.uuid4().hex}"
        writer = counts.select(*KEY, "n").write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.option("path", f"{self.root}/{name}").saveAsTable(table)
        self._tables[name] = table
        return level, name, self.buckets

    def add(self, counts: DataFrame) -> None:
        """Take in a batch: rows of h1, h2, n (documents of the batch with the line)."""
        own = counts.repartition(self.buckets, *KEY).groupBy(*KEY).agg(F.sum("n").alias("n"))
        for run in self.runs:
            own = own.join(self._read(run).where(F.col("n") >= self.min_docs), KEY, "left_anti")
        self._commit([*self.runs, self._write(own, 0)])
        level = 0
        while len(full := [r for r in self.runs if r[0] == level]) >= self.fanout:
            merged = self._write(self._merged(full), level + 1)
            self._commit([merged if r == full[0] else r for r in self.runs if r not in full[1:]])
            level += 1

    def _merged(self, runs: list[tuple[int, str, int]]) -> DataFrame:
        """Sums of the runs' counts, by merging two after the other."""

        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.join(b.withColumnRenamed("n", "more"), KEY, "full")
            return both.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))

        return reduce(merge, map(self._read, runs))

    def common(self) -> DataFrame:
        """Every line of at least ``min_docs`` documents (h1, h2)."""
        if not self.runs:
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint")
        return self._merged(self.runs).where(F.col("n") >= self.min_docs).select(*KEY)


def _line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """_id, _text, h1, h2: each document's distinct line keys, hashed to 128 bits."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        let_go()
        for batch in batches:
            taken, digests = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                keys = {line_key(x) for x in text.split(b"\n")}
                own = [xxh3_128_digest(k) for k in keys if k and (min_chars <= 1 or len(k.decode()) >= min_chars)]
                digests += own
                taken += [i] * len(own)
            halves = np.frombuffer(b"".join(digests), dtype=">i8").astype("<i8").reshape(-1, 2)
            at = pa.array(taken, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["_id", "_text", "h1", "h2"])

    return docs.mapInArrow(run, f"_id {docs.schema['_id'].dataType.simpleString()}, _text bigint, h1 bigint, h2 bigint")


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Texts without the lines that stand in at least ``min_docs`` documents.

    Returns one row for each row of ``docs``: id_col, the columns of ``keep``, text
    (other lines joined by a newline), n_lines, n_dropped. A null or empty text is one empty line,
    and lines whose key is empty always stay. Every row counts as a document,
    repeated rows too; equal rows get equal results. An empty table gives an
    empty table; other columns are ignored.
    """
    import numpy as np

    spark = docs.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark, "lines")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), text.alias("_bytes"), F.struct(*keep).alias("_kept") if keep else F.lit(0).alias("_kept"))
    # not saved: each file that a task writes may start processes, and making them again costs little
    lines = _line_hashes(rows.drop("_kept"), min_chars)
    counts = lines.groupBy(F.pmod(F.xxhash64("_id", "_text"), F.lit(batches)).cast("int").alias("batch"), *KEY).agg(F.count("*").alias("n"))
    staged = scratch.save(counts)
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, staged.count() // LINES_A_BUCKET))
    runs = LineRuns(spark, f"{scratch.root}/runs", min_docs, buckets=buckets)
    for i in range(batches):
        runs.add(staged.where(F.col("batch") == i).select(*KEY, "n"))
    scratch.drop(staged)
    common = scratch.save(runs.common())
    runs.close()
    scratch.drop_folder("runs")
    known = common.limit(BROADCAST_LINES + 1).toArrow()  # at most so many lines, 16 bytes each
    if len(known) <= BROADCAST_LINES:
        scratch.drop(common)
        shared = spark.sparkContext.broadcast(np.stack([known.column(c).to_numpy() for c in KEY], axis=1).astype(">i8").tobytes())
        none = F.lit(None).cast("array<bigint>")
        joined = rows.select("_id", "_bytes", none.alias("_d1"), none.alias("_d2"), "_kept")
    else:
        shared = None
        found = lines.join(common, KEY, "left_semi")
        dropped = found.groupBy("_id", "_text").agg(F.collect_set(F.struct(*KEY)).alias("_drop"))
        dropped = scratch.save(dropped.select(F.col("_id").alias("_of"), F.col("_text").alias("_of_text"), F.col("_drop.h1").alias("_d1"), F.col("_drop.h2").alias("_d2")))
        scratch.drop(common)
        joined = rows.join(dropped, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_text") == F.col("_of_text")), "left").select("_id", "_bytes", "_d1", "_d2", "_kept")

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        let_go()
        digests = lambda data: {data[i : i + 16] for i in range(0, len(data), 16)}
        everywhere = digests(shared.value) if shared else set()
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for data, first, second in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                gone = digests(np.array([first, second], dtype=np.int64).T.astype(">i8").tobytes()) if first else everywhere
                every = data.split(b"\n")
                stay = [x for x in every if not (k := line_key(x)) or xxh3_128_digest(k) not in gone] if gone else every
                n_lines.append(len(every))
                n_dropped.append(len(every) - len(stay))
                kept.append(data if len(stay) == len(every) else b"\n".join(stay))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), batch.column(4)], names=["_id", "kept", "n_lines", "n_dropped", "_kept"])

    kinds = {f: rows.schema[f].dataType.simpleString() for f in ("_id", "_kept")}
    out = joined.mapInArrow(run, f"_id {kinds['_id']}, kept binary, n_lines bigint, n_dropped bigint, _kept {kinds['_kept']}")
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_kept.{c}").alias(c) for c in keep), F.col("kept").cast("string").alias("text"), "n_lines", "n_dropped")


def op2_line_runs(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`drop_common_lines`."""
    out = drop_common_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, u.i, lines[u.i] AS line FROM d, unnest(range(1, len(lines) + 1)) AS u(i)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY k.rid, k.doc_id
"""
