"""Builds that arrive one after another, each compared with the reference graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callweave.operators.report import report
from callweave.plans.engine import match_graphs
from callweave.schema import Options
from callweave.sources.callgraph import parse_graph


def watch_builds(spark: SparkSession, folder: str, reference: DataFrame, out: str, checkpoint: str, options: Options | None = None, **trigger) -> StreamingQuery:
    """Compare each JSON call graph that appears in ``folder``; reports go to ``out`` by build.

    A build is a file; its name is the partition, overwritten if a batch is run
    again, so every report is there exactly once. ``trigger`` is that of
    Structured Streaming.
    """
    builds = spark.readStream.format("text").option("wholetext", "true").load(folder).select("value", F.col("_metadata.file_name").alias("build"))

    def compare(batch: DataFrame, _: int) -> None:
        for row in batch.select("build").collect():  # as many names as files came in
            graph = parse_graph(batch.where(F.col("build") == row.build))
            rows = report(match_graphs(reference, graph, options), reference, graph)
            rows.write.mode("overwrite").parquet(f"{out}/build={row.build}")

    return builds.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
