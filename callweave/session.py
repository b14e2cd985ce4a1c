"""Cutting lineage between the steps of an iteration."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to all executors, for clusters where it isn't installed.

    Functions that run there are named by their module, not sent with the plan.
    """
    root = Path(__file__).parent
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='callweave-')}/callweave", "zip", root.parent, root.name))


def cut(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the checkpoint folder that all executors share."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="callweave-")
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)
