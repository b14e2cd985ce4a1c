"""Reports: unknown base functions and the names found for them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.names import class_of, is_unknown, without_prefix
from callweave.functions.wordlists import NOISE


def report(match: DataFrame, g1: DataFrame, g2: DataFrame) -> DataFrame:
    """address, known_name of unknown g2 functions matched to known g1 ones; the name is the raw one."""
    base = g2.select(F.col("idx").alias("g2_idx"), F.col("base_name").alias("base"))
    ref = g1.select(F.col("idx").alias("g1_idx"), F.col("base_name").alias("known_name"))
    rows = match.select("g2_idx", "g1_idx").join(base, "g2_idx").join(ref, "g1_idx").where(is_unknown(F.col("base")) & ~is_unknown(F.col("known_name")))
    return rows.select(without_prefix(F.col("base")).alias("address"), "known_name")


def _line() -> Column:
    return F.concat(F.lit("- "), F.col("address"), F.lit(" "), F.col("known_name"))


def lines(rows: DataFrame) -> DataFrame:
    """The report's text lines, by address and name."""
    return rows.select("address", "known_name", _line().alias("line"))


def _write_file(text: DataFrame, path: str) -> None:
    """One text file of a sorted column: written beside its place, then moved there."""
    spark = text.sparkSession
    aside = f"{path}.parts-{uuid.uuid4().hex}"
    text.coalesce(1).write.text(aside)
    hadoop = spark._jvm.org.apache.hadoop.fs
    to, parts = hadoop.Path(path), hadoop.Path(aside)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        part = next(s.getPath() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-"))
        fs.delete(to, True)
        if not fs.rename(part, to):
            raise OSError(f"can't write {path}")
    finally:
        fs.delete(parts, True)


def write_report(rows: DataFrame, path: str, noise: tuple[str, ...] = ()) -> None:
    """Sorted lines as one text file, without those that hold a noise text. A path that can't be written raises."""
    kept = lines(rows)
    kept = post_filter(kept, noise) if noise else kept
    _write_file(kept.orderBy("address", "known_name").select("line"), path)


def grouped(rows: DataFrame) -> DataFrame:
    """A row a class: grp, n, body (its lines, by address and name)."""
    each = rows.select(class_of(F.col("known_name")).alias("grp"), F.struct("address", "known_name", _line().alias("line")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    return each.groupBy("grp").agg(F.count("*").alias("n"), body.alias("body"))


def write_grouped(rows: DataFrame, path: str) -> None:
    """Groups in order of their names as one text file: a heading, the lines, an empty line."""
    text = F.concat(F.lit("["), "grp", F.lit("]\n"), "body", F.lit("\n"))
    _write_file(grouped(rows).orderBy("grp").select(text.alias("value")), path)


def post_filter(rows: DataFrame, noise: tuple[str, ...] = NOISE, column: str = "line") -> DataFrame:
    """Rows whose line holds none of the noise texts."""
    return rows.where(~reduce(lambda a, b: a | b, (F.contains(F.col(column), F.lit(x)) for x in noise)))
