"""Neighbour rows, name indexes and the translation of names through a match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(functions: DataFrame) -> DataFrame:
    """A row for each neighbour as listed: idx, dir ('callee' or 'caller'), pos, nbr_name."""
    one = lambda d, c: functions.select("idx", F.lit(d).alias("dir"), F.posexplode(c).alias("pos", "nbr_name"))
    return one("callee", "callees").unionAll(one("caller", "callers"))


def distinct_edges(functions: DataFrame) -> DataFrame:
    """Neighbour sets: idx, dir, nbr_name."""
    return edges(functions).select("idx", "dir", "nbr_name").distinct()


def last_index(functions: DataFrame) -> DataFrame:
    """Of functions of one name the last stands for the name: name, idx."""
    return functions.groupBy("name").agg(F.max("idx").alias("idx"))


def translation(match: DataFrame, g1: DataFrame, g2: DataFrame) -> DataFrame:
    """nbr_name, t: the g1 name that the first matched g2 function of a name is matched to."""
    known = match.select("g2_idx", "g1_idx").join(g2.select(F.col("idx").alias("g2_idx"), F.col("name").alias("nbr_name")), "g2_idx")
    known = known.join(g1.select(F.col("idx").alias("g1_idx"), F.col("name").alias("t")), "g1_idx")
    return known.groupBy("nbr_name").agg(F.min_by("t", "g2_idx").alias("t"))


def required_neighbours(match: DataFrame, g1: DataFrame, g2: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """v, dir, t: g1 names that a match of the g2 function v (of those in ``of``) must have as neighbours."""
    found = edges(g2 if of is None else of).join(translation(match, g1, g2), "nbr_name")
    return found.select(F.col("idx").alias("v"), "dir", "t").distinct()


def neighbour_indices(g2: DataFrame) -> DataFrame:
    """idx, nbr_idx: all g2 functions of the names next to a g2 function."""
    named = g2.select(F.col("name").alias("nbr_name"), F.col("idx").alias("nbr_idx"))
    return edges(g2).join(named, "nbr_name").select("idx", "nbr_idx").distinct()


def unmatched(functions: DataFrame, match: DataFrame, column: str) -> DataFrame:
    """Functions that a match doesn't hold in ``column``."""
    return functions.join(match.select(F.col(column).alias("idx")), "idx", "left_anti")
