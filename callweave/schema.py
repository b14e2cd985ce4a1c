"""Schemas and options of graph comparison."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import types as T

NAMES = T.ArrayType(T.StringType(), True)
#: One row a function; idx is its place in the input.
FUNCTIONS = T.StructType([T.StructField("idx", T.LongType()), T.StructField("name", T.StringType()), T.StructField("base_name", T.StringType()), T.StructField("callees", NAMES), T.StructField("callers", NAMES)])
MATCH = T.StructType([T.StructField("g2_idx", T.LongType()), T.StructField("g1_idx", T.LongType()), T.StructField("stage", T.StringType()), T.StructField("score", T.DoubleType())])
UNKNOWN = "FUN_"


def widened(threshold: float) -> float:
    """A threshold as a 32-bit float, in double: 0.8 becomes 0.800000011920929, so a similarity of 0.8 is below it."""
    return struct.unpack("f", struct.pack("f", threshold))[0]


@dataclass(frozen=True)
class Options:
    """threshold: least similarity, above 0. max_rounds: rounds of structural matching, None until nothing is found.
    inline: whether to compare what is reachable in ``depth`` calls."""

    threshold: float = 0.8
    max_rounds: int | None = 1
    inline: bool = False
    depth: int = 3

    @property
    def least(self) -> float:
        if self.threshold <= 0:
            raise ValueError("a threshold must be above 0: below it every pair would match")
        return widened(self.threshold)
