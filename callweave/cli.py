"""Command line: compare two call graphs and write a report."""

from __future__ import annotations

import re
import sys

from pyspark.sql import SparkSession

from callweave.functions.wordlists import NOISE
from callweave.operators.report import report, write_grouped, write_report
from callweave.plans.engine import match_graphs
from callweave.schema import Options
from callweave.sources.callgraph import read_graph


class Args:
    """Options of a command line: ``--k=v``, ``--k v``, ``-k v``, or a bare flag.

    A value that begins with a dash needs the equals sign. Positional words are
    ignored; of repeated options the last counts.
    """

    def __init__(self, argv: list[str]):
        self.values: dict[str, str] = {}
        words = iter(range(len(argv)))
        for i in words:
            word = argv[i]
            if not word.startswith("-"):
                continue
            name, equals, value = word.lstrip("-").partition("=")
            if not equals and i + 1 < len(argv) and not argv[i + 1].startswith("-"):
                value = argv[i + 1]
                next(words)
            self.values[name] = value

    def has(self, name: str) -> bool:
        return name in self.values

    def get(self, name: str, default: str = "") -> str:
        return self.values.get(name, default)

    def _number(self, name: str, pattern: str, kind, default):
        m = re.match(r"\s*" + pattern, self.get(name))
        return kind(m[0]) if m else default

    def get_int(self, name: str, default: int = 0) -> int:
        """The whole number that the value begins with."""
        return self._number(name, r"[+-]?\d+", int, default)

    def get_float(self, name: str, default: float = 0.0) -> float:
        """The number that the value begins with."""
        return self._number(name, r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", float, default)

    def get_bool(self, name: str, default: bool = False) -> bool:
        """A flag without a value is true; an unclear value is the default."""
        if not self.has(name):
            return default
        value = self.get(name).lower()
        return {"": True, "true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}.get(value, default)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """--base, --ref, -o (result.txt), -t (0.8), --checkInline, --group, --filtered. Returns the exit code.

    ``--filtered`` names a second report, without lines that hold one of the noise texts.
    """
    args = Args(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("callweave").getOrCreate()
    try:
        g1 = read_graph(spark, args.get("ref"), normalised=True)
        g2 = read_graph(spark, args.get("base"))
        match = match_graphs(g1, g2, Options(threshold=args.get_float("t", 0.8), inline=args.get_bool("checkInline")))
        rows = report(match, g1, g2)
        write_report(rows, args.get("o", "result.txt"))
        if args.get("filtered"):
            write_report(rows, args.get("filtered"), NOISE)
        if args.get("group"):
            write_grouped(rows, args.get("group"))
    except Exception as e:  # the exit code tells
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
