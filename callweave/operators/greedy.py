"""Greedy one-to-one matching by descending score, in parallel rounds.

A pair that is the best of both its functions is one that the sequential greedy
would take as well, whatever it takes before. So each round commits all such
pairs and drops what they touch. Under a strict total order (score descending,
g2, g1) the outcome is the sequential one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.session import cut


def greedy_match(candidates: DataFrame) -> DataFrame:
    """candidates: score, g2_idx, g1_idx. Returns the chosen rows; equal scores go to the lesser g2, then g1."""
    rest = cut(candidates.select("score", "g2_idx", "g1_idx").distinct())
    rank = F.struct((-F.col("score")).alias("s"), "g2_idx", "g1_idx")
    chosen = []
    while True:
        best2 = rest.groupBy("g2_idx").agg(F.min(rank).alias("r2"))
        best1 = rest.groupBy("g1_idx").agg(F.min(rank).alias("r1"))
        top = cut(rest.join(best2, "g2_idx").join(best1, "g1_idx").where((F.col("r1") == rank) & (F.col("r2") == rank)).select("score", "g2_idx", "g1_idx"))
        if not top.head(1):
            break
        chosen.append(top)
        rest = cut(rest.join(top.select("g2_idx"), "g2_idx", "left_anti").join(top.select("g1_idx"), "g1_idx", "left_anti"))
    return reduce(DataFrame.unionAll, chosen, top)


def greedy_class_match(scores: DataFrame, vs: DataFrame, us: DataFrame) -> DataFrame:
    """What :func:`greedy_match` chooses among all members (v, c) and (u, d) of pairs of classes (c, d, score).

    Rounds would take one pair of each two classes. So one task takes the pairs of
    classes in order of score, its memory being the members and the pairs of one score.
    """
    row = lambda df, kind, score, a, b: df.select(F.lit(kind).alias("kind"), score.alias("score"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    none = F.lit(0.0)
    rows = row(vs, 0, none, "c", "v").unionAll(row(us, 1, none, "d", "u")).unionAll(row(scores, 2, F.col("score"), "c", "d"))

    def run(batches):
        import heapq
        from collections import deque

        import pyarrow as pa

        free2, free1 = {}, {}

        def settle(level):
            """Pairs of equal score; free members are taken from the least on, classes by their least free member."""
            first = [(free2[c][0], c) for c in level]
            heapq.heapify(first)
            for ds in level.values():
                heapq.heapify(ds)
            while first:
                v, c = heapq.heappop(first)
                ds = level[c]
                # what others have taken since
                while ds and ds[0][0] != (head := free1[ds[0][1]][0] if free1[ds[0][1]] else None):
                    if head is None:
                        heapq.heappop(ds)
                    else:
                        heapq.heapreplace(ds, (head, ds[0][1]))
                if not ds:
                    continue
                u, d = ds[0]
                free2[c].popleft()
                free1[d].popleft()
                if free2[c]:
                    heapq.heappush(first, (free2[c][0], c))
                yield v, u

        def levels():
            level, at = {}, None
            for batch in batches:
                for kind, score, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if kind < 2:
                        (free1 if kind else free2).setdefault(a, deque()).append(b)
                        continue
                    if score != at:
                        yield at, level
                        level, at = {}, score
                    if free2.get(a) and free1.get(b):
                        level.setdefault(a, []).append((free1[b][0], b))
            yield at, level

        for score, level in levels():
            if found := list(settle(level)):
                v, u = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([score] * len(found), pa.float64()), pa.array(v, pa.int64()), pa.array(u, pa.int64())], names=["score", "g2_idx", "g1_idx"])

    # the least members first, then the best pairs
    dealt = rows.repartition(1).sortWithinPartitions("kind", F.desc("score"), "a", "b")
    return dealt.mapInArrow(run, "score double, g2_idx bigint, g1_idx bigint")
