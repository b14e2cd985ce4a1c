"""Embedding near-dedup with spherical-cap filters.

A filter is a cap around a direction. Directions are the products of a random
code: after a random rotation a vector is cut into blocks, each block has its own
list of random codewords, and a direction takes one codeword a block. A vector
passes every direction that its inner product exceeds; list decoding finds these
without trying all, by extending only the prefixes that can still exceed the
bound with the best codewords of the blocks that follow. Vectors that pass the
same filter are compared in double precision, in blocks.

A pair is counted in the least filter that both pass, so links are counted
without being listed: a group of near copies gives a row a member and filter.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._support import Scratch, arrow_batches, components, whole_groups

SEED = 20240607
BLOCKS, CODEWORDS, ROTATIONS = 3, 40, 2
#: Vectors that a filter is to get, when there are more than the least codewords give room for.
VECTORS_A_FILTER = 4
#: Mean number of filters of a rotation that a random vector passes, and the least that any vector is given.
MEAN_FILTERS, LEAST_FILTERS = 12, 6
#: Vectors of a filter that a task holds at once, and how many of them it compares with all others at a time.
CHUNK, SLICE = 4096, 256
#: Groups up to this size are compared many at a time.
SMALL = 48


@lru_cache(maxsize=16)
def code(dim: int, rotation: int, codewords: int):
    """The rotation, the codewords of each block, and the bound that random vectors exceed often enough."""
    import numpy as np

    rng = np.random.default_rng([SEED, dim, rotation, codewords])
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    q *= np.sign(np.diag(r))
    blocks = max(1, min(BLOCKS, dim))
    cuts = np.linspace(0, dim, blocks + 1).astype(int)
    words = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        w = rng.standard_normal((codewords, b - a))
        words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(blocks))
    v = rng.standard_normal((400, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    # sums over some directions; with many codewords a drawn part of them stands for all
    picked = [w[rng.choice(len(w), min(len(w), CODEWORDS), replace=False)] for w in words]
    total = np.zeros((len(v), 1))
    for a, b, w in zip(cuts[:-1], cuts[1:], picked, strict=True):
        total = (total[:, :, None] + (v[:, a:b] @ w.T)[:, None, :]).reshape(len(v), -1)
    bound = float(np.quantile(total, max(0.0, 1 - MEAN_FILTERS / float(codewords) ** blocks)))
    return q, cuts, words, bound


def list_decode(unit, dim: int, rotation: int, codewords: int = CODEWORDS):
    """(row, filter) of every direction that a unit vector exceeds, and the best few if those are fewer."""
    import numpy as np

    q, cuts, words, bound = code(dim, rotation, codewords)
    turned = unit @ q
    products = [turned[:, a:b] @ w.T for a, b, w in zip(cuts[:-1], cuts[1:], words, strict=True)]
    best = [p.max(axis=1) for p in products]
    # the bound of each vector: the common one, or lower if too few directions reach it
    row, at, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))

    def extend(row, at, total, limit):
        for i, p in enumerate(products):
            after = sum((best[j] for j in range(i + 1, len(products))), np.zeros(len(unit)))
            sums = total[:, None] + p[row]
            r, c = np.nonzero(sums + after[row][:, None] >= limit[row][:, None] - 1e-12)
            row, at, total = row[r], at[r] * codewords + c, sums[r, c]
        return row, at, total

    limit = np.full(len(unit), bound)
    r, f, t = extend(row, at, total, limit)
    few = np.flatnonzero(np.bincount(r, minlength=len(unit)) < LEAST_FILTERS)
    if len(few):
        # directions of the best codewords of each block hold the best few sums
        top = min(LEAST_FILTERS, codewords)
        sums, names = np.zeros((len(few), 1)), np.zeros((len(few), 1), np.int64)
        for p in products:
            c = np.argsort(-p[few], axis=1, kind="stable")[:, :top]
            sums = (sums[:, :, None] + np.take_along_axis(p[few], c, 1)[:, None, :]).reshape(len(few), -1)
            names = (names[:, :, None] * codewords + c[:, None, :]).reshape(len(few), -1)
        chosen = np.argsort(-sums, axis=1, kind="stable")[:, :LEAST_FILTERS]
        keep = ~np.isin(r, few)
        r = np.concatenate((r[keep], np.repeat(few, chosen.shape[1])))
        f = np.concatenate((f[keep], np.take_along_axis(names, chosen, 1).ravel()))
    return r, f


def filters_of(vectors, codewords: int = CODEWORDS):
    """(row, filter) for all rotations; a filter's number tells its rotation."""
    import numpy as np

    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    dim, rows, filters = vectors.shape[1], [], []
    for i in range(ROTATIONS):
        r, f = list_decode(unit, dim, i, codewords)
        rows.append(r)
        filters.append(f * ROTATIONS + i)
    return np.concatenate(rows), np.concatenate(filters)


def _near(x, y, least):
    """Which rows of x and y have a cosine of at least ``least``: a table of truth values, made in slices."""
    import numpy as np

    norms = [np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y)]
    units = [v / n for v, n in zip((x, y), norms, strict=True)]
    out = np.empty((len(x), len(y)), bool)
    for k in range(0, len(x), SLICE):
        cosine = units[0][k : k + SLICE] @ units[1].T
        out[k : k + SLICE] = cosine >= least
        # next to the bound the product's rounding could decide: those pairs are taken from the vectors as they are
        i, j = np.nonzero(np.abs(cosine - least) <= 1e-9)
        for at in range(0, len(i), 10_000):
            r, c = i[at : at + 10_000] + k, j[at : at + 10_000]
            out[r, c] = np.einsum("ij,ij->i", x[r], y[c]) / (norms[0][r, 0] * norms[1][c, 0]) >= least
    return out


def _link_block(x, y, filter_, least, codewords):
    """Which rows of x and y link and have no lesser filter than this one in common, as a table of truth values."""
    import numpy as np

    near = _near(x, y, least)
    mine, theirs = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(mine):
        return near
    (r1, f1), (r2, f2) = filters_of(x[mine], codewords), filters_of(y[theirs], codewords)
    names = np.intersect1d(f1[f1 < filter_], f2[f2 < filter_])
    if not len(names):
        return near
    has = []
    for n, r, f in ((len(mine), r1, f1), (len(theirs), r2, f2)):
        own = np.isin(f, names)
        one = np.zeros((n, len(names)), np.float32)
        one[r[own], np.searchsorted(names, f[own])] = 1
        has.append(one)
    for k in range(0, len(mine), SLICE):
        i, j = np.nonzero(has[0][k : k + SLICE] @ has[1].T > 0.5)
        near[mine[i + k], theirs[j]] = False
    return near


def _counted(near, ids_x, ids_y, copies_x, copies_y):
    """Of each row and each column of a table of links: copies linked, and the least vector that links reach."""
    import numpy as np

    n = np.zeros(len(ids_x)), np.zeros(len(ids_y))
    for k in range(0, len(near), SLICE):
        part = near[k : k + SLICE].astype(np.float64)
        n[0][k : k + SLICE] = part @ copies_y
        n[1][:] += copies_x[k : k + SLICE] @ part
    roots, most = [ids_x.copy(), ids_y.copy()], np.iinfo(np.int64).max
    while near.any():
        before = [r.copy() for r in roots]
        for k in range(0, len(near), SLICE):
            rows = near[k : k + SLICE]
            roots[0][k : k + SLICE] = np.minimum(roots[0][k : k + SLICE], np.where(rows, roots[1][None, :], most).min(axis=1))
            roots[1] = np.minimum(roots[1], np.where(rows, roots[0][k : k + SLICE, None], most).min(axis=0))
        if all((a == b).all() for a, b in zip(before, roots, strict=True)):
            break
    return [(ids[c > 0], c[c > 0].astype(np.int64), root[c > 0]) for ids, c, root in zip((ids_x, ids_y), n, roots, strict=True)]


def _link_small(unit, x, ids, copies, filters, starts, sizes, least, codewords):
    """Links within groups of few vectors, all groups of one size at a time: (vec, copies linked, least of the two)."""
    import numpy as np

    firsts, seconds = [], []
    for size in np.unique(sizes):
        at = starts[sizes == size]
        i, j = np.triu_indices(size, 1)
        step = max(1, 100_000 // len(i))
        for k in range(0, len(at), step):
            a, b = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= least - 1e-9
            firsts.append(a[near])
            seconds.append(b[near])
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (firsts, seconds))
    if len(a):
        exact = np.einsum("ij,ij->i", x[a], x[b]) / (np.linalg.norm(x[a], axis=1) * np.linalg.norm(x[b], axis=1)) >= least
        a, b = a[exact], b[exact]
    if not len(a):
        return None
    # rows of one vector have the same filters: decode each vector once
    met, place = np.unique(ids[np.concatenate((a, b))], return_inverse=True)
    where = np.empty(len(met), np.int64)
    where[place] = np.concatenate((a, b))
    r, f = filters_of(x[where], codewords)
    own: list[set[int]] = [set() for _ in met]
    for i, v in zip(r.tolist(), f.tolist(), strict=True):
        own[i].add(v)
    pa, pb = place[: len(a)].tolist(), place[len(a) :].tolist()
    first = np.array([min(own[i] & own[j]) == v for i, j, v in zip(pa, pb, filters[a].tolist(), strict=True)], bool)
    a, b = a[first], b[first]
    low = np.minimum(ids[a], ids[b])
    return np.concatenate((ids[a], ids[b])), np.concatenate((copies[b], copies[a])), np.concatenate((low, low))


def _passed(distinct: DataFrame, codewords: int) -> DataFrame:
    """A row for every filter that a vector passes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, groups = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            vectors = batch.column(2).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                r, f = filters_of(np.array([vectors[k] for k in at], np.float64), codewords)
                took = pa.array(at[r])
                yield pa.RecordBatch.from_arrays([pa.array(groups[at[r]]), pa.array(np.full(len(r), dim, np.int32)), pa.array(f), pa.array(ids[at[r]]), batch.column(2).take(took), batch.column(3).take(took)], names=["grp", "dim", "filter", "vec", "embedding", "copies"])

    kind = distinct.schema["embedding"].dataType.simpleString()
    group = distinct.schema["grp"].dataType.simpleString()
    return distinct.select("vec", "grp", "embedding", "copies").mapInArrow(run, f"grp {group}, dim int, filter bigint, vec bigint, embedding {kind}, copies bigint")


def near_vectors(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """Links and components of vectors with cosine at least ``least`` in the same group.

    Returns one row for each row of ``vectors``: id_col, n_links (other rows
    linked directly), component_id (least id reachable). A null group, a null,
    empty or zero vector, or one with null or non-finite components links with
    nothing; so do vectors of different lengths. Equal vectors always link and
    are compared once. Ids may repeat; rows are counted. An empty table gives an
    empty table; other columns are ignored.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark, "caps")
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col(group_col).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), v.alias("embedding"), good.alias("good"))
    distinct = rows.where("good").groupBy("grp", "embedding").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"))
    vectors_once = scratch.save(distinct)
    for seed in count():  # names that no two vectors share
        distinct = vectors_once.withColumn("vec", F.xxhash64(F.lit(seed), "grp", "embedding"))
        if not distinct.groupBy("vec").agg(F.count("*").alias("n")).where("n > 1").head(1):
            break

    # more vectors, finer filters: a filter gets no more of them
    codewords = max(CODEWORDS, math.ceil((distinct.count() / VECTORS_A_FILTER) ** (1 / BLOCKS)))
    passed = scratch.save(_passed(distinct, codewords))
    # a filter that many pass is cut into chunks, and every two chunks meet in one task's block
    many = passed.groupBy("grp", "dim", "filter").agg(F.count("*").alias("m")).where("m > 1").withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int"))
    cut = passed.join(many, ["grp", "dim", "filter"]).withColumn("own", F.pmod(F.xxhash64("vec"), F.col("chunks")).cast("int"))
    met = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.withColumn("p", F.least("own", "with")).withColumn("q", F.greatest("own", "with")).drop("m", "chunks", "with")
    key = ["grp", "dim", "filter", "p", "q"]
    blocks = met.repartition(*key).sortWithinPartitions(*key, "own", "vec").select(*key, "own", "vec", "embedding", "copies")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def large(x, ids, copies, own, filter_, p, q):
            """All links of one block: counts and the least vector reached, by vector."""
            a, b = np.flatnonzero(own == p), np.flatnonzero(own == q)
            near = _link_block(x[a], x[b], filter_, least, codewords)
            if p == q:
                near = np.triu(near, 1)
            yield from _counted(near, ids[a], ids[b], copies[a].astype(np.float64), copies[b].astype(np.float64))

        def whole(table, starts, ends):
            """Links of the groups that lie in a table whole."""
            columns = [table.column(i).to_numpy() for i in (2, 3, 4, 5, 6, 8)]
            filters, p, q, own, ids, copies = columns
            dims = table.column(1).to_numpy()
            sizes = ends - starts
            for dim in np.unique(dims[starts]):
                rows = np.flatnonzero(dims == dim)
                x = np.zeros((len(dims), dim))
                vectors = table.column(7).take(pa.array(rows)).combine_chunks()
                x[rows] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                few = (dims[starts] == dim) & (sizes > 1) & (sizes <= SMALL) & (p[starts] == q[starts])
                if few.any():
                    norms = np.linalg.norm(x, axis=1, keepdims=True)
                    got = _link_small(x / np.where(norms > 0, norms, 1), x, ids, copies, filters, starts[few], sizes[few], least, codewords)
                    if got:
                        yield got
                for a, b in zip(starts[(dims[starts] == dim) & (sizes > 1) & ~few], ends[(dims[starts] == dim) & (sizes > 1) & ~few], strict=True):
                    yield from large(x[a:b], ids[a:b], copies[a:b], own[a:b], filters[a], p[a], q[a])

        for table, starts, ends in whole_groups(batches, len(key)):
            for got in whole(table, starts, ends):
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["vec", "n", "root"])

    found = scratch.save(blocks.mapInArrow(run, "vec bigint, n bigint, root bigint"))
    scratch.drop(passed)
    linked = found.groupBy("vec").agg(F.sum("n").alias("n"))
    tied = components(found.select(F.col("vec").alias("a"), F.col("root").alias("b")).where("a <> b").distinct(), scratch)
    known = distinct.join(linked, "vec", "left").join(tied.withColumnRenamed("node", "vec"), "vec", "left").withColumn("root", F.coalesce("root", "vec"))
    known = scratch.save(known.select(F.col("grp").alias("_g"), F.col("embedding").alias("_e"), "root", "least_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")))
    scratch.drop(vectors_once, found)
    known = known.drop("least_id").join(known.groupBy("root").agg(F.min("least_id").alias("component")), "root")
    out = rows.join(known, F.col("good") & (F.col("grp") == F.col("_g")) & (F.col("embedding") == F.col("_e")), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").cast("long").alias("component_id"))


def op5_cap_filters(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`near_vectors`."""
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node WHERE r.root < l.y),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1),
n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.node = vec_id LEFT JOIN n ON n.x = vec_id
"""
