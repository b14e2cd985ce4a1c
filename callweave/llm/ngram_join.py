"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles at least ``similarity`` alike differ in at most k elements,
k following from their sizes. Within a band of sizes the hashed element domain is
cut into n1 parts, each into n2 pieces: if two sets differ in at most k elements,
some part holds at most k2 = ceil((k + 1) / n1) - 1 of the differences, so some
n2 - k2 of its pieces are equal in both. A signature is the hash of such a subset
of pieces; every pair to be found shares one, and no threshold is left to chance.

Sets that share a signature are compared in two steps, neither of which lists the
pairs of a group. First each is compared with the group's pivot only, the member
whose spread (how many elements each part of the domain has) is nearest to the
mean of all: for a group of near copies that is the text that they derive from,
or one like it. A bound on differences that follows from the spreads parts unlike
sets before their elements are read. Then members that are not yet connected are
compared with each other by that bound alone, inside a task, and only the pairs
that it lets pass and that would connect something are verified. So a group of
thousands of near copies costs a row a member, and no link is lost. Groups too
large for a task are cut into chunks: each has a pivot, the pivots are compared as
a group of their own, and two chunks of one component never meet.
"""

from __future__ import annotations

import math
from itertools import combinations, count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._support import Scratch, arrow_batches, components, let_go, merged_components, whole_groups

#: Ratio of the largest to the least size of a band, and pieces a part (k2 is 1).
BAND, PIECES_SMALL, PIECES, SMALL_K = 1.5, 3, 2, 12
MOST_WORDS = 1 << 18
#: Sets that one copy of their common partner is sent for.
SHARED = 64
#: The most members of a group that a task holds at once.
CHUNK = 4096
#: Groups of up to so many are compared many at a time.
SMALL = 64
#: Parts of the domain, as bits, that spreads count; how many of them stand together in the coarse ones; the most bits of sketches.
CELL_BITS, COARSE, SKETCH_BITS = 7, 8, 10
#: Up to so many sets (40 bytes each) the texts that are needed again are found by a broadcast, beyond by a shuffle.
BROADCAST_SETS = 200_000
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def bands_of(size: int, percent: int) -> list[int]:
    """Instances that a set of this size takes part in: the bands of all sets up to it that may link with it."""
    band = lambda n: int(math.floor(math.log(n, BAND) + 1e-9))
    return list(range(band(-(-percent * size // 100)), band(size) + 1))


def most_apart(band: int, percent: int) -> int:
    """The most elements in which two linked sets of an instance differ."""
    top = math.ceil(BAND ** (band + 1))  # the smaller one is below this
    larger = top * 100 // percent
    return (100 - percent) * (top + larger) // (100 + percent)


def shape(k: int) -> tuple[int, int, int]:
    """n1, n2, k2 for k differences."""
    if k == 0:
        return 1, 1, 0
    n2 = PIECES_SMALL if k < SMALL_K else PIECES
    return -(-(k + 1) // 2), n2, 1


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of hashed word shingles."""

    def __init__(self, words: int):
        from xxhash import xxh3_64_intdigest

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = h = xxh3_64_intdigest(word)
                return h

        self.words, self.known = words, Known()

    def __call__(self, text: bytes):
        """A-Z lower-cased, split at ASCII white space; fewer words than a shingle make one element."""
        import numpy as np

        if len(self.known) > MOST_WORDS:
            self.known.clear()
        split = text.lower().split()
        n = len(split)
        if not n:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.known.__getitem__, split), np.uint64, n)
        size = min(n, self.words)
        total = np.full(n - size + 1, size, np.uint64)
        for i in range(size):
            total = _mixed(total * np.uint64(MIX[0]) + h[i : n - size + 1 + i])
        return np.unique(total)


def signatures(elements, percent: int):
    """PartEnum signatures of one set, as uint64."""
    import numpy as np

    out, values, top = [], _mixed(elements + np.uint64(MIX[0])), elements >> np.uint64(32)
    for band in bands_of(len(elements), percent):
        n1, n2, k2 = shape(most_apart(band, percent))
        pieces = n1 * n2
        at = np.searchsorted((top * np.uint64(pieces)) >> np.uint64(32), np.arange(pieces + 1, dtype=np.uint64))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(values)))  # wraps around, as hashes may
        piece = (sums[at[1:]] - sums[at[:-1]]).reshape(n1, n2)
        for i, chosen in enumerate(combinations(range(n2), n2 - k2)):
            label = np.arange(n1, dtype=np.uint64) * np.uint64(64) + np.uint64(i) + np.uint64((band + 1) << 40)
            total = np.zeros(n1, np.uint64)
            for c in chosen:
                total = _mixed(total * np.uint64(MIX[0]) + piece[:, c])
            out.append(_mixed(total + _mixed(label)))
    return np.concatenate(out)


def _node(elements, seed: int = 0) -> tuple[int, int]:
    """A set's name, and as much again to tell sets of one name apart."""
    from xxhash import xxh3_128_intdigest

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    h = xxh3_128_intdigest(elements.tobytes(), seed)
    return signed(h >> 64), signed(h & ((1 << 64) - 1))


def spread(elements) -> bytes:
    """How many elements each of 2 ** CELL_BITS parts of the domain has, up to 255.

    Two sets differ in at least as many elements as their spreads do, summed
    over the parts: a bound that parts unlike sets without their elements.
    """
    import numpy as np

    cells = np.bincount((elements >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
    return np.minimum(cells, 255).astype(np.uint8).tobytes()


def sketch(elements) -> bytes:
    """A set's size, then a spread over more parts of the domain the more elements it has."""
    import numpy as np

    bits = min(SKETCH_BITS, max(CELL_BITS, (len(elements) - 1).bit_length() - 2))
    cells = np.bincount((elements >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return len(elements).to_bytes(4, "little") + np.minimum(cells, 255).astype(np.uint8).tobytes()


def folded(sketches: list[bytes], bits: int):
    """Sketches of at least so many bits as a table of spreads over 2 ** bits parts."""
    import numpy as np

    out = np.empty((len(sketches), 1 << bits), np.uint8)
    sizes = np.array([len(x) for x in sketches])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for k in range(0, len(at), 2000):
            cells = np.frombuffer(b"".join([sketches[i][4:] for i in at[k : k + 2000]]), np.uint8).reshape(-1, 1 << bits, (size - 4) >> bits)
            out[at[k : k + 2000]] = np.minimum(cells.sum(axis=2, dtype=np.int32), 255)
    return out


def refined(sketches: list[bytes], detail, n, i, j, percent: int):
    """Which of the pairs (i, j) sketches let link, each pair at the detail (number of parts) that both have."""
    import numpy as np

    keep = np.ones(len(i), bool)
    least = np.minimum(detail[i], detail[j])
    for cells in np.unique(least[least > 1 << CELL_BITS]).tolist():
        at = np.flatnonzero(least == cells)
        step = max(1, (1 << 22) // cells)
        for k in range(0, len(at), step):
            own = at[k : k + step]
            rows, place = np.unique(np.concatenate((i[own], j[own])), return_inverse=True)
            table = folded([sketches[r] for r in rows.tolist()], cells.bit_length() - 1)
            keep[own] = possible(table, n[rows], place[: len(own)], place[len(own) :], percent)
    return keep


def _tasks(rows: DataFrame) -> int:
    """As many tasks as a shuffle has: what they compute is more than their bytes tell."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spreads_of(column):
    """A column of spreads as a table of numbers."""
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 1 << CELL_BITS)


def possible(spreads, n, i, j, percent: int):
    """Whether spreads and sizes let the sets i and j link, place by place."""
    import numpy as np

    out = np.empty(len(i), bool)
    step = max(1, (1 << 22) // spreads.shape[1])
    for k in range(0, len(i), step):
        a, b = i[k : k + step], j[k : k + step]
        apart = np.abs(spreads[a].astype(np.int16) - spreads[b]).sum(axis=1, dtype=np.int64)
        out[k : k + step] = apart * (100 + percent) <= (n[a] + n[b]) * (100 - percent)
    return out


def middle(spreads) -> int:
    """The member whose spread is nearest to the mean."""
    import numpy as np

    mean = np.rint(spreads.mean(axis=0)).astype(np.int16)
    return int(np.abs(spreads - mean).sum(axis=1, dtype=np.int64).argmin())


def _coarse(spreads):
    import numpy as np

    return spreads.reshape(len(spreads), -1, COARSE).sum(axis=2, dtype=np.int16)


def loose_in_small(spreads, coarse, n, part, starts, sizes, percent: int):
    """Index pairs as :func:`loose_pairs` gives them, of groups of few members, all groups of one size at a time."""
    import numpy as np

    for size in np.unique(sizes[sizes > 1]):
        at = starts[sizes == size]
        i, j = np.triu_indices(size, 1)
        step = max(1, 200_000 // len(i))
        for k in range(0, len(at), step):
            a, b = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
            keep = (part[a] != part[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
            a, b = a[keep], b[keep]
            keep = np.abs(coarse[a] - coarse[b]).sum(axis=1, dtype=np.int64) * (100 + percent) <= (n[a] + n[b]) * (100 - percent)
            a, b = a[keep], b[keep]
            keep = possible(spreads, n, a, b, percent)
            yield a[keep], b[keep]


def loose_pairs(spreads, coarse, n, part, left, right, percent: int):
    """Index pairs of left and right members in different parts that sizes and spreads let link.

    If ``left`` is ``right`` each pair comes once. Members are taken by size, so
    only those of like sizes meet, and coarse spreads first.
    """
    import numpy as np

    same = left is right
    left, right = (x[np.argsort(n[x], kind="stable")] for x in (left, right))
    sizes = n[right]
    for k in range(0, len(left), 64):
        own = left[k : k + 64]
        low = np.searchsorted(sizes, -(-percent * n[own[0]] // 100))
        high = np.searchsorted(sizes, 100 * n[own[-1]] // percent, "right")
        if same:
            low = max(low, k + 1)
        other = right[low:high]
        if not len(other):
            continue
        apart = np.abs(coarse[own][:, None, :] - coarse[other][None, :, :]).sum(axis=2, dtype=np.int64)
        near = (apart * (100 + percent) <= (n[own][:, None] + n[other][None, :]) * (100 - percent)) & (part[own][:, None] != part[other][None, :])
        if same:
            near &= np.arange(low, high)[None, :] > np.arange(k, k + len(own))[:, None]
        i, j = np.nonzero(near)
        i, j = own[i], other[j]
        keep = possible(spreads, n, i, j, percent)
        yield i[keep], j[keep]


def _pairs(table, i, j):
    """Pairs of nodes, the lesser one first."""
    import numpy as np
    import pyarrow as pa

    nodes = table.column("node").to_numpy()
    a, b = np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j])
    ab = np.unique(np.stack((a, b), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy()), pa.nulls(len(ab), pa.int64()), pa.nulls(len(ab), pa.int64())], names=["a", "b", "signature", "pivot"])


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """a, b of pivots and members that may link; signature, pivot of each chunk of a group of several.

    members: signature, chunk, node, chunks, n, spread.
    """
    dealt = members.repartition(_tasks(members), "signature", "chunk").sortWithinPartitions("signature", "chunk", "node")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        let_go()
        for table, starts, ends in whole_groups(batches, 2):
            spreads, n = spreads_of(table.column("spread")), table.column("n").to_numpy()
            sizes, pivots = ends - starts, starts.copy()
            for g in np.flatnonzero(sizes > 2):
                pivots[g] += middle(spreads[starts[g] : ends[g]])
            i, j = np.repeat(pivots, sizes), np.arange(len(table))
            other = i != j
            i, j = i[other], j[other]
            keep = possible(spreads, n, i, j, percent)
            yield _pairs(table, i[keep], j[keep])
            cut = pivots[table.column("chunks").to_numpy()[starts] > 1]
            if len(cut):
                nodes = pa.array(table.column("node").to_numpy()[cut])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(cut), pa.int64()), pa.nulls(len(cut), pa.int64()), pa.array(table.column("signature").to_numpy()[cut]), nodes], names=["a", "b", "signature", "pivot"])

    return dealt.select("signature", "chunk", "node", "chunks", "n", "spread").mapInArrow(run, "a bigint, b bigint, signature bigint, pivot bigint")


def _blocks(members: DataFrame, found: DataFrame) -> DataFrame:
    """signature, x, y, own, node, part: members of groups that are not connected, in the blocks that they meet in.

    A block is one chunk, or two. Members of the group's largest part have chunks
    of their own, which meet the chunks of the others but not each other.
    """
    by = Window.partitionBy("signature")
    placed = members.join(found, "node", "left").select("signature", "node", "m", F.coalesce("root", "node").alias("part"))
    open_ = placed.withColumn("p", F.min("part").over(by)).withColumn("q", F.max("part").over(by)).where("p < q AND m > 2").drop("p", "q")
    parts = open_.where(F.col("m") > CHUNK).groupBy("signature", "part").agg(F.count("*").alias("many"))
    major = parts.groupBy("signature").agg(F.max(F.struct("many", "part")).alias("most"))
    cut = open_.join(major, "signature", "left")
    in_major = F.coalesce(F.col("part") == F.col("most.part"), F.lit(False))
    count = lambda n: F.ceil(n / CHUNK).cast("int")
    cut = cut.withColumn("others", F.when(F.col("most").isNull(), 1).otherwise(F.greatest(F.lit(1), count(F.col("m") - F.col("most.many")))))
    cut = cut.withColumn("chunks", F.when(F.col("most").isNull(), 1).otherwise(F.col("others") + count(F.col("most.many"))))
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    cut = cut.withColumn("own", F.when(in_major, F.col("others") + place(F.col("chunks") - F.col("others"))).otherwise(place(F.col("others"))))
    meets = F.when(in_major, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    met = cut.withColumn("with", F.explode(meets))
    return met.select("signature", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "own", "node", "part")


def _loose(blocks: DataFrame, percent: int) -> DataFrame:
    """a, b of members in different parts that may link. blocks: signature, x, y, own, node, part, n, sketch."""
    dealt = blocks.repartition(_tasks(blocks), "signature", "x", "y").sortWithinPartitions("signature", "x", "y", "node")

    def run(batches):
        import numpy as np

        let_go()
        for table, starts, ends in whole_groups(batches, 3):
            sketches = table.column("sketch").to_pylist()
            detail, spreads = np.array([len(x) - 4 for x in sketches]), folded(sketches, CELL_BITS)
            coarse = _coarse(spreads)
            n, part, x, y, own = (table.column(c).to_numpy() for c in ("n", "part", "x", "y", "own"))
            small = (ends - starts <= SMALL) & (x[starts] == y[starts])
            for i, j in loose_in_small(spreads, coarse, n, part, starts[small], (ends - starts)[small], percent):
                keep = refined(sketches, detail, n, i, j, percent)
                if keep.any():
                    yield _pairs(table, i[keep], j[keep])
            for s, e in zip(starts[~small], ends[~small], strict=True):
                at = np.arange(s, e)
                left = at[own[s:e] == x[s]]
                for i, j in loose_pairs(spreads, coarse, n, part, left, left if x[s] == y[s] else at[own[s:e] == y[s]], percent):
                    keep = refined(sketches, detail, n, i, j, percent)
                    if keep.any():
                        yield _pairs(table, i[keep], j[keep])

    found = dealt.select("signature", "x", "y", "own", "node", "part", "n", "sketch").mapInArrow(run, "a bigint, b bigint, signature bigint, pivot bigint")
    return found.select("a", "b").distinct()


def _sets(rows: DataFrame, words: int, seed: int) -> DataFrame:
    """_id, _text, n, node, check, spread, sketch: size, name and spreads of every document's set (node null if empty)."""

    def run(batches):
        import pyarrow as pa

        let_go()
        shingler = Shingler(words)
        for batch in batches:
            every = [shingler(text) for text in batch.column(2).to_pylist()]
            sizes, nodes = [len(x) for x in every], [_node(x, seed) if len(x) else (None, None) for x in every]
            named = [pa.array([h[i] for h in nodes], pa.int64()) for i in (0, 1)]
            spreads = [pa.array([f(x) for x in every], pa.binary()) for f in (spread, sketch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *named, *spreads], names=["_id", "_text", "n", "node", "check", "spread", "sketch"])

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _text bigint, n bigint, node bigint, check bigint, spread binary, sketch binary")


def _signed(rows: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """signature, node for every set of a task once, whatever number of copies it has."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        let_go()
        shingler, done = Shingler(words), set()
        for batch in batches:
            found, nodes, counts = [], [], []
            for text in batch.column(2).to_pylist():
                x = shingler(text)
                if not len(x) or (node := _node(x, seed)[0]) in done:
                    continue
                if len(done) > MOST_WORDS:
                    done.clear()
                done.add(node)
                found.append(signatures(x, percent))
                nodes.append(node)
                counts.append(len(found[-1]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), counts))], names=["signature", "node"])

    return rows.mapInArrow(run, "signature bigint, node bigint")


def sketches_apart(x: bytes, y: bytes) -> tuple[int, int]:
    """In how many elements two sets differ at least, and their sizes' sum. The finer sketch is folded to the coarser."""
    import numpy as np

    cells = sorted((np.frombuffer(v, np.uint8, offset=4) for v in (x, y)), key=len)
    folded = np.minimum(cells[1].reshape(len(cells[0]), -1).sum(axis=1, dtype=np.int64), 255)
    return int(np.abs(folded - cells[0]).sum()), int.from_bytes(x[:4], "little") + int.from_bytes(y[:4], "little")


def sets_apart(x: bytes, y: bytes) -> tuple[int, int]:
    """In how many elements two sets differ, and their sizes' sum."""
    import numpy as np

    both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
    both.sort(kind="stable")
    return len(both) - 2 * int((both[1:] == both[:-1]).sum()), len(both)


def _elements(rows: DataFrame, words: int) -> DataFrame:
    """node, data: the sets of texts."""

    def run(batches):
        import pyarrow as pa

        let_go()
        shingler = Shingler(words)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingler(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "data"])

    return rows.mapInArrow(run, "node bigint, data binary")


def _near(pairs: DataFrame, sets: DataFrame, apart, percent: int) -> DataFrame:
    """The pairs (a, b) that may link by what ``apart`` makes of their sets' data. sets: node, data.

    Of each pair the set with more partners is the head. It is sent once for every
    SHARED of them, the other one with the pair.
    """
    partners = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("partners"))
    of = lambda c: partners.select(F.col("node").alias(c), F.col("partners").alias(f"n_{c}"))
    head = F.col("n_a") >= F.col("n_b")
    turned = pairs.join(of("a"), "a").join(of("b"), "b").select(F.when(head, F.col("a")).otherwise(F.col("b")).alias("head"), F.when(head, F.col("b")).otherwise(F.col("a")).alias("node"), F.greatest("n_a", "n_b").alias("n"))
    salted = turned.select("head", "node", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SHARED)).cast("int").alias("salt"))
    heads = salted.select("head", "salt").distinct().join(sets, F.col("head") == F.col("node")).select("head", "salt", F.lit(None).cast("bigint").alias("node"), "data")
    rows = heads.unionByName(salted.join(sets, "node").select("head", "salt", "node", "data"))
    rows = rows.repartition(_tasks(rows), "head", "salt").sortWithinPartitions("head", "salt", F.col("node").asc_nulls_first())

    def run(batches):
        import pyarrow as pa

        let_go()
        own = b""
        for batch in batches:
            found: list[tuple[int, int]] = []
            for first, node, data in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if node is None:
                    own = data
                    continue
                differ, total = apart(own, data)
                if differ * (100 + percent) <= total * (100 - percent):
                    found.append((min(first, node), max(first, node)))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    # few rows of many tasks: the exchange lets them be written as few files
    return rows.select("head", "salt", "node", "data").mapInArrow(run, "a bigint, b bigint").distinct()


def _named_sets(rows: DataFrame, words: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """The sets of all rows, under names that no two different sets share."""
    for seed in count():
        sets = scratch.save(_sets(rows, words, seed))
        if not sets.where("n > 0").groupBy("node").agg(F.min("check").alias("p"), F.max("check").alias("q")).where("p < q").head(1):
            return sets, seed
        scratch.drop(sets)
    raise AssertionError


def _links(pairs: DataFrame, rows: DataFrame, sets: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that link, by the elements of their sets, each made of one text."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    holder = sets.where("n > 0").join(needed, "node", "left_semi").groupBy("node").agg(F.min(F.struct("_id", "_text")).alias("h"))
    holder = holder.select("node", F.col("h._id").alias("_of"), F.col("h._text").alias("_of_text"))
    if needed.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS:
        holder = F.broadcast(holder)
    texts = rows.join(holder, (F.col("_text") == F.col("_of_text")) & F.col("_id").eqNullSafe(F.col("_of"))).select("node", "_bytes").dropDuplicates(["node"])
    known = scratch.save(_elements(texts, words))
    links = scratch.save(_near(pairs, known, sets_apart, percent))
    scratch.drop(known)
    scratch.release()
    return links


def _labelled(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """_id, _text, n, _group for each row of docs, _group being the key of its component (null without words)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark, "ngrams")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), text.alias("_bytes"))
    sets, seed = _named_sets(rows, words, scratch)

    # the members of every signature that several sets share, each once, and how many they are
    by = Window.partitionBy("signature")
    order = by.orderBy("node")
    signed = _signed(rows, words, percent, seed).withColumn("nth", F.dense_rank().over(order)).withColumn("before", F.lag("node").over(order))
    members = signed.withColumn("m", F.max("nth").over(by)).where("m > 1 AND (before IS NULL OR before < node)")
    members = scratch.save(members.select("signature", "node", "m"))
    scratch.release()
    known = sets.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("spread").alias("spread"))
    sketched = sets.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))

    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    dealt = members.select("signature", F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk"), "node", chunks.alias("chunks"))
    met = scratch.save(_stars(dealt.join(known, "node"), percent).distinct())
    stars = met.where("a IS NOT NULL").select("a", "b")
    heads = met.where("pivot IS NOT NULL").select("signature", F.lit(0).alias("chunk"), F.col("pivot").alias("node"), F.lit(1).alias("chunks"))
    if heads.head(1):
        stars = stars.union(_stars(heads.join(known, "node"), percent).select("a", "b"))
    stars = scratch.save(stars.distinct())
    kept = scratch.save(_near(stars, sketched.select("node", F.col("sketch").alias("data")), sketches_apart, percent))
    scratch.drop(met, stars)
    stars = kept
    links = _links(stars, rows, sets, words, percent, scratch)
    scratch.drop(stars)
    found = scratch.save(components(links, scratch))
    scratch.drop(links)

    loose = scratch.save(_loose(_blocks(members, found).join(sketched, "node"), percent))
    scratch.drop(members)
    links = _links(loose, rows, sets, words, percent, scratch)
    final = scratch.save(merged_components(found, links, scratch))
    scratch.drop(loose, found, links)

    labelled = sets.join(final, "node", "left").withColumn("_group", F.coalesce("root", "node"))
    out = scratch.save(labelled.select("_id", "_text", "n", "_group"))
    scratch.drop(sets, final)
    return out


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by shingle sets at least ``percent`` alike.

    Returns one row for each row of ``docs``: id_col, text_hash (xxhash64 of the
    text's bytes), n_shingles, component_id (the least id reachable by links,
    its own included). A text of fewer words than a shingle is one element; a
    null text, or one without words, has none and links with nothing, not even
    its copies. Repeated rows and equal sets link. An empty table gives an empty
    table; other columns are ignored. Words and shingles are told apart by hashes
    of 64 bits, whole sets by hashes of 128.
    """
    labelled = _labelled(docs, words, percent, id_col, text_col)
    least = labelled.where("n > 0").groupBy("_group").agg(F.min("_id").alias("_least"))
    out = labelled.join(least, "_group", "left")
    return out.select(F.col("_id").alias(id_col), F.col("_text").alias("text_hash"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("_id")).alias("component_id"))


def keep_one_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Documents without near copies: of each component one row stays, with all columns.

    It is a row of the least doc_id, of several texts the one of least hash; a
    null doc_id stays only where the component has no other. Documents without
    words all stay.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    found = _labelled(docs, words, percent, "doc_id", "text").where("n > 0")
    chosen = found.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_text")).alias("h"))
    chosen = chosen.select(F.col("h._id").alias("_of"), F.col("h._text").alias("_of_text"))
    # whole rows in one column, so that no name of docs can clash
    keyed = docs.select(F.col("doc_id").alias("key"), F.xxhash64(text).alias("key_text"), F.regexp_like(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]")).alias("words"), F.struct(*docs.columns).alias("row"))
    kept = keyed.where("words").join(chosen, F.col("key").eqNullSafe(F.col("_of")) & (F.col("key_text") == F.col("_of_text"))).dropDuplicates(["key", "key_text"])
    return kept.select("row.*").unionByName(keyed.where("NOT words").select("row.*"))


def op4_partenum(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`jaccard_components`: 3 words, 90 percent."""
    out = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
sizes AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN sizes u ON u.doc_id = x JOIN sizes v ON v.doc_id = y WHERE 100 * c >= 90 * (u.n + v.n - c)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM sizes UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.node WHERE r.root < b.y)
SELECT sizes.doc_id, n AS n_shingles, min(root) AS component_id FROM sizes JOIN r ON r.node = sizes.doc_id GROUP BY 1, 2
"""
