"""The matching stages: equal names, similar names, structure, reach."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations, groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.names import as_bytes, is_unknown
from callweave.operators.edges import distinct_edges, edges, last_index, required_neighbours, unmatched
from callweave.operators.greedy import greedy_class_match, greedy_match
from callweave.session import cut


def _as_match(rows: DataFrame, stage: str) -> DataFrame:
    score = F.col("score") if "score" in rows.columns else F.lit(1.0)
    return rows.select(F.col("g2_idx").cast("long").alias("g2_idx"), F.col("g1_idx").cast("long").alias("g1_idx"), F.lit(stage).alias("stage"), score.cast("double").alias("score"))


def exact_match(g1: DataFrame, g2: DataFrame) -> DataFrame:
    """Named g2 functions and the last g1 function of the same name; of several the first g2 one."""
    named = g2.where(~is_unknown(F.col("name"))).select("name", F.col("idx").alias("g2_idx"))
    pairs = named.join(last_index(g1).withColumnRenamed("idx", "g1_idx"), "name")
    return _as_match(pairs.groupBy("g1_idx").agg(F.min("g2_idx").alias("g2_idx")), "exact")


#: Bytes of a name's end that are looked up with up to two edits.
TAIL = 8
#: A block of names has at most about so many g1 names.
BLOCK = 4096


def _bag(c: Column) -> Column:
    """64 bits: how often, up to 4, bytes of each of 16 classes stand in a name. An edit adds one bit and removes one at most."""
    kind = lambda i: F.ascii(F.substring(c, i, F.lit(1))).bitwiseAND(15) * 4
    seen = lambda m, at: F.call_function("shiftrightunsigned", m, at).bitwiseAND(F.lit(15).cast("long"))
    more = lambda m, at: m.bitwiseOR(F.call_function("shiftleft", (seen(m, at) * 2 + 1).bitwiseAND(F.lit(15).cast("long")), at))
    return F.aggregate(F.sequence(F.lit(1), F.length(c)), F.lit(0).cast("long"), lambda m, i: more(m, kind(i)))


def _without(c: Column, n: int, drop: int) -> Column:
    """Hashes of what an n-byte text is without each ``drop`` of its bytes."""
    kept = (sorted(set(range(n)) - set(gone)) for gone in combinations(range(n), drop))
    # runs of neighbouring bytes are taken at once
    runs = lambda at: [(g[0], len(g)) for g in ([x for _, x in group] for _, group in groupby(enumerate(at), lambda e: e[1] - e[0]))]
    return F.array(*(F.xxhash64(F.concat(*(F.substring(c, start + 1, length) for start, length in runs(at)))) for at in kept))


def similar_candidates(g1: DataFrame, g2: DataFrame, least: float) -> DataFrame:
    """g2_idx, g1_idx, score of names at least ``least`` similar, found by shared segments.

    With at most k edits between two names, either the last bytes of the g1 name
    have at most two of them, or the bytes before have at most k - 3; then one of
    k - 2 pieces that these are cut into stands unchanged in the g2 name. Where
    such pieces would be short, the whole name is cut into k + 1 pieces instead.
    Some unchanged piece, the j-th from 0, has at most j edits before it, so it is
    moved by j at most. Ends within two edits have something in common when each
    is without up to two bytes. Names join on lengths and pieces, in blocks, and
    on such remains. A name too short for its pieces joins on lengths alone.
    Counts of bytes part most names that met; of the rest distances are taken,
    bounded by k.
    """
    if least <= 0:
        raise ValueError("a threshold must be above 0")

    def named(g: DataFrame, n: int) -> DataFrame:
        rows = g.select(F.col("idx").alias(f"g{n}_idx"), as_bytes(F.col("name")).alias(f"b{n}")).where(f"length(b{n}) > 0")
        return rows.withColumn(f"l{n}", F.length(f"b{n}")).withColumn(f"m{n}", _bag(F.col(f"b{n}")))

    cut1, cut2 = cut(named(g1, 1)), cut(named(g2, 2))
    # lengths that can reach the threshold, one more on each side for rounding
    lengths = lambda own: F.explode(F.sequence(F.greatest(F.lit(1), F.floor(F.col(own) * least).cast("int") - 1), F.ceil(F.col(own) / least).cast("int") + 1))
    edits = F.floor((1 - least) * F.greatest("l1", "l2") + 1e-6).cast("int")
    # how many pieces, and of how many bytes together
    tailed = (F.col("k") >= 3) & (F.col("l1") - TAIL >= 3 * (F.col("k") - 2))
    with_k = lambda rows: rows.withColumn("k", edits).withColumn("n", F.when(tailed, F.col("k") - 2).otherwise(F.col("k") + 1)).withColumn("head", F.when(tailed, F.col("l1") - TAIL).otherwise(F.col("l1")))
    one = with_k(cut1.withColumn("l2", lengths("l1"))).join(F.broadcast(cut2.select("l2").distinct()), "l2", "left_semi")
    two = with_k(cut2.withColumn("l1", lengths("l2"))).join(F.broadcast(cut1.select("l1").distinct()), "l1", "left_semi")
    start = lambda j: F.floor(j * F.col("head") / F.col("n")).cast("int")
    # the number of a piece, its text, and -1 and nothing if the name is too short for pieces
    short = F.col("n") > F.col("head")
    nothing = F.array(F.struct(F.lit(-1).alias("j"), F.lit("").alias("piece")))
    every = F.sequence(F.lit(0), F.col("n") - 1)
    own = F.transform(every, lambda j: F.struct(j.alias("j"), F.substring(F.col("b1"), start(j) + 1, start(j + 1) - start(j)).alias("piece")))

    def moved(j):
        """Places in the g2 name where the j-th piece may stand."""
        more = F.col("l2") - F.col("l1")
        low = F.greatest(F.lit(0), start(j) + F.greatest(-j, more - F.col("k")))
        high = F.least(F.col("l2") - (start(j + 1) - start(j)), start(j) + F.least(j, more + F.col("k")))
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    other = F.flatten(F.transform(every, lambda j: F.transform(moved(j), lambda p: F.struct(j.alias("j"), F.substring(F.col("b2"), p + 1, start(j + 1) - start(j)).alias("piece")))))
    key = ["l1", "l2", "j", "piece"]
    one = one.withColumn("x", F.explode(F.when(short, nothing).otherwise(own))).select("g1_idx", "b1", "m1", "l1", "l2", "x.j", "x.piece")
    two = two.withColumn("x", F.explode(F.array_distinct(F.when(short, nothing).otherwise(other)))).select("g2_idx", "b2", "m2", "l1", "l2", "k", "x.j", "x.piece")
    blocks = cut(one.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"))
    one = one.join(blocks, key, "left").withColumn("block", F.pmod(F.xxhash64("g1_idx"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    two = two.join(blocks, key, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    # few bytes can meet in many pairs, so these tasks aren't merged by bytes
    spark = g1.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = lambda rows: rows.repartition(tasks, *key, "block")
    apart = [F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y)))) <= F.col("k") for x, y in (("m1", "m2"), ("m2", "m1"))]
    distance = F.call_function("levenshtein", "b2", "b1", "k")

    def near(pairs: DataFrame) -> DataFrame:
        return pairs.where(apart[0] & apart[1] & (distance >= 0)).select("g2_idx", "g1_idx", F.greatest("l1", "l2").cast("double").alias("long"), distance.alias("edits"))

    heads = near(dealt(one).hint("merge").join(dealt(two), [*key, "block"]))
    # without up to two bytes on each side, lengths must agree: both without two if they are equal
    end1 = F.expr(f"right(b1, {TAIL})")
    rest = lambda c, n, d: _without(c, n, d)
    ends1 = cut1.where(F.col("l1") >= TAIL + 3).withColumn("rest", F.explode(F.array_distinct(F.flatten(F.array(*(rest(end1, TAIL, d) for d in (0, 1, 2)))))))
    # a longer end loses two bytes against fewer, a shorter one fewer against two
    longer = [(n, min(2, 2 + n - TAIL)) for n in range(TAIL - 2, TAIL + 3)]
    ends2 = [F.when(F.col("l2") >= n, rest(F.expr(f"right(b2, {n})"), n, d)).otherwise(F.array().cast("array<bigint>")) for n, d in longer]
    ends2 = cut2.withColumn("rest", F.explode(F.array_distinct(F.flatten(F.array(*ends2)))))
    tails = near(ends1.join(ends2, "rest").withColumn("k", edits).where("k >= 3"))
    found = heads.unionAll(tails).distinct()
    return found.select("g2_idx", "g1_idx", (1.0 - F.col("edits") / F.col("long")).alias("score")).where(F.col("score") >= least)


def similar_match(g1: DataFrame, g2: DataFrame, match: DataFrame, least: float) -> DataFrame:
    """Named unmatched g2 functions and unused g1 functions of similar names, best first."""
    open2 = unmatched(g2.where(~is_unknown(F.col("name"))), match, "g2_idx")
    return _as_match(greedy_match(similar_candidates(unmatched(g1, match, "g1_idx"), open2, least)), "similar")


#: Shares of names, as powers of 2, that marks are made of: a large set fills the marks of large shares.
SHARES = (0, 4, 8, 12)


def _marks(h: Column) -> list[Column]:
    """A bit for a hashed name, once for each share; none if the name isn't of the share."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    return [F.when(F.call_function("shiftrightunsigned", h, F.lit(8)).bitwiseAND((1 << s) - 1) == 0, bit).otherwise(F.lit(0).cast("long")) for s in SHARES]


def _candidate_classes(required: DataFrame, g1: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, u) and (v, c): candidates of one v of each required set, and the functions that share it.

    Sets are told apart by size and 128 bits of hashes. Each one starts from the
    rarest name in it, so names that everything calls don't join with everything,
    and meets only functions whose marks hold its own; the rest is counted.
    """
    name = lambda d, t: F.xxhash64(d, t)
    required = cut(required.withColumn("h", name("dir", "t")))
    mark = [f"s{s}" for s in SHARES]
    sets = required.groupBy("v").agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64("t", "dir", F.lit(1))).alias("y"))
    sets = cut(sets)
    members = cut(sets.join(sets.groupBy("n", "x", "y").agg(F.min("v").alias("c")), ["n", "x", "y"]).select("v", "c"))
    asked = required.join(members.where("v = c").select("v"), "v", "left_semi").withColumnRenamed("v", "c")
    have = edges(g1).select(F.col("idx").alias("u"), name("dir", "nbr_name").alias("h"))
    held = have.groupBy("h").agg(F.count("*").alias("held"))
    first = asked.join(held, "h", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    # `{p}{m}` are the marks of a set
    marks = lambda p: [F.bit_or(x).alias(f"{p}{m}") for m, x in zip(mark, _marks(F.col("h")))]
    start = first.groupBy("c").agg(F.count("*").alias("n"), F.min(F.struct("held", "h")).alias("r"), *marks("c_")).where("r.held > 0").select("c", "n", F.col("r.h").alias("h"), *(f"c_{m}" for m in mark))
    own = have.groupBy("u").agg(*marks("u_"))
    marked = g1.withColumnRenamed("idx", "u").join(own, "u").select(F.col("u").alias("idx"), "callees", "callers", F.struct(*(f"u_{m}" for m in mark)).alias("m"))
    at = lambda d, c: marked.select(F.col("idx").alias("u"), "m", F.explode(c).alias("t")).select("u", "m", name(F.lit(d), "t").alias("h"))
    fits = reduce(lambda x, y: x & y, (F.col(f"c_{m}").bitwiseAND(F.bitwise_not(F.col(f"m.u_{m}"))) == 0 for m in mark))
    met = cut(start.join(at("callee", "callees").unionAll(at("caller", "callers")), "h").where(fits).select("c", "u", "n").distinct())
    listed = distinct_edges(g1.join(met.select(F.col("u").alias("idx")).distinct(), "idx", "left_semi")).select(F.col("idx").alias("u"), "dir", F.col("nbr_name").alias("t"))
    full = met.join(asked.select("c", "dir", "t"), "c").join(listed, ["u", "dir", "t"], "left_semi").groupBy("c", "u", "n").agg(F.count("*").alias("k")).where("k = n")
    return cut(full.select("c", "u")), members


def structural_candidates(required: DataFrame, g1: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """v, u: g1 functions that have all neighbours that v requires, without those that ``used`` has as u.

    Functions that require the same names have the same candidates, which are
    sought once.
    """
    found, members = _candidate_classes(required, g1)
    if used is not None:
        found = found.join(used.select("u"), "u", "left_anti")
    return found.join(members, "c").select("v", "u")


def unknown_neighbours(g2: DataFrame, match: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """idx, n: listed neighbours of a g2 function (of those in ``of``) without any matched function of their name."""
    known = match.select(F.col("g2_idx").alias("idx")).join(g2.select("idx", "name"), "idx").select(F.col("name").alias("nbr_name")).distinct()
    return edges(g2 if of is None else of).join(known, "nbr_name", "left_anti").groupBy("idx").agg(F.count("*").alias("n"))


def unmatched_neighbours(g1: DataFrame, match: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """idx, n: listed neighbours of a g1 function (of those in ``of``) whose name's last function is unused."""
    open_ = unmatched(last_index(g1), match, "g1_idx").select(F.col("name").alias("nbr_name"))
    return edges(g1 if of is None else of).join(open_, "nbr_name", "left_semi").groupBy("idx").agg(F.count("*").alias("n"))


def _profile(g: DataFrame, of: DataFrame, own: str, count: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``own``, callees, callers, open: lengths of the lists of functions that ``of`` has, and their open neighbours."""
    g = cut(g.join(of.select(F.col(own).alias("idx")).distinct(), "idx", "left_semi"))
    sizes = g.select("idx", F.size("callees").alias("callees"), F.size("callers").alias("callers"))
    return sizes.join(count(g).withColumnRenamed("n", "open"), "idx", "left").select(F.col("idx").alias(own), "callees", "callers", F.coalesce("open", F.lit(0)).alias("open"))


def _profiles(of: DataFrame, by: DataFrame, g1: DataFrame, g2: DataFrame, match: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles, a_ and b_, of the functions v that ``by`` and u that ``of`` has."""
    named = lambda rows, p: rows.withColumnsRenamed({c: f"{p}_{c}" for c in ("callees", "callers", "open")})
    return named(_profile(g2, by, "v", lambda g: unknown_neighbours(g2, match, g)), "a"), named(_profile(g1, of, "u", lambda g: unmatched_neighbours(g1, match, g)), "b")


def _cost() -> Column:
    return reduce(lambda x, y: x + y, (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in ("callees", "callers", "open"))).cast("long")


def ambiguity_cost(candidates: DataFrame, g1: DataFrame, g2: DataFrame, match: DataFrame) -> DataFrame:
    """v, u, cost of unused candidates: differences of list lengths and of open neighbours."""
    free = cut(candidates.join(match.select(F.col("g1_idx").alias("u")), "u", "left_anti"))
    a, b = _profiles(free, free, g1, g2, match)
    return free.join(a, "v").join(b, "u").select("v", "u", _cost().alias("cost"))


def _structural_round(g1: DataFrame, g2: DataFrame, match: DataFrame) -> DataFrame:
    """Works on required sets and on profiles, so pairs of functions that can't be told apart are never made."""
    used = match.select(F.col("g1_idx").alias("u"))
    found, members = _candidate_classes(required_neighbours(match, g1, g2, unmatched(g2, match, "g2_idx")), g1)
    counts = cut(found.groupBy("c").agg(F.count("*").alias("n"), F.min("u").alias("u")))
    single = members.join(counts.where("n = 1"), "c").select("v", "u")
    several = counts.where("n > 1").select("c")
    free = cut(found.join(several, "c", "left_semi").join(used, "u", "left_anti"))
    asking = cut(members.join(free.select("c").distinct(), "c", "left_semi"))
    a, b = _profiles(free, asking, g1, g2, match)
    a_, b_ = (["c", *(f"{p}_{c}" for c in ("callees", "callers", "open"))] for p in "ab")
    asking = cut(asking.join(a, "v"))
    alike = free.join(b, "u").groupBy(b_).agg(F.count("*").alias("k"), F.min("u").alias("u"))
    costs = asking.select(a_).distinct().join(alike, "c").withColumn("cost", _cost())
    # of the least cost: how many, and one of them
    least = costs.groupBy(*a_, "cost").agg(F.sum("k").alias("k"), F.min("u").alias("u")).groupBy(a_).agg(F.min(F.struct("cost", "k", "u")).alias("x"))
    tied = asking.join(least.where("x.k = 1").select(*a_, F.col("x.u").alias("u")), a_)
    proposed = single.unionAll(tied.select("v", "u")).join(used, "u", "left_anti")
    return proposed.groupBy("u").agg(F.min("v").alias("v")).select(F.col("v").alias("g2_idx"), F.col("u").alias("g1_idx"))


def structural_match(g1: DataFrame, g2: DataFrame, match: DataFrame, max_rounds: int | None = 1) -> DataFrame:
    """Unmatched g2 functions and the g1 functions that their matched neighbours single out.

    A single candidate is proposed even if it is used, and then lost; of several
    the unused one of least cost, if no other costs as little. A g1 function goes
    to the first g2 function that it is proposed for. One round sees only what
    was matched before it; ``max_rounds`` None repeats until nothing is found.
    """
    done, rounds = match.select("g2_idx", "g1_idx"), 0
    out = []
    while max_rounds is None or rounds < max_rounds:
        new = cut(_structural_round(g1, g2, done))
        rounds += 1
        out.append(new)
        if max_rounds is None and not new.head(1):
            break
        done = done.unionAll(new)
    return _as_match(reduce(DataFrame.unionAll, out), "structural")


#: Up to so many starts of a step go to all executors, beyond they are joined.
BROADCAST_STARTS = 1_000_000


def _steps(functions: DataFrame, ends: DataFrame, asked: DataFrame) -> DataFrame:
    """at, dir, name, to: one step from the functions ``at``, in the directions (down, up) that ``asked`` names."""
    listed = lambda d, c, wanted: F.when(F.col(wanted), F.transform(c, lambda x: F.struct(F.lit(d).alias("dir"), x.alias("name")))).otherwise(F.array().cast("array<struct<dir:string,name:string>>"))
    few = F.broadcast(asked) if asked.count() <= BROADCAST_STARTS else asked
    own = functions.select(F.col("idx").alias("at"), "callees", "callers").join(few, "at")
    names = own.select("at", F.explode(F.concat(listed("callee", "callees", "down"), listed("caller", "callers", "up"))).alias("x")).select("at", "x.dir", "x.name")
    return cut(names.distinct().join(ends, "name"))


def _walked(functions: DataFrame, ends: DataFrame, depth: int, of: DataFrame | None) -> DataFrame:
    """idx, dir, name, to: what functions (those in ``of``) reach in 1 to ``depth`` steps of one direction.

    ``ends`` (name, to) says which functions a name leads to. With ``of`` a step
    reads the lists of those functions only that the step before has reached.
    """
    if of is None:
        steps = cut(edges(functions).select(F.col("idx").alias("at"), "dir", F.col("nbr_name").alias("name")).distinct().join(ends, "name"))
        now = steps.select(F.col("at").alias("idx"), "dir", "name", "to")
        out, at = [now], now.select("idx", "dir", F.col("to").alias("at")).distinct()
    else:
        out, at = [], of.select("idx", F.explode(F.array(F.lit("callee"), F.lit("caller"))).alias("dir"), F.col("idx").alias("at"))
    while len(out) < depth:
        if of is not None:
            has = lambda d: F.max(F.col("dir") == d)
            steps = _steps(functions, ends, cut(at.groupBy("at").agg(has("callee").alias("down"), has("caller").alias("up"))))
        now = cut(at.join(steps, ["at", "dir"]).select("idx", "dir", "name", "to").distinct())
        out.append(now)
        at = now.select("idx", "dir", F.col("to").alias("at")).distinct()
    return reduce(DataFrame.unionAll, out)


def reach(functions: DataFrame, depth: int, of: DataFrame | None = None) -> DataFrame:
    """idx, dir, name: names that resolve in g1 and are reached (from those in ``of``) in 1 to ``depth`` steps of one direction."""
    return _walked(functions, cut(last_index(functions).withColumnRenamed("idx", "to")), depth, of).select("idx", "dir", "name").distinct()


def translated_reach(g2: DataFrame, g1: DataFrame, match: DataFrame, depth: int, of: DataFrame | None = None) -> DataFrame:
    """idx, dir, name: g1 names of matched g2 functions reached (from those in ``of``); all functions of a name are walked through."""
    found = _walked(g2, cut(g2.select("name", F.col("idx").alias("to"))), depth, of).select("idx", "dir", "to").distinct()
    named = match.select(F.col("g2_idx").alias("to"), "g1_idx").join(g1.select(F.col("idx").alias("g1_idx"), "name"), "g1_idx").select("to", "name")
    return found.join(named, "to").select("idx", "dir", "name").distinct()


def _overlap_pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """v, u that may score ``least``: in some direction the smaller set's rarest names meet the larger set.

    A mean reaches ``least`` only if one direction does. There, the larger set has
    at least ``least`` of the smaller one's n names, so one of any
    n - ceil(least * n) + 1 of them; the rarest are taken.
    """
    held = a.unionAll(b).groupBy("dir", "name").agg(F.count("*").alias("held"))

    def sized(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("idx", "dir").agg(F.count("*").alias("n")), ["idx", "dir"])

    def first(rows: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("idx", "dir").orderBy("held", "name"))
        return rows.join(held, ["dir", "name"]).withColumn("nth", nth).where(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * least - 1e-6) + 1).drop("held", "nth")

    x, y = (cut(sized(rows)) for rows in (a, b))
    own = lambda rows, i: rows.select("dir", "name", F.col("idx").alias(i), F.col("n").alias(f"n_{i}"))
    smaller_v = own(first(x), "v").join(own(y, "u"), ["dir", "name"]).where("n_v <= n_u")
    smaller_u = own(first(y), "u").join(own(x, "v"), ["dir", "name"]).where("n_u < n_v")
    return smaller_v.select("v", "u").unionAll(smaller_u.select("v", "u")).distinct()


def _set_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(idx, c) and the rows of the functions c: functions of equal sets share c, the least of them.

    Sets are told apart by size and 128 bits of hashes.
    """
    sets = rows.groupBy("idx").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("dir", "name")).alias("x"), F.bit_xor(F.xxhash64("name", "dir", F.lit(1))).alias("y"))
    sets = cut(sets)
    members = cut(sets.join(sets.groupBy("n", "x", "y").agg(F.min("idx").alias("c")), ["n", "x", "y"]).select("idx", "c"))
    return members, cut(rows.join(members.where("idx = c").select("idx"), "idx", "left_semi"))


def _scores(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """v, u, score of functions of ``a`` and ``b``, each with each."""
    pairs = cut(_overlap_pairs(a, b, least))
    rows = {"v": a.withColumnRenamed("idx", "v"), "u": b.withColumnRenamed("idx", "u")}
    count = lambda i: rows[i].groupBy(i, "dir").agg(F.count("*").alias(f"n_{i}"))
    met = pairs.join(count("v"), "v").join(count("u"), ["u", "dir"])
    # the names of the smaller set are looked up in the larger one
    in_both = lambda test, own, other: met.where(test).join(rows[own], [own, "dir"]).join(rows[other], [other, "dir", "name"], "left_semi").select("v", "u", "dir")
    both = in_both("n_v <= n_u", "v", "u").unionAll(in_both("n_u < n_v", "u", "v"))
    of_dir = lambda d: F.count(F.when(F.col("dir") == d, 1))
    common = both.groupBy("v", "u").agg(of_dir("callee").alias("callee"), of_dir("caller").alias("caller"))

    def sizes(rows: DataFrame, own: str) -> DataFrame:
        return rows.groupBy(F.col("idx").alias(own)).agg(of_dir("callee").alias(f"{own}_callee"), of_dir("caller").alias(f"{own}_caller"))

    both = common.join(sizes(a, "v"), "v").join(sizes(b, "u"), "u")

    def of(d: str):
        x, y = F.col(f"v_{d}"), F.col(f"u_{d}")
        return F.when((x > 0) & (y > 0), F.col(d).cast("double") / F.least(x, y)).otherwise(0.0), ((x > 0) | (y > 0)).cast("int")

    (s1, p1), (s2, p2) = of("callee"), of("caller")
    return both.select("v", "u", ((s1 * p1 + s2 * p2) / (p1 + p2)).alias("score")).where(F.col("score") >= least)


def _class_scores(a: DataFrame, b: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(c, d, score) of classes of equal sets, and their members (v, c) and (u, d)."""
    (vs, a), (us, b) = _set_classes(a), _set_classes(b)
    scores = cut(_scores(a, b, least).select(F.col("v").alias("c"), F.col("u").alias("d"), "score"))
    return scores, vs.withColumnRenamed("idx", "v"), us.select(F.col("idx").alias("u"), F.col("c").alias("d"))


#: Members of two classes meet in cells of about so many on each side.
CELL = 1024


def _all_members(scores: DataFrame, vs: DataFrame, us: DataFrame) -> DataFrame:
    """v, u, score of all members of the classes of each pair."""
    blocks = lambda rows, c, n: rows.groupBy(c).agg(F.ceil(F.count("*") / CELL).cast("int").alias(n))
    cells = cut(scores.join(blocks(vs, "c", "of_v"), "c").join(blocks(us, "d", "of_u"), "d"))
    block = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["c", "d", "i", "j"]
    one = cells.join(vs, "c").select("c", "d", "score", "v", block("v", "of_v").alias("i"), every("of_u").alias("j"))
    two = cells.join(us, "d").select("c", "d", "u", block("u", "of_u").alias("j"), every("of_v").alias("i"))
    # few bytes can meet in many pairs, so these tasks aren't merged by bytes
    spark = scores.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = lambda rows: rows.repartition(tasks, *key)
    return dealt(one).hint("merge").join(dealt(two), key).select("v", "u", "score")


def overlap_scores(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """v, u, score of functions whose reach sets overlap by ``least`` (above 0) at least.

    In a direction the score is the share of the smaller set that both have. A
    direction counts if either has names in it; the score is the mean over those.
    Functions of equal sets are scored once.
    """
    return _all_members(*_class_scores(a, b, least))


def _open_reach(g1: DataFrame, g2: DataFrame, match: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """What unmatched g2 and g1 functions reach, in g1 names."""
    mine = translated_reach(g2, g1, match, depth, unmatched(g2, match, "g2_idx"))
    return cut(mine), cut(reach(g1, depth, unmatched(g1, match, "g1_idx")))


def inline_candidates(g1: DataFrame, g2: DataFrame, match: DataFrame, least: float, depth: int = 3) -> DataFrame:
    """g2_idx, g1_idx, score of unmatched functions with similar reach."""
    if least <= 0:
        raise ValueError("a threshold must be above 0")
    return overlap_scores(*_open_reach(g1, g2, match, depth), least).select(F.col("v").alias("g2_idx"), F.col("u").alias("g1_idx"), "score")


def inline_match(g1: DataFrame, g2: DataFrame, match: DataFrame, least: float, depth: int = 3) -> DataFrame:
    """Unmatched functions that reach the same functions in a few steps, best first: inlining in between is no matter."""
    if least <= 0:
        raise ValueError("a threshold must be above 0")
    scores, vs, us = _class_scores(*_open_reach(g1, g2, match, depth), least)
    return _as_match(greedy_class_match(scores, vs, us), "inline")


def structural_score(pairs: DataFrame, g1: DataFrame, g2: DataFrame, match: DataFrame) -> DataFrame:
    """v, u, score: the share of v's required neighbours that u has; 0 without any."""
    required = required_neighbours(match, g1, g2, g2.join(pairs.select(F.col("v").alias("idx")).distinct(), "idx", "left_semi"))
    have = distinct_edges(g1).select(F.col("idx").alias("u"), "dir", F.col("nbr_name").alias("t"), F.lit(1).alias("has"))
    counts = pairs.join(required, "v", "left").join(have, ["u", "dir", "t"], "left").groupBy("v", "u").agg(F.count("t").alias("n"), F.sum("has").alias("c"))
    return counts.select("v", "u", F.when(F.col("n") > 0, F.coalesce("c", F.lit(0)) / F.col("n")).otherwise(0.0).cast("double").alias("score"))


def find_target(g1: DataFrame, g2: DataFrame, match: DataFrame, name: str, least: float) -> DataFrame:
    """g1_idx, score: unused g1 functions for the first unmatched g2 function of a name, best first.

    Those that have all required neighbours and score enough; without any, those
    of similar names, their score being similarity plus half the structural one.
    A name without an unmatched function gives no rows.
    """
    first = unmatched(g2.where(F.col("name") == name), match, "g2_idx").agg(F.min("idx").alias("v")).where("v IS NOT NULL")
    first = cut(first)
    free = unmatched(g1, match, "g1_idx")
    required = required_neighbours(match, g1, g2, g2.join(first.select(F.col("v").alias("idx")), "idx", "left_semi"))
    found = structural_candidates(required, g1).join(free.select(F.col("idx").alias("u")), "u", "left_semi")
    strong = cut(structural_score(found, g1, g2, match).where(F.col("score") >= least).select(F.col("u").alias("g1_idx"), "score"))
    if strong.head(1):
        return strong.orderBy(F.desc("score"), "g1_idx")
    one = g2.join(first.select(F.col("v").alias("idx")), "idx", "left_semi")
    close = cut(similar_candidates(free, one, least))
    both = structural_score(close.select(F.col("g2_idx").alias("v"), F.col("g1_idx").alias("u")), g1, g2, match).withColumnRenamed("score", "s")
    out = close.join(both.select(F.col("u").alias("g1_idx"), "s"), "g1_idx")
    return out.select("g1_idx", (F.col("score") + 0.5 * F.col("s")).alias("score")).orderBy(F.desc("score"), "g1_idx")


