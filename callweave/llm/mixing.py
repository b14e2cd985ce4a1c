"""Mixing sources to target weights by entropy balancing (DataFrame operations only).

Each source gets a target of words. Among all document rates between 0 and 2
that meet the targets, the ones nearest to 1 in relative entropy are
``min(2, exp(eta * size / mean))``, one dual value eta a source. The dual is
convex and smooth but for the bound, and safeguarded Newton steps solve it for
all sources at once: one aggregation of (source, size) cells a step. Sums are
exact decimals, so a rerun takes the same steps whatever order rows arrive in.

Rates become whole copies by systematic rounding along each source's sizes, and
what then lacks or exceeds is taken back from the largest sizes that fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._support import WORD, Scratch

WEIGHTS = (5, 2, 1)
MOST_COPIES = 2
MOST_STEPS = 60
FIX_ROUNDS = 6
ROWS_A_SALT, LEAST_SALTS = 50_000, 64


def _ranked(sources: DataFrame, scratch: Scratch, parts: int = 64) -> DataFrame:
    """Sources with ``rank`` from 0 by code point, null last: a range sort and an offset a part."""
    order = [F.col("source").isNull(), F.col("source")]
    sorted_ = scratch.save(sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    counts = sorted_.groupBy("part").count()
    starts = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return sorted_.join(starts, "part").select("source", "n_docs", "words", (F.col("before") + place - 1).alias("rank"))


def _targets(ranked: DataFrame, scratch: Scratch, share: float, most: float, weights=WEIGHTS) -> DataFrame:
    """Adds weight and target: shares by weight, capped at ``most`` times the source, the excess reshared."""
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    table = scratch.save(ranked.withColumn("weight", weight).withColumn("cap", F.col("words") * most))
    total = table.agg(F.sum("words")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        over = F.lit(level) * F.col("weight") >= F.col("cap")
        n, held, rest = table.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first() if capped >= 0 else (0, 0.0, table.agg(F.sum("weight")).first()[0])
        if n == capped or not rest:
            break
        level, capped = (share * total - held) / rest, n
    return table.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.col("cap")).cast("double"))


def _rate(eta: Column, size: Column, mean: Column) -> Column:
    """Tilted rate; the exponent is bounded, so exp can't overflow."""
    return F.least(F.lit(float(MOST_COPIES)), F.exp(F.least(F.lit(1.0), eta * size / mean)))


def _solve(cells: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """Newton steps on log(words taken) - log(target); returns rank, eta, mean, target."""
    mean = F.col("words") / F.col("n_docs")
    t, s = F.col("target"), F.col("words")
    full = t >= s * MOST_COPIES * (1 - 1e-12)
    state = targets.where("words > 0").select("rank", "target", mean.alias("mean"), F.when(t < s, mean * F.log(t / s)).otherwise(0.0).alias("low"), F.when(t < s, 0.0).otherwise(mean * F.log(F.lit(2.0))).alias("high"), (~full & (t > 0)).alias("open"), F.when(full, mean * F.log(F.lit(2.0))).otherwise(F.log(t / s)).alias("eta"))
    state = scratch.save(state.withColumn("eta", F.greatest("low", F.least("high", "eta"))))
    for _ in range(MOST_STEPS):
        rate = _rate(F.col("eta"), F.col("size"), F.col("mean"))
        words = (F.col("n") * F.col("size") * rate).cast("decimal(38,6)")
        slope = F.when(rate < MOST_COPIES, F.col("n") * F.col("size") * rate * F.col("size") / F.col("mean")).otherwise(0.0).cast("decimal(38,6)")
        sums = cells.join(state.where("open"), "rank").groupBy("rank").agg(F.sum(words).cast("double").alias("f"), F.sum(slope).cast("double").alias("g"))
        moved = state.join(sums, "rank", "left")
        low = F.when(F.col("f") < F.col("target"), F.col("eta")).otherwise(F.col("low"))
        high = F.when(F.col("f") > F.col("target"), F.col("eta")).otherwise(F.col("high"))
        step = F.col("eta") - F.log(F.col("f") / F.col("target")) * F.col("f") / F.col("g")
        moved = moved.withColumn("low", F.when(F.col("f").isNull(), F.col("low")).otherwise(low)).withColumn("high", F.when(F.col("f").isNull(), F.col("high")).otherwise(high)).withColumn("step", step)
        fine = F.abs(F.col("f") - F.col("target")) <= F.greatest(F.lit(0.5), F.col("target") * 1e-9)
        inside = F.col("step").isNotNull() & (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        eta = F.when(~F.col("open") | fine, F.col("eta")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        after = scratch.save(moved.select("rank", "target", "mean", "low", "high", (F.col("open") & ~F.coalesce(fine, F.lit(True))).alias("open"), eta.alias("eta")))
        scratch.drop(state)
        state = after
        if not state.where("open").head(1):
            break
    return state


def _copies(cells: DataFrame, solved: DataFrame) -> DataFrame:
    """Cells with ``copies``, the copies that their n documents make together."""
    by = Window.partitionBy("rank")
    along = by.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    out = cells.join(solved.select("rank", "eta", "mean", "target"), "rank").withColumn("rate", _rate(F.col("eta"), F.col("size"), F.col("mean")))
    out = out.withColumn("reach", F.sum(F.col("n") * F.col("rate")).over(along))
    out = out.withColumn("copies", (F.floor(F.col("reach") + 0.5) - F.floor(F.col("reach") - F.col("n") * F.col("rate") + 0.5)).cast("long"))
    out = out.withColumn("copies", F.least(F.greatest("copies", F.lit(0)), F.col("n") * MOST_COPIES))
    for _ in range(FIX_ROUNDS):
        out = out.withColumn("lack", F.round(F.col("target")).cast("long") - F.sum(F.col("copies") * F.col("size")).over(by))
        room = F.when(F.col("lack") > 0, F.col("n") * MOST_COPIES - F.col("copies")).otherwise(F.col("copies"))
        fits = (room > 0) & (F.col("size") <= F.abs("lack"))
        out = out.withColumn("best", F.max(F.when(fits, F.col("size"))).over(by))
        move = F.least(room, F.floor(F.abs("lack") / F.col("size")).cast("long")) * F.signum("lack").cast("long")
        out = out.withColumn("copies", F.col("copies") + F.when(F.col("size") == F.col("best"), move).otherwise(F.lit(0)))
    return out.select("rank", "size", F.col("n").alias("cell_n"), "rate", "copies")


def mix_sources(docs: DataFrame, share: float = 1.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Copies of every document in a mix of ``share`` times all words.

    Returns one row for each row of ``docs``: id_col, text_hash (xxhash64, of a
    null text null), source, size (words; null text 0), source_size, target,
    rate, copies (0 to 2), taken (copies * size). A null source is a source, the
    last one. Documents without words keep one copy. Repeated rows are rows of
    their own. An empty table, or one without words, gives zero targets. Other
    columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    text = F.col(text_col).cast("string")
    rows = scratch.save(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0)).alias("size"), F.xxhash64(text, F.lit(0)).alias("text_hash")))
    per_source = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("words"))
    targets = scratch.save(_targets(_ranked(per_source, scratch), scratch, share, float(MOST_COPIES)))
    known = rows.alias("r").join(targets.select(F.col("source").alias("of"), "rank").alias("t"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    known = scratch.save(known)
    scratch.drop(rows)
    sized = known.where("size > 0")
    cells = scratch.save(sized.groupBy("rank", "size").agg(F.count("*").alias("n")))
    made = scratch.save(_copies(cells, _solve(cells, targets, scratch)))

    # a cell's documents in the order of a hash, counted by salt so that no cell is one window
    salts = max(LEAST_SALTS, -(-known.count() // ROWS_A_SALT))
    place = F.xxhash64("id", "text_hash")
    salted = known.withColumn("place", place).withColumn("salt", F.pmod(F.shiftright("place", 8), F.lit(salts)))
    counts = salted.where("size > 0").groupBy("rank", "size", "salt").agg(F.count("*").alias("here"))
    before = F.sum("here").over(Window.partitionBy("rank", "size").orderBy("salt")) - F.col("here")
    starts = counts.withColumn("before", before).join(made, ["rank", "size"]).select("rank", "size", "salt", "before", "cell_n", "rate", "copies")
    nth = F.col("before") + F.row_number().over(Window.partitionBy("rank", "size", "salt").orderBy("place", "id", "text_hash"))
    each = salted.join(starts, ["rank", "size", "salt"], "left").withColumn("nth", nth)
    extra = F.col("copies") % F.col("cell_n")
    own = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("copies") / F.col("cell_n")) + (F.col("nth") <= extra).cast("long")).cast("long")
    each = each.select("id", "text_hash", "rank", "size", F.coalesce("rate", F.lit(1.0)).alias("rate"), own.alias("copies"))
    out = each.join(targets.select("rank", "source", F.col("words").alias("source_size"), "target"), "rank")
    return out.select(F.col("id").alias(id_col), "text_hash", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_copies(docs: DataFrame, share: float = 1.5) -> DataFrame:
    """The mix itself: every row of documents as often as it is taken, with all columns of ``docs``.

    Rows equal in doc_id and text share their copies evenly.
    """
    mixed = mix_sources(docs, share).groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_text")).agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    # whole rows in one column, so that no name of docs can clash
    keyed = docs.select(F.col("doc_id").alias("key"), F.xxhash64(F.col("text").cast("string"), F.lit(0)).alias("key_text"), F.col("source").alias("by"), F.struct(*docs.columns).alias("row"))
    joined = keyed.join(mixed, F.col("key").eqNullSafe(F.col("of")) & (F.col("key_text") == F.col("of_text")))
    nth = F.row_number().over(Window.partitionBy("key", "key_text").orderBy("by"))
    rest = joined.where("n > 1").withColumn("nth", nth)
    mine = (F.floor(F.col("copies") / F.col("n")) + (F.col("nth") <= F.col("copies") % F.col("n")).cast("long")).cast("long")
    every = joined.where("n = 1").select("row", F.col("copies").cast("long").alias("c")).unionByName(rest.select("row", mine.alias("c")))
    return every.where("c > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("c").cast("int")))).select("row.*")


def op3_entropy_mix(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`mix_sources`."""
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate")


def mix_targets(spark, sf_dir: str) -> DataFrame:
    """What of :func:`mix_sources` follows from the sources alone: every document's size, source_size and target."""
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


MIX_TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, CAST(2 AS DOUBLE) * words / w AS full_at, (SELECT CAST(1.5 AS DOUBLE) * sum(words) FROM s) - coalesce(sum(CAST(2 AS DOUBLE) * words) OVER before, 0) AS rest,
        (SELECT sum(w) FROM s) - coalesce(sum(w) OVER before, 0) AS weights
      FROM s WINDOW before AS (ORDER BY CAST(2 AS DOUBLE) * words / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT coalesce(arg_min(rest / weights, full_at) FILTER (WHERE full_at > rest / weights), max(full_at)) AS level FROM o)
SELECT d.doc_id, d.size, s.words AS source_size, round(least(level * w, CAST(2 AS DOUBLE) * words), 3) AS target FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source, level
"""
