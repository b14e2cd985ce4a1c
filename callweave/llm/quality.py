"""Quality rules and a hashed n-gram log-likelihood ratio.

Base rules count words, symbols, repeated lines and repeated passages of a whole
text. What passes them is scored by the mean, over all its byte n-grams, of the
log ratio between two multinomials over hashed n-grams: one of trusted texts, one
of the raw corpus. The raw one counts every n-gram of every document; trusted
texts are those that one half of all labels marks as good. A fixed threshold, set
where it best parts the other half's good and bad texts while keeping nearly all
good ones, decides every document, with no draw of chance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._support import arrow_batches

BITS, N = 16, 4
SMOOTH = 1.0
#: So many labels at most go to all executors; more are joined. The result is the same.
SENT_LABELS = 1_000_000
#: Scores are counted in cells of this width for the threshold.
CELL = 1e-4
#: Share of the good texts that the threshold keeps at least.
KEEP_GOOD = 0.995
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


def hashed(text: bytes):
    """A bucket for each byte n-gram; a shorter text has none."""
    import numpy as np

    x = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(x) < N:
        return np.empty(0, np.uint32)
    h = x[: len(x) - N + 1].copy()
    for i in range(1, N):
        h = h * np.uint32(257) + x[i : len(x) - N + 1 + i]
    return (h * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()
    n = len(words)
    # code points that are no ASCII white space: bytes that begin a character, less the white space
    chars = len(text) - len(text.translate(None, _STARTS)) - (len(text) - len(text.translate(None, SPACES)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACES):
            seen.add(line)
    repeated = 0
    if n >= 3:
        met: dict[tuple[bytes, bytes, bytes], int] = {}
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            covered = bytearray(n)
            for i, w in enumerate(windows):
                first = met.setdefault(w, i)
                if first != i:
                    covered[i : i + 3] = b"\x01\x01\x01"
                    covered[first : first + 3] = b"\x01\x01\x01"
            repeated = sum(covered)
    return n, chars, symbols, again, repeated


#: Bytes that begin a character in UTF-8.
_STARTS = bytes(b for b in range(256) if b & 0xC0 != 0x80)


def mean_ratio(text: bytes, ratio) -> float:
    h = hashed(text)
    return float(ratio[h].mean()) if len(h) else 0.0


def corpus_counts(docs: DataFrame, text_col: str = "text"):
    """Counts of all hashed n-grams of all documents, as an array of 2**BITS longs.

    A task adds its own up first; the driver gets one sum a bucket.
    """
    import numpy as np

    def run(batches):
        import pyarrow as pa

        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            every = [hashed(text) for text in batch.column(0).to_pylist()]
            total += np.bincount(np.concatenate(every) if every else [], minlength=1 << BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    found = docs.select(text).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def log_ratio(trusted, raw):
    """log p_trusted - log p_raw for each bucket, both smoothed alike."""
    import numpy as np

    v = len(raw)
    return np.log((trusted + SMOOTH) / (trusted.sum() + SMOOTH * v)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * v))


def threshold(values, good, bad) -> float:
    """Where good and bad scores are parted best, with at least KEEP_GOOD of the good ones above.

    ``values`` are scores, ascending, ``good`` and ``bad`` how many texts have
    each. The threshold lies midway between the least score kept and the next one
    below, or half a cell below it.
    """
    import numpy as np

    values, good, bad = np.asarray(values, float), np.asarray(good, np.int64), np.asarray(bad, np.int64)
    if not good.sum():
        return float("-inf")
    most = int(np.argmax(np.cumsum(good) > int((1 - KEEP_GOOD) * good.sum())))
    gain = (np.cumsum(bad) - bad) / max(1, bad.sum()) - (np.cumsum(good) - good) / good.sum()
    least = int(np.argmax(gain[: most + 1])) if bad.sum() else most
    return float((values[least] + values[least - 1]) / 2 if least else values[least] - CELL / 2)


def _scored(rows: DataFrame, ratio) -> DataFrame:
    """doc_id, quality, score of labelled texts that pass the base rules. rows: doc_id, quality, text."""
    shared = rows.sparkSession.sparkContext.broadcast(ratio)  # 2**BITS floats

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            every = [None if failed(base_counts(x)) else mean_ratio(x, shared.value) for x in batch.column(2).to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(every, pa.float64())], names=["doc_id", "quality", "score"])
            yield out.filter(out.column(2).is_valid())

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, quality {rows.schema['quality'].dataType.simpleString()}, score double")


def fit(docs: DataFrame, labels: DataFrame):
    """The log ratios and the threshold, from all labels, of which one half, by hash, gives the trusted texts and the other the threshold.

    Only counts come to the driver, of n-grams and of scores by cell; of several rows of one doc_id the least score.
    """
    import numpy as np

    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality")
    known = known.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)))
    few = known.limit(SENT_LABELS + 1).count() <= SENT_LABELS
    sent = F.broadcast if few else lambda rows: rows
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    rows = docs.select("doc_id", text)
    trusted = corpus_counts(rows.join(sent(known.where("quality = 1 AND half = 0")), "doc_id", "left_semi"))
    ratio = log_ratio(trusted, corpus_counts(docs)) if trusted.any() else np.zeros(1 << BITS)
    scored = _scored(rows.join(sent(known.where("half = 1")), "doc_id").select("doc_id", "quality", "text"), ratio)
    least = scored.groupBy("doc_id", "quality").agg(F.min("score").alias("score"))
    cells = least.groupBy(F.round(F.col("score") / CELL).cast("long").alias("cell")).agg(F.count(F.when(F.col("quality") == 1, 1)).alias("good"), F.count(F.when(F.col("quality") != 1, 1)).alias("bad")).toPandas().sort_values("cell")
    return ratio, threshold(cells["cell"].to_numpy(float) * CELL, cells["good"], cells["bad"])


def failed(counts: tuple[int, ...]) -> bool:
    n, repeated = counts[0], counts[4]
    return n < 50 or 100 * repeated > 50 * n


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, score and verdict of every document.

    Returns one row for each row of ``docs``: id_col, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept. A null text
    counts as empty and fails. ``labels`` has doc_id, quality (1 good); all of
    its rows are used. Without good labels all scores are 0 and only base rules
    decide. Repeated rows are rows of their own;
    an empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    ratio, least = fit(docs, labels)
    shared = spark.sparkContext.broadcast(ratio.astype("float32"))  # 2**BITS floats

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ratio = shared.value.astype(np.float64)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                counts = base_counts(text)
                bad, score = failed(counts), mean_ratio(text, ratio)
                rows.append((*counts, bad, score, not bad and score >= least))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    schema = f"`{id_col}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, score double, kept boolean"
    return docs.select(id_col, text).mapInArrow(run, schema)


def op6_ngram_ratio(spark, sf_dir: str) -> DataFrame:
    """Contract columns of :func:`judge`."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def base_rules(spark, sf_dir: str) -> DataFrame:
    """What of :func:`judge` follows from a text alone: counts and the base rules' verdict."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT rid, u.i, ws[u.i] || ' ' || ws[u.i + 1] || ' ' || ws[u.i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
twice AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
repeated AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
again AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(again.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(repeated.n, 0) > 50 * len(ws) AS base_failed
FROM w LEFT JOIN repeated USING (rid) LEFT JOIN again USING (rid)
"""
