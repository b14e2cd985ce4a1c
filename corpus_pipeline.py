"""A training corpus from ``documents``: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm._support import Scratch
from callweave.llm.bpe import encode_texts
from callweave.llm.line_dedup import drop_common_lines
from callweave.llm.mixing import take_copies
from callweave.llm.ngram_join import keep_one_each
from callweave.llm.toxicity import score_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL can express the machine that the first stage learns.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, labels, keep=("text", "lang", "source", "n_chars"))
    return scored.where("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 10 or more documents go; every document stays, be its text empty then."""
    kept = drop_common_lines(docs, keep=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in 80 % of their 5-word shingles the least doc_id stays."""
    return keep_one_each(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return take_copies(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text and the sha256 of what the decoder makes of them; a text that doesn't come back raises."""
    import public_tokenizers

    digest = lambda c: F.sha2(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"), 256)
    docs = docs.withColumn("text_sha256", digest("text"))
    # half the memory: the JVM beside the workers is as large as earlier stages have made it
    coded = encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True, keep=("lang", "source", "text_sha256"), memory=0.5)
    lost = F.raise_error(F.concat(F.lit("decoded text differs from the text of doc_id "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    back = F.when(digest("decoded") == F.col("text_sha256"), F.col("text_sha256")).otherwise(lost)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), back.alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
