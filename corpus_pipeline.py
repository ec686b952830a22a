"""A training corpus from the documents table: quality rules, near-duplicates, secrets, mixture, token ids."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import bpe, credentials, mixing, quality, simhash
from tidebar.llm.common import col, importable, whole, words
from tidebar.llm.queries import TOKENIZER, WEIGHTS
from tidebar.session import discard, owned, stage

_scratch: list[str] = []


def _step(work):
    """A stage whose scratch tables go when the next stage begins: its result has been written by then."""

    @functools.wraps(work)
    def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _scratch)
        importable(spark)
        with owned(_scratch):
            return work(spark, docs, sf_dir)

    return apply


@_step
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that too many documents of their source share."""
    return _recounted(quality.clean(docs, "doc_id", "text", "source"))


@_step
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.dedup(docs, "doc_id", "text")


@_step
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, reported spans masked."""
    return _recounted(credentials.mask(docs, "text"))


@_step
def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    columns = docs.columns
    row = F.struct(*(col(c) for c in columns)).alias("given")
    size = F.size(words(whole("text"))).cast("long").alias("size")
    given = docs.select(row, F.monotonically_increasing_id().alias("at"), "doc_id", "source", size, F.xxhash64("text").alias("text_hash"))
    mixed = mixing.times(stage(given, "mixture"), "source", "size", mixing.cycled(WEIGHTS), ["doc_id", "text_hash"], "at")
    out = mixed.where("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select(*(F.col("given").getField(c).alias(c) for c in columns))


@_step
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, packed as little-endian unsigned 32-bit integers, instead of the text."""
    path = public_tokenizers.path(TOKENIZER)
    coded = bpe.codec(docs, "text", path)
    return coded.select(
        "doc_id",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        (F.col("decoded") == whole("text")).alias("round_trip"),
    )


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mixture", source_mixture),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Encoding and XXH64 have no counterpart in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None
