"""The operators of this package applied to the given tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import audit, bpe, credentials, embedding, extraction, hmm, merkle, mixing, oracles, quality, sharding, simhash, token_files, urls
from tidebar.llm.common import importable, whole, words
from tidebar.session import new_path

TOKENIZER = "byte_bpe_50k.json"
FILE_TOKENIZER = "word_bpe_49k.json"
SHARDS = 24
WEIGHTS = (5.0, 2.0, 1.0)
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", F.size(words(whole("text"))).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))
    mixed = mixing.mix(sized, "source", "size", mixing.cycled(WEIGHTS), ["doc_id", "text_hash"])
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source", "times"
    )


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.codec(docs, "text", path, keep=False)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    scored = hmm.score(_table(spark, sf_dir, "documents"), "doc_id", "text", held_out)
    return scored.withColumnRenamed("key", "doc_id")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find(_table(spark, sf_dir, "documents"), ["doc_id"], "text")
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *(credentials.counted(spans, k).alias(f"n_{k}") for k, *_ in credentials.BASE),
        F.sha2(credentials.listed(credentials.base(spans)), 256).alias("base_sha256"),
        credentials.listed(spans).alias("spans"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return judged.select(F.col("key").alias("doc_id"), *quality.METRICS, "base_failed", "kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = docs.select(
        "doc_id",
        (F.octet_length(whole("text")) + 8).cast("long").alias("size"),
        F.crc32(whole("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    dealt = sharding.balanced_shards(sized, SHARDS, "size", [F.col("doc_id"), F.col("text_crc32"), F.col("text_hash")])
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    texts = extraction.extract(pages.select("page_id", "url", "html"), "html", extraction.fit(pages, "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(_table(spark, sf_dir, "pages"), "page_id", "url", RULES)
    return judged.select(F.col("key").alias("page_id"), "host", "path", "rule", "verdict")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.groups(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return grouped.select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op10_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = embedding.near_duplicates(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return linked.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text", *(f.alias(n) for n, f in audit.text_filters("text").items()))
    held = audit.copies_of_smaller(read, "doc_id", "text").drop("text")
    # a document may have several labels
    labels = _table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marked = held.join(labels, F.col("doc_id") == F.col("labelled"), "left")
    fails = {n: F.col("copy" if n == "E" else n) for n in "ABCDE"}
    return audit.audit(marked, F.col("part"), fails, F.col("quality") == 1, F.col("toxic") == 1)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = _table(spark, sf_dir, "documents").select(*columns)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    changed = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    given = merkle.leaf([changed if c == "n_chars" else F.col(c) for c in columns]).alias("given")
    proved = merkle.manifest(docs.select(*columns, given), "lang", "doc_id", columns, keep=["doc_id", "given"])
    folded = merkle.fold(F.col("given"), F.col("path"))
    siblings = F.transform("path", lambda s: F.concat(s["left"], s["right"]))
    out = proved.select("doc_id", "leaf", "subroot", "root", merkle.digest(F.concat_ws("", siblings)).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = _table(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark, "token-files")
    token_files.write(docs, "doc_id", "text", public_tokenizers.path(FILE_TOKENIZER), folder)
    found = token_files.read(docs.select("doc_id").distinct(), "doc_id", folder)
    return found.select(
        F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_bpe_codec, op3_lm_scoring, op4_secret_scans, op5_quality_rules, op6_sharding,
    op7_html_extraction, op8_url_filters, op9_simhash, op10_embedding, op11_filter_audit, op12_merkle_manifest,
    op13_token_files,
)}
ORACLES: dict[str, str] = {"op11_filter_audit": oracles.FILTER_AUDIT, "op12_merkle_manifest": oracles.MERKLE}
