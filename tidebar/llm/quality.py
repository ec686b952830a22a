"""Quality rules: per-document counts, and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import SPACE, WORD, col, whole, words
from tidebar.session import stage

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_counts(df: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` and the METRICS of a non-null text column.

    ``n_repeat_words`` counts the words that lie in a 3-word window found twice
    or more. Windows are compared by their 64-bit hash; only texts in which two
    hashes agree are sorted, and the sorted places of their repeated windows
    give the words covered.
    """
    base = df.select(*keep, text.alias("_text"), words(text).alias("_words"))
    lines = F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(WORD))
    base = base.select("*", lines.alias("_lines"))
    hashes = F.expr(
        "CASE WHEN size(_words) > 2 THEN transform(sequence(1, size(_words) - 2), i -> "
        "xxhash64(element_at(_words, i), element_at(_words, i + 1), element_at(_words, i + 2))) "
        "ELSE cast(array() AS array<bigint>) END"
    )
    counted = base.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        (F.length("_text") - F.length(F.regexp_replace("_text", WORD, ""))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("_hashes"),
    )
    ordered = counted.withColumn(
        "_sorted",
        F.expr(
            "CASE WHEN size(array_distinct(_hashes)) < size(_hashes) THEN "
            "array_sort(transform(_hashes, (h, i) -> struct(h AS h, i AS i))) END"
        ),
    )
    repeated = ordered.withColumn(
        "_places",
        F.expr(
            "array_sort(transform(filter(_sorted, (x, k) -> (k > 0 AND _sorted[k - 1].h = x.h) "
            "OR (k < size(_sorted) - 1 AND _sorted[k + 1].h = x.h)), x -> x.i))"
        ),
    )
    covered = F.expr(
        "coalesce(aggregate(transform(_places, (p, k) -> CASE WHEN k < size(_places) - 1 "
        "THEN least(3, _places[k + 1] - p) ELSE 3 END), 0L, (a, x) -> a + x), 0L)"
    )
    return repeated.withColumn("n_repeat_words", covered)


def failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    """Too few words, or too large a part of them in repeated windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def line_key(line: Column) -> Column:
    """Hash of a line in lower case, its words separated by one space."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, SPACE, " "))))


def judge(df: DataFrame, key: str, text: str, host: str, max_documents: int = 10, share: float = 0.1, depleted: float = 0.5) -> DataFrame:
    """(row, key, METRICS, base_failed, removed, kept) per row, ``removed`` an array of hashes of lines to take out.

    A line (hash of its normalised form) found in more than the part ``share`` of
    the distinct documents of one host, and in more than ``max_documents`` of them,
    is taken out of all of them but the first by ``key``; documents with equal
    texts count once on both sides, so verdicts do not depend on the table's size. A document is rejected when
    the base rules fail or when more than the part ``depleted`` of its words goes.

    Null texts are empty (rejected: no words); null hosts are one host; a null
    key is never a first one unless all are null. Repeated rows are judged one
    by one, alike. An empty table gives an empty result. ``row`` numbers the
    input rows; the text itself is not shuffled, only hashes of its lines are.
    """
    lines = F.transform("_lines", lambda line: F.struct(line_key(line).alias("h"), F.size(words(line)).alias("w")))
    keep = [F.monotonically_increasing_id().alias("row"), col(key).alias("key"), col(host).alias("host")]
    counted = text_counts(df, whole(text), keep)
    counted = stage(
        counted.select("row", "key", "host", F.xxhash64("_text").alias("document"), *METRICS, lines.alias("lines")), "quality"
    )
    each = counted.select("row", "key", "host", "document", F.explode("lines").alias("line"))
    each = each.select("row", "key", "host", "document", F.col("line.h").alias("h"), F.col("line.w").alias("w"))
    hosts = counted.groupBy("host").agg(F.count_distinct("document").alias("documents"))
    hosts = stage(hosts.select(F.col("host").alias("in_host"), "documents"), "quality-hosts")
    frequent = (
        each.groupBy("host", "h")
        .agg(F.count_distinct("document").alias("n"), F.min("key").alias("first"))
        .where(F.col("n") > max_documents)
        .join(hosts, F.col("host").eqNullSafe(F.col("in_host")))
        .where(F.col("n") > share * F.col("documents"))
        .select(F.col("host").alias("of"), F.col("h").alias("hash"), "first")
    )
    frequent = stage(frequent, "quality-lines")
    hits = each.join(frequent, F.col("host").eqNullSafe(F.col("of")) & (F.col("h") == F.col("hash")))
    gone = (
        hits.where(~F.col("key").eqNullSafe(F.col("first")))
        .groupBy("row")
        .agg(F.sum("w").alias("gone"), F.collect_set("h").alias("removed"))
    )
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    fails = failed()
    return counted.join(gone.withColumnRenamed("row", "of_row"), F.col("row") == F.col("of_row"), "left").select(
        "row",
        "key",
        *METRICS,
        fails.alias("base_failed"),
        "removed",
        (~fails & (left >= (1 - depleted) * F.col("n_words"))).alias("kept"),
    )


def clean(df: DataFrame, key: str, text: str, host: str, max_documents: int = 10, share: float = 0.1, depleted: float = 0.5) -> DataFrame:
    """The kept rows of ``df`` with the lines above the limit taken out of ``text``; see :func:`judge`.

    A line once in a text and once more in it goes both times; lines without a
    word stay. ``df`` is written once with its row numbers, so that both readings agree.
    """
    inner = stage(df.select(F.struct(*(col(c) for c in df.columns)).alias("given"), F.monotonically_increasing_id().alias("at")), "quality-rows")
    given = inner.select(
        "at", F.col("given").getField(key).alias("key"), F.col("given").getField(text).alias("text"), F.col("given").getField(host).alias("host")
    )
    verdict = judge(given.select("at", "text", "host", "key"), "at", "text", "host", max_documents, share, depleted)
    kept = verdict.where("kept").select(F.col("key").alias("of"), "removed")
    out = inner.join(kept, F.col("at") == F.col("of"), "inner").withColumn("_t", F.col("given").getField(text))
    rest = F.filter(F.split("_t", "\n", -1), lambda line: ~F.array_contains("removed", line_key(line)))
    new = F.when(F.col("removed").isNull(), F.col("_t")).otherwise(F.array_join(rest, "\n"))
    return out.select(*(new.alias(c) if c == text else F.col("given").getField(c).alias(c) for c in df.columns))
