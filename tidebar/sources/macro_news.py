"""Macro series and news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.operators import clean
from tidebar.plans.joins import join_frequent
from tidebar.plans.zones import Order
from tidebar.schema import ARTICLES
from tidebar.session import stage

MACRO = Order(86400 * 30, ("name",))


def load_macro(macro: DataFrame) -> DataFrame:
    """Low-frequency series, gaps filled forward, then 0."""
    return clean.fill_chain(macro, MACRO, ["value"], ("ffill", "zero"))


def flatten_articles(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row per article of a JSON payload; a payload without a list gives none."""
    parsed = payloads.withColumn("_p", F.from_json(column, ARTICLES)).drop(column)
    keys = [c for c in parsed.columns if c != "_p"]
    articles = parsed.select(*keys, F.inline("_p.articles"))
    return (
        articles.withColumn("source_id", F.col("source.id"))
        .withColumn("source_name", F.col("source.name"))
        .drop("source")
    )


def article_timestamps(articles: DataFrame, order: Order, load_date: Column) -> DataFrame:
    """``datetime`` from ``publishedAt``, unreadable values filled; the load date if absent."""
    if "publishedAt" not in articles.columns:
        return articles.withColumn("datetime", load_date.cast("timestamp_ntz"))
    parsed = F.expr("try_cast(regexp_replace(publishedAt, 'Z$', '') AS timestamp_ntz)")
    articles = articles.withColumn("datetime", parsed)
    return clean.fill_chain(articles, order, ["datetime"], ("ffill", "bfill"))


def phrase_hits(text: str, phrases: list[str]) -> Column:
    """Occurrences of the phrases in the whole text, any case."""
    lower = F.lower(F.col(text))
    hits = F.lit(0)
    for phrase in phrases:
        p = phrase.lower()
        hits = hits + ((F.length(lower) - F.length(F.replace(lower, F.lit(p), F.lit("")))) / len(p)).cast("int")
    return hits


def news_window_filter(
    articles: DataFrame, phrases: list[str], until: Column, days_ago: int = 30, lang: str = "en",
    text: str = "text", ts: str = "published_at",
) -> DataFrame:
    """Articles of the last days in one language that hold any of the phrases, best first."""
    since = until - F.make_dt_interval(days=F.lit(days_ago))
    rows = articles.where((F.col("lang") == lang) & F.col(ts).between(since, until))
    rows = rows.withColumn("relevance", phrase_hits(text, phrases)).where(F.col("relevance") > 0)
    return rows.orderBy(F.col("relevance").desc(), ts)


def tokens(text: str) -> Column:
    """Lower-case words of a text."""
    words = F.split(F.lower(F.col(text)), "[^\\p{L}]+")
    return F.filter(words, lambda t: t != "")


def title_sentiment(articles: DataFrame, lexicon: DataFrame, key: str, title: str = "title") -> DataFrame:
    """Mean polarity of the known words of each title; 0 without any.

    A few words make up most of all text; they are joined apart from the others,
    see ``join_frequent``. Polarities are summed as decimals, so that the mean
    does not depend on the order of the words.
    """
    words = stage(articles.select(key, F.explode(tokens(title)).alias("token")), "words")
    known = join_frequent(words, lexicon, "token")
    scored = known.groupBy(key).agg(F.avg(F.col("polarity").cast("decimal(18,9)")).cast("double").alias("_polarity"))
    out = articles.join(scored, key, "left").withColumn("polarity", F.coalesce("_polarity", F.lit(0.0)))
    return out.drop("_polarity")


def mean_sentiment(scored: DataFrame) -> DataFrame:
    """Mean over all titles; 0 when there are none."""
    return scored.agg(
        F.coalesce(F.avg("polarity"), F.lit(0.0)).alias("avg_sentiment"), F.count(F.lit(1)).alias("articles")
    )
