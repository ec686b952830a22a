"""Explicit schemas of the input tables."""

from __future__ import annotations

from pyspark.sql import types as T

BARS = T.StructType(
    [
        T.StructField("series", T.StringType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

MACRO = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("value", T.DoubleType()),
    ]
)

QUOTES = T.StructType(
    [
        T.StructField("expiry", T.TimestampNTZType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("strike", T.DoubleType()),
        T.StructField("iv", T.DoubleType()),
    ]
)

# Payload of the news service; the field names are fixed by the format.
ARTICLES = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField(
            "articles",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "source",
                            T.StructType(
                                [
                                    T.StructField("id", T.StringType()),
                                    T.StructField("name", T.StringType()),
                                ]
                            ),
                        ),
                        T.StructField("author", T.StringType()),
                        T.StructField("title", T.StringType()),
                        T.StructField("description", T.StringType()),
                        T.StructField("url", T.StringType()),
                        T.StructField("urlToImage", T.StringType()),
                        T.StructField("publishedAt", T.StringType()),
                        T.StructField("content", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
