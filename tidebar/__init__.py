"""Market time-series analytics as Spark jobs over ``(series, ts)`` keyed frames."""
