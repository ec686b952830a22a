"""Projection, filter and cleaning operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.plans import zones
from tidebar.plans.zones import Order

# Fixed values of the colour encoding.
COLOR_CODES = {"red": -1, "green": 1, "gray": 0}
# Fixed feature lists.
MODEL_FEATURES = ("macd_histogram", "rsi", "upper_band", "lower_band", "atr", "adx", "ema9", "ema21", "impulse_color")
SEQUENCE_FEATURES = ("close", "macd_histogram", "rsi", "upper_band", "lower_band")


def fill_chain(df: DataFrame, order: Order, columns: list[str], policy: tuple[str, ...]) -> DataFrame:
    """Apply ``ffill``, ``bfill`` and ``zero`` in the given order to ``columns``.

    What a fill leaves missing lies outside the reach of its direction, so a
    second fill may read the original column: the chain is one ``coalesce``
    over fills that share one shuffle and one carry.
    """
    unknown = set(policy) - {"ffill", "bfill", "zero"}
    if unknown:
        raise ValueError(f"unknown fill policy {sorted(unknown)}")
    if not {"ffill", "bfill"} & set(policy):
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})
    carry = zones.Carry(zones.enter(df, order), order)
    chosen = {}
    for c in columns:
        parts = []
        for step in policy:
            if step == "ffill":
                carry.fill_forward(f"_f_{c}", c)
                parts.append(F.col(f"_f_{c}"))
            elif step == "bfill":
                carry.fill_backward(f"_b_{c}", c)
                parts.append(F.col(f"_b_{c}"))
            else:
                parts.append(F.lit(0.0))
        chosen[c] = F.coalesce(*parts)
    z = carry.apply().withColumns(chosen)
    return zones.leave(z.drop(*[f"_{d}_{c}" for c in columns for d in "fb"]))


def ffill(df: DataFrame, order: Order, columns: list[str]) -> DataFrame:
    """Last non-missing value carried forward."""
    return fill_chain(df, order, columns, ("ffill",))


def bfill(df: DataFrame, order: Order, columns: list[str]) -> DataFrame:
    """Next non-missing value carried back."""
    return fill_chain(df, order, columns, ("bfill",))


def fill_zero(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """C4: remaining missing numbers become 0."""
    return df.na.fill(0, subset=columns)


def ensure_datetime(
    df: DataFrame, candidates: list[str], order: Order, now: Column, out: str = "datetime"
) -> DataFrame:
    """First existing candidate column becomes ``out``; unreadable values are filled.

    ``order`` says which rows are neighbours. ``now`` replaces a value only when
    no row of the keys has a readable one; it is an argument, not a clock read.
    """
    found = next((c for c in candidates if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of {candidates} among the columns {df.columns}")
    source = df[found]
    if isinstance(df.schema[found].dataType, T.StringType):
        parsed = F.expr(f"try_cast(`{found}` AS timestamp_ntz)")
    else:
        parsed = source.cast("timestamp_ntz")
    df = df.withColumn(out, parsed)
    if found != out:
        df = df.drop(found)
    df = fill_chain(df, order, [out], ("ffill", "bfill"))
    return df.withColumn(out, F.coalesce(out, now))


def ensure_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every column as a number, unreadable values become missing."""
    names = columns or df.columns
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in names})


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with any missing value."""
    return df.na.drop("any", subset=columns)


def suffix_columns(df: DataFrame, suffix: str, keep: tuple[str, ...] = ("series", "ts")) -> DataFrame:
    """Append ``suffix`` to every column but the keys."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in keep})


def harmonise_price_column(df: DataFrame, out: str, candidates: tuple[str, ...] = ("close", "price")) -> DataFrame:
    """Rename the first existing candidate to ``out``."""
    found = next((c for c in candidates if c in df.columns), None)
    return df.withColumnRenamed(found, out) if found else df


def encode_category(column: str, codes: dict[str, int] | None = None) -> Column:
    """Category to number; an unknown category becomes missing."""
    expr = F.lit(None).cast("int")
    for value, code in (codes or COLOR_CODES).items():
        expr = F.when(F.col(column) == value, F.lit(code)).otherwise(expr)
    return expr


def select_features(
    df: DataFrame, features: tuple[str, ...], optional: tuple[str, ...] = (), keys: tuple[str, ...] = ("series", "ts")
) -> DataFrame:
    """C11: keys, the named features and those optional ones that exist."""
    return df.select(*keys, *features, *[c for c in optional if c in df.columns])


def numeric_columns(df: DataFrame, drop: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in drop]


def select_numeric(df: DataFrame, target: str = "close", keys: tuple[str, ...] = ("series", "ts")) -> DataFrame:
    """Keys and the numeric columns without the target."""
    return df.select(*keys, *numeric_columns(df, (target, *keys)))


def missing_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values per column and whether any remain, in one aggregate."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns]
    )
    return counts.select(F.inline(pairs)).withColumn("any_missing", F.col("missing") > 0)


def constant_zero_check(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """C14: per keys, whether a whole column is 0."""
    return df.groupBy(*keys).agg(*[F.bool_and(F.col(c) == 0).alias(f"{c}_all_zero") for c in columns])


def nan_to_zero(column: str) -> tuple[Column, Column]:
    """The value with missing as 0, and the flag that it was missing."""
    value = F.col(column)
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)), value.isNull() | F.isnan(value)


def head_tail(df: DataFrame, n: int = 5, keys: tuple[str, ...] = ("series",), ts: str = "ts") -> DataFrame:
    """First and last ``n`` rows per keys.

    The rank filter becomes a per-task limit before the shuffle, so only
    ``n`` rows per task and key move. Two ranks in one plan would hide the
    filter from that rule, hence the union.
    """
    first = Window.partitionBy(*keys).orderBy(ts)
    last = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    head = df.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= n)
    tail = df.withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") <= n)
    head = head.withColumn("part", F.lit("head"))
    tail = tail.withColumn("part", F.lit("tail"))
    return head.unionByName(tail).withColumnRenamed("_rank", "rank")
