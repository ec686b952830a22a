"""Trades and backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.operators.evaluate import coverage, error_metrics
from tidebar.operators.features import multi_horizon_targets
from tidebar.operators.signals import STRATEGIES, long_signals
from tidebar.plans import zones
from tidebar.plans.joins import join_configured
from tidebar.plans.zones import Order

# Fixed constants.
BAND_FACTOR = 1.28
CONDOR_WIDTH = 2
ROLL_CONFIDENCE, ROLL_SHARE = 0.5, 0.9
TRADE_TYPES = ("credit_spread", "debit_spread", "iron_condor", "straddle")


def forward_trades(df: DataFrame, order: Order, trade_days: int = 2, evaluation_days: int = 1, c: str = "close") -> DataFrame:
    """B1: open price ``evaluation_days`` rows ahead, close price ``trade_days`` after that."""
    df = zones.over(
        df,
        order,
        after=trade_days + evaluation_days,
        open_price=lambda w: F.lead(c, evaluation_days).over(w),
        close_price=lambda w: F.lead(c, evaluation_days + trade_days).over(w),
    )
    return df.where(F.col("close_price").isNotNull())


def row_deviation(columns: list[str]) -> Column:
    """Population deviation across the columns of a row."""
    values = [F.col(c) for c in columns]
    mean = sum(values[1:], values[0]) / len(values)
    squares = [(v - mean) * (v - mean) for v in values]
    return F.sqrt(sum(squares[1:], squares[0]) / len(values))


def ensemble_band(predicted: str, models: list[str], factor: float = BAND_FACTOR) -> dict[str, Column]:
    """B2: prediction ± factor times the deviation across the models."""
    margin = factor * row_deviation(models)
    return {"low": F.col(predicted) - margin, "high": F.col(predicted) + margin}


def trade_success(price: str = "close_price", low: str = "low", high: str = "high") -> Column:
    """B3."""
    return F.col(price).between(F.col(low), F.col(high))


def backtest_metrics(
    trades: DataFrame, keys: tuple[str, ...] = ("series",), actual: str = "close_price", predicted: str = "predicted"
) -> DataFrame:
    """Errors and the share of successful trades."""
    e = error_metrics(actual, predicted)
    return trades.groupBy(*keys).agg(
        e["mae"].alias("mae"),
        e["rmse"].alias("rmse"),
        F.avg(F.col("success").cast("double")).alias("win_share"),
        F.count(F.lit(1)).alias("trades"),
    )


def multi_horizon_backtest(
    df: DataFrame, order: Order, horizons, predicted: str = "close", level: float = 0.75,
    keys: tuple[str, ...] = ("timeframe", "horizon"),
) -> DataFrame:
    """Error and interval coverage per timeframe and horizon.

    ``predicted`` is any column known at the row; the last close by default.
    The keys are timeframes and horizons, whose number does not grow with the data.
    """
    rows = multi_horizon_targets(df, order, horizons)
    rows = rows.withColumnsRenamed({"target": "actual"}).withColumn("predicted", F.col(predicted))
    band = rows.groupBy(*keys).agg(
        (F.avg("predicted") - level * F.stddev_pop("predicted")).alias("low"),
        (F.avg("predicted") + level * F.stddev_pop("predicted")).alias("high"),
    )
    e = error_metrics()
    return join_configured(rows, band, keys).groupBy(*keys).agg(
        e["mae"].alias("mae"), e["rmse"].alias("rmse"), coverage().alias("coverage"),
        F.count(F.lit(1)).alias("n"),
    )


def option_payoff() -> Column:
    """Profit or loss by trade type; an unknown type gives 0."""
    c = F.col
    net = c("premium_received") - c("premium_paid")
    kind = c("trade_type")
    close, strike = c("close_price"), c("strike")
    inside = (strike < close) & (close < strike + CONDOR_WIDTH)
    moved = F.abs(close - strike) > c("volatility") * c("time_decay")
    return (
        F.when(kind == "credit_spread", F.when(close > strike, -c("max_loss")).otherwise(net))
        .when(
            kind == "debit_spread",
            F.when(close < strike, c("max_profit") - c("premium_paid")).otherwise(-c("premium_paid")),
        )
        .when(kind == "iron_condor", F.when(inside, net).otherwise(-c("max_loss")))
        .when(kind == "straddle", F.when(moved, net).otherwise(-c("premium_paid")))
        .otherwise(F.lit(0.0))
    )


def roll_adjustment(pl: str = "profit_loss") -> Column:
    """A losing trade held with confidence is rolled for a reduced premium."""
    rolled = F.col(pl) + (ROLL_SHARE * F.col("premium_received") - F.col("premium_paid"))
    return F.when((F.col(pl) < 0) & (F.col("confidence") > ROLL_CONFIDENCE), rolled).otherwise(F.col(pl))


def trade_outcome(pl: str = "profit_loss") -> Column:
    """B8."""
    return F.col(pl) > 0


def simulate_trades(trades: DataFrame) -> DataFrame:
    """B6–B8 as columns of the trade table."""
    trades = trades.withColumn("profit_loss", option_payoff())
    trades = trades.withColumn("profit_loss", roll_adjustment())
    return trades.withColumn("successful", trade_outcome())


def trade_summary(trades: DataFrame) -> DataFrame:
    """The trade record with its expiry date, from simulated trades."""
    c = F.col
    expiry = c("open_date") + F.make_dt_interval(days=c("evaluation_days"))
    return trades.select(
        "series",
        "trade_type",
        c("open_price").alias("strike_price_open"),
        c("close_price").alias("strike_price_close"),
        "open_date",
        expiry.alias("expiry_date"),
        c("evaluation_days").alias("days_evaluated"),
        "risk_reward",
        "profit_loss",
        c("open_price").alias("price_open"),
        c("close_price").alias("price_close"),
        c("successful").alias("successful_trade"),
        c("confidence").alias("prediction_confidence"),
    )


def risk_management(
    stop_loss: float | Column, take_profit: float | Column, pl: str = "profit_loss", outcome: str = "successful"
) -> dict[str, Column]:
    """Close at the stop, else at the take-profit, else unchanged. The stop is tested first."""
    stop = stop_loss if isinstance(stop_loss, Column) else F.lit(float(stop_loss))
    take = take_profit if isinstance(take_profit, Column) else F.lit(float(take_profit))
    value = F.col(pl)
    return {
        "managed_profit_loss": F.when(value <= stop, stop).when(value >= take, take).otherwise(value),
        "managed_outcome": F.when(value <= stop, F.lit(False))
        .when(value >= take, F.lit(True))
        .otherwise(F.coalesce(F.col(outcome), value > 0)),
    }


def strategy_summary(trades: DataFrame, by_year: bool = False) -> DataFrame:
    """Profit, win rate and count per trade type; with ``by_year`` also subtotals."""
    aggs = [
        F.sum("profit_loss").alias("total_pl"),
        F.avg("profit_loss").alias("mean_pl"),
        F.avg(F.col("successful").cast("double")).alias("win_rate"),
        F.count(F.lit(1)).alias("trades"),
    ]
    if not by_year:
        return trades.groupBy("trade_type").agg(*aggs)
    return trades.withColumn("year", F.year("open_date")).rollup("trade_type", "year").agg(*aggs)


def signal_trades(signals: DataFrame, bars: DataFrame, order: Order, trade_days: int = 2, evaluation_days: int = 1) -> DataFrame:
    """Every fired signal becomes a trade at the prices of B1."""
    prices = forward_trades(bars.select("series", "ts", "close"), order, trade_days, evaluation_days)
    fired = long_signals(signals.select("series", "ts", *STRATEGIES)).where(F.col("fired") == 1)
    return fired.drop("fired").join(prices, ["series", "ts"])
