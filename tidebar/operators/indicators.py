"""Technical indicators (I2–I31), on close/high/low/volume per series.

Every rolling value needs a full frame: until ``n`` rows exist it is missing.
The functions named after an indicator return window expressions; the frames
at the bottom put them together on one zoned shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions.scalars import col, oscillator, ratio
from tidebar.operators.ewm import ewm_carry, ewm_zoned, mean_of_mean
from tidebar.plans import zones
from tidebar.plans.zones import Carry, Order

# Fixed default lengths of the indicators.
FAST, SLOW, SIGNAL = 8, 21, 9
RSI_ROWS = ATR_ROWS = ADX_ROWS = MFI_ROWS = 14
BAND_ROWS, BAND_WIDTH = 20, 2
PLACES = 6  # two values that agree to this many places count as equal
#: Part of the price by which two means must differ to count as different.
PART = 1e-9
# Rows of context the composed frame needs: 14 + 14 for ADX, one lag, some spare.
CONTEXT = 40


def full(agg, c: str | Column, w: WindowSpec, n: int) -> Column:
    """``agg`` over the last ``n`` rows, missing until ``n`` non-missing values are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(frame) >= n, agg(col(c)).over(frame))


def total(c: str | Column, w: WindowSpec, n: int) -> Column:
    """Sum over the last ``n`` rows of a column that is never missing; missing until there are ``n``."""
    return F.when(F.col("_pos") >= n - 1, F.sum(col(c)).over(w.rowsBetween(-(n - 1), 0)))


def previous(c: str, w: WindowSpec) -> Column:
    return F.lag(c).over(w)


def change(c: str, w: WindowSpec) -> Column:
    return F.col(c) - F.lag(c).over(w)


def positive(c: Column) -> Column:
    return F.when(c > 0, c).otherwise(0.0)


def negative(c: Column) -> Column:
    return F.when(c < 0, -c).otherwise(0.0)


def sma(c: str, w: WindowSpec, n: int = BAND_ROWS) -> Column:
    """I6."""
    return full(F.avg, c, w, n)


# I5–I16 in four layers. A layer holds expressions that need only the layers
# before it, so a composed frame evaluates each layer in one window pass; a
# single indicator picks the names it needs.


def price_changes(w: WindowSpec) -> dict[str, Column]:
    """First layer, lags. I8, and the changes behind I5, I11 and I16.

    The first change of the close counts as 0; the others are missing.
    """
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return {
        "prev_close": previous("close", w),
        "_d": F.coalesce(change("close", w), F.lit(0.0)),
        "_dh": change("high", w),
        "_dl": change("low", w),
        "typical_price": typical,
        "_dtp": typical - F.lag(typical).over(w),
    }


def movements() -> dict[str, Column]:
    """Second layer, per row. I9 (high - low on the first row), I11, I15 and the split flow of I16.

    I11 has no mutual exclusion.
    """
    high, low, before, flow = F.col("high"), F.col("low"), F.col("prev_close"), F.col("typical_price") * F.col("volume")
    zero = F.lit(0.0)
    return {
        "_up": positive(F.col("_d")),
        "_down": negative(F.col("_d")),
        "tr": F.greatest(high - low, F.abs(high - before), F.abs(low - before)),
        "plus_dm": F.when(F.col("_dh").isNotNull(), F.greatest(F.col("_dh"), zero)),
        "minus_dm": F.when(F.col("_dl").isNotNull(), F.abs(F.least(F.col("_dl"), zero))),
        "money_flow": flow,
        "positive_flow": F.when(F.col("_dtp") > 0, flow).otherwise(zero),
        "negative_flow": F.when(F.col("_dtp") < 0, flow).otherwise(zero),
    }


def frames(w: WindowSpec, n: int = RSI_ROWS, band: int = BAND_ROWS) -> dict[str, Column]:
    """Third layer, rolling sums. I6 and the parts of I5, I7, I10, I12 and I16."""
    return {
        "_up_n": total("_up", w, n),
        "_down_n": total("_down", w, n),
        "_tr_n": full(F.sum, "tr", w, n),
        "_plus_n": full(F.sum, "plus_dm", w, n),
        "_minus_n": full(F.sum, "minus_dm", w, n),
        "_flow_in": total("positive_flow", w, n),
        "_flow_out": total("negative_flow", w, n),
        "sma20": sma("close", w, band),
        "_sd": full(F.stddev_samp, "close", w, band),
    }


def values(n: int = RSI_ROWS, width: float = BAND_WIDTH) -> dict[str, Column]:
    """Fourth layer, per row. I5, I7, I10, I12, I16 and the ratio behind I13.

    RSI and MFI are 0 in the warm-up and at 0/0.
    """
    c = F.col
    plus, minus = 100 * ratio(c("_plus_n"), c("_tr_n")), 100 * ratio(c("_minus_n"), c("_tr_n"))
    return {
        "rsi": F.coalesce(oscillator(c("_up_n") / n, c("_down_n") / n), F.lit(0.0)),
        "upper_band": c("sma20") + width * c("_sd"),
        "lower_band": c("sma20") - width * c("_sd"),
        "atr": c("_tr_n") / n,
        "plus_di": plus,
        "minus_di": minus,
        "mfi": F.coalesce(oscillator(c("_flow_in"), c("_flow_out")), F.lit(0.0)),
        "_dx": ratio(F.abs(plus - minus), plus + minus),
    }


def adx(w: WindowSpec, n: int = ADX_ROWS) -> Column:
    """One missing ratio voids its ``n`` frames; missing becomes 0."""
    return F.coalesce(100 * full(F.avg, "_dx", w, n), F.lit(0.0))


def pick(layer: dict[str, Column], *names: str) -> dict[str, Column]:
    return {n: layer[n] for n in names}


def bollinger(z: DataFrame, w: WindowSpec) -> DataFrame:
    """Mean and both bands, sample deviation."""
    z = z.withColumns(pick(frames(w), "sma20", "_sd"))
    return z.withColumns(pick(values(), "upper_band", "lower_band")).drop("_sd")


def with_rsi(z: DataFrame, w: WindowSpec) -> DataFrame:
    """Simple-mean RSI."""
    z = z.withColumns(pick(price_changes(w), "_d")).withColumns(pick(movements(), "_up", "_down"))
    z = z.withColumns(pick(frames(w), "_up_n", "_down_n")).withColumns(pick(values(), "rsi"))
    return z.drop("_d", "_up", "_down", "_up_n", "_down_n")


def with_true_range(z: DataFrame, w: WindowSpec) -> DataFrame:
    """I8, I9."""
    return z.withColumns(pick(price_changes(w), "prev_close")).withColumns(pick(movements(), "tr"))


def with_atr(z: DataFrame, w: WindowSpec) -> DataFrame:
    """I10."""
    return z.withColumns(pick(frames(w), "_tr_n")).withColumns(pick(values(), "atr")).drop("_tr_n")


def with_directional_movement(z: DataFrame, w: WindowSpec) -> DataFrame:
    """Missing on the first row."""
    z = z.withColumns(pick(price_changes(w), "_dh", "_dl"))
    return z.withColumns(pick(movements(), "plus_dm", "minus_dm")).drop("_dh", "_dl")


def with_directional_index(z: DataFrame, w: WindowSpec) -> DataFrame:
    """I12."""
    parts = ("_tr_n", "_plus_n", "_minus_n")
    z = z.withColumns(pick(frames(w), *parts)).withColumns(pick(values(), "plus_di", "minus_di", "_dx"))
    return z.drop(*parts)


def with_adx(z: DataFrame, w: WindowSpec) -> DataFrame:
    """I13 after I12."""
    return z.withColumn("adx", adx(w)).drop("_dx")


def with_money_flow(z: DataFrame, w: WindowSpec) -> DataFrame:
    """Typical price, money flow, and the flow split by the direction of the price."""
    z = z.withColumns(pick(price_changes(w), "typical_price", "_dtp"))
    return z.withColumns(pick(movements(), "money_flow", "positive_flow", "negative_flow")).drop("_dtp")


def with_mfi(z: DataFrame, w: WindowSpec) -> DataFrame:
    """I16 after I15."""
    z = z.withColumns(pick(frames(w), "_flow_in", "_flow_out")).withColumns(pick(values(), "mfi"))
    return z.drop("_flow_in", "_flow_out")


def macd_carry(
    z: DataFrame, order: Order, fast: float = FAST, slow: float = SLOW, signal: float = SIGNAL,
    extra: dict[str, tuple[str, float]] | None = None,
) -> Carry:
    """Means of I2 and I3, and ``extra`` ones, open for more values; see ``finish_macd``."""
    means = {"ema12": ("close", fast), "ema26": ("close", slow), "_emas": ("close", signal), **(extra or {})}
    return ewm_carry(z, order, means)


def finish_macd(
    z: DataFrame, order: Order, fast: float = FAST, slow: float = SLOW, signal: float = SIGNAL
) -> DataFrame:
    """Difference of two means, its mean and the histogram."""
    macd = F.col("ema12") - F.col("ema26")
    if signal in (fast, slow):
        z = ewm_zoned(z.drop("_emas").withColumn("macd", macd), order, {"macd_signal": ("macd", signal)})
        return z.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
    smooth = mean_of_mean("ema12", "_emas", fast, signal) - mean_of_mean("ema26", "_emas", slow, signal)
    return z.withColumns({"macd": macd, "macd_signal": smooth, "macd_histogram": macd - smooth}).drop("_emas")


def with_macd(z: DataFrame, order: Order, fast: float = FAST, slow: float = SLOW, signal: float = SIGNAL) -> DataFrame:
    return finish_macd(macd_carry(z, order, fast, slow, signal).apply(), order, fast, slow, signal)


def impulse_color(histogram: str, rsi: str, previous_rsi: str, price: str = "close", places: int = PLACES) -> Column:
    """The histogram counts above ``PART`` of the price, the RSI (0 to 100) is rounded, so that noise decides nothing."""
    hist, least = F.col(histogram), PART * F.abs(F.col(price))
    now, before = F.round(rsi, places), F.round(previous_rsi, places)
    return (
        F.when((hist > least) & (now > before), "green")
        .when((hist < -least) & (now < before), "red")
        .otherwise("gray")
    )


def simple_impulse(c: str, w: WindowSpec) -> Column:
    """Colour by the sign of the change."""
    d = change(c, w)
    return F.when(d > 0, "green").when(d < 0, "red").otherwise("gray")


# -- composed frames -------------------------------------------------------


WARMUP_COLUMNS = ("sma20", "upper_band", "lower_band", "prev_close", "atr", "plus_di", "minus_di")


INTERMEDIATE = (
    "_d", "_dh", "_dl", "_dtp", "_up", "_down", "_up_n", "_down_n", "_tr_n", "_plus_n", "_minus_n", "_flow_in", "_flow_out",
    "_sd", "_dx", "_prev_rsi", "plus_dm", "minus_dm", "typical_price", "money_flow", "positive_flow", "negative_flow",
)


def zoned_indicators(z: DataFrame, order: Order) -> DataFrame:
    """I2–I19 on a zoned frame with ``CONTEXT`` rows of context.

    The final fill (forward, then 0) travels with the means in one carry.
    """
    w = zones.window(order)
    z = z.withColumns(price_changes(w)).withColumns(movements()).withColumns(frames(w)).withColumns(values())
    z = z.withColumns({"adx": adx(w), "_prev_rsi": previous("rsi", w)})
    carry = macd_carry(z, order, extra={"ema9": ("close", 9), "ema21": ("close", 21)})
    for c in WARMUP_COLUMNS:
        carry.fill_forward(c, c)
    z = finish_macd(carry.apply(), order)
    z = z.withColumns(
        {
            "impulse_macd": F.col("macd"),
            "impulse_rsi": F.col("rsi"),
            "impulse_color": impulse_color("macd_histogram", "rsi", "_prev_rsi"),
            **{c: F.coalesce(F.col(c), F.lit(0.0)) for c in WARMUP_COLUMNS},
        }
    )
    return z.select(*[c for c in z.columns if c not in INTERMEDIATE])


def indicator_frame(bars: DataFrame, order: Order) -> DataFrame:
    """Bars with all indicator columns, from one shuffle of the bars."""
    return zones.leave(zoned_indicators(zones.enter(bars, order, before=CONTEXT), order))


def sequence_indicators(bars: DataFrame, order: Order) -> DataFrame:
    """The indicator set of the sequence model, warm-up left missing."""
    z = zones.enter(bars, order, before=3 * 14 + 4)
    w = zones.window(order)
    z = bollinger(with_rsi_inner(z, w), w)
    z = with_mfi_variant(z, w)
    z = with_adx_variant(z, w)
    extra = {f"ema{n}": ("close", n) for n in (9, 21, 50, 200)}
    z = finish_macd(macd_carry(z, order, 12, 26, 9, extra).apply(), order, 12, 26, 9)
    z = z.withColumn("impulse_macd", F.signum(F.round("macd_histogram", PLACES)).cast("int"))
    return zones.leave(z)


def with_rsi_inner(z: DataFrame, w: WindowSpec, n: int = RSI_ROWS) -> DataFrame:
    """RSI from the ``n - 1`` changes inside each full frame of ``n`` rows; 0/0 is missing."""
    z = z.withColumn("_d", change("close", w))
    z = z.withColumns({"_up": positive(F.col("_d")), "_down": negative(F.col("_d"))})
    inner = w.rowsBetween(-(n - 2), 0)
    enough = F.count("close").over(w.rowsBetween(-(n - 1), 0)) >= n
    value = F.when(enough, oscillator(F.sum("_up").over(inner), F.sum("_down").over(inner)))
    return z.withColumn("rsi", value).drop("_d", "_up", "_down")


def with_mfi_variant(z: DataFrame, w: WindowSpec, n: int = MFI_ROWS) -> DataFrame:
    """Flow ratio and MFI without the fill."""
    z = with_money_flow(z, w)
    up, down = total("positive_flow", w, n), total("negative_flow", w, n)
    return z.withColumns({"mfr": ratio(up, down), "mfi": oscillator(up, down)})


def with_range_hlc(z: DataFrame, w: WindowSpec, n: int = ATR_ROWS) -> DataFrame:
    """Spread of high, low and close, and its mean."""
    spread = F.greatest("high", "low", "close") - F.least("high", "low", "close")
    return z.withColumn("tr", spread).withColumn("atr", full(F.avg, "tr", w, n))


def with_dm_exclusive(z: DataFrame, w: WindowSpec) -> DataFrame:
    """The larger of the two movements counts; there is no test for a positive one."""
    z = z.withColumns({"_u": change("high", w), "_v": -change("low", w)})
    z = z.withColumns(
        {
            "plus_dm": F.when(F.col("_u") > F.col("_v"), F.col("_u")).otherwise(0.0),
            "minus_dm": F.when(F.col("_v") > F.col("_u"), F.col("_v")).otherwise(0.0),
        }
    )
    return z.drop("_u", "_v")


def with_adx_variant(z: DataFrame, w: WindowSpec, n: int = ADX_ROWS) -> DataFrame:
    """I31 with I29 and I30."""
    z = with_dm_exclusive(with_range_hlc(z, w), w)
    z = z.withColumns(
        {"_p": ratio(F.col("plus_dm"), F.col("atr")), "_m": ratio(F.col("minus_dm"), F.col("atr"))}
    )
    z = z.withColumns({"plus_di": 100 * full(F.avg, "_p", w, n), "minus_di": 100 * full(F.avg, "_m", w, n)})
    total = F.abs(F.col("plus_di") + F.col("minus_di"))
    z = z.withColumn("dx", 100 * ratio(F.abs(F.col("plus_di") - F.col("minus_di")), total))
    return z.withColumn("adx", full(F.avg, "dx", w, n)).drop("_p", "_m")


def with_rsi_short(z: DataFrame, w: WindowSpec, out: str = "rsi") -> DataFrame:
    """RSI whose frame may be short; missing at 0/0."""
    z = z.withColumns(pick(price_changes(w), "_d")).withColumns(pick(movements(), "_up", "_down"))
    frame = w.rowsBetween(-(RSI_ROWS - 1), 0)
    z = z.withColumn(out, oscillator(F.avg("_up").over(frame), F.avg("_down").over(frame)))
    return z.drop("_d", "_up", "_down")


def rsi_min1(bars: DataFrame, order: Order, out: str = "rsi") -> DataFrame:
    """RSI whose frame may be short; filled back, then 0."""
    z = with_rsi_short(zones.enter(bars, order, before=RSI_ROWS + 1), zones.window(order), out)
    z = zones.fill_backward(z, order, {out: out})
    return zones.leave(z.withColumn(out, F.coalesce(F.col(out), F.lit(0.0))))


def bollinger_bfill(bars: DataFrame, order: Order) -> DataFrame:
    """Bands with the warm-up filled back, then 0."""
    z = zones.enter(bars, order, before=BAND_ROWS)
    z = bollinger(z, zones.window(order))
    z = zones.fill_backward(z, order, {"upper_band": "upper_band", "lower_band": "lower_band"})
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("upper_band", "lower_band")}
    return zones.leave(z.withColumns(zero))
