"""Causal features: only rows at or before a row's time take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quotes import depth_imbalance, microprice, mid, ratio, spread, spread_bps
from ..model import FEATURES, QUOTE, stream_keys


def rolling_std(c: Column, w, rows: int) -> Column:
    """Sample deviation over the last ``rows`` rows, null until all are there."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(c).over(frame) == rows, F.stddev_samp(c).over(frame))


def causal(df: DataFrame, time: str = "grid_timestamp_ms", drop_warmup: bool = False) -> DataFrame:
    """The eleven features by row lags per stream; metadata and quotes first, label last."""
    keys = stream_keys(df.columns)
    w = Window.partitionBy(*keys).orderBy(time)
    out = df.withColumns({"mid_price": mid(), "spread": spread(), "spread_bps": spread_bps(), "microprice": microprice(), "depth_imbalance": depth_imbalance()})
    m = F.col("mid_price")
    lags = {f"mid_return_{k}s": ratio(m - F.lag(m, k).over(w), F.lag(m, k).over(w)) for k in (1, 3, 5)}
    out = out.withColumns(lags | {"bid_change_1s": F.col("bid") - F.lag("bid").over(w), "ask_change_1s": F.col("ask") - F.lag("ask").over(w)})
    out = out.withColumn("mid_volatility_5s", rolling_std(F.col("mid_return_1s"), w, 5))
    label = ["label"] if "label" in df.columns else []
    rest = [c for c in df.columns if c not in (*QUOTE, *label)]
    out = out.select(*rest, *QUOTE, *FEATURES, *label)
    return out.dropna(subset=FEATURES) if drop_warmup else out


def first_generation(df: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """Returns, spreads, depth changes and volatilities over 10 and 50 rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    m, d = F.col("mid_price"), lambda c: F.col(c) - F.lag(c).over(w)
    change = lambda k: ratio(m, F.lag(m, k).over(w)) - 1
    out = df.withColumns({"return_1": change(1), "return_5": change(5), "return_10": change(10)})
    return out.withColumns({
        "spread_bps": ratio(F.col("spread"), m) * 10000,
        "depth_imbalance": ratio(F.col("bid_depth") - F.col("ask_depth"), F.col("bid_depth") + F.col("ask_depth")),
        "microprice_deviation": ratio(F.col("microprice") - m, m),
        "bid_depth_change": d("bid_depth"),
        "ask_depth_change": d("ask_depth"),
        "volatility_10": rolling_std(F.col("return_1"), w, 10),
        "volatility_50": rolling_std(F.col("return_1"), w, 50),
        "momentum_10": m - F.lag(m, 10).over(w),
    })


def time_range_volatility(df: DataFrame, value: Column, time: str, span: int, keys: list[str], least: int = 3) -> DataFrame:
    """Adds values (how many over (time - span, time]) and volatility, their sample deviation,
    null below ``least`` values.

    A range is the end of one bucket of ``span`` and the start of the next. Both are running
    counts, means and squares from the buckets' common bound outwards, so work does not grow
    with the rows in a range; the two are put together without differences of sums.
    """
    moments = lambda w, name: {f"_n{name}": F.count("_v").over(w), f"_m{name}": F.coalesce(F.avg("_v").over(w), F.lit(0.0)), f"_q{name}": F.coalesce(F.var_pop("_v").over(w), F.lit(0.0))}
    t = F.col(time)
    rows = df.withColumns({"_v": value, "_b": (t - F.pmod(t, F.lit(span))) / span})
    start = Window.partitionBy(*keys, "_b").orderBy(time).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns(moments(start, 1))
    held = rows.select(*keys, "_b", t.alias("_t"), F.lit(False).alias("_asks"), "_v", F.lit(None).cast(T.StructType(rows.schema.fields)).alias("_row"))
    asks = rows.select(*keys, (F.col("_b") - 1).alias("_b"), (t - span + 1).alias("_t"), F.lit(True).alias("_asks"), F.lit(None).cast("double").alias("_v"), F.struct(*rows.columns).alias("_row"))
    # from the bucket's end backwards; a row at the very start of a range comes before the question
    end = Window.partitionBy(*keys, "_b").orderBy(F.col("_t").desc(), "_asks").rowsBetween(Window.unboundedPreceding, 0)
    both = held.unionByName(asks).withColumns(moments(end, 2)).where("_asks")
    none = F.col("_t").isNull()  # rows without a time are each other's range
    both = both.select("_row.*", *[F.when(none, F.lit(0)).otherwise(F.col(c)).alias(c) for c in ("_n2", "_m2", "_q2")])
    n1, n2, n = F.col("_n1"), F.col("_n2"), F.col("_n1") + F.col("_n2")
    apart = F.col("_m1") - F.col("_m2")
    squares = n1 * F.col("_q1") + n2 * F.col("_q2") + apart * apart * n1 * n2 / F.nullif(n, F.lit(0))
    return both.select(*df.columns, n.alias("values"), F.when((n >= least) & (n > 1), F.sqrt(squares / F.nullif(n - 1, F.lit(0)))).alias("volatility"))


def order_flow(df: DataFrame, step: int, time: str = "grid_timestamp_ms") -> DataFrame:
    """Quote order-flow imbalance, raw and by depth; only where a row follows at one step."""
    w = Window.partitionBy(*stream_keys(df.columns)).orderBy(time)
    before = {c: F.lag(c).over(w) for c in (*QUOTE, time)}
    b, a, qb, qa = (F.col(c) for c in QUOTE)
    b0, a0, qb0, qa0 = (F.col(f"_{c}") for c in QUOTE)
    bid_flow = F.when(b > b0, qb).when(b == b0, qb - qb0).otherwise(-qb0)
    ask_flow = F.when(a < a0, -qa).when(a == a0, -(qa - qa0)).otherwise(qa0)
    out = df.withColumns({f"_{c}": x for c, x in before.items()})
    flow = F.when(F.col(time) - F.col(f"_{time}") == step, bid_flow + ask_flow)
    out = out.withColumn("quote_ofi_raw", flow)
    out = out.withColumn("quote_ofi_norm", F.col("quote_ofi_raw") / (F.lit(0.5) * (qb + qa + qb0 + qa0) + 1e-6))
    return out.drop(*[f"_{c}" for c in before])


def regime_features(df: DataFrame, order: list[str], keys: list[str], rows: int = 50) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    m = F.col("mid_price")
    out = df.withColumn("_r", ratio(m, F.lag(m).over(w)) - 1)
    return out.withColumns({"regime_volatility": rolling_std(F.col("_r"), w, rows), "regime_trend": ratio(m, F.lag(m, rows).over(w)) - 1}).drop("_r")


def regimes(df: DataFrame, volatility_median: Column, trend_band: Column) -> Column:
    v, t = F.col("regime_volatility"), F.col("regime_trend")
    high, up, down = v > volatility_median, t > trend_band, t < -trend_band
    return (
        F.when(v.isNull() | t.isNull(), "INSUFFICIENT_HISTORY")
        .when(up & high, "TREND_UP_HIGH_VOL").when(down & high, "TREND_DOWN_HIGH_VOL")
        .when(up, "TREND_UP_LOW_VOL").when(down, "TREND_DOWN_LOW_VOL")
        .when(high, "RANGE_HIGH_VOL").otherwise("RANGE_LOW_VOL")
    )


def pair_pivot(df: DataFrame, time: str, side: str, values: list[str]) -> DataFrame:
    """UP and DOWN rows of one time side by side; times that lack a side are dropped.

    Two rows of one time and side stop the job: no row could stand for both.
    """
    twice = F.raise_error(F.concat(F.lit("one time has a side twice: "), F.col(time).cast("string"))).cast("boolean")
    cols = [F.max(F.when(F.col(side) == s, F.col(v))).alias(f"{s.lower()}_{v}") for s in ("UP", "DOWN") for v in values]
    n = [F.count_if(F.col(side) == s).alias(f"n_{s.lower()}") for s in ("UP", "DOWN")]
    both = df.groupBy(time).agg(*cols, *n).where(F.when((F.col("n_up") > 1) | (F.col("n_down") > 1), twice).otherwise(F.lit(True)))
    return both.where("n_up > 0 AND n_down > 0").drop("n_up", "n_down")
