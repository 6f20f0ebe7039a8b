"""Ticks to bars: minute, dollar and resampled bars, trimming, gaps, runs, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.functions.num import order_key
from tideglass.operators.ordered import last_known, running_sum

DAY = 86400


def day_of(ts: str = "ts") -> Column:
    return F.floor(F.unix_seconds(ts) / DAY)


def valid_ticks(ticks: DataFrame) -> DataFrame:
    """Positive prices and volumes that are not negative."""
    return ticks.where((F.col("price") > 0) & (F.col("volume") >= 0))


def distinct_ticks(ticks: DataFrame) -> DataFrame:
    """Exact repeats of asset, time, price and volume once: the one of the lowest id."""
    return ticks.groupBy("asset", "ts", "price", "volume").agg(F.min("id").alias("id"))


def time_bars(ticks: DataFrame, seconds: int) -> DataFrame:
    """OHLC, volume and count per asset and left-labelled interval; empty intervals are absent. Map-side combined."""
    at = order_key(F.unix_micros("ts"), F.col("id"))
    start = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / seconds) * seconds)
    return valid_ticks(ticks).groupBy("asset", start.alias("bar")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_trades")
    )


def resample(bars: DataFrame, seconds: int, ts: str = "ts") -> DataFrame:
    """Coarser bars from bars, left-closed and left-labelled."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)
    return bars.groupBy("asset", start.alias("bar")).agg(F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"), F.sum("volume").alias("volume"), F.sum("n_trades").alias("n_trades"))


def dollar_bars(ticks: DataFrame, target: int) -> DataFrame:
    """Bars of equal traded value: bucket = floor(cumulative value * target / total value) per asset, exact in decimals.

    The last tick's cumulative value is the total, so it opens bucket ``target``; a tick larger than a bucket skips numbers.
    """
    money = (F.col("price").cast("decimal(18,4)") * F.col("volume").cast("decimal(18,4)")).cast("decimal(28,6)")
    rows = valid_ticks(ticks).withColumn("value", money)
    total = rows.groupBy("asset").agg(F.sum("value").cast("decimal(28,6)").alias("total"))
    cum = running_sum(rows, "asset", ["ts", "id"], day_of(), {"cum": F.col("value")}).join(F.broadcast(total), "asset")
    # assets are few by nature: one row each
    bucket = F.floor(F.try_divide((F.col("cum").cast("decimal(28,6)") * F.lit(target)).cast("decimal(38,6)"), F.col("total")))
    at = order_key(F.unix_micros("ts"), F.col("id"))
    return cum.groupBy("asset", bucket.cast("long").alias("bucket")).agg(
        F.max("ts").alias("bar"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"), F.sum("value").cast("double").alias("dollar_volume"), F.count(F.lit(1)).alias("n_ticks"),
    )


def common_window(ticks: DataFrame) -> DataFrame:
    """Rows in the window that all assets share, both ends included."""
    per = ticks.groupBy("asset").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    # one row by construction
    return ticks.crossJoin(F.broadcast(per)).where(F.col("ts").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def tick_summary(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.min("price").alias("low"), F.max("price").alias("high"),
        (F.round((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / (365.25 * DAY * 1e6), 9)).alias("years"),
    )


def bar_gaps(bars: DataFrame, ts: str = "bar") -> DataFrame:
    """Hours since the bar before; of each asset's first bar null."""
    by = Window.partitionBy("asset").orderBy(ts)
    return bars.select("asset", ts, ((F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(by))) / 3.6e9).alias("gap_h"))


def run_lengths(ticks: DataFrame) -> DataFrame:
    """Lengths of runs of equal prices per asset: how many runs of each length."""
    rows = last_known(ticks.where("price is not null"), "asset", ["ts", "id"], day_of(), {"_before": F.col("price")}, strict=True)
    rows = rows.withColumn("new", F.coalesce((F.col("price") != F.col("_before")).cast("int"), F.lit(1)))
    runs = running_sum(rows, "asset", ["ts", "id"], day_of(), {"run": F.col("new").cast("long")})
    return runs.groupBy("asset", "run").agg(F.count(F.lit(1)).alias("length")).groupBy("asset", "length").agg(F.count(F.lit(1)).alias("runs"))
