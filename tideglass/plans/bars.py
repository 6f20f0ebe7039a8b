"""Queries over ticks and bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators import bars as B
from tideglass.operators.ordered import asof
from tideglass.plans.registry import Registry
from tideglass.sources.adapters import CANDLES_SQL, TICKS_SQL, candles, ticks

R = Registry()
_T = f"with t as ({TICKS_SQL}), v as (select * from t where price > 0 and volume >= 0)"
_BAR = "arg_min(price, (ts, id)) as open, max(price) as high, min(price) as low, arg_max(price, (ts, id)) as close, sum(volume) as volume, count(*) as n_trades"


def _bar_sql(seconds: int) -> str:
    return f"{_T} select asset, (epoch_us(ts) // {seconds * 1000000} * {seconds})::bigint as bar_epoch, {_BAR} from v group by 1, 2"


def _epoch(df: DataFrame, c: str = "bar") -> DataFrame:
    return df.withColumn(f"{c}_epoch", F.unix_seconds(c)).drop(c)


@R.add(_bar_sql(60))
def bars_minute(spark: SparkSession, d: str) -> DataFrame:
    return _epoch(B.time_bars(ticks(spark, d), 60))


@R.add(_bar_sql(3600))
def bars_hour(spark: SparkSession, d: str) -> DataFrame:
    return _epoch(B.time_bars(ticks(spark, d), 3600))


@R.add(
    f"with c as ({CANDLES_SQL}) select asset, (epoch_us(ts) // 3600000000 * 3600)::bigint as bar_epoch, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, round(sum(volume), 6) as volume, sum(n_trades)::bigint as n_trades from c group by 1, 2"
)
def bars_resample_hour(spark: SparkSession, d: str) -> DataFrame:
    return _epoch(B.resample(candles(spark, d), 3600)).withColumn("volume", F.round("volume", 6))


@R.add(
    f"""{_T}, m as (select *, (price::decimal(18,4) * volume::decimal(18,4))::decimal(28,6) as value from v), c as (select *, sum(value) over (partition by asset order by ts, id) as cum, sum(value) over (partition by asset) as total from m)
    select asset, bucket, epoch_us(max(ts)) as bar_us, arg_min(price, (ts, id)) as open, max(price) as high, min(price) as low, arg_max(price, (ts, id)) as close, round(sum(volume), 6) as volume, round(sum(value)::double, 4) as dollar_volume, count(*) as n_ticks
    from (select *, ((cum * 1000000)::hugeint * 100 // (total * 1000000)::hugeint)::bigint as bucket from c) group by 1, 2"""
)
def bars_dollar(spark: SparkSession, d: str) -> DataFrame:
    b = B.dollar_bars(ticks(spark, d), 100)
    return b.withColumn("bar_us", F.unix_micros("bar")).drop("bar").withColumn("volume", F.round("volume", 6)).withColumn("dollar_volume", F.round("dollar_volume", 4))


@R.add(f"{_T} select asset, count(*) as n, epoch_us(min(ts)) as first, epoch_us(max(ts)) as last, min(price) as low, max(price) as high, round((epoch_us(max(ts)) - epoch_us(min(ts))) / (365.25 * 86400 * 1e6), 9) as years from t group by 1")
def tick_summary(spark: SparkSession, d: str) -> DataFrame:
    return B.tick_summary(ticks(spark, d)).withColumn("first", F.unix_micros("first")).withColumn("last", F.unix_micros("last"))


@R.add(f"{_T} select asset, (epoch_us(ts) // 86400000000)::bigint as day, round(median(price), 9) as price from t group by 1, 2")
def daily_median(spark: SparkSession, d: str) -> DataFrame:
    return ticks(spark, d).groupBy("asset", B.day_of().alias("day")).agg(F.round(F.median("price"), 9).alias("price"))


@R.add(f"{_T} select asset, (epoch_us(ts) // 86400000000)::bigint as day, round(count(distinct epoch_us(ts) // 60000000) / 1440.0, 9) as share from t group by 1, 2")
def coverage_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Share of the day's minutes with a tick."""
    minutes = ticks(spark, d).select("asset", F.floor(F.unix_seconds("ts") / 60).alias("m")).distinct()
    return minutes.groupBy("asset", F.floor(F.col("m") / 1440).alias("day")).agg(F.round(F.count(F.lit(1)) / 1440, 9).alias("share"))


@R.add(f"{_T}, w as (select max(lo) as lo, min(hi) as hi from (select min(ts) as lo, max(ts) as hi from t group by asset)) select t.asset, count(*) as n, round(sum(price), 6) as price from t, w where ts between lo and hi group by 1")
def common_window_trim(spark: SparkSession, d: str) -> DataFrame:
    return B.common_window(ticks(spark, d)).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 6).alias("price"))


@R.add(f"{_T} select asset, epoch_us(ts) as us, price, volume, min(id) as id from t group by asset, ts, price, volume")
def ticks_distinct(spark: SparkSession, d: str) -> DataFrame:
    return B.distinct_ticks(ticks(spark, d)).select("asset", F.unix_micros("ts").alias("us"), "price", "volume", "id")


@R.add(f"{_T}, b as (select distinct asset, epoch_us(ts) // 3600000000 as h from t) select asset, (h * 3600)::bigint as bar_epoch, (h - lag(h) over (partition by asset order by h))::double as gap_h from b")
def bar_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _epoch(B.bar_gaps(B.time_bars(ticks(spark, d).where("price is not null"), 3600)))


@R.add(
    f"{_T}, n as (select *, case when price = lag(price) over (partition by asset order by ts, id) then 0 else 1 end as new from t), r as (select asset, sum(new) over (partition by asset order by ts, id) as run from n), l as (select asset, run, count(*) as length from r group by 1, 2) select asset, length, count(*) as runs from l group by 1, 2"
)
def run_lengths(spark: SparkSession, d: str) -> DataFrame:
    return B.run_lengths(ticks(spark, d))


def _grid(spark: SparkSession, d: str, seconds: int = 3600) -> DataFrame:
    """A fixed-frequency grid from each asset's first tick, not floored."""
    span = ticks(spark, d).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    assets = ticks(spark, d).select("asset").distinct()
    instants = span.select(F.explode(F.sequence("lo", "hi", F.expr(f"interval {seconds} seconds"))).alias("ts"))
    return assets.crossJoin(instants)  # few assets by the instants of one calendar


_GRID = f"{_T}, g as (select a.asset, s.ts from (select distinct asset from t) a, (select unnest(generate_series(min(ts), max(ts), interval 1 hour)) as ts from t) s)"


@R.add(f"{_GRID} select g.asset, epoch_us(g.ts) as us, t.price from g asof left join t on g.asset = t.asset and g.ts >= t.ts")
def asof_backward_grid(spark: SparkSession, d: str) -> DataFrame:
    """The last price at or before every grid instant."""
    out = asof(_grid(spark, d), ticks(spark, d), "asset", "ts", "price", "price")
    return out.select("asset", F.unix_micros("ts").alias("us"), "price")


ASSETS = ("click", "purchase", "view")


@R.add(
    f"""{_GRID}, p as (select g.asset, g.ts, t.price from g asof left join t on g.asset = t.asset and g.ts >= t.ts),
    w as (select ts, max(price) filter (where asset = 'click') as click_price, max(price) filter (where asset = 'purchase') as purchase_price from p group by 1)
    select epoch_us(ts) as us, click_price, purchase_price, round(ln(click_price) - lag(ln(click_price)) over (order by ts), 9) as click_return, round(ln(purchase_price) - lag(ln(purchase_price)) over (order by ts), 9) as purchase_return
    from w where click_price is not null and purchase_price is not null"""
)
def aligned_wide(spark: SparkSession, d: str) -> DataFrame:
    """Two assets side by side on the grid from the first instant both have a price, with log returns."""
    from pyspark.sql import Window

    p = asof(_grid(spark, d), ticks(spark, d), "asset", "ts", "price", "price")
    w = p.groupBy("ts").pivot("asset", ["click", "purchase"]).agg(F.max("price"))
    w = w.where("click is not null and purchase is not null")
    by = Window.orderBy("ts")  # one row per instant of one calendar
    ret = lambda c: F.round(F.log(c) - F.lag(F.log(c)).over(by), 9)
    return w.select(F.unix_micros("ts").alias("us"), F.col("click").alias("click_price"), F.col("purchase").alias("purchase_price"), ret("click").alias("click_return"), ret("purchase").alias("purchase_return"))


@R.add(f"{_T}, h as (select asset, epoch_us(ts) // 3600000000 as h, arg_max(price, (ts, id)) as close from v group by 1, 2) select asset, (h * 3600)::bigint as bar_epoch, round(100 * close / first_value(close) over (partition by asset order by h), 6) as value from h")
def indexed_long(spark: SparkSession, d: str) -> DataFrame:
    """Hourly closes, the first of each asset set to 100."""
    h = B.time_bars(ticks(spark, d), 3600)
    first = h.groupBy("asset").agg(F.min_by("close", "bar").alias("first"))
    return h.join(F.broadcast(first), "asset").select("asset", F.unix_seconds("bar").alias("bar_epoch"), F.round(100 * F.col("close") / F.col("first"), 6).alias("value"))


@R.add(
    f"""{_T}, h as (select asset, epoch_us(ts) // 3600000000 as h, arg_max(price, (ts, id)) as close from v group by 1, 2),
    r as (select asset, h, ln(close) - lag(ln(close)) over (partition by asset order by h) as r from h)
    select a.asset as asset_a, b.asset as asset_b, round(corr(a.r, b.r), 6) as corr from r a join r b on a.h = b.h and a.asset < b.asset where a.r is not null and b.r is not null group by 1, 2"""
)
def return_corr(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of hourly returns of every pair of assets."""
    from pyspark.sql import Window

    h = B.time_bars(ticks(spark, d), 3600)
    r = h.select("asset", "bar", (F.log("close") - F.lag(F.log("close")).over(Window.partitionBy("asset").orderBy("bar"))).alias("r")).where("r is not null")
    a, b = r.selectExpr("asset as asset_a", "bar", "r as ra"), r.selectExpr("asset as asset_b", "bar", "r as rb")
    return a.join(b, "bar").where("asset_a < asset_b").groupBy("asset_a", "asset_b").agg(F.round(F.corr("ra", "rb"), 6).alias("corr"))
