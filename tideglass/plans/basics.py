"""Smaller queries: pivots, matrices, tails, set operations, quantiles, clocks, validation, resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.functions.num import interpolate
from tideglass.operators import pairs as P
from tideglass.operators import vol as V
from tideglass.operators.bars import resample
from tideglass.plans.registry import Registry
from tideglass.session import table
from tideglass.sources.adapters import CANDLES_SQL, FORECASTS_SQL, MARKETS_SQL, candles, forecasts, markets
from tideglass.sources.readers import split_valid

R = Registry()
_HR = f"with c as ({CANDLES_SQL}), h as (select asset, epoch_us(ts) // 3600000000 as h, arg_max(close, ts) as close from c group by 1, 2), r as (select asset, h, ln(close) - lag(ln(close)) over (partition by asset order by h) as r from h)"


def _returns(spark: SparkSession, d: str) -> DataFrame:
    h = resample(candles(spark, d), 3600)
    r = F.log("close") - F.lag(F.log("close")).over(Window.partitionBy("asset").orderBy("bar"))
    return h.select("asset", "bar", "close", r.alias("r"))


@R.add(f"{_HR}, s as (select asset, (r - avg(r) over w) / stddev_pop(r) over w as z from r where r is not null window w as (partition by asset)) select asset, count(*) as n, round(avg(pow(z, 4)) - 3, 6) as kurtosis, sum((abs(z) > 4)::int)::bigint as tails from s group by 1")
def shock_tails(spark: SparkSession, d: str) -> DataFrame:
    """Excess kurtosis of hourly returns and how many lie beyond four deviations."""
    r = _returns(spark, d).where("r is not null")
    m = r.groupBy("asset").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    z = r.join(F.broadcast(m), "asset").withColumn("z", F.try_divide(F.col("r") - F.col("m"), F.col("s")))  # one row per asset
    return z.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.pow("z", F.lit(4))) - 3, 6).alias("kurtosis"), F.sum((F.abs("z") > 4).cast("long")).alias("tails"))


@R.add(f"{_HR}, q as (select a.asset as x, b.asset as y, corr(a.r, b.r) as c from r a join r b using (h) where a.r is not null and b.r is not null and a.asset < b.asset group by 1, 2), u as (select x, y, c from q union all select y, x, c from q) select x as asset, count(*) as others, round(avg(c), 6) as mean_corr, round(max(c), 6) as most from u group by 1")
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The symmetric matrix of return correlations, summed up by row."""
    r = _returns(spark, d).where("r is not null")
    a, b = r.selectExpr("asset as x", "bar", "r as ra"), r.selectExpr("asset as y", "bar", "r as rb")
    q = a.join(b, "bar").where("x < y").groupBy("x", "y").agg(F.corr("ra", "rb").alias("c"))
    u = q.unionByName(q.select(F.col("y").alias("x"), F.col("x").alias("y"), "c"))
    return u.groupBy(F.col("x").alias("asset")).agg(F.count(F.lit(1)).alias("others"), F.round(F.avg("c"), 6).alias("mean_corr"), F.round(F.max("c"), 6).alias("most"))


@R.add(
    f"""with f as ({FORECASTS_SQL}), b as (select least(floor(p * 4), 3)::int as q, model_id, y from f)
    select q, round(avg(y) filter (where model_id = 'naive_2x'), 9) as naive_2x, round(avg(y) filter (where model_id = 'har_mix'), 9) as har_mix, round(avg(y) filter (where model_id = 'gbm_har'), 9) as gbm_har from b group by 1"""
)
def hit_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of hits by quarter of the forecast, models side by side."""
    f = forecasts(spark, d).withColumn("q", F.least(F.floor(F.col("p") * 4), F.lit(3)).cast("int"))
    p = f.groupBy("q").pivot("model_id", ["naive_2x", "har_mix", "gbm_har"]).agg(F.avg(F.col("y").cast("double")))
    return p.select("q", *[F.round(c, 9).alias(c) for c in ("naive_2x", "har_mix", "gbm_har")])


@R.add(f"with f as ({FORECASTS_SQL}) select model_id, count(*) as n, count(distinct week) as weeks, min(week) as first, max(week) as last, round(quantile_cont(p, 0.5), 9) as median from f group by 1")
def forecast_spans(spark: SparkSession, d: str) -> DataFrame:
    return forecasts(spark, d).groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("week").alias("weeks"), F.min("week").alias("first"), F.max("week").alias("last"), F.round(F.percentile("p", 0.5), 9).alias("median"))


@R.add(
    """with a as (select distinct series_id from forecast where series_id is not null), b as (select distinct series_id from macro_observation where series_id is not null)
    select 'both' as what, series_id from (select * from a intersect select * from b) union all select 'forecast only', series_id from (select * from a except select * from b)
    union all select 'observed only', series_id from (select * from b except select * from a) union all select 'any', series_id from (select * from a union select * from b)"""
)
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Series of forecasts and observations: shared, on one side only, and all."""
    a, b = (table(spark, d, t).select("series_id").where("series_id is not null").distinct() for t in ("forecast", "macro_observation"))
    tag = lambda df, w: df.select(F.lit(w).alias("what"), "series_id")
    return tag(a.intersect(b), "both").unionByName(tag(a.exceptAll(b), "forecast only")).unionByName(tag(b.exceptAll(a), "observed only")).unionByName(tag(a.union(b).distinct(), "any"))


@R.add(
    f"""with f as ({FORECASTS_SQL}), w as (select model_id, p, 1 + y as w, sum(1 + y) over o - (1 + y) / 2.0 as c from f window o as (partition by model_id order by p, forecast_id)), t as (select model_id, sum(w) / 2.0 as half from w group by 1),
    n as (select w.model_id, max(case when c <= half then row(c, p) end) as lo, min(case when c > half then row(c, p) end) as hi, max(half) as half from w join t using (model_id) group by 1)
    select model_id, round(case when lo is null then hi[2] when hi is null then lo[2] else lo[2] + (hi[2] - lo[2]) * (half - lo[1]) / (hi[1] - lo[1]) end, 8) as median from n"""
)
def weighted_median(spark: SparkSession, d: str) -> DataFrame:
    """Median of the forecasts, hits weighing double, interpolated at cumulative weights less half of each."""
    f = forecasts(spark, d).withColumn("w", 1.0 + F.col("y"))
    by = Window.partitionBy("model_id").orderBy("p", "forecast_id")  # a handful of models; per model the order is the point
    c = f.withColumn("c", F.sum("w").over(by) - F.col("w") / 2)
    half = f.groupBy("model_id").agg((F.sum("w") / 2).alias("half"))
    j = c.join(F.broadcast(half), "model_id")
    pick = F.struct("c", "p")
    n = j.groupBy("model_id").agg(F.max(F.when(F.col("c") <= F.col("half"), pick)).alias("lo"), F.min(F.when(F.col("c") > F.col("half"), pick)).alias("hi"), F.max("half").alias("half"))
    mid = F.col("lo.p") + (F.col("hi.p") - F.col("lo.p")) * (F.col("half") - F.col("lo.c")) / (F.col("hi.c") - F.col("lo.c"))
    return n.select("model_id", F.round(F.when(F.col("lo").isNull(), F.col("hi.p")).when(F.col("hi").isNull(), F.col("lo.p")).otherwise(mid), 8).alias("median"))


@R.add(f"{_HR}, k as (select asset, r, row_number() over (partition by asset order by h desc) - 1 as back from r), l as (select asset, sum(r * r) filter (where back between 1 and 24) as s24, sum(r * r) filter (where back between 1 and 168) as s168, count(r) filter (where back between 1 and 168) as n from k group by 1) select asset, round(s24, 10) as s24, round(s168, 10) as s168, n from l where n >= 168")
def live_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the last day's and week's squared returns, the forming hour left out."""
    r = _returns(spark, d).withColumn("back", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("bar"))) - 1)
    s = lambda n: F.sum(F.when(F.col("back").between(1, n), F.col("r") * F.col("r")))
    g = r.groupBy("asset").agg(s(24).alias("s24"), s(168).alias("s168"), F.count(F.when(F.col("back").between(1, 168), F.col("r"))).alias("n"))
    return g.where("n >= 168").select("asset", F.round("s24", 10).alias("s24"), F.round("s168", 10).alias("s168"), "n")


@R.add(f"with m as ({MARKETS_SQL}), h as (select market_id, ((epoch_us(close_time) - epoch_us(window_start)) // 3600000000) / 24.0 as days from m where window_start is not null and close_time is not null) select market_id, round(case when days <= 1 then 0.766 when days <= 7 then 0.766 + (0.673 - 0.766) * (days - 1) / 6 when days <= 30 then 0.673 + (0.647 - 0.673) * (days - 7) / 23 else 0.647 end, 8) as spread from h")
def horizon_spread(spark: SparkSession, d: str) -> DataFrame:
    """A spread interpolated between the horizons it was fitted at."""
    m = markets(spark, d).where("window_start is not null and close_time is not null")
    days = F.floor((F.unix_micros("close_time") - F.unix_micros("window_start")) / 3_600_000_000) / 24
    return m.select("market_id", F.round(interpolate(days, [1, 7, 30], [0.766, 0.673, 0.647]), 8).alias("spread"))


@R.add("select forecast_id, (epoch_us(ts) // 3600000000)::bigint as hour, (epoch_us(date_trunc('hour', ts + interval 1 hour)) // 1000000)::bigint as next_hour, year(ts at time zone 'UTC')::int as year, (epoch_us(ts) // 3600000000 // 168)::bigint as week168 from (select distinct forecast_id, ts from forecast)")
def clocks(spark: SparkSession, d: str) -> DataFrame:
    """Hour index, next full hour, year and week of hours of every forecast."""
    f = table(spark, d, "forecast").select("forecast_id", "ts").distinct()
    hour = F.floor(F.unix_seconds("ts") / 3600)
    return f.select("forecast_id", hour.alias("hour"), F.unix_seconds(F.date_trunc("hour", F.col("ts") + F.expr("interval 1 hour"))).alias("next_hour"), F.year("ts").alias("year"), F.floor(hour / 168).alias("week168"))


_RULE = "hawkish_dovish_score between -1 and 1 and surprise_magnitude between 0 and 1 and lower(sentiment) in ('hawkish', 'dovish', 'neutral') and confidence between 0 and 1 and length(rationale) <= 500"


@R.add(f"select label_id, coalesce({_RULE}, false) as valid from reliability_label")
def validated_labels(spark: SparkSession, d: str) -> DataFrame:
    """Rows that keep the schema's ranges and choices, and the quarantine."""
    good, rest = split_valid(table(spark, d, "reliability_label"), F.expr(_RULE))
    return good.select("label_id", F.lit(True).alias("valid")).unionByName(rest.select("label_id", F.lit(False).alias("valid")))


@R.add("with q as (select distinct snapshot_id, best_ask - best_bid as gap, best_bid, best_ask from market_snapshot) select count(*) as n, round(avg(abs(gap)), 6) as mean_gap, max(gap) as most, sum((gap > 0.1)::int)::bigint as wide, sum((best_bid > best_ask)::int)::bigint as crossed from q where best_bid between 0 and 1 and best_ask between 0 and 1")
def cycle_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a pricing cycle over all quotes."""
    q = table(spark, d, "market_snapshot").select("snapshot_id", (F.col("best_ask") - F.col("best_bid")).alias("gap"), "best_bid", "best_ask").distinct().where("best_bid between 0 and 1 and best_ask between 0 and 1")
    return q.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs("gap")), 6).alias("mean_gap"), F.max("gap").alias("most"), F.sum((F.col("gap") > 0.1).cast("long")).alias("wide"), F.sum((F.col("best_bid") > F.col("best_ask")).cast("long")).alias("crossed"))


@R.add("select s.snapshot_id from (select distinct snapshot_id, market_id from market_snapshot) s where not exists (select 1 from market m where m.market_id = s.market_id)")
def orphan_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes whose contract is in no delivery."""
    s = table(spark, d, "market_snapshot").select("snapshot_id", "market_id").distinct()
    return s.join(table(spark, d, "market").select("market_id").distinct(), "market_id", "left_anti").select("snapshot_id")


@R.add(f"{_HR}, f as (select asset, count(*) as n from c group by 1) select asset, n, round(n / sum(n) over (), 9) as share, rank() over (order by n desc)::int as place from f")
def flow_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of the candles by asset, and its rank (one row per asset)."""
    f = candles(spark, d).groupBy("asset").agg(F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy(F.lit(0))
    return f.select("asset", "n", F.round(F.col("n") / F.sum("n").over(all_), 9).alias("share"), F.rank().over(all_.orderBy(F.desc("n"))).alias("place"))


@R.add()
def bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    """Interval of each model's mean Brier score by resampling weeks of sums."""
    from tideglass.operators.scoring import cluster_bootstrap, cluster_sums

    f = forecasts(spark, d)
    s = cluster_sums(f, F.pow(F.col("p") - F.col("y"), F.lit(2)), F.lit(0.0), "week", ["model_id"])
    return cluster_bootstrap(s, ["model_id"], 2000).select("model_id", *[F.round(c, 7).alias(c) for c in ("diff", "ci_low", "ci_high")], "clusters")


@R.add()
def stat_tests(spark: SparkSession, d: str) -> DataFrame:
    """Unit-root statistic of each asset's log price, with the robust mean of its returns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar")
        y = np.log(pdf["close"].to_numpy(float))
        if len(y) < 30:
            return pd.DataFrame({"asset": [], "adf": [], "p": [], "mean": [], "t": []})
        stat = P.adf(y)
        mean, t = P.newey_west_mean(np.diff(y))
        return pd.DataFrame({"asset": [pdf["asset"].iloc[0]], "adf": [round(stat, 6)], "p": [round(P.mackinnon_p(stat), 6)], "mean": [round(mean, 9)], "t": [round(t, 6)]})

    return _returns(spark, d).select("asset", "bar", "close").groupBy("asset").applyInPandas(run, "asset string, adf double, p double, mean double, t double")


@R.add(f"with {V.DENSE_SQL} select asset, count(*) as hours, sum(traded::int)::bigint as traded, round(avg(traded::int), 9) as coverage, round(sum(rv), 9) as rv from dense group by 1")
def dense_summary(spark: SparkSession, d: str) -> DataFrame:
    """Dense hours by asset."""
    h = V.dense_hours(table(spark, d, "hourly_grid"))
    return h.groupBy("asset").agg(F.count(F.lit(1)).alias("hours"), F.sum(F.col("traded").cast("long")).alias("traded"), F.round(F.avg(F.col("traded").cast("double")), 9).alias("coverage"), F.round(F.sum("rv"), 9).alias("rv"))


@R.add("with d as (select l_shipdate::date as day, l_extendedprice / l_quantity as price, l_quantity as volume, l_orderkey, l_linenumber from lineitem where l_quantity > 0) select day, arg_min(price, (l_orderkey, l_linenumber)) as open, max(price) as high, min(price) as low, arg_max(price, (l_orderkey, l_linenumber)) as close, sum(volume) as volume, count(*) as n from d group by 1")
def lineitem_days(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of a long series."""
    at = F.struct("l_orderkey", "l_linenumber")
    rows = table(spark, d, "lineitem").where("l_quantity > 0").select(F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"), "l_orderkey", "l_linenumber")
    return rows.groupBy("day").agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"))


@R.add("select event_key, string_agg(market_id, '|' order by market_id) as contracts, count(*) as n from (select distinct event_key, market_id from market where event_key is not null) group by 1")
def contracts_of_event(spark: SparkSession, d: str) -> DataFrame:
    """The contracts of every event in order: an event's list is a venue's choice, not a hot group."""
    m = table(spark, d, "market").where("event_key is not null").select("event_key", "market_id").distinct()
    return m.groupBy("event_key").agg(F.array_join(F.array_sort(F.collect_list("market_id")), "|").alias("contracts"), F.count(F.lit(1)).alias("n"))
