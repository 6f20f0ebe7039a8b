"""Queries of reports: time ranges, latest cycles, alerts, rolling estimators, counts of tests, ladders against venues."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.operators import pairs as P
from tideglass.operators.trailing import latest_rows
from tideglass.plans.pairs import _ROWS, LOOK, _rows
from tideglass.plans.registry import Registry
from tideglass.session import broadcast_if_small, table
from tideglass.sources.adapters import CANDLES_SQL, FORECASTS_SQL, MARKETS_SQL, QUOTES_SQL, candles, forecasts, markets, quotes

R = Registry()
LN2 = math.log(2)


@R.add("with m as (select to_timestamp((min(epoch_us(ts)) + 86400000000) / 1e6) as lo, to_timestamp((min(epoch_us(ts)) + 5 * 86400000000) / 1e6) as hi from candle) select asset, count(*) as n, round(avg(close), 9) as close from candle, m where epoch_us(ts) >= epoch_us(lo) and epoch_us(ts) < epoch_us(hi) and asset is not null group by 1")
def time_range(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a half-open range of time, passed as parameters of a query, so that the bounds reach the scan."""
    c = table(spark, d, "candle")
    first = c.agg(F.min(F.unix_micros("ts"))).first()[0]
    if first is None:
        first = 0
    c.createOrReplaceTempView("_candle_range")
    lo, hi = first + 86_400_000_000, first + 5 * 86_400_000_000
    return spark.sql("select asset, count(*) as n, round(avg(close), 9) as close from _candle_range where ts >= timestamp_micros(:lo) and ts < timestamp_micros(:hi) and asset is not null group by asset", args={"lo": lo, "hi": hi})


_DAILY = f"c as ({CANDLES_SQL}), dd as (select asset, (epoch_us(ts) // 86400000000)::bigint as day, max(high) as high, min(low) as low, arg_max(close, ts) as close from c where high > 0 and low > 0 group by 1, 2), dr as (select *, ln(close) - lag(ln(close)) over (partition by asset order by day) as r, pow(ln(high / low), 2) as hl from dd)"


@R.add(f"with {_DAILY} select asset, day, case when count(r) over w >= 2 then round(stddev_samp(r) over w * sqrt(365), 8) end as vol_close, round(sqrt(avg(hl) over w / (4 * ln(2)) * 365), 8) as vol_range, round(sum(r * r) over w, 10) as rv from dr window w as (partition by asset order by day range between 30 preceding and 1 preceding)")
def rolling_vol(spark: SparkSession, d: str) -> DataFrame:
    """Close-to-close and range volatility and realised variance over the 30 days before each day."""
    day = F.floor(F.unix_seconds("ts") / 86_400)
    dd = candles(spark, d).where("high > 0 and low > 0").groupBy("asset", day.alias("day")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"))
    dr = dd.withColumn("r", F.log("close") - F.lag(F.log("close")).over(Window.partitionBy("asset").orderBy("day"))).withColumn("hl", F.pow(F.log(F.col("high") / F.col("low")), 2))
    w = Window.partitionBy("asset").orderBy("day").rangeBetween(-30, -1)
    close = F.when(F.count("r").over(w) >= 2, F.stddev_samp("r").over(w) * math.sqrt(365))
    return dr.select("asset", "day", F.round(close, 8).alias("vol_close"), F.round(F.sqrt(F.avg("hl").over(w) / (4 * LN2) * 365), 8).alias("vol_range"), F.round(F.sum(F.col("r") * F.col("r")).over(w), 10).alias("rv"))


@R.add(f"{_ROWS}, s as (select pair, avg((abs(z) >= 2)::int) as frac, avg(abs(z)) as mean_z from zs where z is not null group by 1) select pair, round(frac, 9) as frac, round(mean_z, 6) as mean_z from s order by round(frac, 9) desc, round(mean_z, 6), pair limit 1")
def best_pair(spark: SparkSession, d: str) -> DataFrame:
    """The pair whose spread is most often two deviations out, of equals the one with the smaller mean score."""
    z = P.zscore(P.ols_hedge(_rows(spark, d)), LOOK).where("z is not null")
    s = z.groupBy("pair").agg(F.round(F.avg((F.abs("z") >= 2).cast("double")), 9).alias("frac"), F.round(F.avg(F.abs("z")), 6).alias("mean_z"))
    return s.orderBy(F.desc("frac"), "mean_z", "pair").limit(1)


@R.add(f"with f as ({FORECASTS_SQL}), p as (select series_id, week, max(p) filter (where model_id = 'har_mix') as a, max(p) filter (where model_id = 'naive_2x') as b from f where series_id is not null and week is not null group by 1, 2) select series_id, week, round(greatest(a - b, b - a), 9) as edge from p where a is not null and b is not null order by round(greatest(a - b, b - a), 9) desc, series_id, week limit 8")
def widest_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The eight weeks of a series in which the highest forecasts of two models differ most, whichever is higher."""
    of = lambda m, n: F.max(F.when(F.col("model_id") == m, F.col("p"))).alias(n)
    p = forecasts(spark, d).where("series_id is not null and week is not null").groupBy("series_id", "week").agg(of("har_mix", "a"), of("naive_2x", "b")).where("a is not null and b is not null")
    return p.select("series_id", "week", F.round(F.greatest(F.col("a") - F.col("b"), F.col("b") - F.col("a")), 9).alias("edge")).orderBy(F.desc("edge"), "series_id", "week").limit(8)


@R.add(
    f"with c as ({CANDLES_SQL}), a as (select asset, count(*) as n, round(avg(close), 9) as mean from c group by 1), g as (select asset, count(*) as n, round(avg(close), 9) as mean from (select distinct asset, h, close from hourly_grid where close is not null) group by 1) select lower(a.asset) as key, a.n as n_candle, g.n as n_grid, a.mean as mean_candle, g.mean as mean_grid from a join g on lower(a.asset) = lower(g.asset)"
)
def merged_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Two summaries side by side on a derived key, their columns told apart by suffix."""
    of = lambda df, s: df.groupBy(F.lower("asset").alias("key"), "asset").agg(F.count(F.lit(1)).alias(f"n_{s}"), F.round(F.avg("close"), 9).alias(f"mean_{s}")).drop("asset")
    g = table(spark, d, "hourly_grid").where("close is not null and asset is not null").select("asset", "h", "close").distinct()
    return of(candles(spark, d), "candle").join(of(g, "grid"), "key")


@R.add(
    f"""with q as ({QUOTES_SQL}), m as ({MARKETS_SQL}), last as (select market_id, max(ts) as ts from q where market_id is not null group by 1), cyc as (select m.event_key, max(last.ts) as ts from last join m using (market_id) where m.kind = 'threshold' and m.event_key is not null group by 1)
    select m.event_key, m.strike_pct, count(*) as quotes, round(max(coalesce((bid + ask) / 2, last)), 9) as mid from q join m using (market_id) join cyc on cyc.event_key = m.event_key where m.kind = 'threshold' and m.strike_pct is not null and epoch_us(cyc.ts) - epoch_us(q.ts) <= 7 * 86400000000 group by 1, 2"""
)
def latest_cycle(spark: SparkSession, d: str) -> DataFrame:
    """The ladder of each event over the week before its latest quote."""
    m = broadcast_if_small(markets(spark, d).where("kind = 'threshold' and event_key is not null").select("market_id", "event_key", "strike_pct"))
    q = quotes(spark, d).where("market_id is not null").join(m, "market_id")
    end = q.groupBy("event_key").agg(F.max(F.unix_micros("ts")).alias("end"))
    near = q.where("strike_pct is not null").join(broadcast_if_small(end), "event_key").where(F.col("end") - F.unix_micros("ts") <= 7 * 86_400_000_000)
    return near.groupBy("event_key", "strike_pct").agg(F.count(F.lit(1)).alias("quotes"), F.round(F.max(F.coalesce((F.col("bid") + F.col("ask")) / 2, "last")), 9).alias("mid"))


@R.add(
    f"""with q as ({QUOTES_SQL}), g as (select market_id, count(*) as n, max(epoch_us(ts)) as seen, avg((bid is null or ask is null)::int) as one_sided, avg(ask - bid) as width, coalesce(max(volume_24h), 0) as volume from q where market_id is not null group by 1), a as (select max(seen) as now from g)
    select market_id, now - seen > 3 * 3600000000 as stale, one_sided > 0.5 as one_sided, coalesce(width > 0.1, false) as wide, volume = 0 as idle, n < 10 as sparse from g, a"""
)
def alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alert predicates of every contract: stale, one-sided, wide, idle, sparse."""
    q = quotes(spark, d).where("market_id is not null")
    empty = (F.col("bid").isNull() | F.col("ask").isNull()).cast("double")
    g = q.groupBy("market_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("ts")).alias("seen"), F.avg(empty).alias("empty"), F.avg(F.col("ask") - F.col("bid")).alias("width"), F.coalesce(F.max("volume_24h"), F.lit(0.0)).alias("volume"))
    now = q.agg(F.max(F.unix_micros("ts")).alias("now"))
    return g.crossJoin(F.broadcast(now)).select("market_id", (F.col("now") - F.col("seen") > 3 * 3_600_000_000).alias("stale"), (F.col("empty") > 0.5).alias("one_sided"), F.coalesce(F.col("width") > 0.1, F.lit(False)).alias("wide"), (F.col("volume") == 0).alias("idle"), (F.col("n") < 10).alias("sparse"))  # one row against all


@R.add(
    """with recursive w as (select asset, (epoch_us(ts) // 86400000000)::bigint as day, rv from (select asset, ts, rv, row_number() over (partition by asset, h order by ingested_at desc, ts desc, rv desc nulls last) as k from hourly_grid where asset is not null) where k = 1),
    s as (select asset, day, sum(rv) as v from w group by 1, 2), t as (select asset, count(*) as tests, count(*) filter (where v > 2 * m) as hits from (select *, avg(v) over (partition by asset) as m from s where v is not null) group by 1)
    select sum(tests)::bigint as tests, round(sum(tests) * 0.05, 6) as expected, sum(hits)::bigint as hits, round(1 - exp(ln(0.95) * sum(tests)), 9) as any_by_chance, count(distinct tests) as sizes from t"""
)
def significance_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many tests were made, how many of them chance alone would pass, how many did, and how many sizes of them there are."""
    g = latest_rows(table(spark, d, "hourly_grid").where("asset is not null"), ["asset", "h"], "ingested_at", ["ts", "rv"])
    s = g.groupBy("asset", F.floor(F.unix_seconds("ts") / 86_400).alias("day")).agg(F.sum("rv").alias("v")).where("v is not null")
    t = s.withColumn("m", F.avg("v").over(Window.partitionBy("asset"))).groupBy("asset").agg(F.count(F.lit(1)).alias("tests"), F.sum((F.col("v") > 2 * F.col("m")).cast("long")).alias("hits"))
    n = F.sum("tests")
    return t.agg(n.alias("tests"), F.round(n * 0.05, 6).alias("expected"), F.sum("hits").alias("hits"), F.round(1 - F.exp(n * math.log(0.95)), 9).alias("any_by_chance"), F.countDistinct("tests").alias("sizes"))


_LADDER = f"""q as ({QUOTES_SQL}), m as ({MARKETS_SQL}), lt as (select market_id, arg_max(coalesce((bid + ask) / 2, last), (ts, snapshot_id)) as mid from q where market_id is not null group by 1),
    lad as (select strike_pct as s, avg(mid) as p from lt join m using (market_id) where kind = 'threshold' and strike_pct is not null and mid is not null group by 1),
    buc as (select bucket_bps as b, avg(mid) as p from lt join m using (market_id) where kind = 'bucket' and bucket_bps is not null and mid is not null group by 1)"""


@R.add(f"with {_LADDER}, cand as (select distinct s as bound from lad), g as (select bound, b, buc.p as venue, lo.p - hi.p as ladder from cand, buc join lad lo on abs(lo.s - (bound + b / 100.0 - 0.25)) < 1e-6 join lad hi on abs(hi.s - (bound + b / 100.0)) < 1e-6) select bound, count(*) as rungs, round(sum(abs(venue - ladder)), 7) as gap from g group by 1")
def ladder_against_venue(spark: SparkSession, d: str) -> DataFrame:
    """Distance between the steps of one venue's ladder and another's buckets, for each bound that may hold now."""
    at = F.struct("ts", "snapshot_id")
    q = quotes(spark, d).where("market_id is not null").groupBy("market_id").agg(F.max_by(F.coalesce((F.col("bid") + F.col("ask")) / 2, "last"), at).alias("mid")).where("mid is not null")
    j = q.join(broadcast_if_small(markets(spark, d).select("market_id", "kind", "strike_pct", "bucket_bps")), "market_id")
    micro = lambda c: F.round(c * 1e6).cast("long")
    lad = j.where("kind = 'threshold' and strike_pct is not null and not isnan(strike_pct)").groupBy(micro(F.col("strike_pct")).alias("s")).agg(F.avg("mid").alias("p"))
    buc = j.where("kind = 'bucket' and bucket_bps is not null").groupBy("bucket_bps").agg(F.avg("mid").alias("venue"))
    steps = lad.select((F.col("s") + 250_000).alias("top"), F.col("p").alias("lo")).join(lad.select(F.col("s").alias("top"), F.col("p").alias("hi")), "top").withColumn("ladder", F.col("lo") - F.col("hi"))
    # every step fits every bucket under one bound: rungs times buckets, both as many as a venue lists
    g = steps.crossJoin(broadcast_if_small(buc)).withColumn("bound", F.col("top") - F.col("bucket_bps") * 10_000).join(lad.select(F.col("s").alias("bound")), "bound")
    return g.groupBy((F.col("bound") / 1e6).alias("bound")).agg(F.count(F.lit(1)).alias("rungs"), F.round(F.sum(F.abs(F.col("venue") - F.col("ladder"))), 7).alias("gap"))
