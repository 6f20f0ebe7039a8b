"""Queries of event studies, simulation and beliefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.functions.num import ndtr_sql
from tideglass.operators import event_study as E
from tideglass.operators import quotes as Q
from tideglass.operators import simulate as M
from tideglass.operators.bars import resample
from tideglass.operators.touch import with_touch
from tideglass.plans.registry import Registry
from tideglass.session import stored, table
from tideglass.sources.adapters import CANDLES_SQL, TICKS_SQL, candles, forecasts, markets, ticks

R = Registry()
_EV = f"with t as ({TICKS_SQL}), e as (select id, 'view' as asset, ts, price as score from t where asset = 'purchase'), b as (select asset, ts, max(price) as price from t where asset = 'view' group by 1, 2), mx as (select max(ts) as last from b)"
_RET = f"""{_EV}, j0 as (select e.*, b.price as before from e asof left join b on e.asset = b.asset and e.ts > b.ts), j1 as (select j0.*, b.price as p1 from (select *, ts + interval 1 hour as t1, ts + interval 6 hour as t6 from j0) j0 asof left join b on j0.asset = b.asset and j0.t1 >= b.ts),
    j6 as (select j1.*, b.price as p6 from j1 asof left join b on j1.asset = b.asset and j1.t6 >= b.ts), r as (select id, ts, score, case when t1 <= last and before > 0 then p1 / before - 1 end as ret1, case when t6 <= last and before > 0 then p6 / before - 1 end as ret6 from j6, mx)
"""


def _returns(spark: SparkSession, d: str) -> DataFrame:
    t = ticks(spark, d)
    e = t.where("asset = 'purchase'").select("id", F.lit("view").alias("asset"), "ts", F.col("price").alias("score"))
    return E.forward_return(e, t.where("asset = 'view'").select("asset", "ts", "price"), "asset", "ts", "price", [1, 6])


@R.add(f"{_RET} select id, round(ret1, 9) as ret1, round(ret6, 9) as ret6 from r")
def forward_return(spark: SparkSession, d: str) -> DataFrame:
    """Returns of one series after each event of another: strictly before, at or before the horizon."""
    return _returns(spark, d).select("id", F.round("ret1", 9).alias("ret1"), F.round("ret6", 9).alias("ret6"))


_IC = f"""{_RET}, k as (select *, (epoch_us(ts) // 604800000000)::bigint as week from r where ret6 is not null), rk as (select *, rank() over (partition by week order by score) + (count(*) over (partition by week, score) - 1) / 2.0 as x0, rank() over (partition by week order by ret6) + (count(*) over (partition by week, ret6) - 1) / 2.0 as y0 from k),
    ce as (select *, x0 - avg(x0) over (partition by week) as x, y0 - avg(y0) over (partition by week) as y from rk), sx as (select *, sum(x * x) over (partition by week) as sxx, sum(x * y) over (partition by week) / sum(x * x) over (partition by week) as b from ce),
    g as (select *, x * (y - b * x) as g from sx), s as (select *, g * g + 1.5 * g * coalesce(lag(g, 1) over w, 0) + g * coalesce(lag(g, 2) over w, 0) + 0.5 * g * coalesce(lag(g, 3) over w, 0) as s from g window w as (partition by week order by ts)),
    ic as (select week, count(*) as n, corr(x, y) as ic, max(b) * max(sxx) / sqrt(sum(s)) as t_stat from s group by 1 having count(*) >= 3 and sum(s) > 0)
"""


def _ic(spark: SparkSession, d: str) -> DataFrame:
    r = _returns(spark, d).withColumn("week", F.floor(F.unix_seconds("ts") / 604800))
    return E.rank_ic(r, ["week"], "ts", "score", "ret6").where("t_stat is not null")


@R.add(f"{_IC} select week, n, round(ic, 8) as ic, round(t_stat, 6) as t_stat, round(2 * {ndtr_sql('(-abs(t_stat))')}, 8) as p_value from ic")
def rank_ic(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c, n: F.round(c, n).alias(c)
    return _ic(spark, d).select("week", "n", r("ic", 8), r("t_stat", 6), r("p_value", 8))


@R.add(f"{_IC}, pv as (select week, round(2 * {ndtr_sql('(-abs(t_stat))')}, 8) as p from ic), kk as (select *, row_number() over (order by p, week) as k, count(*) over () as n from pv) select week, coalesce(k <= max(case when p <= k / n * 0.4 then k end) over (), false) as kept from kk")
def bh(spark: SparkSession, d: str) -> DataFrame:
    p = _ic(spark, d).select("week", F.round("p_value", 8).alias("p"), F.lit(0).alias("all"))
    return E.benjamini_hochberg(p, "p", ["all"], 0.4).select("week", "kept")


@R.add("with a as (select lower(sentiment) as a, case when hawkish_dovish_score > 0.15 then 'hawkish' when hawkish_dovish_score < -0.15 then 'dovish' else 'neutral' end as b from reliability_label where sentiment is not null and hawkish_dovish_score is not null), t as (select count(*) as n, sum((a = b)::int) as same from a), x as (select c, sum(na) as na, sum(nb) as nb from (select a as c, 1 as na, 0 as nb from a union all select b, 0, 1 from a) group by 1), e as (select sum(na * nb) as e from x) select n, round(same / n, 9) as observed, round(e / (n * n), 9) as expected, round((same / n - e / (n * n)) / (1 - e / (n * n)), 9) as kappa from t, e")
def kappa(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the stated sentiment with the sign of the score."""
    l = table(spark, d, "reliability_label")
    s = F.col("hawkish_dovish_score")
    l = l.where("hawkish_dovish_score is not null").select(F.lower("sentiment").alias("a"), F.when(s > 0.15, "hawkish").when(s < -0.15, "dovish").otherwise("neutral").alias("b"))
    k = E.kappa(l, "a", "b")
    return k.select("n", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


@R.add("select round(corr(surprise_magnitude, confidence), 9) as r, round(avg(abs(surprise_magnitude - confidence)), 9) as mae, round(avg(surprise_magnitude - confidence), 9) as bias, count(*) as n from reliability_label where surprise_magnitude is not null and confidence is not null")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    a = E.agreement(table(spark, d, "reliability_label"), "surprise_magnitude", "confidence")
    return a.select(*[F.round(c, 9).alias(c) for c in ("r", "mae", "bias")], "n")


@R.add(
    f"""{_RET}, k as (select *, (epoch_us(ts) // 604800000000)::bigint as week, case when score >= 12 then 1.0 when score <= -12 then -1.0 else 0.0 end as pos from r where ret1 is not null), n as (select *, pos * ret1 - case when pos <> 0 then 0.001 else 0 end as net from k)
    select id, week, pos::double as pos, round(net, 9) + 0.0 as net, round(sum(ln(1 + net)) over (partition by week order by ts, id), 6) + 0.0 as log_equity from n where net > -1"""
)
def event_backtest(spark: SparkSession, d: str) -> DataFrame:
    r = _returns(spark, d).where("ret1 is not null").withColumn("week", F.floor(F.unix_seconds("ts") / 604800))
    r = r.where((F.when(F.col("score") >= 12, F.col("ret1") - 0.001).otherwise(F.lit(0.0))) > -1)
    b = E.bets(r, ["week"], "ts", "score", "ret1", 5.0, 12.0)
    by = Window.partitionBy("week").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return b.select("id", "week", "pos", (F.round("net", 9) + F.lit(0.0)).alias("net"), (F.round(F.sum(F.log1p("net")).over(by), 6) + F.lit(0.0)).alias("log_equity"))


@R.add("select label_id, epoch_us(timezone('America/New_York', strptime(meeting_date || ' 14:00', '%Y-%m-%d %H:%M'))) as us from reliability_label where regexp_full_match(meeting_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_strptime(meeting_date, '%Y-%m-%d') is not null")
def et_to_utc(spark: SparkSession, d: str) -> DataFrame:
    """Plain ISO dates at two in the afternoon, Eastern time, as UTC."""
    l = table(spark, d, "reliability_label").where(F.col("meeting_date").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    at = F.to_utc_timestamp(F.try_to_timestamp(F.concat("meeting_date", F.lit(" 14:00")), F.lit("yyyy-MM-dd HH:mm")), "America/New_York")
    return l.select("label_id", F.unix_micros(at).alias("us")).where("us is not null")


def _hourly_returns(spark: SparkSession, d: str) -> DataFrame:
    h = resample(candles(spark, d), 3600)
    return h.select("asset", "bar", (F.log("close") - F.lag(F.log("close")).over(Window.partitionBy("asset").orderBy("bar"))).alias("r")).where("r is not null")


@R.add()
def history_touch(spark: SparkSession, d: str) -> DataFrame:
    """Touch probabilities within a day by filtered historical simulation."""
    return M.history_touch(_hourly_returns(spark, d), "asset", "bar", "r", 24, (-0.02, 0.02)).withColumn("probability", F.round("probability", 6))


_HOURLY = f"with c as ({CANDLES_SQL}), h as (select asset, epoch_us(ts) // 3600000000 as h, arg_max(close, ts) as close from c group by 1, 2), r as (select * from (select asset, ln(close) - lag(ln(close)) over (partition by asset order by h) as r from h) where r is not null)"


@R.add(
    f"""{_HOURLY}, m as (select asset, quantile_cont(r, 0.5) as m from r group by 1), a as (select r.asset, r, abs(r - m) as d from r join m using (asset)), s as (select asset, quantile_cont(d, 0.5) * 1.4826 as s from a group by 1),
    b as (select a.*, d > 4.5 * s as j from a join s using (asset)), g as (select asset, count(*) as n, count(*) filter (where j) as jumps, stddev_samp(r) filter (where not j) as calm, stddev_samp(r) as every, avg(r) filter (where j) as mean, stddev_samp(r) filter (where j) as sd from b group by 1)
    select asset, n, case when jumps >= 3 then jumps else 0 end as jumps, round(case when jumps >= 3 then calm else every end * sqrt(8760), 6) as sigma, round(case when jumps >= 3 then jumps * 8760.0 / n else 0 end, 6) as rate, round(case when jumps >= 3 then mean else 0 end, 6) as jump_mean, round(case when jumps >= 3 then sd else 0 end, 6) as jump_sd from g"""
)
def jump_split(spark: SparkSession, d: str) -> DataFrame:
    j = M.jump_split(_hourly_returns(spark, d), "asset", "r", 1 / 8760)
    return j.select("asset", "n", "jumps", *[F.round(c, 6).alias(c) for c in ("sigma", "rate", "jump_mean", "jump_sd")])


@R.add(f"{_HOURLY} select asset, count(*) as n, round(3 + count(*) / 2, 6) as alpha, round(1e-4 + sum(r * r) / 2, 9) as beta, round((1e-4 + sum(r * r) / 2) / (2 + count(*) / 2), 9) as variance from r group by 1")
def variance_state(spark: SparkSession, d: str) -> DataFrame:
    """State and mean of the inverse-gamma belief about each asset's variance."""
    b = M.variance_belief(_hourly_returns(spark, d), "asset", "r")
    return b.select("asset", "n", F.round("alpha", 6).alias("alpha"), *[F.round(c, 9).alias(c) for c in ("beta", "variance")])


@R.add()
def variance_belief(spark: SparkSession, d: str) -> DataFrame:
    b = M.variance_belief(_hourly_returns(spark, d), "asset", "r")
    return b.select("asset", "n", "alpha", *[F.round(c, 9).alias(c) for c in ("beta", "variance", "low", "high")])


@R.add()
def touch_by_paths(spark: SparkSession, d: str) -> DataFrame:
    """Bridge-corrected simulation at each asset's volatility of hourly returns beside the closed form (without jumps) for it."""
    t, barrier = 7 / 365, 0.05
    v = stored(_hourly_returns(spark, d).groupBy("asset").agg((F.stddev_samp("r") * F.sqrt(F.lit(8760.0))).alias("sigma")), "volatilities")
    p = M.touch_by_paths_each(v, "asset", "sigma", 40_000, 48, t, barrier)
    j = M.touch_by_paths_each(v, "asset", "sigma", 40_000, 48, t, barrier, kind="merton", rate=20.0, jump_mean=0.0, jump_sd=0.03)
    both = p.withColumn("kind", F.lit("gbm")).unionByName(j.withColumn("kind", F.lit("merton")))
    at = both.withColumns({"s0": F.lit(1.0), "k": F.exp(F.lit(barrier)), "t": F.lit(t), "direction": F.lit(1)})
    return with_touch(at, {"closed_form": F.col("sigma")}).drop("s0", "k", "t", "direction")


@R.add()
def first_exit_by_paths(spark: SparkSession, d: str) -> DataFrame:
    return M.first_exit_by_paths(spark, 20_000, 500, 30 / 365, 0.6, -0.05, 0.08)


@R.add()
def calibration_ranks(spark: SparkSession, d: str) -> DataFrame:
    """How often the true variance has each rank among its posterior draws."""
    return M.calibration_ranks(spark, 2000).groupBy("rank").agg(F.count(F.lit(1)).alias("trials"))


@R.add()
def implied_volatility(spark: SparkSession, d: str) -> DataFrame:
    """Volatility at which each forecast is the chance of touching five percent above within its week."""
    f = forecasts(spark, d).select("forecast_id", "p")
    return f.select("forecast_id", F.round(M.implied_volatility(F.col("p"), F.lit(100.0), F.lit(105.0), F.lit(7 / 365)), 6).alias("volatility"))


@R.add("select forecast_id, round(lgamma(1 + 10 * p), 8) as value from (select distinct forecast_id, p from forecast where y is not null and p is not null)")
def log_gamma(spark: SparkSession, d: str) -> DataFrame:
    return forecasts(spark, d).select("forecast_id", F.round(M.log_gamma(1 + 10 * F.col("p")), 8).alias("value"))


@R.add()
def dirichlet_interval(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the outcome shares by direction of touch contracts."""
    c = markets(spark, d).where("kind = 'touch' and direction is not null").groupBy("event_key", "direction").agg(F.sum(F.when(F.col("resolved_yes"), 1).otherwise(0)).alias("n"))
    b = Q.dirichlet(c, "event_key", "direction", "n", 2.0).withColumn("total", F.sum("alpha").over(Window.partitionBy("event_key")))
    i = M.beta_interval(b, "alpha", "total")
    return i.select("event_key", "direction", "alpha", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
