"""Queries of volatility and touch contracts, over candles and the hourly grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.functions.num import ndtr_sql
from tideglass.operators import touch as T
from tideglass.operators import vol as V
from tideglass.operators.bars import resample
from tideglass.operators.trailing import volatility_features
from tideglass.plans.registry import Registry
from tideglass.session import table
from tideglass.sources.adapters import CANDLES_SQL, candles

R = Registry()
_C = f"with c as ({CANDLES_SQL})"
PPY = V.MINUTES_PER_YEAR
#: The test tables hold about 80 days: a week of warm-up, folds of four weeks.
CFG = T.TouchConfig(warmup_h=168, horizons_d=(1, 2, 7), z=(0.5, 1.0, 2.0), fold_h=672, least_train=200)


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hourly_grid")


def _rounded(df: DataFrame, n: int = 8) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_RET = "r as (select asset, ts, (epoch_us(ts) // 86400000000)::bigint as day, ln(close) - lag(ln(close)) over (partition by asset, epoch_us(ts) // 86400000000 order by ts) as r from c)"


@R.add(f"{_C}, {_RET} select asset, round(stddev_samp(r) * sqrt({PPY}), 6) as vol from r group by 1")
def vol_close(spark: SparkSession, d: str) -> DataFrame:
    """Close-to-close volatility of returns within the day."""
    c = candles(spark, d).withColumn("day", F.floor(F.unix_seconds("ts") / 86400))
    r = c.withColumn("r", F.log("close") - F.lag(F.log("close")).over(Window.partitionBy("asset", "day").orderBy("ts")))
    return r.groupBy("asset").agg(F.round(V.close_to_close(F.col("r"), PPY), 6).alias("vol"))


_OHLC = " where high > 0 and low > 0 and open > 0 group by 1"


def _ohlc(spark: SparkSession, d: str, f) -> DataFrame:
    return candles(spark, d).where("high > 0 and low > 0 and open > 0").groupBy("asset").agg(F.round(f(PPY), 6).alias("vol"))


@R.add(f"{_C} select asset, round(sqrt(avg(pow(ln(high / low), 2)) / (4 * ln(2)) * {PPY}), 6) as vol from c {_OHLC}")
def vol_parkinson(spark: SparkSession, d: str) -> DataFrame:
    return _ohlc(spark, d, V.parkinson)


@R.add(f"{_C} select asset, round(sqrt(greatest(avg(0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2)), 0) * {PPY}), 6) as vol from c {_OHLC}")
def vol_gk(spark: SparkSession, d: str) -> DataFrame:
    return _ohlc(spark, d, V.garman_klass)


@R.add(f"{_C} select asset, round(sqrt(greatest(avg(ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)), 0) * {PPY}), 6) as vol from c {_OHLC}")
def vol_rs(spark: SparkSession, d: str) -> DataFrame:
    return _ohlc(spark, d, V.rogers_satchell)


@R.add(
    f"""{_C}, {_RET}, x as (select *, abs(r) * abs(lag(r) over (partition by asset, day order by ts)) as rr from r), s as (select asset, day, sum(r * r) as rv, sum(rr) * pi() / 2 as bv from x group by 1, 2)
    select asset, day, round(rv, 9) as rv, round(bv, 9) as bv, round(case when rv > 0 then greatest((rv - coalesce(bv, 0)) / rv, 0) else 0 end, 6) as jump from s where rv is not null"""
)
def rv_bv_jump(spark: SparkSession, d: str) -> DataFrame:
    return V.realised(candles(spark, d)).select("asset", "day", F.round("rv", 9).alias("rv"), F.round("bv", 9).alias("bv"), F.round("jump", 6).alias("jump"))


_HOURLY = f"{_C}, h as (select asset, epoch_us(ts) // 3600000000 as h, arg_max(close, ts) as close from c group by 1, 2), r as (select asset, h, ln(close) - lag(ln(close)) over (partition by asset order by h) as r from h)"


@R.add(f"{_HOURLY}, w as (select asset, r, pow(0.94, row_number() over (partition by asset order by h desc) - 1) as w from r where r is not null) select asset, round(sum(w * r * r) / sum(w), 12) as variance from w group by 1")
def vol_ewma(spark: SparkSession, d: str) -> DataFrame:
    h = resample(candles(spark, d), 3600)
    r = h.select("asset", "bar", (F.log("close") - F.lag(F.log("close")).over(Window.partitionBy("asset").orderBy("bar"))).alias("r")).where("r is not null")
    return V.ewma_variance(r).withColumn("variance", F.round("variance", 12))


@R.add(
    f"""{_C}, n as (select *, epoch_us(ts) // 86400000000 as day, row_number() over (partition by asset, epoch_us(ts) // 86400000000 order by ts) - 1 as rn from c), e as (select asset, day, ts, close, unnest([1, 2, 5, 10, 30, 60]) as m, rn from n),
    r as (select asset, m, ln(close) - lag(ln(close)) over (partition by asset, day, m order by ts) as r from e where rn % m = 0) select asset, m, round(avg(r * r) * {PPY} / m, 6) as variance from r group by 1, 2"""
)
def vol_signature(spark: SparkSession, d: str) -> DataFrame:
    return V.signature(candles(spark, d)).withColumn("variance", F.round("variance", 6))


@R.add(
    f"""with {V.DENSE_SQL}, d as (select asset, h // 24 as day, sum(rv) as rv, count(*) as n from dense group by 1, 2), w as (select asset, day, n,
        ln(greatest(rv, 1e-12)) as x1, ln(greatest(avg(rv) over (partition by asset order by day rows between 4 preceding and current row), 1e-12)) as x5, ln(greatest(avg(rv) over (partition by asset order by day rows between 21 preceding and current row), 1e-12)) as x22,
        case when lead(day, 5) over (partition by asset order by day) is not null then avg(rv) over (partition by asset order by day rows between 1 following and 5 following) end as target, row_number() over (partition by asset order by day) as k from d)
    select asset, day, round(x1, 8) as x1, round(x5, 8) as x5, round(x22, 8) as x22, round(target + 1e-15, 12) as target from w where k >= 22"""
)
def har_features(spark: SparkSession, d: str) -> DataFrame:
    """Log daily variance, its 5 and 22 day means, and the mean of the next five days."""
    daily = V.dense_hours(_grid(spark, d)).groupBy("asset", F.floor(F.col("h") / 24).cast("int").alias("day")).agg(F.sum("rv").alias("rv"))
    by = Window.partitionBy("asset").orderBy("day")
    log = lambda c: F.round(F.log(F.greatest(c, F.lit(1e-12))), 8)
    mean = lambda a, b: F.avg("rv").over(by.rowsBetween(a, b))
    w = daily.select("asset", "day", log(F.col("rv")).alias("x1"), log(mean(-4, 0)).alias("x5"), log(mean(-21, 0)).alias("x22"), F.round(F.when(F.lead("day", 5).over(by).isNotNull(), mean(1, 5)) + 1e-15, 12).alias("target"), F.row_number().over(by).alias("k"))
    return w.where("k >= 22").drop("k")


_W = CFG.warmup_h
_LAM, _DEL = 0.5 ** (1 / 120.0), 1 - 1 / 240.0
_FEAT = f"""{V.DENSE_SQL}, fi as (select *, row_number() over a - 1 as i, coalesce(ln(close) - lag(ln(close)) over a, 0) as r from dense window a as (partition by asset order by h)),
    fe as (select *, pow({_LAM}, i) * sum((1 - {_LAM}) * r * r * pow({_LAM}, -i)) over a as ew, pow({_DEL}, i) * sum((r * r / 2 + case when i = 0 then {_DEL} * 2 * 0.36 / 8760 else 0 end) * pow({_DEL}, -i)) over a as be, pow({_DEL}, i) * sum((0.5 + case when i = 0 then {_DEL} * 3 else 0 end) * pow({_DEL}, -i)) over a as al from fi window a as (partition by asset order by h)),
    feat as (select asset, h, close, high, low, rv, case when i >= {_W} then sqrt(greatest((sum(r * r) over w - pow(sum(r) over w, 2) / {_W}) / ({_W} - 1), 0) * 8760) end as vol,
        case when i >= 24 then sum(rv) over d1 end as rv1, case when i >= 168 then sum(rv) over d7 / 7 end as rv7, case when i >= {_W} then sum(rv) over w / ({_W} / 24) end as rvl,
        sqrt(lag(ew) over a * 8760) as ewma_vol, lag(al) over a as alpha, lag(be) over a as beta, case when i >= {_W} then sum(traded::int) over w / {_W} end as coverage, lag(close) over a as s0, i
        from fe window a as (partition by asset order by h), w as (partition by asset order by h rows between {_W} preceding and 1 preceding), d1 as (partition by asset order by h rows between 24 preceding and 1 preceding), d7 as (partition by asset order by h rows between 168 preceding and 1 preceding))
"""


@R.add(f"with {_FEAT} select asset, h, round(vol, 6) as vol, round(rv1 + 3.7e-14, 9) as rv1, round(rv7 + 3.7e-14, 9) as rv7, round(ewma_vol, 6) as ewma_vol, round(alpha, 6) as alpha, round(beta, 9) as beta, round(coverage, 8) as coverage from feat")
def features_causal(spark: SparkSession, d: str) -> DataFrame:
    f = V.features(_grid(spark, d), CFG.warmup_h)
    r = lambda c, n: F.round(c, n).alias(c)
    return f.select("asset", "h", r("vol", 6), F.round(F.col("rv1") + 3.7e-14, 9).alias("rv1"), F.round(F.col("rv7") + 3.7e-14, 9).alias("rv7"), r("ewma_vol", 6), r("alpha", 6), r("beta", 9), r("coverage", 8))


@R.add(f"with {V.DENSE_SQL}, e as (select asset, h, max(high) over w as hi, min(low) over w as lo, count(*) over w as n from dense window w as (partition by asset order by h rows between current row and 23 following)) select asset, h, case when n = 24 then hi end as hi24, case when n = 24 then lo end as lo24 from e")
def window_extremes(spark: SparkSession, d: str) -> DataFrame:
    return V.forward_extremes(V.dense_hours(_grid(spark, d)), [24]).select("asset", "h", "hi24", "lo24")


@R.add(
    """with g as (select asset, h, arg_max(ts, (ingested_at, ts)) as ts, (list(rv order by ingested_at desc, ts desc, rv desc nulls last))[1] as rv from hourly_grid where asset is not null and ts is not null group by 1, 2),
    d as (select asset, (ts at time zone 'UTC')::date as day, sum(rv) as rv from g group by 1, 2), sp as (select asset, min(day) + 1 as lo, max(day) + 31 as hi from d group by 1), a as (select asset, unnest(generate_series(lo, hi, interval 1 day))::date as day from sp),
    f as (select a.asset, a.day, coalesce(sum(d.rv) filter (where d.day >= a.day - 1), 0) as rv1d, coalesce(sum(d.rv) filter (where d.day >= a.day - 7), 0) / 7 as rv7d, coalesce(sum(d.rv), 0) / 30 as rv30d from a left join d on d.asset = a.asset and d.day < a.day and d.day >= a.day - 30 group by 1, 2),
    n as (select *, lead(rv1d) over (partition by asset order by day) as next from f), l as (unpivot (select asset, next, rv1d, rv7d, rv30d from n where next > 1e-12) on rv1d, rv7d, rv30d into name model value forecast)
    select asset, model, round(avg(next / forecast - ln(next / forecast) - 1), 5) as qlike, count(*) as n from l where forecast > 1e-12 group by 1, 2"""
)
def vol_qlike(spark: SparkSession, d: str) -> DataFrame:
    """Loss of yesterday's, last week's and last month's variance as forecasts of the day's."""
    f = volatility_features(_grid(spark, d))
    by = Window.partitionBy("asset").orderBy("anchor_date")
    f = f.withColumn("next", F.lead("rv1d_var").over(by)).where("next > 1e-12")
    each = f.select("asset", "next", F.expr("stack(3, 'rv1d', rv1d_var, 'rv7d', rv7d_var, 'rv30d', rv30d_var) as (model, forecast)")).where("forecast > 1e-12")
    x = F.col("next") / F.col("forecast")
    return each.groupBy("asset", "model").agg(F.round(F.avg(x - F.log(x) - 1), 5).alias("qlike"), F.count(F.lit(1)).alias("n"))


_KINDS = ", ".join(f"({d}, {z}, {s})" for d in CFG.horizons_d for z in CFG.z for s in (1, -1))
_UNI = f"""{_FEAT}, ex as (select f.*, {', '.join(f"max(high) over w{d} as hi{d}, min(low) over w{d} as lo{d}, count(*) over w{d} as n{d}" for d in CFG.horizons_d)} from feat f window {', '.join(f"w{d} as (partition by asset order by h rows between current row and {24 * d - 1} following)" for d in CFG.horizons_d)}),
    an as (select * from ex where h >= {_W} and (h - {_W}) % {CFG.step_h} = 0 and vol > 0 and coverage >= {CFG.min_coverage} and s0 is not null and n{max(CFG.horizons_d)} = {24 * max(CFG.horizons_d)} and hi{max(CFG.horizons_d)} is not null),
    kd as (select * from (values {_KINDS}) as x(horizon_d, z, direction)),
    uk as (select an.*, kd.*, horizon_d / 365.0 as t, s0 * exp(direction * z * vol * sqrt(horizon_d / 365.0)) as k from an, kd),
    u as (select asset, h as anchor, horizon_d, z::double as z, direction, s0, k, t, vol as sigma_ref, rv1, rv7, rvl, ewma_vol,
        coalesce(case when direction > 0 then (case {' '.join(f'when horizon_d = {d} then hi{d}' for d in CFG.horizons_d)} end) >= k else (case {' '.join(f'when horizon_d = {d} then lo{d}' for d in CFG.horizons_d)} end) <= k end, false)::int as label, h + 24 * horizon_d as resolve, h // {CFG.fold_h} as fold, h // 168 as week from uk)
"""


@R.add(f"with {_UNI} select asset, anchor, horizon_d, z, direction, round(k, 6) as k, label, resolve from u")
def universe_labels(spark: SparkSession, d: str) -> DataFrame:
    u = T.universe(_grid(spark, d), CFG)
    return u.select("asset", "anchor", "horizon_d", "z", "direction", F.round("k", 6).alias("k"), "label", "resolve")


@R.add(f"with {_UNI} select horizon_d, direction, z, round(avg(label), 9) as rate, count(*) as n from u group by 1, 2, 3")
def base_rates(spark: SparkSession, d: str) -> DataFrame:
    return T.base_rates(T.universe(_grid(spark, d), CFG)).withColumn("rate", F.round("rate", 9))


@R.add(
    f"""with {_UNI}, ct as (select distinct fold from u union all select null) select ct.fold, horizon_d, direction, z, round(avg(label), 9) as rate, count(*) as n
    from ct join u on ct.fold is null or u.resolve < ct.fold * {CFG.fold_h} group by 1, 2, 3, 4"""
)
def base_rates_by_fold(spark: SparkSession, d: str) -> DataFrame:
    """Base rates at each fold's own cutoff, and over all contracts (fold null)."""
    return T.base_rates_by_fold(T.universe(_grid(spark, d), CFG), CFG.fold_h).withColumn("rate", F.round("rate", 9))


def _touch_sql(sigma: str) -> str:
    b, nu = "(direction * ln(k / s0))", f"(direction * (-{sigma} * {sigma} / 2))"
    root = f"({sigma} * sqrt(t))"
    d1, d2 = f"(({nu} * t - {b}) / {root})", f"((-{b} - {nu} * t) / {root})"
    tail = f"(case when {d2} > -30 then ln(greatest({ndtr_sql(d2)}, 1e-300)) else -{d2} * {d2} / 2 - ln(-{d2}) - 0.9189385332046727 + ln(1 - 1 / ({d2} * {d2}) + 3 / pow({d2}, 4)) end)"
    return f"(case when {b} <= 0 then 1.0 else least(greatest({ndtr_sql(d1)} + exp(2 * {nu} * {b} / ({sigma} * {sigma}) + {tail}), 0), 1) end)"


_ABOVE = ndtr_sql("((ln(s0 / k) - sigma_ref * sigma_ref / 2 * t) / (sigma_ref * sqrt(t)))")
_FORMS = f"{_UNI}, p as (select *, least(2 * case when direction > 0 then {_ABOVE} else 1 - {_ABOVE} end, 1) as naive_2x, {_touch_sql('sigma_ref')} as gbm_trailing30, {_touch_sql('sqrt(greatest(rv7, 1e-12) * 365)')} as gbm_rv7 from u)"


@R.add(f"with {_FORMS} select asset, anchor, horizon_d, z, direction, round(naive_2x, 7) as naive_2x, round(gbm_trailing30, 7) as gbm_trailing30, round(gbm_rv7, 7) as gbm_rv7 from p")
def touch_prob(spark: SparkSession, d: str) -> DataFrame:
    """Closed-form probabilities of every contract."""
    p = T.closed_forms(T.universe(_grid(spark, d), CFG))
    return p.select("asset", "anchor", "horizon_d", "z", "direction", *[F.round(c, 7).alias(c) for c in ("naive_2x", "gbm_trailing30", "gbm_rv7")])


@R.add(f"with {_UNI}, q as (select *, {_ABOVE} as above from u) select horizon_d, z, direction, round(avg(above), 7) as above, round(avg((ln(s0 / (s0 * 0.9)) / ln(1.1 / 0.9))), 7) as straight, count(*) as n from q group by 1, 2, 3")
def terminal_naive(spark: SparkSession, d: str) -> DataFrame:
    """Mean probability of ending above the barrier, and of leaving a corridor of ten percent upwards without drift."""
    u = T.universe(_grid(spark, d), CFG)
    above = T.terminal_probability(F.col("s0"), F.col("k"), F.col("sigma_ref"), F.col("t"))
    straight = F.log(F.col("s0") / (F.col("s0") * 0.9)) / F.log(F.lit(1.1) / 0.9)
    return u.groupBy("horizon_d", "z", "direction").agg(F.round(F.avg(above), 7).alias("above"), F.round(F.avg(straight), 7).alias("straight"), F.count(F.lit(1)).alias("n"))


_SCORED = f"{_FORMS}, longs as (unpivot (select label, naive_2x, gbm_trailing30, gbm_rv7 from p) on naive_2x, gbm_trailing30, gbm_rv7 into name model value q), cut as (select *, least(greatest(q, 1e-6), 1 - 1e-6) as cl from longs)"


@R.add(
    f"""with {_SCORED}, scores as (select model, count(*) as n, avg(-(label * ln(cl) + (1 - label) * ln(1 - cl))) as log_loss, avg(pow(q - label, 2)) as brier from cut group by 1)
    select model, n, round(log_loss, 6) as log_loss, round(brier, 6) as brier, round(1 - brier / (select brier from scores where model = 'naive_2x'), 5) as skill from scores"""
)
def score_closed_forms(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the models that need no fit, over all contracts."""
    from tideglass.operators.scoring import score_models

    s = score_models(T.closed_forms(T.universe(_grid(spark, d), CFG)), ("naive_2x", "gbm_trailing30", "gbm_rv7"), "label", "naive_2x", [])
    return s.select("model", "n", F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"), F.round("skill", 5).alias("skill"))


@R.add()
def har_fit(spark: SparkSession, d: str) -> DataFrame:
    """Log variance regression per horizon."""
    rows = T.har_rows(_grid(spark, d), CFG).where((F.col("h") - CFG.warmup_h) % 24 == 0)
    return _rounded(T.fit_har(rows, ["horizon_d"]), 6)


@R.add()
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Contracts of all folds priced by seven models from the past alone."""
    return _rounded(T.walk_forward(_grid(spark, d), CFG), 7)


@R.add()
def score_table(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the walk-forward by model: count, log loss, Brier, skill against the naive rule."""
    from tideglass.operators.scoring import score_models

    return _rounded(score_models(T.walk_forward(_grid(spark, d), CFG), T.MODELS, "label", "naive_2x", []), 6)


@R.add()
def score_by_fold(spark: SparkSession, d: str) -> DataFrame:
    from tideglass.operators.scoring import score_models

    return _rounded(score_models(T.walk_forward(_grid(spark, d), CFG), T.MODELS, "label", "naive_2x", ["fold"]), 6)
