"""Queries that score the stored probability forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.functions.num import expit, log_loss, logit
from tideglass.operators import scoring as S
from tideglass.plans.registry import Registry
from tideglass.sources.adapters import FORECASTS_SQL, forecasts

R = Registry()
_F = f"with f as ({FORECASTS_SQL}), l as (select *, least(greatest(p, 1e-6), 1 - 1e-6) as q from f), s as (select *, -(y * ln(q) + (1 - y) * ln(1 - q)) as ll, pow(p - y, 2) as br from l)"


@R.add(f"{_F}, m as (select model_id, count(*) as n, avg(ll) as log_loss, avg(br) as brier from s group by 1) select model_id, n, round(log_loss, 8) as log_loss, round(brier, 8) as brier, round(1 - brier / max(case when model_id = 'naive_2x' then brier end) over (), 8) as skill from m")
def forecast_scores(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d)
    y = F.col("y").cast("double")
    m = f.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.avg(log_loss(F.col("p"), y)).alias("ll"), F.avg(F.pow(F.col("p") - y, 2)).alias("br"))
    base = F.max(F.when(F.col("model_id") == "naive_2x", F.col("br"))).over(Window.partitionBy(F.lit(0)))
    return m.select("model_id", "n", F.round("ll", 8).alias("log_loss"), F.round("br", 8).alias("brier"), F.round(1 - F.col("br") / base, 8).alias("skill"))


_BIN = "(case " + " ".join(f"when p >= {e!r} then {k}" for k, e in reversed(list(enumerate([0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9], 1)))) + " else 0 end)"


@R.add(f"{_F} select model_id, {_BIN}::int as bin, round(avg(p), 9) as mean_forecast, round(avg(y), 9) as frequency, count(*) as n from s group by 1, 2")
def reliability(spark: SparkSession, d: str) -> DataFrame:
    r = S.reliability(forecasts(spark, d), ["model_id"])
    return r.select("model_id", "bin", F.round("mean_forecast", 9).alias("mean_forecast"), F.round("frequency", 9).alias("frequency"), "n")


@R.add(
    f"""{_F}, b as (select model_id, {_BIN} as bin, avg(p) as mf, avg(y) as fr, count(*) as n from s group by 1, 2), t as (select *, sum(fr * n) over (partition by model_id) / sum(n) over (partition by model_id) as base from b)
    select model_id, round(sum(n * pow(mf - fr, 2)) / sum(n), 9) as reliability, round(sum(n * pow(fr - base, 2)) / sum(n), 9) as resolution, round(max(base * (1 - base)), 9) as uncertainty, sum(n)::bigint as n from t group by 1"""
)
def brier_parts(spark: SparkSession, d: str) -> DataFrame:
    b = S.brier_parts(forecasts(spark, d), ["model_id"])
    return b.select("model_id", *[F.round(c, 9).alias(c) for c in ("reliability", "resolution", "uncertainty")], "n")


@R.add()
def calibration(spark: SparkSession, d: str) -> DataFrame:
    """Intercept and slope of the outcome's log odds on the forecast's."""
    c = S.calibration(forecasts(spark, d), ["model_id"])
    return c.select("model_id", F.round("intercept", 6).alias("intercept"), F.round("slope", 6).alias("slope"))


@R.add(f"{_F} select model_id, week, round(sum(ll - 0.6931471805599453), 8) as s, count(*) as n from s group by 1, 2")
def loss_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Loss against a coin's, summed by week: what the cluster bootstrap draws from."""
    f = forecasts(spark, d)
    c = S.cluster_sums(f, log_loss(F.col("p"), F.col("y").cast("double")), F.lit(0.6931471805599453), "week", ["model_id"])
    return c.withColumn("s", F.round("s", 8))


@R.add(f"{_F}, dl as (select model_id, week, -(y * ln(q) + (1 - y) * ln(1 - q)) - 0.6931471805599453 as x from s where week is not null) select model_id, round(sum(x) / count(*), 8) as diff, count(distinct week) as clusters, count(*) as n from dl group by 1")
def loss_points(spark: SparkSession, d: str) -> DataFrame:
    """Mean loss against a coin's from the sums by week that the bootstrap draws from."""
    f = forecasts(spark, d).where("week is not null")
    c = S.cluster_sums(f, log_loss(F.col("p"), F.col("y").cast("double")), F.lit(0.6931471805599453), "week", ["model_id"])
    total = [n for n in c.columns if n not in ("model_id", "week")]
    return c.groupBy("model_id").agg(F.round(F.sum(total[0]) / F.sum(total[1]), 8).alias("diff"), F.count(F.lit(1)).alias("clusters"), F.sum(total[1]).alias("n"))


@R.add()
def loss_diff(spark: SparkSession, d: str) -> DataFrame:
    """Mean loss against a coin's with a week-clustered interval."""
    f = forecasts(spark, d)
    c = S.cluster_sums(f, log_loss(F.col("p"), F.col("y").cast("double")), F.lit(0.6931471805599453), "week", ["model_id"])
    b = S.cluster_bootstrap(c, ["model_id"])
    return b.select("model_id", *[F.round(x, 8).alias(x) for x in ("diff", "ci_low", "ci_high")], "clusters")


@R.add(f"{_F}, x as (select forecast_id, model_id, 1 / (1 + exp(-(0.3 * ln(q / (1 - q)) + 0.7 * ln(0.55 / 0.45)))) as pooled, 1 / (1 + exp(-(ln(q / (1 - q)) + ln(1.5)))) as updated from s) select forecast_id, round(pooled, 9) as pooled, round(updated, 9) as updated from x")
def pool_logit(spark: SparkSession, d: str) -> DataFrame:
    """Log-odds pool with a fixed opinion, and the odds-form update by a likelihood ratio of 1.5."""
    f = forecasts(spark, d)
    z = logit(F.col("p"))
    other = logit(F.lit(0.55))
    return f.select("forecast_id", F.round(expit(0.3 * z + 0.7 * other), 9).alias("pooled"), F.round(expit(z + F.log(F.lit(1.5))), 9).alias("updated"))


@R.add(f"{_F}, w as (select unnest([0.0, 0.25, 0.5, 0.75, 1.0]::double[]) as w), t as (select w, 1 / (1 + exp(-w * ln(q / (1 - q)))) as p, y from l, w) select w, round(avg(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))), 8) as log_loss from t group by 1")
def pool_weight_grid(spark: SparkSession, d: str) -> DataFrame:
    """Log loss of the forecasts drawn towards a half by every weight of a grid."""
    f = forecasts(spark, d).select(logit(F.col("p")).alias("z"), F.col("y").cast("double").alias("y"))
    f = f.withColumn("w", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])))
    return f.groupBy("w").agg(F.round(F.avg(log_loss(expit(F.col("w") * F.col("z")), F.col("y"))), 8).alias("log_loss"))


@R.add(f"{_F}, g as (select week, model_id, avg(ll) as ll from s group by 1, 2) select year0 as period, model_id, round(avg(ll), 8) as log_loss, count(*) as weeks from (select 0 as year0, * from g union all select week // 52 as year0, * from g) group by 1, 2")
def scores_two_grains(spark: SparkSession, d: str) -> DataFrame:
    """Weekly log loss by year of weeks and over all (period 0 also holds the whole)."""
    f = forecasts(spark, d)
    g = f.groupBy("week", "model_id").agg(F.avg(log_loss(F.col("p"), F.col("y").cast("double"))).alias("ll"))
    both = g.withColumn("period", F.lit(0).cast("long")).unionByName(g.withColumn("period", F.floor(F.col("week") / 52)))
    return both.groupBy("period", "model_id").agg(F.round(F.avg("ll"), 8).alias("log_loss"), F.count(F.lit(1)).alias("weeks"))
