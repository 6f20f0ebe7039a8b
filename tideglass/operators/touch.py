"""Touch contracts: universe and labels, closed forms, forecast mixtures, purged walk-forward, scores."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tideglass.functions import vectors as V
from tideglass.functions.num import clip, log_ndtr, ndtr
from tideglass.operators.vol import features, forward_extremes
from tideglass.session import stored

# Fixed value: the discrete-monitoring shift of Broadie, Glasserman and Kou.
BGK = 0.5826
SMALL = 1e-12


@dataclass(frozen=True)
class TouchConfig:
    """The defaults are a long history's: 30 days of warm-up and horizons up to 30 days."""

    warmup_h: int = 720
    step_h: int = 6
    horizons_d: tuple[int, ...] = (1, 7, 30)
    z: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)
    min_coverage: float = 0.9
    fold_h: int = 8760
    least_train: int = 1000
    nodes: int = 15


def with_touch(df: DataFrame, sigmas: dict[str, Column], monitor_dt: float = 0.0, mu: float = 0.0) -> DataFrame:
    """df (s0, k, t, direction) with, for each name, the probability that the price touches k within t years.

    Direction 1 is a barrier above, -1 below. What the normal integral is taken of is a column of its own first: an
    expression that repeats its argument some twenty times would outgrow a generated method.
    """
    sg = F.col("direction").cast("double")
    cols = df.columns
    out = df.withColumn("_gap", sg * F.log(F.col("k") / F.col("s0")))
    out = out.withColumns({f"_s_{n}": s for n, s in sigmas.items()})
    stage = {}
    for n in sigmas:
        sigma = F.col(f"_s_{n}")
        b = F.col("_gap") + BGK * sigma * math.sqrt(monitor_dt)
        nu = sg * (F.lit(mu) - sigma * sigma / 2)
        root = sigma * F.sqrt(F.greatest("t", F.lit(SMALL)))
        stage |= {f"_a_{n}": (nu * F.col("t") - b) / root, f"_b_{n}": (-b - nu * F.col("t")) / root, f"_e_{n}": 2 * nu * b / (sigma * sigma)}
    out = out.withColumns(stage)
    out = out.withColumns({f"_l_{n}": log_ndtr(F.col(f"_b_{n}")) for n in sigmas})
    hit = {n: ndtr(F.col(f"_a_{n}")) + F.exp(F.col(f"_e_{n}") + F.col(f"_l_{n}")) for n in sigmas}
    out = out.withColumns({f"_h_{n}": h for n, h in hit.items()})
    price = {n: F.when(F.col("_gap") <= 0, 1.0).when(F.col("t") <= 0, 0.0).otherwise(clip(F.col(f"_h_{n}"), 0, 1)) for n in sigmas}
    return out.select(*cols, *[p.alias(n) for n, p in price.items()])


def terminal_probability(s0: Column, k: Column, sigma: Column, t: Column, mu: float = 0.0) -> Column:
    """Probability that the price ends above k."""
    return ndtr((F.log(s0 / k) + (F.lit(mu) - sigma * sigma / 2) * t) / (sigma * F.sqrt(t)))


def first_exit_upper(s0: Column, lower: Column, upper: Column, sigma: Column, mu: float = 0.0) -> Column:
    """Probability of reaching the upper barrier before the lower one."""
    nu = F.lit(mu) - sigma * sigma / 2
    scale = lambda x: 1 - F.exp(-2 * nu * F.log(x) / (sigma * sigma))
    straight = F.log(s0 / lower) / F.log(upper / lower)
    return F.when(F.abs(nu) < SMALL, straight).otherwise((scale(s0) - scale(lower)) / (scale(upper) - scale(lower)))


def universe(grid: DataFrame, cfg: TouchConfig) -> DataFrame:
    """Every contract that would have been listed, with its outcome. Windows are shared by all horizons; the grid of
    horizons, distances and directions is a literal array, so there is no join."""
    hours = [24 * d for d in cfg.horizons_d]
    f = forward_extremes(features(grid, cfg.warmup_h), hours)
    last = f"hi{max(hours)}"
    a = f.where((F.col("h") >= cfg.warmup_h) & ((F.col("h") - cfg.warmup_h) % cfg.step_h == 0) & F.col("vol").isNotNull() & (F.col("coverage") >= cfg.min_coverage) & (F.col("vol") > 0) & F.col("s0").isNotNull())
    a = a.where(F.col(last).isNotNull())
    kinds = F.array(*[F.struct(F.lit(d).alias("horizon_d"), F.lit(z).alias("z"), F.lit(s).alias("direction")) for d in cfg.horizons_d for z in cfg.z for s in (1, -1)])
    a = a.withColumn("c", F.explode(kinds)).select("*", "c.*").drop("c")
    t = F.col("horizon_d") / 365.0
    k = F.col("s0") * F.exp(F.col("direction") * F.col("z") * F.col("vol") * F.sqrt(t))
    pick = lambda stem: F.coalesce(*[F.when(F.col("horizon_d") == d, F.col(f"{stem}{24 * d}")) for d in cfg.horizons_d])
    a = a.withColumn("k", k).withColumn("t", t)
    label = F.when(F.col("direction") > 0, pick("hi") >= F.col("k")).otherwise(pick("lo") <= F.col("k"))
    cols = ["asset", F.col("h").alias("anchor"), "horizon_d", "z", "direction", "s0", "k", "t", F.col("vol").alias("sigma_ref"), "rv1", "rv7", "rvl", "ewma_vol", "alpha", "beta"]
    return a.select(*cols, F.coalesce(label, F.lit(False)).cast("int").alias("label"), (F.col("h") + 24 * F.col("horizon_d")).alias("resolve"), F.floor(F.col("h") / cfg.fold_h).cast("int").alias("fold"), F.floor(F.col("h") / 168).cast("int").alias("week"))


def closed_forms(u: DataFrame) -> DataFrame:
    """The models that need no fit."""
    daily = F.sqrt(F.greatest(F.col("rv7"), F.lit(SMALL)) * 365)
    out = with_touch(u, {"gbm_trailing30": F.col("sigma_ref"), "gbm_rv7": daily, "gbm_ewma": F.greatest("ewma_vol", F.lit(SMALL))})
    d = out.withColumn("_d", (F.log(F.col("s0") / F.col("k")) - F.col("sigma_ref") ** 2 / 2 * F.col("t")) / (F.col("sigma_ref") * F.sqrt("t")))
    d = d.withColumn("_p", ndtr(F.col("_d")))
    return d.withColumn("naive_2x", F.least(2 * F.when(F.col("direction") > 0, F.col("_p")).otherwise(1 - F.col("_p")), F.lit(1.0))).drop("_d", "_p")


def base_rates(u: DataFrame) -> DataFrame:
    """Share of touches by horizon, direction and distance among all contracts."""
    return u.groupBy("horizon_d", "direction", "z").agg(F.avg("label").alias("rate"), F.count(F.lit(1)).alias("n"))


def base_rates_by_fold(u: DataFrame, fold_h: int) -> DataFrame:
    """Share of touches by horizon, direction and distance among what was resolved before each fold began, as the
    walk-forward has it; the rows without a fold are over all contracts. Folds before anything is resolved give no row.

    Contracts are counted once by fold and by the first fold that knows them; every kind is listed in the same folds.
    """
    kind = ["horizon_d", "direction", "z"]
    known = (F.floor(F.col("resolve") / fold_h) + 1).alias("known")
    g = u.groupBy(*kind, "fold", known).agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("c"))
    # folds are a handful of calendar periods
    g = g.groupBy(*kind).agg(F.collect_list(F.struct("known", "hits", "c")).alias("parts"), F.collect_set("fold").alias("folds"))
    g = g.select(*kind, "parts", F.explode(F.array_append("folds", F.lit(None).cast("int"))).alias("fold")).select(*kind, "fold", F.inline("parts"))
    g = g.where(F.col("fold").isNull() | (F.col("known") <= F.col("fold"))).groupBy("fold", *kind)
    return g.agg((F.sum("hits") / F.sum("c")).alias("rate"), F.sum("c").alias("n"))


def har_rows(grid: DataFrame, cfg: TouchConfig) -> DataFrame:
    """Design and target of the log variance regression, one row per (asset, hour, horizon)."""
    from pyspark.sql import Window

    f = features(grid, cfg.warmup_h)
    by = Window.partitionBy("asset").orderBy("h")
    left = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("h")))
    f = f.withColumn("_left", left)
    f = f.withColumns({f"_v{d}": F.when(F.col("_left") >= 24 * d, F.sum("rv").over(by.rowsBetween(0, 24 * d - 1)) / d) for d in cfg.horizons_d})
    targets = F.array(*[F.struct(F.lit(d).alias("horizon_d"), F.col(f"_v{d}").alias("v")) for d in cfg.horizons_d])
    f = f.where("rvl is not null").withColumn("y", F.explode(targets)).where("y.v is not null")
    log = lambda c: F.log(F.greatest(c, F.lit(SMALL)))
    return f.select("asset", "h", "y.horizon_d", *[log(F.col(c)).alias(f"x{i}") for i, c in enumerate(("rv1", "rv7", "rvl"), 1)], log(F.col("y.v")).alias("target"), (F.col("h") + 24 * F.col("y.horizon_d")).alias("resolve"))


def har_sums(rows: DataFrame, keys: list) -> DataFrame:
    """The sums of the normal equations by keys."""
    xs = [F.lit(1.0), F.col("x1"), F.col("x2"), F.col("x3")]
    sums = [F.sum(xs[i] * xs[j]).alias(f"s{i}{j}") for i in range(4) for j in range(i, 4)]
    sums += [F.sum(x * F.col("target")).alias(f"b{i}") for i, x in enumerate(xs)] + [F.sum(F.col("target") ** 2).alias("yy")]
    return rows.groupBy(*keys).agg(*sums)


def solve_har(total: DataFrame, keys: list[str]) -> DataFrame:
    """keys, c0..c3, the residual spread (ddof 0) and the number of rows from the sums of the normal equations."""
    kinds = {f.name: f.dataType.simpleString() for f in total.schema}

    def solve(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                a = np.array([[getattr(r, f"s{min(i, j)}{max(i, j)}") for j in range(4)] for i in range(4)])
                b = np.array([getattr(r, f"b{i}") for i in range(4)])
                c = np.linalg.lstsq(a, b, rcond=None)[0]
                sse = max(r.yy - 2 * c @ b + c @ a @ c, 0.0)
                out.append([*[getattr(r, k) for k in keys], *c, math.sqrt(sse / max(a[0, 0], 1)), int(a[0, 0])])
            yield pd.DataFrame(out, columns=[*keys, "c0", "c1", "c2", "c3", "spread", "n"])

    return total.mapInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", c0 double, c1 double, c2 double, c3 double, spread double, n long")


def fit_har(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Least squares per group of keys by normal equations: the sums are aggregated, 4x4 systems are solved per group."""
    return solve_har(har_sums(rows, keys), keys)


def mixture(nodes: int = 15):
    """Vectorised UDF of (s0, k, t, direction, log median of the daily variance, its spread): the closed form averaged
    over a log-normal variance by Gauss-Hermite nodes."""
    x, w = np.polynomial.hermite_e.hermegauss(nodes)
    w = w / w.sum()

    @F.pandas_udf(DoubleType())
    def mixed(s0: pd.Series, k: pd.Series, t: pd.Series, sign: pd.Series, med: pd.Series, spread: pd.Series) -> pd.Series:
        a = [c.to_numpy(float) for c in (s0, k, t, sign, med, spread)]
        out = np.zeros(len(a[0]))
        for xi, wi in zip(x, w):
            out += wi * V.touch(a[0], a[1], np.sqrt(np.exp(a[4] + a[5] * xi) * 365), a[2], a[3])
        return pd.Series(out)

    return mixed


def walk_forward(grid: DataFrame, cfg: TouchConfig) -> DataFrame:
    """Contracts of every fold but those without enough training, priced from what was resolved before the fold began.

    Every training row is counted once, by the first fold that knows it; a fold's parameters come from the sums of all folds
    up to it, so the work does not grow with folds times history. Contracts are written once, as they are read three times.
    """
    u = stored(universe(grid, cfg), "contracts")
    folds = F.broadcast(u.select("fold").distinct())  # a handful of calendar periods
    design = har_rows(grid, cfg).where((F.col("h") - cfg.warmup_h) % 24 == 0)
    by_known = har_sums(design, ["horizon_d", F.ceil(F.col("resolve") / cfg.fold_h).cast("int").alias("known")])
    upto = by_known.join(folds, F.col("known") <= F.col("fold")).groupBy("fold", "horizon_d").agg(*[F.sum(c).alias(c) for c in by_known.columns if c not in ("horizon_d", "known")])
    fits = solve_har(upto, ["fold", "horizon_d"]).where("n >= 10").select("fold", "horizon_d", "c0", "c1", "c2", "c3", "spread")
    known = F.floor(F.col("resolve") / cfg.fold_h) + 1
    enough = u.groupBy(known.alias("known")).agg(F.count(F.lit(1)).alias("c")).join(folds, F.col("known") <= F.col("fold")).groupBy("fold").agg(F.sum("c").alias("c")).where(F.col("c") >= cfg.least_train).select("fold")
    rates = base_rates_by_fold(u, cfg.fold_h).where("fold is not null").select("fold", "horizon_d", "direction", "z", F.col("rate").alias("base_rate"))
    u = closed_forms(u)
    out = u.join(F.broadcast(enough), "fold").join(F.broadcast(fits), ["fold", "horizon_d"]).join(F.broadcast(rates), ["fold", "horizon_d", "direction", "z"], "left")
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(SMALL)))
    med = F.col("c0") + F.col("c1") * log("rv1") + F.col("c2") * log("rv7") + F.col("c3") * log("rvl")
    out = out.withColumn("log_median", med)
    s0, k, t, sg = F.col("s0"), F.col("k"), F.col("t"), F.col("direction").cast("double")
    out = with_touch(out, {"gbm_har": F.sqrt(F.exp(F.col("log_median") + F.col("spread") ** 2 / 2) * 365)})
    return out.select("asset", "anchor", "horizon_d", "z", "direction", "label", "fold", "week", "naive_2x", "gbm_trailing30", "gbm_rv7", "gbm_ewma", "gbm_har", mixture(cfg.nodes)(s0, k, t, sg, F.col("log_median"), F.col("spread")).alias("har_mix"), "base_rate")


MODELS = ("naive_2x", "gbm_trailing30", "gbm_rv7", "gbm_ewma", "gbm_har", "har_mix", "base_rate")
