"""Monte Carlo over chunks of paths, and the beliefs that need special functions. Each chunk has a seed of its own."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tideglass.functions import vectors as V


def _chunks(spark: SparkSession, paths: int, chunk: int, run, schema: str) -> DataFrame:
    n = -(-paths // chunk)

    def each(it):
        for pdf in it:
            for k in pdf["id"]:
                yield run(np.random.default_rng([int(k), 20_240_101]), min(chunk, paths - int(k) * chunk))

    return spark.range(0, n, 1, max(1, min(n, 64))).mapInPandas(each, schema)


def gbm_steps(rng, paths: int, steps: int, t: float, sigma: float, mu: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    dt = t / steps
    return (mu - sigma**2 / 2) * dt + sigma * math.sqrt(dt) * rng.standard_normal((paths, steps)), np.full((1, steps), sigma**2 * dt)


def merton_steps(rng, paths: int, steps: int, t: float, sigma: float, rate: float, jump_mean: float, jump_sd: float, mu: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    dt = t / steps
    k = math.exp(jump_mean + jump_sd**2 / 2) - 1
    n = rng.poisson(rate * dt, (paths, steps))
    jumps = n * jump_mean + np.sqrt(n) * jump_sd * rng.standard_normal((paths, steps))
    return (mu - sigma**2 / 2 - rate * k) * dt + sigma * math.sqrt(dt) * rng.standard_normal((paths, steps)) + jumps, np.full((1, steps), sigma**2 * dt)


def history_steps(rng, paths: int, steps: int, history: np.ndarray, lam: float = 0.94, block: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Filtered historical simulation: blocks of standardised past shocks scaled by a variance that follows the path."""
    r = np.asarray(history, float)
    v = np.empty(len(r) + 1)
    v[0] = np.mean(r[:50] ** 2) if len(r) else 0.0
    for i, x in enumerate(r):
        v[i + 1] = lam * v[i] + (1 - lam) * x * x
    shocks = r / np.sqrt(np.maximum(v[:-1], 1e-18))
    shocks = shocks - shocks.mean()
    spread = shocks.std()
    shocks = shocks / spread if spread > 0 else shocks  # of unit variance, so that the recursion keeps its level
    start = rng.integers(0, max(1, len(shocks) - block), (paths, -(-steps // block)))
    pick = (start[:, :, None] + np.arange(block)).reshape(paths, -1)[:, :steps]
    z = shocks[np.minimum(pick, len(shocks) - 1)]
    dx, var = np.empty((paths, steps)), np.empty((paths, steps))
    now = np.full(paths, v[-1])
    for k in range(steps):
        var[:, k] = now
        dx[:, k] = np.sqrt(now) * z[:, k]
        now = lam * now + (1 - lam) * dx[:, k] ** 2
    return dx, var


def bridge_touch(dx: np.ndarray, var: np.ndarray, barrier: float) -> np.ndarray:
    """Probability of each path of having touched a log barrier above 0, with the chance between its steps."""
    x = np.cumsum(dx, axis=1)
    before = np.concatenate([np.zeros((len(x), 1)), x[:, :-1]], axis=1)
    gap = np.maximum(barrier - before, 0) * np.maximum(barrier - x, 0)
    return 1 - np.prod(1 - np.exp(-2 * gap / np.maximum(var, 1e-300)), axis=1)


def touch_by_paths(spark: SparkSession, paths: int, steps: int, t: float, sigma: float, barrier: float, chunk: int = 20_000, kind: str = "gbm", **more) -> DataFrame:
    """n, probability, se, ended: bridge-corrected touch probability from partial sums, and the share that ends beyond."""
    make = {"gbm": gbm_steps, "merton": merton_steps}[kind]

    def run(rng, n: int) -> pd.DataFrame:
        dx, var = make(rng, n, steps, t, sigma, **more)
        sign = 1.0 if barrier >= 0 else -1.0
        p = bridge_touch(sign * dx, var, abs(barrier))
        return pd.DataFrame({"n": [n], "s": [p.sum()], "ss": [(p * p).sum()], "e": [float((sign * dx.sum(axis=1) >= abs(barrier)).sum())]})

    g = _chunks(spark, paths, chunk, run, "n long, s double, ss double, e double").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss", "e")])
    mean = F.col("s") / F.col("n")
    return g.select("n", mean.alias("probability"), F.sqrt(F.greatest((F.col("ss") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0)) / F.col("n")).alias("se"), (F.col("e") / F.col("n")).alias("ended"))


def touch_by_paths_each(sigmas: DataFrame, key: str, sigma: str, paths: int, steps: int, t: float, barrier: float, chunk: int = 20_000, kind: str = "gbm", **more) -> DataFrame:
    """key, sigma, n, probability, se, ended: touch_by_paths at the volatility of each row; a chunk has the same seed for every key."""
    make = {"gbm": gbm_steps, "merton": merton_steps}[kind]
    rows = sigmas.select(F.col(key).cast("string").alias("k"), F.col(sigma).cast("double").alias("sigma")).where("sigma > 0")
    chunks = [F.lit(i) for i in range(-(-paths // chunk))]
    rows = rows.withColumn("chunk", F.explode(F.array(*chunks))).repartition(4 * sigmas.sparkSession.sparkContext.defaultParallelism, "k", "chunk")
    sign = 1.0 if barrier >= 0 else -1.0

    def run(it):
        for pdf in it:
            got = []
            for r in pdf.itertuples(index=False):
                n = min(chunk, paths - r.chunk * chunk)
                dx, var = make(np.random.default_rng([int(r.chunk), 20_240_101]), n, steps, t, r.sigma, **more)
                p = bridge_touch(sign * dx, var, abs(barrier))
                got.append((r.k, r.sigma, n, p.sum(), (p * p).sum(), float((sign * dx.sum(axis=1) >= abs(barrier)).sum())))
            yield pd.DataFrame(got, columns=["k", "sigma", "n", "s", "ss", "e"])

    g = rows.mapInPandas(run, "k string, sigma double, n long, s double, ss double, e double").groupBy("k", "sigma").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss", "e")])
    mean = F.col("s") / F.col("n")
    se = F.sqrt(F.greatest((F.col("ss") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0)) / F.col("n"))
    return g.select(F.col("k").alias(key), "sigma", "n", mean.alias("probability"), se.alias("se"), (F.col("e") / F.col("n")).alias("ended"))


def first_exit_by_paths(spark: SparkSession, paths: int, steps: int, t: float, sigma: float, lower: float, upper: float, chunk: int = 20_000) -> DataFrame:
    """Shares of paths that leave a log corridor above, below, or not at all."""

    def run(rng, n: int) -> pd.DataFrame:
        x = np.cumsum(gbm_steps(rng, n, steps, t, sigma)[0], axis=1)
        far = steps + 1
        up = np.where((x >= upper).any(axis=1), (x >= upper).argmax(axis=1), far)
        down = np.where((x <= lower).any(axis=1), (x <= lower).argmax(axis=1), far)
        return pd.DataFrame({"n": [n], "u": [float((up < down).sum())], "d": [float((down < up).sum())]})

    g = _chunks(spark, paths, chunk, run, "n long, u double, d double").agg(F.sum("n").alias("n"), F.sum("u").alias("u"), F.sum("d").alias("d"))
    return g.select("n", (F.col("u") / F.col("n")).alias("above"), (F.col("d") / F.col("n")).alias("below"))


def history_touch(returns: DataFrame, key: str, order: str, r: str, steps: int, barriers: tuple[float, ...], paths: int = 2000) -> DataFrame:
    """key, barrier, probability by filtered historical simulation; a key's history is one calendar of hours."""
    rows = returns.select(F.col(key).cast("string").alias("k"), F.col(order).alias("o"), F.col(r).alias("r")).where("r is not null")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf.sort_values("o")["r"].to_numpy(float)
        if len(h) < 60:
            return pd.DataFrame({"k": [], "b": [], "p": []})
        dx, var = history_steps(np.random.default_rng(sum(map(ord, pdf["k"].iloc[0]))), paths, steps, h)
        got = [(pdf["k"].iloc[0], b, float(bridge_touch(math.copysign(1, b) * dx, var, abs(b)).mean())) for b in barriers]
        return pd.DataFrame(got, columns=["k", "b", "p"])

    return rows.groupBy("k").applyInPandas(run, "k string, b double, p double").withColumnsRenamed({"k": key, "b": "barrier", "p": "probability"})


def jump_split(returns: DataFrame, key: str, r: str, dt_years: float, threshold: float = 4.5) -> DataFrame:
    """Jump-diffusion parameters per key by a robust threshold (exact medians): diffusion, jump rate, mean and spread; none under three jumps."""
    rows = returns.where(F.col(r).isNotNull()).select(F.col(key).alias("k"), F.col(r).alias("r"))
    m = rows.groupBy("k").agg(F.percentile("r", 0.5).alias("m"))
    a = rows.join(m, "k").withColumn("d", F.abs(F.col("r") - F.col("m")))
    s = a.groupBy("k").agg((F.percentile("d", 0.5) * 1.4826).alias("s"))
    b = a.join(s, "k").withColumn("j", F.col("d") > threshold * F.col("s"))
    g = b.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("j").cast("long")).alias("jumps"), F.stddev_samp(F.when(~F.col("j"), F.col("r"))).alias("calm"), F.stddev_samp("r").alias("all"), F.avg(F.when(F.col("j"), F.col("r"))).alias("mean"), F.stddev_samp(F.when(F.col("j"), F.col("r"))).alias("sd"))
    some = F.col("jumps") >= 3
    return g.select(F.col("k").alias(key), "n", F.when(some, F.col("jumps")).otherwise(0).alias("jumps"), (F.when(some, F.col("calm")).otherwise(F.col("all")) / math.sqrt(dt_years)).alias("sigma"), F.when(some, F.col("jumps") / (F.col("n") * dt_years)).otherwise(0.0).alias("rate"), F.when(some, F.col("mean")).otherwise(0.0).alias("jump_mean"), F.when(some, F.col("sd")).otherwise(0.0).alias("jump_sd"))


def variance_belief(returns: DataFrame, key: str, r: str, alpha0: float = 3.0, beta0: float = 1e-4, level: float = 0.9) -> DataFrame:
    """Inverse-gamma belief about the variance per key: state, mean and interval of the volatility, from two sums."""
    g = returns.where(F.col(r).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(r) * F.col(r)).alias("s"))
    g = g.select("k", "n", (F.lit(alpha0) + F.col("n") / 2).alias("alpha"), (F.lit(beta0) + F.col("s") / 2).alias("beta"))

    def quantile(q: float):
        @F.pandas_udf(DoubleType())
        def f(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(np.sqrt(V.inverse_gamma_quantile(q, a.to_numpy(float), b.to_numpy(float))))

        return f

    tail = (1 - level) / 2
    mean = F.when(F.col("alpha") > 1, F.col("beta") / (F.col("alpha") - 1))
    return g.select(F.col("k").alias(key), "n", "alpha", "beta", mean.alias("variance"), quantile(tail)("alpha", "beta").alias("low"), quantile(1 - tail)("alpha", "beta").alias("high"))


@F.pandas_udf(DoubleType())
def implied_volatility(price: pd.Series, s0: pd.Series, k: pd.Series, t: pd.Series) -> pd.Series:
    """The volatility at which the touch probability is the price, null where none between 0.01 and 20 gives it."""
    p, a, b, y = (x.to_numpy(float) for x in (price, s0, k, t))
    sign = np.where(b >= a, 1.0, -1.0)
    with np.errstate(all="ignore"):
        root = V.bisect(lambda v: V.touch(a, b, v, y, sign) - p, np.full(len(p), 0.01), np.full(len(p), 20.0))
    return pd.Series(root).where(np.isfinite(root), None)


@F.pandas_udf(DoubleType())
def log_gamma(x: pd.Series) -> pd.Series:
    return pd.Series([math.lgamma(v) if v is not None and v > 0 else None for v in x])


def beta_interval(df: DataFrame, alpha: str, total: str, level: float = 0.9) -> DataFrame:
    """df with low and high of each outcome's marginal Beta distribution."""
    tail = (1 - level) / 2

    def q(p: float):
        @F.pandas_udf(DoubleType())
        def f(a: pd.Series, t: pd.Series) -> pd.Series:
            x = a.to_numpy(float)
            return pd.Series(V.beta_quantile(p, x, np.maximum(t.to_numpy(float) - x, 1e-9)))

        return f

    return df.withColumn("low", q(tail)(alpha, total)).withColumn("high", q(1 - tail)(alpha, total))


def calibration_ranks(spark: SparkSession, trials: int, observations: int = 50, draws: int = 99, alpha0: float = 3.0, beta0: float = 2.0, chunk: int = 250) -> DataFrame:
    """trial-by-trial rank of the true variance among posterior draws: uniform if the updates are right."""

    def run(rng, n: int) -> pd.DataFrame:
        v = beta0 / rng.gamma(alpha0, 1, n)
        r = rng.standard_normal((n, observations)) * np.sqrt(v)[:, None]
        a, b = alpha0 + observations / 2, beta0 + (r * r).sum(axis=1) / 2
        post = b[:, None] / rng.gamma(a, 1, (n, draws))
        return pd.DataFrame({"rank": (post < v[:, None]).sum(axis=1).astype(np.int64)})

    return _chunks(spark, trials, chunk, run, "rank long")
