"""Pairs of series: hedge ratios, standardised spreads, positions, backtests, barrier labels, cointegration scans.

A pair's rows are hours of a calendar, so a group by pair is bounded by its span whatever the tick volume.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.functions.vectors import ndtr

KEY = "pair"


def adjacent_pairs(assets: DataFrame) -> DataFrame:
    """Pairs of neighbours in name order: as many as there are assets."""
    by = Window.orderBy("asset")  # one row per asset
    return assets.select("asset").distinct().select(F.col("asset").alias("asset_a"), F.lead("asset").over(by).alias("asset_b")).where("asset_b is not null").withColumn(KEY, F.concat_ws("-", "asset_a", "asset_b"))


def pair_rows(hours: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, bar, i, a, b: hours in which both assets have a close, numbered from 0."""
    a = pairs.join(hours.select(F.col("asset").alias("asset_a"), "bar", F.col("close").alias("a")), "asset_a")
    both = a.join(hours.select(F.col("asset").alias("asset_b"), "bar", F.col("close").alias("b")), ["asset_b", "bar"])
    return both.select(KEY, "bar", (F.row_number().over(Window.partitionBy(KEY).orderBy("bar")) - 1).alias("i"), "a", "b")


def ols_hedge(rows: DataFrame) -> DataFrame:
    """rows with the static hedge ratio of their pair and the spread a - h * b (the intercept stays in)."""
    fit = rows.groupBy(KEY).agg(F.regr_slope("a", "b").alias("h"))
    return rows.join(fit, KEY).withColumn("spread", F.col("a") - F.col("h") * F.col("b"))


def kalman_filter(a: np.ndarray, b: np.ndarray, delta: float = 1e-4, noise: float = 1e-3, fit: int | None = None) -> np.ndarray:
    """Filtered (hedge ratio, intercept) of the random-walk regression of a on b, seeded by least squares on the first
    ``fit`` rows (0 or None: all). The seed is the predicted state of the first row."""
    n = len(a)
    m = fit or n
    x = np.column_stack([b[:m], np.ones(m)])
    s = np.linalg.lstsq(x, a[:m], rcond=None)[0] if m else np.zeros(2)
    p, q = np.ones((2, 2)), delta / (1 - delta) * np.eye(2)
    out = np.empty((n, 2))
    for t in range(n):
        if t:
            p = p + q
        h = np.array([b[t], 1.0])
        ph = p @ h
        k = ph / (h @ ph + noise)
        s = s + k * (a[t] - h @ s)
        p = p - np.outer(k, ph)
        out[t] = s
    return out


def kalman_hedge(rows: DataFrame, delta: float = 1e-4, noise: float = 1e-3, fit: int | None = None) -> DataFrame:
    """rows with the filtered hedge ratio, intercept and the spread at the ratio filtered with the row itself."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        s = kalman_filter(pdf["a"].to_numpy(float), pdf["b"].to_numpy(float), delta, noise, fit)
        return pdf.assign(h=s[:, 0], c=s[:, 1], spread=pdf["a"] - s[:, 0] * pdf["b"])

    return rows.groupBy(KEY).applyInPandas(run, ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", h double, c double, spread double")


def zscore(rows: DataFrame, lookback: int, atol: float = 1e-3) -> DataFrame:
    """rows with z of the spread against the ``lookback`` rows before it (ddof 0); null until there are as many, 0 where
    they hardly move compared with everything before the row."""
    by = Window.partitionBy(KEY).orderBy("i")
    w, past = by.rowsBetween(-lookback, -1), by.rowsBetween(Window.unboundedPreceding, -1)
    mu, sd = F.avg("spread").over(w), F.stddev_pop("spread").over(w)
    wide = F.sqrt(F.greatest(F.avg(F.col("spread") * F.col("spread")).over(past) - F.pow(F.avg("spread").over(past), 2), F.lit(0.0)))
    z = F.when(sd > atol * F.greatest(wide, F.lit(1e-12)), (F.col("spread") - mu) / sd).otherwise(F.lit(0.0))
    return rows.withColumn("z", F.when(F.col("i") >= lookback, z))


def positions(rows: DataFrame, entry: float, exit_: float) -> DataFrame:
    """rows with the position of the hysteresis rule: enter against z beyond ``entry`` from flat, leave within ``exit_``.

    Every row within ``exit_`` ends an island; inside one the position is that of its first entry. No state machine.
    """
    if not entry > exit_:
        raise ValueError("entry must be wider than exit")
    by = Window.partitionBy(KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum(F.when(F.abs("z") <= exit_, 1).otherwise(0)).over(by)
    rows = rows.withColumn("_island", island)
    inside = Window.partitionBy(KEY, "_island").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.when(F.abs("z") >= entry, -F.signum("z")), ignorenulls=True).over(inside)
    return rows.withColumn("pos", F.when(F.col("z").isNull(), 0.0).otherwise(F.coalesce(first, F.lit(0.0)))).drop("_island")


def backtest(rows: DataFrame, bps: float) -> DataFrame:
    """rows with the lagged position's gross and net return and the compounded equity.

    The hedge ratio is lagged inside the notional, which is lagged again; costs are charged on changes of the lagged
    position, which starts at 0.
    """
    by = Window.partitionBy(KEY).orderBy("i")
    lag = lambda c, d: F.coalesce(F.lag(c).over(by), d)
    r = rows.withColumn("_h", lag("h", F.col("h"))).withColumn("_p", lag("pos", F.lit(0.0)))
    r = r.withColumn("_n", F.col("a") + F.col("_h") * F.col("b"))
    pnl = (F.col("a") - lag("a", F.col("a"))) - F.col("_h") * (F.col("b") - lag("b", F.col("b")))
    r = r.withColumn("gross", F.coalesce(F.col("_p") * pnl / lag("_n", F.col("_n")), F.lit(0.0)))
    r = r.withColumn("net", F.col("gross") - F.abs(F.col("_p") - lag("_p", F.lit(0.0))) * (bps / 1e4))
    curve = F.exp(F.sum(F.log1p("net")).over(by.rowsBetween(Window.unboundedPreceding, 0))) - 1
    return r.withColumn("equity", curve).drop("_h", "_n").withColumnRenamed("_p", "held")


def performance(rows: DataFrame, ppy: float, keys: list[str]) -> DataFrame:
    """Sharpe ratio and its standard error, additive drawdown, hit rate, total return, n. equity is per order of i."""
    by = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("_dd", F.col("equity") - F.max("equity").over(by))
    m, s, n = F.avg("net"), F.stddev_pop("net"), F.count(F.lit(1))
    sr = F.when(s > 1e-15, m / s).otherwise(0.0)
    return r.groupBy(*keys).agg(
        (sr * math.sqrt(ppy)).alias("sharpe"), F.when((n >= 2) & (s > 1e-15), F.sqrt((1 + sr * sr / 2) / n) * math.sqrt(ppy)).alias("sharpe_se"), F.min("_dd").alias("max_drawdown"),
        F.coalesce(F.avg(F.when(F.col("net") != 0, (F.col("net") > 0).cast("double"))), F.lit(0.0)).alias("hit_rate"), F.max_by("equity", "i").alias("total_return"), n.alias("n"),
    )


def entries(rows: DataFrame) -> DataFrame:
    """pair, entry, direction: changes from flat to a position; the first row is never one."""
    by = Window.partitionBy(KEY).orderBy("i")
    return rows.withColumn("_l", F.lag("pos").over(by)).where((F.col("pos") != 0) & (F.col("_l") == 0)).select(KEY, F.col("i").alias("entry"), F.signum("pos").alias("direction"))


def triple_barrier(rows: DataFrame, exit_: float, stop: float, longest: int) -> DataFrame:
    """Entries with the first barrier they meet: profit taking before stop-loss on the same row, else the time limit.

    Each entry joins only the rows of its own span, through the span's row numbers.
    """
    if stop <= exit_:
        raise ValueError("stop must be wider than exit")
    e = entries(rows)
    last = rows.groupBy(KEY).agg((F.max("i")).alias("last"))
    e = e.join(last, KEY).withColumn("horizon", F.least(F.col("entry") + longest, F.col("last")))
    steps = e.withColumn("i", F.explode(F.when(F.col("horizon") > F.col("entry"), F.sequence(F.col("entry") + 1, F.col("horizon"))).otherwise(F.array(F.col("entry")))))
    j = steps.join(rows.select(KEY, "i", "z"), [KEY, "i"])
    live = F.col("i") > F.col("entry")
    hit = F.when(live & (F.abs("z") <= exit_), "profit_take").when(live & (((F.col("direction") > 0) & (F.col("z") <= -stop)) | ((F.col("direction") < 0) & (F.col("z") >= stop))), "stop_loss")
    first = F.min(F.when(hit.isNotNull(), F.struct("i", hit.alias("what")))).alias("x")
    out = j.groupBy(KEY, "entry", "direction", "horizon").agg(first)
    out = out.select(KEY, "entry", "direction", F.coalesce("x.i", "horizon").alias("exit"), F.coalesce("x.what", F.lit("timeout")).alias("outcome"))
    return out.withColumn("label", (F.col("outcome") == "profit_take").cast("int")).withColumn("held", F.col("exit") - F.col("entry"))


def event_positions(rows: DataFrame, events: DataFrame) -> DataFrame:
    """pair, i, pos: each event held from entry to exit, both included; where events overlap the later one holds."""
    spans = events.select(KEY, "entry", "direction", F.explode(F.sequence("entry", "exit")).alias("i")).groupBy(KEY, "i").agg(F.max_by("direction", "entry").alias("p"))
    return rows.select(KEY, "i").join(spans, [KEY, "i"], "left").select(KEY, "i", F.coalesce("p", F.lit(0.0)).alias("pos"))


def entry_features(rows: DataFrame, window: int = 20) -> DataFrame:
    """Per entry: |z|, trailing spread of spread and hedge ratio before it, rows since the entry before."""
    by = Window.partitionBy(KEY).orderBy("i")
    w = by.rowsBetween(-window, -1)
    r = rows.withColumn("_sv", F.coalesce(F.stddev_pop("spread").over(w), F.lit(0.0))).withColumn("_hv", F.coalesce(F.stddev_pop("h").over(w), F.lit(0.0)))
    e = entries(rows)
    j = e.join(r.select(KEY, F.col("i").alias("entry"), F.abs("z").alias("abs_z"), "_sv", "_hv"), [KEY, "entry"])
    since = F.coalesce(F.col("entry") - F.lag("entry").over(Window.partitionBy(KEY).orderBy("entry")), F.lit(window))
    return j.select(KEY, "entry", "direction", "abs_z", F.col("_sv").alias("spread_vol"), F.col("_hv").alias("hedge_vol"), since.alias("since"))


def split_rows(rows: DataFrame, fraction: float) -> DataFrame:
    """rows with whether they lie in the later, out-of-sample part; the cut is rounded half to even."""
    n = rows.groupBy(KEY).agg(F.bround(F.count(F.lit(1)) * (1 - fraction)).cast("long").alias("cut"))
    return rows.join(n, KEY).withColumn("oos", F.col("i") >= F.col("cut")).drop("cut")


def conviction(direction: Column, probability: Column, least: float = 0.5) -> Column:
    """Bet size 2p - 1 in the direction, 0 at or below ``least``."""
    return direction * F.when(probability > least, F.least(F.greatest(2 * probability - 1, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


# MacKinnon's response surfaces for p-values of unit-root tests with a constant, one and two series.
_STAR, _MIN, _MAX = (-1.61, -2.62), (-18.83, -18.86), (2.74, 0.92)
_SMALL = ((2.1659, 1.4412, 0.038269), (2.92, 1.5012, 0.039796))
_LARGE = ((1.7339, 0.93202, -0.12745, -0.010368), (2.1945, 0.64695, -0.29198, -0.042377))


def mackinnon_p(stat: float, series: int = 1) -> float:
    k = series - 1
    if stat > _MAX[k]:
        return 1.0
    if stat < _MIN[k]:
        return 0.0
    c = _SMALL[k] if stat <= _STAR[k] else _LARGE[k]
    return float(ndtr(np.array(np.polyval(c[::-1], stat))))


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    c, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ c
    return c, e, float(e @ e)


def adf(y: np.ndarray, constant: bool = True) -> float:
    """Augmented Dickey-Fuller statistic; the number of lags by AIC up to 12 (n / 100)^(1/4)."""
    y = np.asarray(y, float)
    n = len(y)
    most = max(0, min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2 - int(constant)))
    dy = np.diff(y)
    full = np.column_stack([y[most:-1], *[dy[most - j : len(dy) - j] for j in range(1, most + 1)], *([np.ones(len(dy) - most)] if constant else [])])
    t = dy[most:]
    last = [full.shape[1] - 1] if constant else []
    best = min(range(most + 1), key=lambda k: (lambda sse, m: m * math.log(max(sse, 1e-300) / m) + 2 * (1 + k + int(constant)))(_ols(full[:, [*range(1 + k), *last]], t)[2], len(t)))
    x = np.column_stack([y[best:-1], *[dy[best - j : len(dy) - j] for j in range(1, best + 1)], *([np.ones(len(dy) - best)] if constant else [])])
    c, e, sse = _ols(x, dy[best:])
    s2 = sse / max(len(e) - x.shape[1], 1)
    return float(c[0] / math.sqrt(max(s2 * np.linalg.pinv(x.T @ x)[0, 0], 1e-300)))


def engle_granger(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Statistic and p-value of the two-step cointegration test with a constant."""
    x = np.column_stack([b, np.ones(len(b))])
    _, e, sse = _ols(x, np.asarray(a, float))
    if sse < 1e-20 * max(float(np.dot(a, a)), 1e-300):
        return -math.inf, 0.0
    stat = adf(e, constant=False)
    return stat, mackinnon_p(stat, 2)


def sample_windows(n: int, length: int, count: int, seed: int | None) -> list[tuple[int, int]]:
    """Random windows without replacement, in order."""
    if length >= n:
        raise ValueError("the window is not shorter than the series")
    starts = np.random.default_rng(seed).choice(n - length + 1, size=min(count, n - length + 1), replace=False)
    return [(int(s), int(s) + length) for s in sorted(starts)]


SCANNED = [KEY, "start", "stat", "pvalue"]


def scan(rows: DataFrame, length: int, count: int, seed: int = 0) -> DataFrame:
    """pair, start, stat, pvalue: the test over random windows of each pair, drawn with a seed of the pair's own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pd.DataFrame(_scanned(pdf[KEY].iloc[0], pdf["a"].to_numpy(float), pdf["b"].to_numpy(float), length, count, seed), columns=SCANNED)

    return rows.groupBy(KEY).applyInPandas(run, f"{KEY} string, start long, stat double, pvalue double")


def _scanned(name: str, a: np.ndarray, b: np.ndarray, length: int, count: int, seed: int) -> list[tuple]:
    if len(a) <= length:
        return []
    own = seed + sum(map(ord, name))
    return [(name, s, *engle_granger(a[s:e], b[s:e])) for s, e in sample_windows(len(a), length, count, own)]


def scan_all(hours: DataFrame, length: int, count: int, seed: int = 0) -> DataFrame:
    """scan over every pair of assets a < b. An asset's closes travel as one row, so only assets meet, not their hours."""
    series = hours.where("asset is not null and close is not null").groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("bar", "close"))).alias("x"))
    of = lambda s: series.select(F.col("asset").alias(f"asset_{s}"), F.col("x.bar").cast("array<long>").alias(f"bar_{s}"), F.col("x.close").alias(f"close_{s}"))
    parts = 4 * hours.sparkSession.sparkContext.defaultParallelism
    pairs = of("a").repartition(parts, "asset_a").join(of("b"), F.col("asset_a") < F.col("asset_b"))

    def run(it):
        for pdf in it:
            got = []
            for r in pdf.itertuples(index=False):
                _, i, j = np.intersect1d(r.bar_a, r.bar_b, assume_unique=True, return_indices=True)
                got += _scanned(f"{r.asset_a}-{r.asset_b}", np.asarray(r.close_a, float)[i], np.asarray(r.close_b, float)[j], length, count, seed)
            yield pd.DataFrame(got, columns=SCANNED)

    return pairs.mapInPandas(run, f"{KEY} string, start long, stat double, pvalue double")


def scan_summary(found: DataFrame, alpha: float = 0.05) -> DataFrame:
    return found.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.avg("pvalue").alias("mean_p"), F.median("pvalue").alias("median_p"), F.avg((F.col("pvalue") < alpha).cast("double")).alias("significant"), F.avg("stat").alias("mean_stat"))


def newey_west_mean(x: np.ndarray, lags: int = 3) -> tuple[float, float]:
    """Mean and t statistic with Bartlett weights."""
    x = np.asarray(x, float)
    n, e = len(x), x - x.mean()
    s = e @ e
    for k in range(1, lags + 1):
        s += 2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k])
    return float(x.mean()), float(x.mean() / math.sqrt(max(s, 1e-300) / n**2))
