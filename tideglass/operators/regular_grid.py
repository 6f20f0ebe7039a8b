"""Irregular readings onto a regular hourly grid by compact-kernel weighted local regression.

The kernel 1 - u^2 is a polynomial and its support is exactly three grid cells, so every weighted sum that the local
line needs is a combination of power sums of the readings in those cells. Readings are therefore reduced once, by
(series, cell), to those sums, which serve as the index: no reading is copied to its neighbours, and the window over a
series sees one row per occupied cell.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.functions.num import order_key

CELL_S = 3600
FINE_S = 300
#: Half width of the kernel in cells: the cell itself and one on either side.
HALF = 1.5


def _shifted(moments: Column, k: int, d: float, stem: str) -> Column:
    """Sum of (tau + d)^k (times y) from the power sums of tau."""
    return sum((moments[f"{stem}{i}"] * F.lit(comb(k, i) * d ** (k - i)) for i in range(k + 1)), F.lit(0.0))


def _kernel_sums(parts: list[tuple[Column, float]]) -> dict[str, Column]:
    """Kernel sums S0..S2, T0, T1 and the sum of squared weights over cells with their offsets d to the grid time."""
    h2 = HALF**2

    def total(f) -> Column:
        return sum((F.coalesce(f(m, d), F.lit(0.0)) for m, d in parts), F.lit(0.0))

    w = lambda stem, k: total(lambda m, d: _shifted(m, k, d, stem) - _shifted(m, k + 2, d, stem) / h2)
    sq = total(lambda m, d: _shifted(m, 0, d, "t") - 2 * _shifted(m, 2, d, "t") / h2 + _shifted(m, 4, d, "t") / h2**2)
    return {"s0": w("t", 0), "s1": w("t", 1), "s2": w("t", 2), "y0": w("y", 0), "y1": w("y", 1), "ww": sq}


def _effective(m: Column, d: float, stem: str) -> Column:
    """Effective number of readings of one cell at offset d: the square of the summed weights over the sum of squares."""
    h2 = HALF**2
    mass = _shifted(m, 0, d, stem) - _shifted(m, 2, d, stem) / h2
    squares = _shifted(m, 0, d, stem) - 2 * _shifted(m, 2, d, stem) / h2 + _shifted(m, 4, d, stem) / h2**2
    return F.when(squares > 1e-12, mass * mass / squares).otherwise(F.lit(0.0))


def hourly_series(candles: DataFrame, asset: str = "asset", ts: str = "ts", close: str = "close", trades: str = "n_trades", version: str = "ingested_at", tie: str = "candle_id", min_readings: int = 1) -> DataFrame:
    """A dense hourly series per asset: hour_epoch, close (last known), rv, traded, readings, support, fit, missing.

    The hours run from that of the asset's first row to that of its last. A reading is a row with a positive close and
    trades > 0; of rows with the same asset and time the one ingested last holds (ties: highest id). close is the last
    reading's at or before the hour's end, rv the sum of squared log returns of five-minute closes carried forward,
    traded whether any row of the hour (superseded ones included) has a close and trades, support the kernel's
    effective number of readings around the hour, fit the local line at its middle (the weighted mean where a line is
    undetermined). missing is set where the kernel at the middle of the hour draws an effective support of fewer than
    min_readings (less a half) traded times from the hour's own cell: weights there lie between 8/9 and 1, so the
    effective number is within half a per cent of the number, and of one traded time it is one.

    Nulls: rows of null asset or time are left out; null or NaN closes and null trades are no readings. close and fit
    are null until something is known, rv is 0 where nothing moved. An empty table gives no rows. Repeats count once.
    """
    p = F.col(close).cast("double")
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = candles.where(F.col(asset).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(asset).cast("string").alias("a"),
        us.alias("us"),
        F.floor(us / (CELL_S * 1_000_000)).alias("hour"),
        F.when((p > 0) & ~F.isnan(p) & (F.col(trades) > 0), p).alias("y"),
        (p.isNotNull() & ~F.isnan(p) & (F.col(trades) > 0)).alias("live"),
        F.unix_micros(F.col(version).cast("timestamp")).alias("v"),
        F.col(tie).alias("id"),
    )
    # one shuffle by (asset, hour); the three reductions below all keep that partitioning
    rows = rows.repartition("a", "hour")
    held = F.max_by("y", order_key(F.col("v"), F.coalesce(F.col("id").cast("long"), F.lit(-(2**62)))))
    once = rows.groupBy("a", "hour", "us").agg(held.alias("y"), F.bool_or(F.coalesce("live", F.lit(False))).alias("live"))
    tau = (F.col("us") - F.col("hour") * (CELL_S * 1_000_000)) / (CELL_S * 1e6)
    have = F.col("y").isNotNull()
    fine = once.withColumn("tau", tau).groupBy("a", "hour", F.floor(F.col("us") / (FINE_S * 1_000_000)).alias("five")).agg(
        F.count("y").alias("n"),
        F.bool_or("live").alias("live"),
        F.max_by("y", F.when(have, F.col("us"))).alias("end"),
        *[F.sum(F.when(have, F.pow("tau", F.lit(k)))).alias(f"t{k}") for k in range(5)],
        *[F.sum(F.when(F.col("live"), F.pow("tau", F.lit(k))).otherwise(F.lit(0.0))).alias(f"l{k}") for k in range(5)],
        *[F.sum(F.when(have, F.pow("tau", F.lit(k)) * F.col("y"))).alias(f"y{k}") for k in range(4)],
    )
    cells = fine.groupBy("a", "hour").agg(
        F.sum("n").alias("n"),
        F.bool_or("live").alias("live"),
        F.array_sort(F.collect_list(F.when(F.col("end").isNotNull(), F.struct("five", F.col("end").alias("y"))))).alias("ends"),
        *[F.sum(f"t{k}").alias(f"t{k}") for k in range(5)],
        *[F.sum(f"l{k}").alias(f"l{k}") for k in range(5)],
        *[F.sum(f"y{k}").alias(f"y{k}") for k in range(4)],
    )
    sums = F.struct(*[f"t{k}" for k in range(5)], *[f"y{k}" for k in range(4)])
    by = Window.partitionBy("a").orderBy("hour")
    known = F.last(F.when(F.col("n") > 0, F.element_at(F.col("ends.y"), -1)), ignorenulls=True)
    cells = cells.withColumn("m", sums).withColumn("traded_at", F.struct(*[f"l{k}" for k in range(5)])).select(
        "a", "hour", "n", "live", "m", "traded_at",
        F.coalesce(F.lead("hour").over(by), F.col("hour") + 1).alias("next"),
        F.lag("hour").over(by).alias("prev"),
        F.lead("m").over(by).alias("m_next"),
        F.lag("m").over(by).alias("m_prev"),
        known.over(by).alias("close"),
        known.over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.col("ends.y").alias("path"),
    )
    path = F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat(F.array("before"), F.col("path")))
    logs = F.transform(path, lambda y: F.log(y))
    pairs = F.zip_with(F.slice(logs, F.lit(1), F.greatest(F.size(logs) - 1, F.lit(0))), F.slice(logs, F.lit(2), F.greatest(F.size(logs) - 1, F.lit(0))), lambda x, y: (y - x) * (y - x))
    cells = cells.withColumn("rv", F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))
    grid = cells.withColumn("g", F.explode(F.sequence("hour", F.col("next") - 1)))
    own = F.col("g") == F.col("hour")
    at = lambda test, col: F.when(test, F.col(col))
    k = _kernel_sums(
        [
            (at(own, "m"), -0.5),
            (F.when(own & (F.col("prev") == F.col("g") - 1), F.col("m_prev")).when(F.col("g") == F.col("hour") + 1, F.col("m")), -1.5),
            (at(F.col("next") == F.col("g") + 1, "m_next"), 0.5),
        ]
    )
    grid = grid.select("*", *[c.alias(n) for n, c in k.items()])
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    line = (F.col("s2") * F.col("y0") - F.col("s1") * F.col("y1")) / det
    n = F.when(own, F.col("n")).otherwise(F.lit(0))
    return grid.select(
        F.col("a").alias(asset),
        (F.col("g") * CELL_S).alias("hour_epoch"),
        "close",
        F.when(own, F.col("rv")).otherwise(F.lit(0.0)).alias("rv"),
        (own & F.col("live")).alias("traded"),
        n.cast("long").alias("readings"),
        F.when(F.col("ww") > 1e-12, F.col("s0") * F.col("s0") / F.col("ww")).otherwise(F.lit(0.0)).alias("support"),
        F.when(det > 1e-9 * F.col("s0") * F.col("s0"), line).when(F.col("s0") > 1e-12, F.col("y0") / F.col("s0")).alias("fit"),
        (F.when(own, _effective(F.col("traded_at"), -0.5, "l")).otherwise(F.lit(0.0)) < min_readings - 0.5).alias("missing"),
    )
