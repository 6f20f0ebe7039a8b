"""Volatility: estimators over bars, causal features and forward extremes over dense hours.

Windows are partitioned by asset over hours or days, whose number is bounded by the calendar, not by the ticks; what is
finer is partitioned by (asset, day).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.operators.trailing import latest_rows

HOURS_PER_YEAR = 24 * 365
MINUTES_PER_YEAR = 60 * HOURS_PER_YEAR
LN2 = math.log(2.0)


def dense_hours(grid: DataFrame) -> DataFrame:
    """Every hour of an asset from its first to its last: superseded rows resolved, closes carried, rv 0 where nothing moved."""
    rows = latest_rows(grid.where("asset is not null and h is not null"), ["asset", "h"], "ingested_at", ["high", "low", "close", "rv", "traded"])
    by = Window.partitionBy("asset").orderBy("h")
    known = rows.select("*", F.coalesce(F.lead("h").over(by), F.col("h") + 1).alias("next"), F.last("close", ignorenulls=True).over(by).alias("held"))
    out = known.withColumn("g", F.explode(F.sequence("h", F.col("next") - 1)))
    own = F.col("g") == F.col("h")
    pick = lambda c: F.when(own, F.col(c))
    live = own & F.coalesce("traded", F.lit(False))
    return out.select("asset", F.col("g").alias("h"), F.when(live, F.col("high")).alias("high"), F.when(live, F.col("low")).alias("low"), F.col("held").alias("close"), F.coalesce(pick("rv"), F.lit(0.0)).alias("rv"), live.alias("traded"))


DENSE_SQL = """
    l as (select asset, h, high, low, close, rv, coalesce(traded, false) as traded from (select *, row_number() over (partition by asset, h order by ingested_at desc, high desc nulls last, low desc nulls last, close desc nulls last, rv desc nulls last, traded desc nulls last) as k from hourly_grid where asset is not null and h is not null) where k = 1),
    sp as (select asset, min(h) as lo, max(h) as hi from l group by 1), gg as (select asset, unnest(range(lo, hi + 1))::int as h from sp),
    dense as (select g.asset, g.h, case when l.traded then l.high end as high, case when l.traded then l.low end as low, last_value(l.close ignore nulls) over (partition by g.asset order by g.h) as close, coalesce(l.rv, 0) as rv, coalesce(l.traded, false) as traded from gg g left join l using (asset, h))
"""


def linear_recursion(df: DataFrame, key: str, index: str, x: Column, a: float, start: Column | float = 0.0, name: str = "y") -> DataFrame:
    """df with y_t = a * y_(t-1) + x_t, y before the first row being ``start``; index counts the rows of a key from 0.

    In closed form over blocks so long that powers of a neither overflow inside one nor matter beyond the one before it.
    """
    size = max(1, int(600 / abs(math.log(a))))
    b, t = F.floor(F.col(index) / size), F.col(index) % size
    w = Window.partitionBy(key, "_b").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_b", b)
    first = F.when(F.col(index) == 0, a * (start if isinstance(start, Column) else F.lit(start))).otherwise(F.lit(0.0))
    own = F.pow(F.lit(a), t) * F.sum((x + first) * F.pow(F.lit(a), -t)).over(w)
    rows = rows.withColumn("_own", own)
    if size >= 2**31:
        return rows.withColumnRenamed("_own", name).drop("_b")
    ends = rows.groupBy(F.col(key).alias("_k"), (F.col("_b") + 1).alias("_nb")).agg(F.max_by("_own", index).alias("_carry"))
    out = rows.join(ends, (rows[key] == ends["_k"]) & (rows["_b"] == ends["_nb"]), "left")
    return out.select(*df.columns, (F.col("_own") + F.coalesce("_carry", F.lit(0.0)) * F.pow(F.lit(a), t + 1)).alias(name))


def features(grid: DataFrame, window_h: int = 720, half_life_d: float = 5.0, memory_d: float = 10.0) -> DataFrame:
    """Features of every dense hour from hours before it only: trailing volatility, variances, EWMA and belief states.

    window_h: the long window; sums are null until their window is full. The belief is an inverse-gamma state with
    discounting, seeded with an annual volatility of 0.6 at strength 2.
    """
    d = dense_hours(grid)
    by = Window.partitionBy("asset").orderBy("h")
    d = d.withColumn("i", F.row_number().over(by) - 1).withColumn("r", F.coalesce(F.log("close") - F.lag(F.log("close")).over(by), F.lit(0.0)))
    d = d.withColumn("r2", F.col("r") * F.col("r"))
    lam, delta = 0.5 ** (1.0 / (half_life_d * 24)), 1 - 1 / (memory_d * 24)
    seed_alpha = 2.0 + 1.0
    seed_beta = (seed_alpha - 1) * 0.6**2 / HOURS_PER_YEAR
    d = linear_recursion(d, "asset", "i", (1 - lam) * F.col("r2"), lam, name="ew")
    d = linear_recursion(d, "asset", "i", F.lit(0.5), delta, start=seed_alpha, name="al")
    d = linear_recursion(d, "asset", "i", F.col("r2") / 2, delta, start=seed_beta, name="be")

    def before(c: str, n: int) -> Column:
        return F.when(F.col("i") >= n, F.sum(c).over(by.rowsBetween(-n, -1)))

    w = window_h
    s1, s2 = before("r", w), before("r2", w)
    return d.withColumn("live", F.col("traded").cast("double")).select(
        "asset", "h", "close", "high", "low", "rv", "r",
        F.when(s1.isNotNull(), F.sqrt(F.greatest((s2 - s1 * s1 / w) / (w - 1), F.lit(0.0)) * HOURS_PER_YEAR)).alias("vol"),
        before("rv", 24).alias("rv1"), (before("rv", 168) / 7).alias("rv7"), (before("rv", w) / (w / 24)).alias("rvl"),
        F.sqrt(F.lag("ew").over(by) * HOURS_PER_YEAR).alias("ewma_vol"), F.lag("al").over(by).alias("alpha"), F.lag("be").over(by).alias("beta"),
        (before("live", w) / w).alias("coverage"), F.lag("close").over(by).alias("s0"),
    )


def forward_extremes(d: DataFrame, hours: list[int]) -> DataFrame:
    """Highest high and lowest low of the hours [h, h + n), null where that runs past the end."""
    by = Window.partitionBy("asset").orderBy("h")
    left = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("h")))
    out = d.withColumn("_left", left)
    for n in hours:
        w = by.rowsBetween(0, n - 1)
        out = out.withColumn(f"hi{n}", F.when(F.col("_left") >= n, F.max("high").over(w))).withColumn(f"lo{n}", F.when(F.col("_left") >= n, F.min("low").over(w)))
    return out.drop("_left")


def close_to_close(r: Column, ppy: float) -> Column:
    return F.stddev_samp(r) * math.sqrt(ppy)


def parkinson(ppy: float) -> Column:
    return F.sqrt(F.avg(F.pow(F.log(F.try_divide("high", "low")), 2)) / (4 * LN2) * ppy)


def garman_klass(ppy: float) -> Column:
    return F.sqrt(F.greatest(F.avg(0.5 * F.pow(F.log(F.try_divide("high", "low")), 2) - (2 * LN2 - 1) * F.pow(F.log(F.try_divide("close", "open")), 2)), F.lit(0.0)) * ppy)


def rogers_satchell(ppy: float) -> Column:
    h, low, c, o = (F.col(x) for x in ("high", "low", "close", "open"))
    return F.sqrt(F.greatest(F.avg(F.log(F.try_divide(h, c)) * F.log(F.try_divide(h, o)) + F.log(F.try_divide(low, c)) * F.log(F.try_divide(low, o))), F.lit(0.0)) * ppy)


def realised(bars: DataFrame) -> DataFrame:
    """Per asset and day: realised variance, bipower variation and the share of jumps."""
    by = Window.partitionBy("asset", "day").orderBy("ts")
    r = bars.withColumn("day", F.floor(F.unix_seconds("ts") / 86400)).withColumn("r", F.log("close") - F.lag(F.log("close")).over(by))
    r = r.withColumn("rr", F.abs("r") * F.abs(F.lag("r").over(by)))
    s = r.groupBy("asset", "day").agg(F.sum(F.col("r") * F.col("r")).alias("rv"), (F.sum("rr") * math.pi / 2).alias("bv"))
    return s.where("rv is not null").withColumn("jump", F.when(F.col("rv") > 0, F.greatest((F.col("rv") - F.coalesce("bv", F.lit(0.0))) / F.col("rv"), F.lit(0.0))).otherwise(F.lit(0.0)))


def signature(bars: DataFrame, multiples: tuple[int, ...] = (1, 2, 5, 10, 30, 60)) -> DataFrame:
    """Annualised realised variance at every m-th bar of a day."""
    by = Window.partitionBy("asset", "day").orderBy("ts")
    rows = bars.withColumn("day", F.floor(F.unix_seconds("ts") / 86400)).withColumn("rn", F.row_number().over(by) - 1)
    each = rows.withColumn("m", F.explode(F.array(*map(F.lit, multiples)))).where(F.col("rn") % F.col("m") == 0)
    w = Window.partitionBy("asset", "day", "m").orderBy("ts")
    each = each.withColumn("r", F.log("close") - F.lag(F.log("close")).over(w))
    return each.groupBy("asset", "m").agg((F.avg(F.col("r") * F.col("r")) * MINUTES_PER_YEAR / F.first("m")).alias("variance"))


def ewma_variance(returns: DataFrame, lam: float = 0.94) -> DataFrame:
    """Weighted mean of squared returns per asset, the latest weighing most."""
    back = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("bar"))) - 1
    w = F.pow(F.lit(lam), back)
    rows = returns.select("asset", w.alias("w"), "r")
    return rows.groupBy("asset").agg((F.sum(F.col("w") * F.col("r") * F.col("r")) / F.sum("w")).alias("variance"))
