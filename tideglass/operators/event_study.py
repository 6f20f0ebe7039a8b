"""Event studies: forward returns without look-ahead, rank correlation with robust errors, multiple testing, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.functions.num import ndtr
from tideglass.operators.ordered import asof


def forward_return(events: DataFrame, bars: DataFrame, key: str, ts: str, price: str, hours: list[int]) -> DataFrame:
    """events with ret<h>: price at or before h hours after the event over the last price strictly before it, less one.

    Null where there is no price before, or the target lies beyond the key's last price.
    """
    last = bars.groupBy(F.col(key).alias("_lk")).agg(F.max(ts).alias("_last"))
    out = asof(events, bars, key, ts, price, "_before", inclusive=False)
    for h in hours:
        moved = out.withColumn("_event", F.col(ts)).withColumn(ts, F.col(ts) + F.expr(f"interval {h} hours"))
        moved = asof(moved, bars, key, ts, price, f"_p{h}")
        out = moved.withColumn(f"_t{h}", F.col(ts)).withColumn(ts, F.col("_event")).drop("_event")
    out = out.join(last, out[key] == last["_lk"], "left")
    rets = [F.when((F.col(f"_t{h}") <= F.col("_last")) & (F.col("_before") > 0), F.col(f"_p{h}") / F.col("_before") - 1).alias(f"ret{h}") for h in hours]
    return out.select(*events.columns, *rets)


def average_rank(x: str, keys: list[str]) -> Column:
    """Rank of x within the keys, ties sharing their mean rank."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2


def rank_ic(df: DataFrame, keys: list[str], order: str, score: str, ret: str, lags: int = 3) -> DataFrame:
    """Per group: n, rank correlation, t statistic and p-value of the rank regression with Bartlett-weighted errors."""
    r = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull()).withColumn("_x", average_rank(score, keys)).withColumn("_y", average_rank(ret, keys))
    of = Window.partitionBy(*keys)
    r = r.withColumn("_x", F.col("_x") - F.avg("_x").over(of)).withColumn("_y", F.col("_y") - F.avg("_y").over(of))
    sxx = F.sum(F.col("_x") * F.col("_x")).over(of)
    b = F.sum(F.col("_x") * F.col("_y")).over(of) / sxx
    r = r.withColumn("_sxx", sxx).withColumn("_b", F.when(F.col("_sxx") > 0, b))
    r = r.withColumn("_g", F.col("_x") * (F.col("_y") - F.col("_b") * F.col("_x")))
    by = Window.partitionBy(*keys).orderBy(order)
    s = F.col("_g") * F.col("_g")
    for k in range(1, lags + 1):
        s = s + 2 * (1 - k / (lags + 1)) * F.col("_g") * F.coalesce(F.lag("_g", k).over(by), F.lit(0.0))
    r = r.withColumn("_s", s)
    g = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("ic"), F.max("_b").alias("_b"), F.max("_sxx").alias("_sxx"), F.sum("_s").alias("_s")).where("n >= 3")
    g = g.withColumn("t_stat", F.when(F.col("_s") > 0, F.col("_b") * F.col("_sxx") / F.sqrt("_s")))
    return g.withColumn("_a", -F.abs("t_stat")).withColumn("p_value", 2 * ndtr(F.col("_a"))).select(*keys, "n", "ic", "t_stat", "p_value")


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """df with whether each p-value survives within its keys: all up to the largest rank that passes."""
    of = Window.partitionBy(*keys)
    rank = F.row_number().over(of.orderBy(p))
    r = df.withColumn("_k", rank).withColumn("_n", F.count(F.lit(1)).over(of))
    edge = F.max(F.when(F.col(p) <= F.col("_k") / F.col("_n") * alpha, F.col("_k"))).over(of)
    return r.withColumn("_e", edge).withColumn("kept", F.coalesce(F.col("_k") <= F.col("_e"), F.lit(False))).drop("_k", "_n", "_e")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed and expected agreement and Cohen's kappa of two raters; 1 where the expected agreement is complete."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("a").alias("c"), "n"), F.struct(F.lit(1).alias("s"), F.col("b").alias("c"), "n"))).alias("x")).groupBy("x.c").agg(F.sum(F.when(F.col("x.s") == 0, F.col("x.n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("x.s") == 1, F.col("x.n")).otherwise(0)).alias("nb"))
    total = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    expect = sides.agg(F.sum(F.col("na") * F.col("nb")).alias("e"))
    j = total.crossJoin(F.broadcast(expect))  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return j.select("n", po.alias("observed"), pe.alias("expected"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation, mean absolute difference, bias, n."""
    d = F.col(a) - F.col(b)
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.corr(a, b).alias("r"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), F.count(F.lit(1)).alias("n"))


def bets(df: DataFrame, keys: list[str], order: str, score: str, ret: str, bps: float, threshold: float) -> DataFrame:
    """df with position, gross and net return of one bet per event at a flat round-trip cost, and the compounded equity."""
    pos = F.when(F.col(score) >= threshold, 1.0).when(F.col(score) <= -threshold, -1.0).otherwise(0.0)
    r = df.withColumn("pos", pos).withColumn("gross", F.col("pos") * F.col(ret))
    r = r.withColumn("net", F.col("gross") - F.when(F.col("pos") != 0, 2 * bps / 1e4).otherwise(0.0))
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("equity", F.exp(F.sum(F.log1p("net")).over(by)) - 1)
