"""Quotes of contracts: mids, normalisation, ladders, merges of deliveries, beliefs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mid_price(bid: Column, ask: Column, last: Column, widest: float = 0.1) -> Column:
    """The middle if both sides are there and no further apart than ``widest``, else the last price."""
    return F.when(ask - bid <= widest, (bid + ask) / 2).otherwise(last)


def latest(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Of each key the row with the latest time, ties by the larger ``tie``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_r")).select(*keys, "_r.*")


def overround(df: DataFrame, event: str, q: str) -> DataFrame:
    return df.groupBy(event).agg((F.sum(q) - 1).alias("overround"), F.count(q).alias("outcomes"))


def proportional(df: DataFrame, event: str, q: str) -> DataFrame:
    total = F.sum(q).over(Window.partitionBy(event))
    return df.withColumn("share", F.when(total > 0, F.col(q) / total))


def _root(total: Callable[[Column], Column], lo: Column, hi: Column, steps: int = 60) -> Column:
    """Where a falling total comes down to 1, by halving the range between lo and hi."""

    def halve(r: Column, _: Column) -> Column:
        mid = (r["lo"] + r["hi"]) / 2
        return F.when(total(mid) > 1, F.struct(mid.alias("lo"), r["hi"].alias("hi"))).otherwise(F.struct(r["lo"].alias("lo"), mid.alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(lo.alias("lo"), hi.alias("hi")), halve, lambda r: (r["lo"] + r["hi"]) / 2)


def normalise(df: DataFrame, event: str, outcome: str, q: str) -> DataFrame:
    """event, outcome, q, power, shin, insider: probabilities of the outcomes of each event, inside the JVM.

    power: q to the exponent with which the outcomes sum to 1. shin: as if a share of informed money (insider) explained the
    overround. Both are proportional where the sum is at most 1; power also where a q reaches 1 or only one is above 0. Null
    q count 0, others are cut to 0..1; all are null where they sum to 0. An event's outcomes are a venue's list of choices.
    """
    held = F.least(F.greatest(F.coalesce(F.col(q).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    e = df.select(F.col(event).cast("string").alias("e"), F.struct(F.col(outcome).cast("string").alias("o"), F.col(q).alias("q"), held.alias("x")).alias("r")).groupBy("e").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    add = lambda f: F.aggregate("rs", F.lit(0.0), lambda s, r: s + f(r["x"]))
    e = e.withColumn("t", add(lambda x: x))
    positive = F.size(F.filter("rs", lambda r: r["x"] > 0))
    flat = (F.col("t") <= 1) | F.exists("rs", lambda r: r["x"] >= 1) | (positive < 2)
    shin = lambda x, z: (F.sqrt(z * z + 4 * (1 - z) * x * x / F.col("t")) - z) / (2 * (1 - z))
    e = e.withColumn("k", F.when(flat, F.lit(None)).otherwise(_root(lambda k: add(lambda x: F.when(x > 0, F.pow(x, k)).otherwise(F.lit(0.0))), F.lit(1.0), F.lit(200.0))))
    e = e.withColumn("z", F.when(F.col("t") <= 1, F.lit(0.0)).otherwise(_root(lambda z: add(lambda x: shin(x, z)), F.lit(0.0), F.lit(1 - 1e-9))))
    some, x = F.col("t") > 0, F.col("r.x")
    power = F.when(F.col("k").isNull(), x / F.col("t")).when(x > 0, F.pow(x, F.col("k"))).otherwise(F.lit(0.0))
    informed = F.when(F.col("t") <= 1, x / F.col("t")).otherwise(shin(x, F.col("z")))
    out = e.select("e", F.explode("rs").alias("r"), "t", "k", "z")
    return out.select(F.col("e").alias(event), F.col("r.o").alias(outcome), F.col("r.q").alias(q), F.when(some, power).alias("power"), F.when(some, informed).alias("shin"), F.when(some, F.col("z")).alias("insider"))


def isotonic_decreasing(v: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Weighted least-squares fit that does not increase, cut to 0..1: at each place the least, over where a stretch may
    begin at or before it, of the largest mean of the stretches that end at or behind it."""
    v = np.asarray(v, float)
    w = np.ones(len(v)) if w is None else np.asarray(w, float)
    if not len(v):
        return v
    mass, size = np.append(0, np.cumsum(w * v)), np.append(0, np.cumsum(w))
    k = np.arange(len(v))
    ends_behind = k[None, :] >= k[:, None]
    mean = np.where(ends_behind, (mass[None, 1:] - mass[:-1, None]) / np.where(ends_behind, size[None, 1:] - size[:-1, None], 1), -np.inf)
    largest = np.maximum.accumulate(mean[:, ::-1], axis=1)[:, ::-1]
    return np.clip(np.min(np.where(ends_behind, largest, np.inf), axis=0), 0, 1)


def repair_ladders(df: DataFrame, event: str, strike: str, p: str) -> DataFrame:
    """event, strike, p, fitted, violations: probabilities of ending above each strike made to fall with it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["p", "s"]).sort_values("s").reset_index(drop=True)
        v = pdf["p"].to_numpy(float)
        return pdf.assign(fitted=isotonic_decreasing(v) if len(v) else v, violations=int((np.diff(v) > 1e-12).sum()))

    rows = df.select(F.col(event).cast("string").alias("e"), F.col(strike).cast("double").alias("s"), F.col(p).alias("p"))
    return rows.groupBy("e").applyInPandas(run, "e string, s double, p double, fitted double, violations int").withColumnsRenamed({"e": event, "s": strike})


def ladder_buckets(df: DataFrame, event: str, strike: str, p: str) -> DataFrame:
    """Probability of each step between neighbouring strikes, with what is above the highest one."""
    by = Window.partitionBy(event).orderBy(strike)
    return df.withColumn("bucket", F.col(p) - F.coalesce(F.lead(p).over(by), F.lit(0.0))).withColumn("above", F.sum("bucket").over(by.rowsBetween(0, Window.unboundedFollowing)))


def upsert(old: DataFrame, new: DataFrame, key: list[str], replace: list[str], fill: list[str]) -> DataFrame:
    """A keyed merge: columns of ``replace`` take the new row's value, of ``fill`` the new one unless null, others stay."""
    n = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns])
    cond = None
    for k in key:
        c = old[k] == n[f"_n_{k}"]
        cond = c if cond is None else cond & c
    j = old.withColumn("_o", F.lit(True)).join(n, cond, "full")
    both = F.col("_o").isNotNull() & F.col(f"_n_{key[0]}").isNotNull()

    def pick(c: str) -> Column:
        o, x = F.col(c), F.col(f"_n_{c}")
        if c in key:
            return F.coalesce(o, x)
        if c in replace:
            return F.when(both, x).otherwise(F.coalesce(o, x))
        if c in fill:
            return F.coalesce(x, o)
        return F.when(F.col("_o").isNotNull(), o).otherwise(x)

    return j.select(*[pick(c).alias(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and the new rows whose key it does not hold; of new rows of one key the first in all columns' order."""
    rest = [c for c in new.columns if c not in key]
    once = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*")
    return old.unionByName(once.join(old.select(*key), key, "left_anti").select(*old.columns))


def dirichlet(counts: DataFrame, event: str, outcome: str, n: str, strength: float) -> DataFrame:
    """Predictive mean of a Dirichlet belief with a uniform prior of that strength after the counts."""
    by = Window.partitionBy(event)
    alpha = F.lit(strength) / F.count(F.lit(1)).over(by) + F.col(n)
    return counts.withColumn("alpha", alpha).withColumn("mean", F.col("alpha") / F.sum("alpha").over(by))
