"""Ordered computations that stay parallel inside a key: running sums and last known values over blocks of time.

A window partitioned by a key alone puts a hot key's rows into one task. Here rows are windowed within (key, block);
what must be carried over is computed on one row per block and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.session import broadcast_if_small


def running_sum(df: DataFrame, key: str, order: list[str], block: Column, sums: dict[str, Column]) -> DataFrame:
    """df with, for each name of sums, the sum of the column up to and including the row, in order within the key.

    block: a whole number that does not decrease in the order (for example the day). Sums keep the columns' types, so
    decimals are exact. Null amounts count 0; ties in the order must be broken by it.
    """
    rows = df.withColumn("_b", block).select("*", *[F.coalesce(c, F.lit(0)).alias(f"_x_{n}") for n, c in sums.items()])
    totals = rows.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_tb")).agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    by = Window.partitionBy("_k").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_k", "_tb", *[F.coalesce(F.sum(f"_t_{n}").over(by), F.lit(0)).alias(f"_o_{n}") for n in sums])
    w = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("*", *[F.sum(f"_x_{n}").over(w).alias(f"_r_{n}") for n in sums])
    out = inside.join(broadcast_if_small(before), inside[key].eqNullSafe(before["_k"]) & (inside["_b"] == before["_tb"]))
    return out.select(*[inside[c] for c in df.columns], *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def last_known(df: DataFrame, key: str, order: list[str], block: Column, values: dict[str, Column], strict: bool = False) -> DataFrame:
    """df with, for each name of values, the last non-null value of the column at or before the row (before it: strict)."""
    rows = df.withColumn("_b", block).select("*", *[c.alias(f"_x_{n}") for n, c in values.items()])
    place = F.struct(*order)
    ends = rows.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_tb")).agg(*[F.max_by(f"_x_{n}", F.when(F.col(f"_x_{n}").isNotNull(), place)).alias(f"_t_{n}") for n in values])
    by = Window.partitionBy("_k").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("_k", "_tb", *[F.last(f"_t_{n}", ignorenulls=True).over(by).alias(f"_o_{n}") for n in values])
    w = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    inside = rows.select("*", *[F.last(f"_x_{n}", ignorenulls=True).over(w).alias(f"_r_{n}") for n in values])
    out = inside.join(broadcast_if_small(before), inside[key].eqNullSafe(before["_k"]) & (inside["_b"] == before["_tb"]))
    return out.select(*[inside[c] for c in df.columns], *[F.coalesce(f"_r_{n}", f"_o_{n}").alias(n) for n in values])


def asof(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, as_name: str, block_s: int = 86400, inclusive: bool = True) -> DataFrame:
    """left with the value of the right row of its key last before its time (at or before it: inclusive).

    Of right rows of equal time the larger value holds. Left rows without one keep null. Both sides are unioned and the
    last known value is carried through blocks of block_s seconds, so no key is held in one task.
    """
    cols = left.columns
    side = 1 if inclusive else 0
    right_once = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(ts).alias("_ts")).agg(F.max(value).alias("_v"))
    a = left.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.lit(side).alias("_side"), F.lit(None).cast(dict(right_once.dtypes)["_v"]).alias("_v"), F.struct(*cols).alias("_row"))
    b = right_once.select("_key", "_ts", F.lit(1 - side).alias("_side"), "_v", F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    both = a.unionByName(b)
    block = F.coalesce(F.floor(F.unix_seconds(F.col("_ts").cast("timestamp")) / block_s), F.lit(-(2**40)))
    out = last_known(both, "_key", ["_ts", "_side"], block, {as_name: F.col("_v")})
    return out.where("_row is not null").select(*[F.col(f"_row.{c}").alias(c) for c in cols], F.when(F.col("_key").isNotNull() & F.col("_ts").isNotNull(), F.col(as_name)).alias(as_name))
