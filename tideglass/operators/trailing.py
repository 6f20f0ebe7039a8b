"""Rolling totals over trailing days by event-contribution deltas.

Each daily amount adds to the total on the day after and subtracts once the window has passed; the running sum of the
deltas is the total. Deltas are summed per (entity, day) before the window, so a hot entity's rows are reduced map-side
and the window sees at most one row per day and window length. Sums are exact decimals: what was added is taken away
without a rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.functions.num import order_key

EXACT = "decimal(38,20)"


def latest_rows(df: DataFrame, keys: list[str], version: str, values: list[str]) -> DataFrame:
    """Of each key the row with the latest version (a timestamp, null first); of equal versions one and the same row, by
    the hash of its values, so repeats count once. By hash aggregation, without a sort; keys hardly repeat, so the bare
    rows are shuffled rather than partial results."""
    kept = df.where(F.col(keys[0]).isNotNull()).select(*keys, version, *values).repartition(*keys)
    at = order_key(F.unix_micros(F.col(version).cast("timestamp")), F.xxhash64(*values))
    return kept.withColumn("_at", at).groupBy(*keys).agg(*[F.max_by(v, "_at").alias(v) for v in values])


def trailing_totals(daily: DataFrame, entity: str, day: str, amounts: dict[str, tuple[str, int]], until: int = 0) -> DataFrame:
    """entity, day and one total per entry of amounts, for every day from the first with an effect to the last.

    daily: amounts per entity and day (several rows of a day add up). amounts: name -> (column, days): the sum of the
    column over that many days before the day, the day itself left out. Days without activity are included; the series
    of an entity ends the longest window plus ``until`` days after its last row. Null amounts count 0, rows of a null
    entity or day are left out, an empty table gives no rows.
    """
    longest = max(n for _, n in amounts.values())
    days = F.datediff(F.col(day).cast("date"), F.lit("1970-01-01").cast("date"))
    base = daily.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(F.col(entity).alias("e"), days.alias("d"), *[F.coalesce(F.col(c).cast(EXACT), F.lit(0).cast(EXACT)).alias(n) for n, (c, _) in amounts.items()])
    zero = F.lit(0).cast(EXACT)
    at = {1: [F.col(n).alias(n) for n in amounts]}
    for name, (_, length) in amounts.items():
        cols = at.setdefault(1 + length, [zero.alias(n) for n in amounts])
        cols[list(amounts).index(name)] = (-F.col(name)).cast(EXACT).alias(name)
    at.setdefault(1 + longest + until, [zero.alias(n) for n in amounts])
    deltas = F.array(*[F.struct(F.lit(offset).alias("o"), *cols) for offset, cols in sorted(at.items())])
    moved = base.select("e", "d", F.explode(deltas).alias("x")).groupBy("e", (F.col("d") + F.col("x.o")).alias("d")).agg(*[F.sum(f"x.{n}").cast(EXACT).alias(n) for n in amounts])
    by = Window.partitionBy("e").orderBy("d")
    run = moved.select("e", "d", F.coalesce(F.lead("d").over(by), F.col("d") + 1).alias("next"), *[F.sum(n).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in amounts])
    run = run.withColumn("d", F.explode(F.sequence("d", F.col("next") - 1)))
    return run.select(F.col("e").alias(entity), F.date_add(F.lit("1970-01-01").cast("date"), F.col("d").cast("int")).alias(day), *[F.col(n).cast("double").alias(n) for n in amounts])


def volatility_features(grid: DataFrame) -> DataFrame:
    """asset, anchor_date, rv1d_var, rv7d_var, rv30d_var, coverage30 for every day, from superseded and repeated hours.
    Days are those of UTC, whatever the time zone of the session."""
    hours = latest_rows(grid.where(F.col("asset").isNotNull() & F.col("ts").isNotNull()), ["asset", "h"], "ingested_at", ["ts", "rv", "traded"])
    rv = F.when(~F.isnan("rv"), F.col("rv")).cast(EXACT)
    daily = hours.select("asset", F.date_from_unix_date((F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000))).cast("int")).alias("anchor_date"), rv.alias("rv"), F.coalesce(F.col("traded").cast("int"), F.lit(0)).alias("hours")).groupBy("asset", "anchor_date").agg(F.sum("rv").alias("rv"), F.sum("hours").alias("hours"))
    t = trailing_totals(daily, "asset", "anchor_date", {"t1": ("rv", 1), "t7": ("rv", 7), "t30": ("rv", 30), "c30": ("hours", 30)})
    return t.select("asset", "anchor_date", F.col("t1").alias("rv1d_var"), (F.col("t7") / 7).alias("rv7d_var"), (F.col("t30") / 30).alias("rv30d_var"), (F.col("c30") / 720).alias("coverage30"))


def wrong_features(grid: DataFrame, stored: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """asset, anchor_date, field, stored, right: stored values off the right one by more than the tolerance of it.

    A day without any effect has totals of 0. Null stored values are no cases; repeats of a stored row count once.
    """
    fields = ["rv1d_var", "rv7d_var", "rv30d_var", "coverage30"]
    right = volatility_features(grid).select("asset", "anchor_date", *[F.col(f).alias(f"r_{f}") for f in fields])
    mine = stored.where(F.col("asset").isNotNull() & F.col("anchor_date").isNotNull()).select("asset", F.col("anchor_date").cast("date").alias("anchor_date"), *fields)
    both = mine.join(right, ["asset", "anchor_date"], "left")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("stored"), F.coalesce(f"r_{f}", F.lit(0.0)).alias("right")) for f in fields])).alias("x")
    out = both.select("asset", "anchor_date", each).select("asset", "anchor_date", "x.field", "x.stored", "x.right")
    return out.where(F.col("stored").isNotNull() & (F.abs(F.col("stored") - F.col("right")) > tolerance * F.abs(F.col("right")))).distinct()
