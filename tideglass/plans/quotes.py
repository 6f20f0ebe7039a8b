"""Queries over contracts and their quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.operators import quotes as Q
from tideglass.plans.registry import Registry
from tideglass.session import broadcast_if_small, table
from tideglass.sources.adapters import MARKETS_SQL, QUOTES_SQL, markets, quotes

R = Registry()
_Q = f"with q as ({QUOTES_SQL}), m as ({MARKETS_SQL})"
_MID = "case when ask - bid <= 0.1 then (bid + ask) / 2 else last end"
_LATEST = f"lt as (select * from (select *, {_MID} as mid, row_number() over (partition by market_id order by ts desc, snapshot_id desc) as k from q) where k = 1)"


def _latest(spark: SparkSession, d: str) -> DataFrame:
    q = quotes(spark, d)
    return Q.latest(q.withColumn("mid", Q.mid_price(F.col("bid"), F.col("ask"), F.col("last"))), ["market_id"], "ts", "snapshot_id")


@R.add(f"{_Q} select snapshot_id, round({_MID}, 9) as mid from q")
def mid_price(spark: SparkSession, d: str) -> DataFrame:
    q = quotes(spark, d)
    return q.select("snapshot_id", F.round(Q.mid_price(F.col("bid"), F.col("ask"), F.col("last")), 9).alias("mid"))


@R.add(f"{_Q}, {_LATEST} select market_id, snapshot_id, epoch_us(ts) as us, round(mid, 9) as mid from lt")
def latest_quote(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).select("market_id", "snapshot_id", F.unix_micros("ts").alias("us"), F.round("mid", 9).alias("mid"))


def _outcomes(spark: SparkSession, d: str, kind: str) -> DataFrame:
    m = markets(spark, d).where(F.col("kind") == kind).select("market_id", "event_key", "outcome_label", "bucket_bps", "strike_pct")
    return _latest(spark, d).select("market_id", "mid").join(broadcast_if_small(m), "market_id").where("mid is not null")


@R.add(f"{_Q}, {_LATEST} select event_key, round(sum(mid) - 1, 9) as overround, count(mid) as outcomes from lt join m using (market_id) where kind = 'bucket' and mid is not null group by 1")
def overround(spark: SparkSession, d: str) -> DataFrame:
    return Q.overround(_outcomes(spark, d, "bucket"), "event_key", "mid").withColumn("overround", F.round("overround", 9))


@R.add(f"{_Q}, {_LATEST}, o as (select event_key, outcome_label, mid from lt join m using (market_id) where kind = 'bucket' and mid is not null) select event_key, outcome_label, round(mid / sum(mid) over (partition by event_key), 9) as share from o")
def proportional(spark: SparkSession, d: str) -> DataFrame:
    return Q.proportional(_outcomes(spark, d, "bucket"), "event_key", "mid").select("event_key", "outcome_label", F.round("share", 9).alias("share"))


_HALVED = "{n} as (select event_key, 0 as i, {lo}::double as lo, {hi}::double as hi from ev union all select r.event_key, i + 1, case when {f} > 1 then (lo + hi) / 2 else lo end, case when {f} > 1 then hi else (lo + hi) / 2 end from {n} r join ev using (event_key) where i < 60)"
_SHIN = "(sqrt({z} * {z} + 4 * (1 - {z}) * x * x / t) - {z}) / (2 * (1 - {z}))"
_KS = _HALVED.format(n="ks", lo="1", hi="200", f="list_sum(list_transform(q, lambda x: case when x > 0 then pow(x, (lo + hi) / 2) else 0 end))")
_ZS = _HALVED.format(n="zs", lo="0", hi="(1 - 1e-9)", f="list_sum(list_transform(q, lambda x: " + _SHIN.format(z="((lo + hi) / 2)") + "))")


@R.add(
    f"""{_Q.replace("with ", "with recursive ", 1)}, {_LATEST}, o as (select event_key, outcome_label, least(greatest(mid, 0), 1) as x from lt join m using (market_id) where kind = 'bucket' and mid is not null),
    ev as (select event_key, list(x order by outcome_label, x) as q, sum(x) as t, count(*) filter (where x > 0) as n, max(x) as most from o group by 1), {_KS}, {_ZS},
    f as (select o.*, t, n, most, (ks.lo + ks.hi) / 2 as k, (zs.lo + zs.hi) / 2 as z from o join ev using (event_key) join ks using (event_key) join zs using (event_key) where ks.i = 60 and zs.i = 60)
    select event_key, outcome_label, case when t > 0 then round(case when t <= 1 or most >= 1 or n < 2 then x / t when x > 0 then pow(x, k) else 0 end, 7) end as power,
        case when t > 0 then round(case when t <= 1 then x / t else {_SHIN.format(z="z")} end, 7) end as shin, case when t > 0 then round(case when t <= 1 then 0 else z end, 7) end as insider from f"""
)
def shin_power(spark: SparkSession, d: str) -> DataFrame:
    """Normalised probabilities by the power rule and by informed trading."""
    n = Q.normalise(_outcomes(spark, d, "bucket"), "event_key", "outcome_label", "mid")
    return n.select("event_key", "outcome_label", *[F.round(c, 7).alias(c) for c in ("power", "shin", "insider")])


@R.add(
    f"""{_Q}, {_LATEST}, o as (select event_key, strike_pct, mid, row_number() over (partition by event_key order by strike_pct) as k from lt join m using (market_id) where kind = 'threshold' and mid is not null and strike_pct is not null),
    upto as (select a.event_key, a.k as s, b.k as e, avg(c.mid) as mean from o a join o b using (event_key) join o c using (event_key) where a.k <= b.k and c.k between a.k and b.k group by 1, 2, 3),
    fit as (select o.event_key, o.strike_pct, o.mid, (select max(mm) from (select u.e, min(u.mean) as mm from upto u where u.event_key = o.event_key and u.s <= o.k and u.e >= o.k group by u.e)) as fitted from o)
    select event_key, strike_pct, round(mid, 9) as mid, round(least(greatest(fitted, 0), 1), 7) as fitted from fit"""
)
def isotonic(spark: SparkSession, d: str) -> DataFrame:
    """Ladders of thresholds made to fall with the strike."""
    r = Q.repair_ladders(_outcomes(spark, d, "threshold"), "event_key", "strike_pct", "mid")
    return r.select("event_key", "strike_pct", F.round("p", 9).alias("mid"), F.round("fitted", 7).alias("fitted"))


@R.add(f"{_Q}, {_LATEST}, o as (select event_key, strike_pct, mid from lt join m using (market_id) where kind = 'threshold' and mid is not null and strike_pct is not null), b as (select *, mid - coalesce(lead(mid) over (partition by event_key order by strike_pct), 0) as bucket from o) select event_key, strike_pct, round(bucket, 9) + 0.0 as bucket, round(sum(bucket) over (partition by event_key order by strike_pct rows between current row and unbounded following), 9) + 0.0 as above from b")
def ladder_buckets(spark: SparkSession, d: str) -> DataFrame:
    o = _outcomes(spark, d, "threshold").where("strike_pct is not null").select("event_key", "strike_pct", "mid")
    b = Q.ladder_buckets(o, "event_key", "strike_pct", "mid")
    return b.select("event_key", "strike_pct", (F.round("bucket", 9) + F.lit(0.0)).alias("bucket"), (F.round("above", 9) + F.lit(0.0)).alias("above"))


_FIRST = "with x as (select *, row_number() over (partition by market_id order by ingested_at, title) as k, row_number() over (partition by market_id order by ingested_at desc, title desc) as r from market where market_id is not null), o as (select * from x where k = 1), n as (select * from x where r = 1)"


@R.add(f"{_FIRST} select market_id, n.title, o.barrier, n.resolution_rule, epoch_us(n.close_time) as close_us, coalesce(n.resolved_yes, o.resolved_yes) as resolved_yes from o join n using (market_id)")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """First deliveries of contracts merged with their last: title, rule and close time follow, results fill, terms stay."""
    cols = ["market_id", "title", "barrier", "resolution_rule", "close_time", "resolved_yes"]
    m = table(spark, d, "market").where("market_id is not null")
    rest = F.struct(*[c for c in m.columns if c != "market_id"])
    old = m.groupBy("market_id").agg(F.min_by(rest, F.struct("ingested_at", "title")).alias("r")).select("market_id", "r.*").select(*cols)
    new = markets(spark, d).select(*cols)
    out = Q.upsert(old, new, ["market_id"], ["title", "resolution_rule", "close_time"], ["resolved_yes"])
    return out.select("market_id", "title", "barrier", "resolution_rule", F.unix_micros("close_time").alias("close_us"), "resolved_yes")


@R.add(
    """with s as (select market_id, ts, snapshot_id, epoch_us(ingested_at) - epoch_us(ts) <= 3600000000 as prompt from market_snapshot),
    o as (select market_id, ts, min(snapshot_id) as snapshot_id from s where prompt group by 1, 2), n as (select market_id, ts, min(snapshot_id) as snapshot_id from s where not prompt group by 1, 2)
    select market_id, epoch_us(ts) as us, snapshot_id from o union all select market_id, epoch_us(ts), snapshot_id from n where not exists (select 1 from o where o.market_id = n.market_id and o.ts = n.ts)"""
)
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Late quotes added to those that came within the hour, where contract and time are new."""
    s = table(spark, d, "market_snapshot").withColumn("prompt", F.unix_micros("ingested_at") - F.unix_micros("ts") <= 3_600_000_000)
    old = s.where("prompt").groupBy("market_id", "ts").agg(F.min("snapshot_id").alias("snapshot_id"))
    new = s.where("not prompt").select("market_id", "ts", "snapshot_id")
    return Q.insert_ignore(old, new, ["market_id", "ts"]).select("market_id", F.unix_micros("ts").alias("us"), "snapshot_id")


@R.add(f"{_Q}, c as (select event_key, direction, count(*) filter (where resolved_yes) as n from m where kind = 'touch' and direction is not null group by 1, 2), a as (select *, 2.0 / count(*) over (partition by event_key) + n as alpha from c) select event_key, direction, alpha, round(alpha / sum(alpha) over (partition by event_key), 9) as mean from a")
def dirichlet(spark: SparkSession, d: str) -> DataFrame:
    c = markets(spark, d).where("kind = 'touch' and direction is not null").groupBy("event_key", "direction").agg(F.sum(F.when(F.col("resolved_yes"), 1).otherwise(0)).alias("n"))
    return Q.dirichlet(c, "event_key", "direction", "n", 2.0).select("event_key", "direction", "alpha", F.round("mean", 9).alias("mean"))


_SCORE = """
    WITH q AS (SELECT DISTINCT snapshot_id, market_id, ts, last_price FROM market_snapshot WHERE last_price BETWEEN 0 AND 1),
    m AS (SELECT market_id, max(close_time) AS close_time, max(resolved_yes) AS resolved_yes FROM market GROUP BY market_id),
    r AS (SELECT q.market_id, q.last_price AS p, m.resolved_yes, row_number() OVER (PARTITION BY q.market_id ORDER BY q.ts DESC, q.snapshot_id DESC) AS k
        FROM q JOIN m USING (market_id) WHERE m.resolved_yes IS NOT NULL AND q.ts <= m.close_time - INTERVAL '1' DAY AND q.ts >= m.close_time - INTERVAL '90' DAY)
    SELECT market_id, resolved_yes, round(power(p - CASE WHEN resolved_yes THEN 1 ELSE 0 END, 2), 9) AS brier FROM r WHERE k = 1
"""


@R.add(_SCORE)
def sql_latest_score(spark: SparkSession, d: str) -> DataFrame:
    """The last quote at least a day before the close, scored against the result; in SQL as it stands."""
    q, m = table(spark, d, "market_snapshot"), table(spark, d, "market")
    return spark.sql(_SCORE.replace("FROM market_snapshot", "FROM {q}").replace("FROM market ", "FROM {m} "), q=q, m=m)


_PANEL = """
    SELECT venue, kind, make_date(year(close_time), month(close_time), 1) AS month, count(DISTINCT market_id) AS contracts,
        count(DISTINCT CASE WHEN resolved_yes THEN market_id END) AS yes,
        CASE WHEN count(DISTINCT market_id) > (SELECT avg(n) FROM (SELECT count(DISTINCT market_id) AS n FROM market GROUP BY event_key)) THEN 'large' ELSE 'small' END AS size
    FROM market WHERE kind IN ('touch', 'threshold', 'bucket') AND close_time IS NOT NULL GROUP BY venue, kind, make_date(year(close_time), month(close_time), 1)
"""


@R.add(_PANEL)
def sql_panels(spark: SparkSession, d: str) -> DataFrame:
    """Contracts by venue, kind and month, with a scalar subquery over a nested aggregate."""
    return spark.sql(_PANEL.replace("FROM market ", "FROM {m} "), m=table(spark, d, "market"))


@R.add("select event_key, count(distinct market_id) as contracts from market where kind = 'touch' and resolved_yes is null and close_time < timestamptz '2021-03-01 00:00:00+00' group by 1")
def sql_past_unresolved(spark: SparkSession, d: str) -> DataFrame:
    """Events with touch contracts past their close without a result."""
    m = table(spark, d, "market").where("kind = 'touch' and resolved_yes is null and close_time < timestamp '2021-03-01 00:00:00'")
    return m.groupBy("event_key").agg(F.countDistinct("market_id").alias("contracts"))


@R.add(f"{_Q}, w as (select market_id, (epoch_us(ts) // 3600000000)::bigint as hour, count(*) as n, round(avg(bid) + 1e-12, 8) as bid, round(min(bid), 8) as low from q group by 1, 2) select * from w")
def quotes_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Quotes by contract and hour."""
    return quotes(spark, d).groupBy("market_id", F.floor(F.unix_seconds("ts") / 3600).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("bid") + 1e-12, 8).alias("bid"), F.round(F.min("bid"), 8).alias("low"))


@R.add(f"""{_Q}, t as (select market_id, asset, window_start, direction from m where kind = 'touch' and window_start is not null and asset is not null),
    c as (select asset, ts, max(high) as high, min(low) as low from candle where high is not null and low is not null and asset is not null group by 1, 2)
    select t.market_id, case when t.direction = 'up' then max(c.high) else min(c.low) end as extreme, count(*) as candles from t join c on c.asset = t.asset and c.ts >= t.window_start group by t.market_id, t.direction""")
def running_extreme(spark: SparkSession, d: str) -> DataFrame:
    """Highest or lowest price since each contract's window began: daily extremes first, then only the first day by rows."""
    t = markets(spark, d).where("kind = 'touch' and window_start is not null and asset is not null").select("market_id", "asset", "window_start", "direction")
    day = lambda c: F.floor(F.unix_seconds(c) / 86400)
    c = table(spark, d, "candle").where("high is not null and low is not null and asset is not null").groupBy("asset", "ts").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    days = c.groupBy("asset", day("ts").alias("day")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.count(F.lit(1)).alias("n"))
    after = Window.partitionBy("asset").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    tail = days.select("asset", "day", F.max("high").over(after).alias("high"), F.min("low").over(after).alias("low"), F.sum("n").over(after).alias("n"))
    tail = tail.withColumn("prev", F.lag("day").over(Window.partitionBy("asset").orderBy("day")))
    t = t.withColumn("day", day("window_start"))
    later = t.join(tail, "asset").where((tail["day"] > t["day"]) & (F.coalesce("prev", F.lit(-(2**40))) <= t["day"])).select("market_id", "direction", "high", "low", "n")
    first = t.join(c.withColumn("day", day("ts")), ["asset", "day"]).where("ts >= window_start").groupBy("market_id", "direction").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.count(F.lit(1)).alias("n"))
    u = later.unionByName(first).groupBy("market_id", "direction").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.sum("n").alias("candles"))
    return u.select("market_id", F.when(F.col("direction") == "up", F.col("high")).otherwise(F.col("low")).alias("extreme"), "candles")
