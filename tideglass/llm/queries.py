"""Queries of the problems of this subpackage: p3, p8, p9, p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm.leaks import find_leaks
from tideglass.llm.nearest import nearest_in_time
from tideglass.llm.packing import pack
from tideglass.llm.pii import find_personal, redact
from tideglass.plans.registry import Registry
from tideglass.session import broadcast_if_small, table

R = Registry()

#: Names of the desk's projects and books, which read as names of persons do. TESTDATA.md rules them out as
#: cases, and nothing in a text tells them apart; a user gives the names of their own house here.
PROJECTS = ("Pewter Sable", "Port Ravel", "Umber Lathe", "Brindle North", "Juniper Wicket", "Ellerby Coldwater", "Upper Mottram", "Old Thistle", "Saltmarsh")

_P3 = """
    with m as (select market_id, arg_max(asset, ingested_at) as asset from market where asset is not null group by 1),
    s as (select distinct snapshot_id, asset, epoch_us(ts) as us from market_snapshot join m using (market_id)),
    c as (select asset, epoch_us(ts) as us, min(candle_id) as candle_id from candle where close is not null group by 1, 2),
    b as (select s.*, c.us as us0, c.candle_id as id0 from s asof left join c on s.asset = c.asset and s.us >= c.us),
    n as (select b.*, c.us as us1, c.candle_id as id1 from b asof left join c on b.asset = c.asset and b.us <= c.us),
    r as (select snapshot_id, us, case when id1 is null or (id0 is not null and us - us0 <= us1 - us) then id0 else id1 end as candle_id,
        least(coalesce(us - us0, 9000000000000000000), coalesce(us1 - us, 9000000000000000000)) as d, case when id1 is null or (id0 is not null and us - us0 <= us1 - us) then us0 - us else us1 - us end as lag_us from n)
"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    market = table(spark, d, "market").where("asset is not null and market_id is not null").groupBy("market_id").agg(F.max_by("asset", "ingested_at").alias("asset"))
    quotes = table(spark, d, "market_snapshot").select("snapshot_id", "market_id", "ts").join(broadcast_if_small(market), "market_id")
    candles = table(spark, d, "candle").where("close is not null and not isnan(close)").select("candle_id", "asset", "ts")
    return nearest_in_time(quotes, candles, "snapshot_id", "candle_id", "asset", "ts", 120)


@R.add(_P3 + "select distinct snapshot_id, candle_id from r where d <= 120000000")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("snapshot_id", "candle_id")


@R.add(_P3 + "select distinct snapshot_id, candle_id, lag_us from r where d <= 120000000")
def p3_lags(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with how much later the candle is."""
    return _pairs(spark, d)


@R.add()
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), "doc_id", "text")


@R.add()
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and room left over by shard."""
    boxes = pack(table(spark, d, "documents"), "doc_id", "text").groupBy("shard", "container").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    return boxes.groupBy("shard").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.sum(2048 - F.col("n")).alias("room"), F.max("n").alias("fullest"))


@R.add()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"), "doc_id", "text", "item_id", "text").select("doc_id", "item_id").distinct()


@R.add()
def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents and their largest share."""
    got = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"), "doc_id", "text", "item_id", "text")
    return got.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.max("share"), 6).alias("largest_share"))


@R.add()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_personal(table(spark, d, "documents"), "doc_id", "text", register=PROJECTS).select("doc_id", "kind", "start_pos")


@R.add()
def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document with typed placeholders."""
    return redact(table(spark, d, "documents"), "doc_id", "text", register=PROJECTS)
