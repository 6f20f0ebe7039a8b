"""The test tables as domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.session import table


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """asset, ts, price, volume, id from the event stream."""
    return table(spark, d, "events").select(
        F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), (F.get_json_object("props", "$.k").cast("double") + 1).alias("volume"), F.col("event_id").alias("id")
    )


TICKS_SQL = "select event_type as asset, ts, value as price, cast(json_extract_string(props, '$.k') as double) + 1 as volume, event_id as id from events"


def candles(spark: SparkSession, d: str) -> DataFrame:
    """Candles that hold: of each (asset, ts) the one ingested last, with prices and trades."""
    c = table(spark, d, "candle").where("asset is not null and ts is not null")
    last = F.max(F.struct("ingested_at", "candle_id", "open", "high", "low", "close", "volume", "n_trades")).alias("c")
    held = c.groupBy("asset", "ts").agg(last).select("asset", "ts", "c.candle_id", "c.open", "c.high", "c.low", "c.close", "c.volume", "c.n_trades")
    return held.where("close > 0 and n_trades > 0")


CANDLES_SQL = """
    select asset, ts, candle_id, open, high, low, close, volume, n_trades from (select *, row_number() over (partition by asset, ts order by ingested_at desc, candle_id desc) as k
    from candle where asset is not null and ts is not null) where k = 1 and close > 0 and n_trades > 0
"""


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots once each, with a crossed book's quotes and prices outside 0 to 1 set to null."""
    s = table(spark, d, "market_snapshot").dropDuplicates(["snapshot_id"])
    inside = lambda c: F.when(F.col(c).between(0, 1), F.col(c))
    s = s.select("snapshot_id", "market_id", "ts", inside("best_bid").alias("bid"), inside("best_ask").alias("ask"), inside("last_price").alias("last"), "bid_size", "ask_size", "volume_24h")
    crossed = F.col("bid") > F.col("ask")
    return s.withColumn("b", F.when(~F.coalesce(crossed, F.lit(False)), F.col("bid"))).withColumn("a", F.when(~F.coalesce(crossed, F.lit(False)), F.col("ask"))).drop("bid", "ask").withColumnsRenamed({"b": "bid", "a": "ask"})


QUOTES_SQL = """
    select snapshot_id, market_id, ts, case when coalesce(b > a, false) then null else b end as bid, case when coalesce(b > a, false) then null else a end as ask, last, bid_size, ask_size, volume_24h from (
        select distinct snapshot_id, market_id, ts, case when best_bid between 0 and 1 then best_bid end as b, case when best_ask between 0 and 1 then best_ask end as a,
            case when last_price between 0 and 1 then last_price end as last, bid_size, ask_size, volume_24h from market_snapshot)
"""


def markets(spark: SparkSession, d: str) -> DataFrame:
    """Of each contract the row ingested last."""
    m = table(spark, d, "market").where("market_id is not null")
    return m.groupBy("market_id").agg(F.max_by(F.struct(*[c for c in m.columns if c != "market_id"]), F.struct("ingested_at", "title")).alias("m")).select("market_id", "m.*")


MARKETS_SQL = "select * exclude (k) from (select *, row_number() over (partition by market_id order by ingested_at desc, title desc) as k from market where market_id is not null) where k = 1"


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts once each, with an outcome."""
    return table(spark, d, "forecast").where("y is not null and p is not null").dropDuplicates(["forecast_id"])


FORECASTS_SQL = "select distinct * from forecast where y is not null and p is not null"
