"""Queries of readers, sinks and streaming jobs: tables go out in a source's form and come back through its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideglass.operators.bars import time_bars
from tideglass.plans.registry import Registry
from tideglass.session import shared_dir, stored, table
from tideglass.sources import readers as S
from tideglass.sources.adapters import TICKS_SQL, ticks
from tideglass.streaming import jobs as J

R = Registry()


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_T = f"t as (select * from ({TICKS_SQL}))"


@R.add(f"with {_T}, c as (select distinct asset, epoch_us(ts) // 1000000 as s, price, volume from t where price is not null) select asset, (s // 3600)::bigint as hour, count(*) as n, round(sum(volume), 6) as volume, round(max(price), 6) as high from c group by 1, 2")
def tick_files_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Headerless tick files, one folder an asset, read lazily into one long table: repeats within a second count once."""
    out = _path(spark, "ticks")
    t = ticks(spark, d).where("price is not null")
    t.select("asset", F.unix_seconds("ts").alias("unixtime"), "price", "volume").write.partitionBy("asset").csv(out)
    assets = sorted(r[0] for r in t.select("asset").distinct().collect())  # one source a name
    long = S.tick_files(spark, {a: f"{out}/asset={a}" for a in assets})
    return long.groupBy("asset", F.floor(F.unix_seconds("ts") / 3600).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("volume"), 6).alias("volume"), F.round(F.max("price"), 6).alias("high"))


@R.add("select label_id, meeting_date, hawkish_dovish_score, surprise_magnitude, lower(sentiment) as sentiment, confidence from reliability_label where hawkish_dovish_score between -1 and 1 and confidence between 0 and 1 and length(rationale) <= 10000")
def json_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels as one array of records in a file, read with a schema and validated."""
    out = _path(spark, "labels")
    rows = table(spark, d, "reliability_label").select("label_id", *[f.name for f in S.LABEL.fields])
    array = rows.groupBy().agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))  # a file of labels is small by nature
    array.coalesce(1).write.text(out)
    back = S.json_array(spark, out, T.StructType([T.StructField("label_id", T.LongType()), *S.LABEL.fields]))
    good, _ = S.split_valid(back, F.col("hawkish_dovish_score").between(-1, 1) & F.col("confidence").between(0, 1) & (F.length("rationale") <= 10_000))
    return good.select("label_id", "meeting_date", "hawkish_dovish_score", "surprise_magnitude", F.lower("sentiment").alias("sentiment"), "confidence")


_KLINE = "select asset, (epoch_us(ts) // 1000)::bigint as ms, open, high, low, close, volume from candle where asset is not null and ts is not null and close is not null"


@R.add(f"with k as ({_KLINE}) select asset, ms, count(*) as n, round(sum(close), 6) as close, round(max(high), 6) as high, round(sum(volume), 6) as volume from k group by 1, 2")
def kline_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Candles as arrays of arrays (milliseconds first), one answer an asset and day, parsed again."""
    c = table(spark, d, "candle").where("asset is not null and ts is not null and close is not null")
    ms = F.unix_millis("ts")
    row = F.array(*[x.cast("string") for x in (ms, F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("volume"))])
    raw = c.groupBy("asset", F.floor(ms / 86_400_000).alias("day")).agg(F.to_json(F.collect_list(row)).alias("body"))
    k = S.klines(raw, "body")
    return k.groupBy("asset", F.unix_millis("ts").alias("ms")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 6).alias("close"), F.round(F.max("high"), 6).alias("high"), F.round(F.sum("volume"), 6).alias("volume"))


@R.add(f"with k as ({_KLINE}) select asset, (ms // 1000)::bigint as s, count(*) as n, round(sum(close), 6) as close from k group by 1, 2")
def keyed_candles(spark: SparkSession, d: str) -> DataFrame:
    """Candles as a keyed result with an error list, seconds first."""
    c = table(spark, d, "candle").where("asset is not null and ts is not null and close is not null")
    row = F.array(*[x.cast("string") for x in (F.unix_seconds("ts"), F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.lit(0), F.col("volume"))])
    raw = c.groupBy("asset", F.floor(F.unix_seconds("ts") / 86_400).alias("day")).agg(F.to_json(F.struct(F.array().cast("array<string>").alias("error"), F.struct(F.collect_list(row).alias("pair")).alias("result"))).alias("body"))
    k = S.keyed_ohlc(raw, "body", "pair")
    return k.groupBy("asset", F.unix_seconds("ts").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 6).alias("close"))


@R.add("select market_id, (epoch_us(ts) // 1000000)::bigint as s, count(*) as n, round(sum(last_price), 6) as last_price from market_snapshot where market_id is not null and ts is not null and last_price is not null group by 1, 2")
def price_histories(spark: SparkSession, d: str) -> DataFrame:
    """Last prices as histories of seconds and price, one answer a contract and day."""
    q = table(spark, d, "market_snapshot").where("market_id is not null and ts is not null and last_price is not null")
    s = F.unix_seconds("ts")
    raw = q.groupBy("market_id", F.floor(s / 86_400).alias("day")).agg(F.to_json(F.struct(F.collect_list(F.struct(s.alias("t"), F.col("last_price").alias("p"))).alias("history"))).alias("body"))
    return S.price_history(raw, "body").groupBy("market_id", F.unix_seconds("ts").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("last_price"), 6).alias("last_price"))


@R.add(
    """select market_id, case when outcome_label like '%↑%' then 'up' when outcome_label like '%↓%' then 'down' end as direction, try_cast(replace(regexp_extract(outcome_label, '[↑↓]\\s*\\$?\\s*([\\d,]+(?:\\.\\d+)?)', 1), ',', '') as double) as level,
    count(*) as rows from market where kind = 'touch' and market_id is not null group by all"""
)
def touch_strikes(spark: SparkSession, d: str) -> DataFrame:
    """Direction and level of touch contracts from how the venue writes them."""
    m = table(spark, d, "market").where("kind = 'touch' and market_id is not null")
    way, level = S.strike_from(F.col("outcome_label"))
    return m.select("market_id", way.alias("direction"), level.alias("level")).groupBy("market_id", "direction", "level").agg(F.count(F.lit(1)).alias("rows"))


@R.add("select doc_id % 3 = 0 as known, count(*) as requests from documents where text is not null group by 1")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Requests answered by a cache keyed by the hash of their content, and those that are not."""
    q = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    cache = q.where("doc_id % 3 = 0").select(F.sha2(F.concat_ws("|", "doc_id", "text"), 256).alias("key")).withColumn("answer", F.lit(1))
    hit, miss = S.cached_by_content(q.withColumn("doc_id", F.col("doc_id").cast("string")), cache, ["doc_id", "text"])
    return hit.groupBy(F.lit(True).alias("known")).agg(F.count(F.lit(1)).alias("requests")).unionByName(miss.groupBy(F.lit(False).alias("known")).agg(F.count(F.lit(1)).alias("requests")))


@R.add("select model_id, week, count(*) as n, round(sum(p), 6) as p from forecast where p is not null and week is not null group by 1, 2")
def partitioned_sink(spark: SparkSession, d: str) -> DataFrame:
    """A result table replaced as a whole, by model, read again; and once more as CSV with a header."""
    out = _path(spark, "forecast")
    S.write_table(table(spark, d, "forecast").where("p is not null and week is not null").select("model_id", "week", "p"), out, ["model_id"])
    back = spark.read.parquet(out).groupBy("model_id", "week").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 6).alias("p"))
    S.write_table(back, f"{out}-csv", form="csv")
    return spark.read.schema("model_id string, week long, n long, p double").option("header", True).csv(f"{out}-csv")


@R.add("select asset, close_us as us, market_id from (select asset, epoch_us(close_time) as close_us, market_id, row_number() over (partition by market_id order by ingested_at) as k from market where market_id is not null and close_time is not null) where k = 1")
def first_seen_markets(spark: SparkSession, d: str) -> DataFrame:
    """Contracts as first delivered, by a stream of deliveries into a table that ignores keys it holds."""
    src, out = _path(spark, "deliveries"), _path(spark, "contracts")
    m = table(spark, d, "market").where("market_id is not null and close_time is not null").select("ingested_at", "market_id", "asset", "close_time")
    m.repartitionByRange(4, "ingested_at").write.parquet(src)
    J.into_table(J.stream_of(spark, src, m.schema, 100), out, ["market_id"], _path(spark, "checkpoint"))
    return J.read_table(spark, out).select("asset", F.unix_micros("close_time").alias("us"), "market_id")


@R.add(f"with {_T} select asset, ((epoch_us(ts) // 3600000000) * 3600)::bigint as hour, round(arg_min(price, (ts, id)), 9) as open, round(max(price), 9) as high, round(min(price), 9) as low, round(arg_max(price, (ts, id)), 9) as close, round(sum(volume), 6) as volume, count(*) as n_trades from t group by 1, 2")
def streamed_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of a stream of ticks, by tumbling windows with a watermark; the table is replaced batch by batch."""
    src, out = _path(spark, "tick-stream"), _path(spark, "bars")
    t = ticks(spark, d)
    t.repartitionByRange(4, "ts").write.parquet(src)
    s = J.streaming_bars(J.stream_of(spark, src, t.schema, 100))
    q = s.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", _path(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    r = lambda c, n: F.round(c, n).alias(c)
    return spark.read.parquet(out).select("asset", F.unix_seconds("bar").alias("hour"), r("open", 9), r("high", 9), r("low", 9), r("close", 9), r("volume", 6), "n_trades")


@R.add()
def streamed_state(spark: SparkSession, d: str) -> DataFrame:
    """Level, variance and position of every asset after its last tick, with state carried from batch to batch."""
    src, out = _path(spark, "tick-stream"), _path(spark, "state")
    t = ticks(spark, d)
    t.repartitionByRange(4, "ts").write.parquet(src)
    s = J.keyed_state(J.stream_of(spark, src, t.schema, 100))
    s.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", _path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("asset").agg(F.max_by(F.struct("us", "level", "variance", "position"), "us").alias("x"), F.count(F.lit(1)).alias("ticks"))
    return last.select("asset", "ticks", "x.*")


@R.add(f"with {_T}, m as (select max(epoch_us(ts)) as us from t) select asset, count(*) as n from t, m where m.us - epoch_us(ts) <= 3 * 3600 * 1000000::bigint group by 1")
def fresh_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Ticks no older than three hours before the latest one."""
    t = ticks(spark, d)
    now = t.agg(F.max("ts")).first()[0]
    return J.fresh(t, "ts", now, 3 * 3600).groupBy("asset").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"with {_T} select asset, (epoch_us(ts) // 60000000)::bigint as minute, count(*) as n from t where price > 0 and volume >= 0 group by 1, 2")
def cached_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Minute bars of ticks, written once to the shared folder and read from there."""
    b = stored(time_bars(ticks(spark, d), 60), "minute-bars")
    return b.select("asset", F.floor(F.unix_seconds("bar") / 60).alias("minute"), F.col("n_trades").alias("n"))


_MON = "case regexp_extract(native_id, '-(\\d{2})([A-Z]{3})', 2) " + " ".join(f"when '{m}' then '{i:02d}'" for i, m in enumerate(S.MONTHS, 1)) + " end"


@R.add(
    f"""select market_id, coalesce('fomc-20' || regexp_extract(native_id, '-(\\d{{2}})([A-Z]{{3}})', 1) || '-' || {_MON}, 'fomc-' || strftime(close_time at time zone 'UTC', '%Y-%m')) as meeting,
    case when lower(outcome_label) = 'no change' then 0 when outcome_label like '%bps decrease' then -regexp_extract(outcome_label, '^(\\d+)', 1)::int when outcome_label like '%bps increase' then regexp_extract(outcome_label, '^(\\d+)', 1)::int end as bps, count(*) as rows
    from market where kind in ('bucket', 'threshold') and market_id is not null group by all"""
)
def meeting_keys(spark: SparkSession, d: str) -> DataFrame:
    """Contracts of both venues under one key a meeting, and the basis points their labels stand for."""
    m = table(spark, d, "market").where("kind in ('bucket', 'threshold') and market_id is not null")
    m = m.select("market_id", S.meeting_key(F.col("native_id"), F.col("close_time")).alias("meeting"), S.bucket_bps(F.col("outcome_label")).alias("bps"))
    return m.groupBy("market_id", "meeting", "bps").agg(F.count(F.lit(1)).alias("rows"))


@R.add("select market_id, case when max(last_price) filter (where last_price between 0 and 1) > 0.99 then true when max(last_price) filter (where last_price between 0 and 1) < 0.01 then false end as outcome from market_snapshot where market_id is not null group by 1")
def told_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What each contract's highest last price would tell of its outcome, had it closed there."""
    q = table(spark, d, "market_snapshot").where("market_id is not null").groupBy("market_id").agg(F.max(F.when(F.col("last_price").between(0, 1), F.col("last_price"))).alias("p"))
    return q.select("market_id", S.settled(F.lit(True), F.col("p")).alias("outcome"))
