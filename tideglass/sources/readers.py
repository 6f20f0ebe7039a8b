"""Readers and sinks: ticks, candles and venue payloads as files, result tables, caches keyed by content."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TICK = T.StructType([T.StructField("unixtime", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("volume", T.DoubleType())])
LABEL = T.StructType([T.StructField("meeting_date", T.StringType()), T.StructField("hawkish_dovish_score", T.DoubleType()), T.StructField("surprise_magnitude", T.DoubleType()), T.StructField("sentiment", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("rationale", T.StringType())])
GOLD = T.StructType([T.StructField("query", T.StringType()), T.StructField("relevant_chunk_ids", T.ArrayType(T.StringType()))])


def tick_csv(spark: SparkSession, path: str, asset: str) -> DataFrame:
    """Headerless ticks (seconds, price, volume) with exact repeats of time, price and volume removed. Lazy."""
    t = spark.read.schema(TICK).csv(path, header=False)
    return t.select(F.lit(asset).alias("asset"), F.timestamp_seconds("unixtime").alias("ts"), "price", "volume").dropDuplicates()


def tick_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All assets in one long table."""
    return reduce(DataFrame.unionByName, [tick_csv(spark, p, a) for a, p in sorted(paths.items())])


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that is one array of records."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def gold_queries(spark: SparkSession, path: str, tier: str) -> DataFrame:
    g = json_array(spark, path, GOLD)
    return g.select(F.lit(tier).alias("tier"), "query", F.explode("relevant_chunk_ids").alias("chunk"))


def text_files(spark: SparkSession, roots: Iterable[str], pattern: str = "*.md") -> DataFrame:
    """path, text of all files below the roots that match, each path once."""
    files = [spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(r) for r in roots]
    both = reduce(DataFrame.unionByName, files)
    return both.select("path", F.decode("content", "UTF-8").alias("text")).dropDuplicates(["path"])


def klines(raw: DataFrame, column: str) -> DataFrame:
    """Candles from an array of arrays: milliseconds, open, high, low, close, volume."""
    rows = raw.select("*", F.explode(F.from_json(column, "array<array<string>>")).alias("_k"))
    x = lambda i: F.col("_k")[i].cast("double")
    return rows.select(*raw.columns, F.timestamp_millis(F.col("_k")[0].cast("long")).alias("ts"), x(1).alias("open"), x(2).alias("high"), x(3).alias("low"), x(4).alias("close"), x(5).alias("volume")).drop(column)


def keyed_ohlc(raw: DataFrame, column: str, key: str) -> DataFrame:
    """Candles from {"error": [], "result": {key: [[seconds, open, high, low, close, vwap, volume, n], ...]}}."""
    checked = raw.withColumn("_e", F.from_json(F.get_json_object(column, "$.error"), "array<string>"))
    checked = checked.withColumn("_ok", F.when(F.size("_e") > 0, F.raise_error(F.concat(F.lit("source error: "), F.array_join("_e", ", ")))).otherwise(F.lit("")))
    rows = checked.select(*raw.columns, "_ok", F.explode(F.from_json(F.get_json_object(column, f"$.result.{key}"), "array<array<string>>")).alias("_k"))
    x = lambda i: F.col("_k")[i].cast("double")
    return rows.where("_ok = ''").select(*[c for c in raw.columns if c != column], F.timestamp_seconds(F.col("_k")[0].cast("double")).alias("ts"), x(1).alias("open"), x(2).alias("high"), x(3).alias("low"), x(4).alias("close"), x(6).alias("volume"))


def price_history(raw: DataFrame, column: str) -> DataFrame:
    """Last prices from {"history": [{"t": seconds, "p": price}, ...]}."""
    rows = raw.select("*", F.explode(F.from_json(F.get_json_object(column, "$.history"), "array<struct<t: bigint, p: double>>")).alias("_h"))
    return rows.select(*[c for c in raw.columns if c != column], F.timestamp_seconds("_h.t").alias("ts"), F.col("_h.p").alias("last_price"))


# Fixed value: how venues write a touch level.
STRIKE = "([↑↓])\\s*\\$?\\s*([\\d,]+(?:\\.\\d+)?)"


def strike_from(title: Column) -> tuple[Column, Column]:
    """Direction and level of titles with an arrow and a number."""
    arrow, level = F.regexp_extract(title, STRIKE, 1), F.regexp_extract(title, STRIKE, 2)
    return F.when(arrow == "↑", "up").when(arrow == "↓", "down"), F.nullif(F.replace(level, F.lit(","), F.lit("")), F.lit("")).cast("double")


# Month names as venues write them in tickers.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def meeting_key(ticker: Column, end: Column, prefix: str = "fomc") -> Column:
    """The same key for a meeting at every venue, prefix-YYYY-MM: from the year and month of a ticker, else from the end."""
    year, month = F.regexp_extract(ticker, r"-(\d{2})([A-Z]{3})", 1), F.regexp_extract(ticker, r"-(\d{2})([A-Z]{3})", 2)
    at = F.array_position(F.array(*map(F.lit, MONTHS)), month)
    told = F.when(at > 0, F.concat(F.lit(f"{prefix}-20"), year, F.lit("-"), F.lpad(at.cast("string"), 2, "0")))
    return F.coalesce(told, F.concat(F.lit(f"{prefix}-"), F.date_format(F.to_utc_timestamp(end, F.current_timezone()), "yyyy-MM")))


def bucket_bps(label: Column) -> Column:
    """Basis points of a bucket's label: 0 for no change, negative for a decrease; null for labels of another kind."""
    size = F.regexp_extract(label, r"(?i)^(\d+)\+?\s*bps\s+(in|de)crease$", 1)
    down = F.lower(F.regexp_extract(label, r"(?i)^(\d+)\+?\s*bps\s+(in|de)crease$", 2)) == "de"
    return F.when(F.lower(F.trim(label)) == "no change", F.lit(0)).when(size != "", F.when(down, -size.try_cast("int")).otherwise(size.try_cast("int")))


def settled(closed: Column, price: Column) -> Column:
    """Outcome that a closed contract's price tells: yes above 0.99, no below 0.01, else unknown."""
    return F.when(closed & (price > 0.99), F.lit(True)).when(closed & (price < 0.01), F.lit(False))


def dollars(text: Column) -> Column:
    """A dollar text as a number, null where it is empty."""
    return F.nullif(F.trim(text), F.lit("")).cast("double")


def split_valid(df: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that keep a rule, and the rest for quarantine."""
    ok = F.coalesce(rule, F.lit(False))
    return df.where(ok), df.where(~ok)


def write_table(df: DataFrame, path: str, partition: list[str] | None = None, form: str = "parquet") -> None:
    """A result table, replaced as a whole."""
    w = df.write.mode("overwrite")
    if form == "csv":
        w = w.option("header", True)
    if partition:
        w = w.partitionBy(*partition)
    w.format(form).save(path)


def cached_by_content(requests: DataFrame, cache: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Answers that the cache holds under the hash of the request's columns, and the requests it does not hold."""
    keyed = requests.withColumn("key", F.sha2(F.concat_ws("|", *columns), 256))
    return keyed.join(cache, "key"), keyed.join(cache, "key", "left_anti")


def save_artifact(path: str, artifact: dict) -> str:
    """A small model as JSON; its id comes from its content."""
    text = json.dumps(artifact, sort_keys=True)
    with open(path, "w") as f:
        f.write(text)
    return f"{artifact.get('kind', 'model')}-{hashlib.sha256(text.encode()).hexdigest()[:8]}"


def load_artifact(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def read_within(root: str, relative: str, most: int = 200_000) -> str:
    """A text file below a root, no larger than ``most`` bytes; nothing outside the root."""
    full = os.path.realpath(os.path.join(root, relative))
    if not full.startswith(os.path.realpath(root) + os.sep):
        raise PermissionError("outside the allowed folder")
    if os.path.getsize(full) > most:
        raise ValueError("the file is too large")
    with open(full, encoding="utf-8", errors="replace") as f:
        return f.read()


class ReplaySource(DataSource):
    """Recorded responses as a source: one JSON file a response, one partition a file. Options: path, venue."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return "venue string, endpoint string, fetched_at timestamp, payload string"

    def reader(self, schema):
        return _ReplayReader(self.options)


class _ReplayReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.venue = options["path"], options.get("venue", "replay")

    def partitions(self):
        return [InputPartition(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".json")] or [InputPartition("")]

    def read(self, partition):
        import datetime

        if partition.value:
            with open(partition.value, encoding="utf-8") as f:
                at = datetime.datetime.fromtimestamp(os.path.getmtime(partition.value), datetime.timezone.utc)
                yield self.venue, os.path.basename(partition.value)[:-5], at, f.read()
