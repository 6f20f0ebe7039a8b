"""Streaming forms of the operators: windows with watermarks, keyed state, merges per batch, freshness."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_of(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """New parquet files below a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def streaming_bars(ticks: DataFrame, every: str = "1 hour", late: str = "3 hours") -> DataFrame:
    """OHLCV bars per asset and tumbling window; rows later than the watermark are dropped by it."""
    at = F.struct("ts", "id")
    w = ticks.withWatermark("ts", late).groupBy("asset", F.window("ts", every).alias("w"))
    bars = w.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_trades"))
    return bars.select("asset", F.col("w.start").alias("bar"), "open", "high", "low", "close", "volume", "n_trades")


def fresh(df: DataFrame, ts: str, now, oldest_s: float) -> DataFrame:
    """Rows no older than oldest_s before ``now``."""
    return df.where(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(ts) <= oldest_s * 1e6)


STATE = "alpha double, beta double, level double, position double, last_us long"


def _step(state: tuple, us: int, x: float, delta: float, gain: float, entry: float, exit_: float) -> tuple:
    """One reading: discounted variance belief, level, and the hysteresis position of the standardised gap."""
    alpha, beta, level, pos, _ = state
    gap = 0.0 if level != level else x - level
    sd = (beta / max(alpha - 1, 1e-9)) ** 0.5 if alpha > 1 else 0.0
    z = gap / sd if sd > 0 else 0.0
    if pos == 0.0 and abs(z) >= entry:
        pos = -1.0 if z > 0 else 1.0
    elif pos != 0.0 and abs(z) <= exit_:
        pos = 0.0
    level = x if level != level else level + gain * gap
    return delta * alpha + 0.5, delta * beta + gap * gap / 2, level, pos, us


def keyed_state(ticks: DataFrame, delta: float = 0.99, gain: float = 0.2, entry: float = 2.0, exit_: float = 0.5) -> DataFrame:
    """asset, us, level, variance, position after every tick, with the state carried from batch to batch per asset.

    Ticks of an asset that arrive late within a batch are put in order; those behind the state's time are ignored.
    """
    out = "asset string, us long, level double, variance double, position double"

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (2.0, 1e-6, float("nan"), 0.0, -(2**62))
        for pdf in parts:
            rows = []
            for us, x in pdf.sort_values(["us", "id"])[["us", "price"]].itertuples(index=False):
                if us < now[4]:
                    continue
                now = _step(now, int(us), float(x), delta, gain, entry, exit_)
                rows.append((key[0], us, now[2], now[1] / max(now[0] - 1, 1e-9), now[3]))
            yield pd.DataFrame(rows, columns=["asset", "us", "level", "variance", "position"])
        state.update(now)

    rows = ticks.select("asset", F.unix_micros("ts").alias("us"), "price", "id").where("price is not null")
    return rows.groupBy("asset").applyInPandasWithState(run, out, STATE, "append", GroupStateTimeout.NoTimeout)


def into_table(stream: DataFrame, path: str, key: list[str], checkpoint: str) -> object:
    """Run the stream once over what is there, adding rows whose key the table at path does not hold yet.

    Every batch adds a folder of its own, named by checkpoint and batch, with the new rows alone; nothing that was written
    before is touched. A folder counts once Spark has marked it complete, so a batch that broke off leaves no trace, and a
    repeated one replaces its own folder. Failures to read the table are raised.
    """
    mark = f"part-{zlib.crc32(checkpoint.encode()):08x}"

    def write(batch: DataFrame, number: int) -> None:
        spark, mine = batch.sparkSession, f"{mark}-{number:010d}"
        before = [p for p in _parts(spark, path) if not p.endswith(f"/{mine}")]
        rest = [c for c in batch.columns if c not in key]
        new = batch.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*") if rest else batch.distinct()
        if before:
            new = new.join(spark.read.schema(batch.schema).parquet(*before).select(*key), key, "left_anti")
        new.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/{mine}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _parts(spark: SparkSession, path: str) -> list[str]:
    """Folders of the table that are complete."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(at(path)):
        return []
    found = [s.getPath() for s in fs.listStatus(at(path)) if s.isDirectory() and s.getPath().getName().startswith("part-")]
    return sorted(p.toString() for p in found if fs.exists(at(p, "_SUCCESS")))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    parts = _parts(spark, path)
    if not parts:
        raise FileNotFoundError(path)
    return spark.read.parquet(*parts)


def each_venue(venues: dict[str, Callable[[], int]]) -> dict[str, object]:
    """Run every venue's step; one that fails does not stop the rest, its error is reported in its place."""
    out: dict[str, object] = {}
    for name, step in venues.items():
        try:
            out[name] = step()
        except Exception as e:  # noqa: BLE001 - reported
            out[name] = e
    return out


def run_to_memory(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Everything the stream has now, as a table of the session (for tests and previews)."""
    w = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
