"""Session helpers: tables by name, the shared folder, size-checked broadcasts and skew salts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most this many (narrow) rows.
BROADCAST_ROWS = 400_000
#: And this many bytes.
BROADCAST_BYTES = 48 << 20


def local_session(app: str = "tideglass", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers, unless it lies on the path that they inherit or was sent before."""
    home = Path(__file__).resolve().parent
    sc = spark.sparkContext
    if str(home.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_tideglass_sent", False):
        return
    path = Path(tempfile.mkdtemp(prefix="tideglass-")) / "tideglass_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(path))
    sc._tideglass_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table; columns and filters are pushed down by Catalyst."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, one of our own in local mode, else an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not there:
        there = tempfile.mkdtemp(prefix="tideglass-")
        spark.conf.set("spark.checkpoint.dir", there)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(there)
    return there


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most that many rows and, by the lengths of its texts and the
    width of its other columns, bytes; else as it is, for a shuffle join."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t == "string"]
    width = 16 + sum(64 if t[:5] in ("array", "struc", "map<s") else 16 for _, t in df.dtypes)
    n, chars = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and n * width + chars <= size else df


def salted(keys: list[str], df: DataFrame, per_salt: int, n: str = "_n") -> DataFrame:
    """Rows of each key and how many salts it takes for none to hold more than per_salt rows: keys, _n, _salts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).withColumn("_salts", F.ceil(F.col(n) / F.lit(per_salt)).cast("int"))
