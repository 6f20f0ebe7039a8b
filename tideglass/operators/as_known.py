"""Attributes as known at event time: bitemporal lookup by co-groups and vectorised binary search."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days that stand for an open start or end.
FIRST, LAST = -1_000_000, 10_000_000


def timeline(entity: np.ndarray, about: np.ndarray, since: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one entity's versions: the days from which another version is the one to use, and its row (-1: none).

    A version is recorded on the days since..until. Of those recorded, the latest ``about`` holds, then the latest
    ``since``. A sweep over the recorded spans with a heap that drops what has ended.
    """
    order = np.lexsort((np.arange(len(about)), since))
    days = np.unique(np.concatenate([since, until + 1]))
    heap: list[tuple[int, int, int, int]] = []
    rows, k = np.full(len(days), -1, np.int64), 0
    for j, d in enumerate(days):
        while k < len(order) and since[order[k]] <= d:
            i = order[k]
            heapq.heappush(heap, (-int(about[i]), -int(since[i]), int(until[i]), int(i)))
            k += 1
        while heap and heap[0][2] < d:
            heapq.heappop(heap)
        if heap:
            rows[j] = heap[0][3]
    return days, rows


def as_known(events: DataFrame, versions: DataFrame, event_id: str, entity: str, event_ts: str, about: str, since: str, until: str, value: str, per_salt: int = 100_000, per_chunk: int = 100_000) -> DataFrame:
    """event id, entity, about, since, value: for each event the latest non-null observation recorded on its UTC day.

    Both days of a version are included, a null end is open. Of the versions recorded that day, the one with the latest
    ``about`` holds, then the latest ``since``. Events without one do not appear.

    No group outgrows a task on either side: an entity's events are salted and its versions cut into chunks, by counted
    rows; every salt meets every chunk, and since the best of all versions is the best of the chunks' best ones, the
    largest (about, since) per event is the answer.

    Nulls: events of null id, entity or time and versions of null entity, ``about``, ``since`` or
    value never match. Repeats of an event id, and of a version, count once; equal versions of different values give the
    larger value. Versions that end before they start are void. Empty tables give no rows; other columns are ignored.
    """
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    ev = events.where(F.col(event_id).isNotNull() & F.col(entity).isNotNull() & F.col(event_ts).isNotNull())
    ev = ev.select(F.col(event_id).alias("id"), F.col(entity).alias("e"), F.floor(F.unix_seconds(F.col(event_ts).cast("timestamp")) / 86400).alias("d"))
    v = F.col(value).cast("double")
    vs = versions.where(F.col(entity).isNotNull() & F.col(about).isNotNull() & F.col(since).isNotNull() & v.isNotNull() & ~F.isnan(v))
    vs = vs.select(F.col(entity).alias("e"), day(about).alias("about"), day(since).alias("since"), F.coalesce(day(until), F.lit(LAST)).alias("until"), v.alias("v"))
    vs = vs.where(F.col("until") >= F.col("since")).groupBy("e", "about", "since").agg(F.max("until").alias("until"), F.max("v").alias("v"))
    salts = ev.groupBy("e").agg(F.ceil(F.count(F.lit(1)) / per_salt).cast("int").alias("n"))
    chunks = vs.groupBy("e").agg(F.ceil(F.count(F.lit(1)) / per_chunk).cast("int").alias("m"))
    cut = salts.join(chunks, "e")
    part = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ev = ev.join(cut, "e").withColumn("s", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("c", part("m")).select("id", "e", "d", "s", "c")
    vs = vs.join(cut, "e").withColumn("c", F.pmod(F.xxhash64("about", "since"), F.col("m")).cast("int")).withColumn("s", part("n")).select("e", "about", "since", "until", "v", "s", "c")
    kind = dict(events.select(F.col(event_id).alias("id")).dtypes)["id"]
    name = dict(events.select(F.col(entity).alias("e")).dtypes)["e"]

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = {"id": left["id"].iloc[:0], "e": left["e"].iloc[:0], "about": np.zeros(0, np.int64), "since": np.zeros(0, np.int64), "v": np.zeros(0)}
        if not len(left) or not len(right):
            return pd.DataFrame(cols)
        a, s, u = (right[c].to_numpy(np.int64) for c in ("about", "since", "until"))
        days, rows = timeline(right["e"].to_numpy(), a, s, u)
        at = np.searchsorted(days, left["d"].to_numpy(np.int64), side="right") - 1
        row = np.where(at >= 0, rows[np.maximum(at, 0)], -1)
        hit = row >= 0
        r = row[hit]
        return pd.DataFrame({"id": left["id"].to_numpy()[hit], "e": left["e"].to_numpy()[hit], "about": a[r], "since": s[r], "v": right["v"].to_numpy()[r]})

    out = ev.groupBy("e", "s", "c").cogroup(vs.groupBy("e", "s", "c")).applyInPandas(match, f"id {kind}, e {name}, about long, since long, v double")
    date = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c).cast("int"))
    best = out.groupBy("id", "e").agg(F.max(F.struct("about", "since", "v")).alias("b"))
    return best.select(F.col("id").alias(event_id), F.col("e").alias(entity), date("b.about").alias(about), date("b.since").alias(since), F.col("b.v").alias(value))
