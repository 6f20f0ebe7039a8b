"""Nearest record in time of the same entity, by a piecewise-linear learned index per entity-time shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.functions.arrow import whole_groups


class LearnedIndex:
    """Positions in a sorted array of distinct integer keys, predicted by line segments whose error is at most ``error``.

    Segments never cross a shard: they start as one per shard and are halved until every key's predicted position is
    within the bound. All segments are fitted together.
    """

    def __init__(self, keys: np.ndarray, shard: np.ndarray, error: int = 8) -> None:
        self.keys, self.error = keys, error
        n = len(keys)
        lo = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.zeros(0, np.int64)
        pos = np.arange(n)
        while n:
            hi = np.concatenate([lo[1:], [n]]) - 1
            seg = np.repeat(np.arange(len(lo)), hi - lo + 1)
            slope = (hi - lo) / np.maximum(keys[hi] - keys[lo], 1)
            off = np.abs(lo[seg] + (keys - keys[lo[seg]]) * slope[seg] - pos)
            worst = np.maximum.reduceat(off, lo)
            split = worst > error
            if not split.any():
                break
            lo = np.sort(np.concatenate([lo, (lo + hi + 1)[split] // 2]))
        self.lo = lo
        self.hi = np.concatenate([lo[1:], [n]]) - 1 if n else lo
        self.first = keys[lo]
        self.slope = (self.hi - lo) / np.maximum(keys[self.hi] - self.first, 1)

    def lower_bound(self, q: np.ndarray) -> np.ndarray:
        """For each q the number of keys below it: prediction, then a local search within the error bound."""
        if not len(self.keys):
            return np.zeros(len(q), np.int64)
        seg = np.maximum(np.searchsorted(self.first, q, side="right") - 1, 0)
        guess = np.rint(self.lo[seg] + (q - self.first[seg]) * self.slope[seg])
        guess = np.clip(guess, self.lo[seg], self.hi[seg]).astype(np.int64)
        a = np.maximum(guess - self.error - 1, self.lo[seg])
        b = np.minimum(guess + self.error + 2, self.hi[seg] + 1)
        while True:
            wide = a < b
            if not wide.any():
                return a
            mid = (a + b) // 2
            below = wide & (self.keys[np.minimum(mid, len(self.keys) - 1)] < q)
            a = np.where(below, mid + 1, a)
            b = np.where(wide & ~below, mid, b)


def _match(t: pa.Table, tolerance: int, width: int) -> pa.RecordBatch:
    """Matches in whole shards; t is sorted by (e, shard, side, us, id), side 0 the records searched in."""
    e, shard, side, us, ids = t["e"].combine_chunks(), t["shard"].to_numpy(), t["side"].to_numpy(), t["us"].to_numpy(), t["id"].to_numpy()
    edge = np.concatenate([[True], pc.not_equal(e[1:], e[:-1]).to_numpy(zero_copy_only=False) | (shard[1:] != shard[:-1])])
    group = np.cumsum(edge) - 1
    key = group * (width + 2 * tolerance + 2) + (us - shard * width + tolerance)
    same = np.concatenate([[False], (key[1:] == key[:-1]) & (side[1:] == side[:-1])])
    right = np.flatnonzero((side == 0) & ~same)  # of equal times the lowest id
    left = np.flatnonzero((side == 1) & ~(same & np.concatenate([[False], ids[1:] == ids[:-1]])))
    index = LearnedIndex(key[right], group[right])
    k, q, g = key[right], key[left], group[left]
    if len(k):
        at = index.lower_bound(q)
        far = np.int64(2**62)
        before, after = np.maximum(at - 1, 0), np.minimum(at, len(k) - 1)
        d0 = np.where((at > 0) & (group[right][before] == g), q - k[before], far)
        d1 = np.where((at < len(k)) & (group[right][after] == g), k[after] - q, far)
        best, d = np.where(d0 <= d1, before, after), np.minimum(d0, d1)
        hit = d <= tolerance
        rows, found, d = left[hit], right[best[hit]], d[hit]
    else:
        rows = found = d = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(ids[found]), pa.array((us[found] - us[rows]).astype(np.int64))], names=["l", "r", "lag"])


def nearest_in_time(left: DataFrame, right: DataFrame, left_id: str, right_id: str, entity: str, ts: str, tolerance_s: float, shard_s: int = 3600, right_entity: str | None = None, right_ts: str | None = None) -> DataFrame:
    """left id, right id, lag_us: for each left record the right record of its entity nearest in time, within the tolerance.

    At equal distance the earlier time holds, at equal times the lower id. Both sides go to shards of an entity and
    shard_s seconds; right records within the tolerance of a shard's edge go to the neighbour as well, so a shard
    answers alone, and a hot entity is spread over as many tasks as it has shards.

    Records of null id, entity or time match nothing. A left record without a match does not appear; repeats of a left
    id at the same time count once. Ids are whole numbers. Empty tables give no rows; other columns are ignored.
    """
    tol, width = round(tolerance_s * 1_000_000), shard_s * 1_000_000

    def side(df: DataFrame, key: str, ent: str, at: str) -> DataFrame:
        us = F.unix_micros(F.col(at).cast("timestamp"))
        return df.where(F.col(key).isNotNull() & F.col(ent).isNotNull() & F.col(at).isNotNull()).select(F.col(ent).cast("string").alias("e"), us.alias("us"), F.col(key).cast("long").alias("id"))

    shard = lambda x: F.floor(x / width)
    lt = side(left, left_id, entity, ts).select("e", shard(F.col("us")).alias("shard"), F.lit(1).cast("byte").alias("side"), "us", "id")
    rt = side(right, right_id, right_entity or entity, right_ts or ts)
    rt = rt.select("e", F.explode(F.sequence(shard(F.col("us") - tol), shard(F.col("us") + tol))).alias("shard"), F.lit(0).cast("byte").alias("side"), "us", "id")
    both = lt.unionByName(rt).repartition("e", "shard").sortWithinPartitions("e", "shard", "side", "us", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ("e", "shard"), 100_000):
            yield _match(t, tol, width)

    return both.mapInArrow(run, "l long, r long, lag long").select(F.col("l").alias(left_id), F.col("r").alias(right_id), F.col("lag").alias("lag_us"))
