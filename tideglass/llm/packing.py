"""Documents into containers of fixed capacity by best-two-fit."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.functions.arrow import whole_groups

#: Split pattern of the public byte-level vocabularies (fixed value of the tokenizer).
FALLBACK_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    """Path of the public vocabulary file, from the installed package of public tokenizers or /opt/tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    base = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(base, "byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=FALLBACK_PATTERN, mergeable_ranks=ranks, special_tokens={})


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, all sizes in 1..capacity.

    A bin is filled greedily with the largest item that still fits. Then its smallest item is replaced by two unpacked
    items that together fit the gap it leaves more tightly than it did, if there are such. Items of equal size are taken
    in the order given. Work per bin is a few passes over the sizes, whatever the number of items.
    """
    n = len(sizes)
    bins = np.full(n, -1, np.int64)
    order = np.argsort(sizes, kind="stable")
    ends = np.cumsum(np.bincount(sizes, minlength=capacity + 1))
    start = np.concatenate([[0], ends[:-1]])
    left = (ends - start).astype(np.int64)
    taken = start.copy()
    grid = np.arange(capacity + 1)

    def largest() -> np.ndarray:
        """Per gap the largest unpacked size that fits, 0 for none."""
        return np.maximum.accumulate(np.where(left > 0, grid, 0))

    packed, b, fit = 0, 0, largest()
    while packed < n:
        gap, mine = capacity, []
        while gap > 0:
            s = int(fit[gap])
            if s == 0:
                break
            left[s] -= 1
            mine.append(s)
            gap -= s
            if left[s] == 0:
                fit = largest()
        if gap > 0 and len(mine) > 1:
            s = mine[-1]
            room = gap + s
            a = grid[1:room][left[1:room] > 0]
            if len(a):
                rest = np.minimum(room - a, a)
                two = fit[rest]
                # the same size twice needs two items of it; else the next smaller one
                twice = (two == a) & (left[a] < 2)
                if twice.any():
                    two = np.where(twice, fit[np.maximum(a - 1, 0)], two)
                total = np.where(two > 0, a + two, 0)
                k = int(np.argmax(total))
                if total[k] > s:
                    x, y = int(a[k]), int(two[k])
                    left[x] -= 1
                    left[y] -= 1
                    left[s] += 1
                    mine[-1:] = [x, y]
                    fit = largest()
        for s in mine:
            bins[order[taken[s]]] = b
            taken[s] += 1
        packed += len(mine)
        b += 1
    return bins


def pack(df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, vocabulary: str | None = None, shard_rows: int = 20_000) -> DataFrame:
    """shard, container, id, piece, start, n_tokens: every document in containers of ``capacity`` tokens.

    A text is split only if it is larger than a container: into full pieces, each a container of its own, and a rest.
    Sizes are taken where the rows lie; only (id, size) is shuffled, to shards of about shard_rows documents by hash of
    the id, each packed by best-two-fit. At most the last container or two of a shard stay loose.

    A text without tokens takes no room and goes to its shard's container 0. Null ids and null texts are left out; a
    repeated row is packed again. An empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()
    kind = dict(df.select(F.col(id_col).alias("id")).dtypes)["id"]
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) for t in b["t"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(sizes, pa.int64())], names=["id", "n"])

    shards = max(1, -(-df.count() // shard_rows))
    sized = rows.mapInArrow(count, f"id {kind}, n long").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    sized = sized.repartition("shard").sortWithinPartitions("shard", F.desc("n"), "id")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in whole_groups(batches, ("shard",), 1):
            shard = many["shard"].to_numpy()
            for s in np.unique(shard):
                t = many.filter(pa.array(shard == s))
                n = t["n"].to_numpy()
                full, rest = n // capacity, n % capacity
                loose = np.flatnonzero(rest)
                bins = best_two_fit(rest[loose], capacity)
                base = int(bins.max()) + 1 if len(bins) else 0
                whole = np.repeat(np.arange(len(n)), full)
                piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
                none = np.flatnonzero(n == 0)
                row = np.concatenate([loose, whole, none])
                box = np.concatenate([bins, base + np.arange(len(whole)), np.zeros(len(none), np.int64)])
                part = np.concatenate([full[loose], piece, np.zeros(len(none), np.int64)])
                size = np.concatenate([rest[loose], np.full(len(whole), capacity), np.zeros(len(none), np.int64)])
                out = [np.full(len(row), s, np.int32), box, t["id"].combine_chunks().take(pa.array(row)), part, part * capacity, size]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in out], names=["shard", "container", "id", "piece", "start", "n_tokens"])

    out = sized.mapInArrow(fill, f"shard int, container long, id {kind}, piece long, start long, n_tokens long")
    return out.select("shard", "container", F.col("id").alias(id_col), "piece", "start", "n_tokens")
