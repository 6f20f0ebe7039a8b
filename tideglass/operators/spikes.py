"""Implausible readings per source: a local-level state-space filter over blocks of each source's history.

Every source is cut into blocks of about ``block_rows`` rows in time order, each with a halo of ``halo_rows`` rows on
either side, so a source that holds a third of all rows is spread over many tasks. Inside a task the filters of all
blocks advance together, one reading per numpy step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.functions.arrow import whole_groups
from tideglass.session import broadcast_if_small, stored

REASONS = ("range", "spike", "stuck")


@dataclass(frozen=True)
class SpikeConfig:
    """low, high: the physical range. spike_sd: bound on standardised innovations of a lively field, in sd of its moves.
    quiet_moves: the same for a field that seldom changes, in units of the typical lasting move of the source's steadiest
    field: a last price gathers several moves of the quotes in one. longest: readings a spike
    lasts at most. vanished: innovation variance, in units of the source's own, below which a run may be frozen (updates are
    withheld beyond the bound, so 15 equal readings always bring it there). stuck: equal readings that make a frozen run. lively: share of changes from which a field counts as one
    that changes at nearly every reading."""

    low: float = 0.0
    high: float = 1.0
    spike_sd: float = 5.4
    quiet_moves: float = 3.6
    longest: int = 3
    vanished: float = 0.25
    stuck: int = 15
    lively: float = 0.6
    block_rows: int = 8192
    halo_rows: int = 64
    bucket_s: int = 60


def _blocks(df: DataFrame, cfg: SpikeConfig) -> DataFrame:
    """Rows with their block and whether they are its core; a row near an edge also goes to the neighbour as halo. Rows
    without source or time go to blocks below 0 by their id.

    Only sources of over two blocks are cut, along a histogram by time bucket, so the cut points come from aggregates.
    """
    known = F.col("src").isNotNull() & F.col("ts").isNotNull()
    sizes = stored(df.where(known).groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * cfg.block_rows).select("src"), "big-sources")
    big = broadcast_if_small(sizes)
    bucket = F.floor(F.unix_seconds("ts") / cfg.bucket_s)
    hist = df.where(known).join(big, "src", "left_semi").groupBy("src", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("src").orderBy("bucket")
    hist = hist.withColumn("c1", F.sum("n").over(by)).withColumn("c0", F.col("c1") - F.col("n"))
    hist = hist.withColumn("block", F.dense_rank().over(Window.partitionBy("src").orderBy(F.floor(F.col("c0") / cfg.block_rows))))
    of = Window.partitionBy("src", "block")
    hist = hist.withColumn("b0", F.min("c0").over(of)).withColumn("b1", F.max("c1").over(of))
    last = F.max("block").over(Window.partitionBy("src"))
    hist = hist.withColumn(
        "blocks",
        F.array_compact(
            F.array(
                F.struct(F.col("block"), F.lit(True).alias("core")),
                F.when((F.col("c0") < F.col("b0") + cfg.halo_rows) & (F.col("block") > 1), F.struct((F.col("block") - 1).alias("block"), F.lit(False).alias("core"))),
                F.when((F.col("c1") > F.col("b1") - cfg.halo_rows) & (F.col("block") < last), F.struct((F.col("block") + 1).alias("block"), F.lit(False).alias("core"))),
            )
        ),
    ).select("src", "bucket", "blocks")
    hist = broadcast_if_small(stored(hist, "blocks"))
    out = df.withColumn("bucket", bucket).join(hist, ["src", "bucket"], "left")
    loose = F.array(F.struct((-1 - F.pmod(F.xxhash64("id"), F.lit(1 << 20))).cast("int").alias("block"), F.lit(True).alias("core")))
    whole = F.array(F.struct(F.lit(0).alias("block"), F.lit(True).alias("core")))
    return out.withColumn("b", F.explode(F.when(~known, loose).otherwise(F.coalesce("blocks", whole)))).select("src", F.col("b.block").alias("block"), F.col("b.core").alias("core"), *[c for c in df.columns if c != "src"])


def _median_by(series: np.ndarray, x: np.ndarray, n: int, q: float = 0.5) -> np.ndarray:
    """Quantile (lower) of x by series 0..n-1; nan where there is none."""
    order = np.lexsort((x, series))
    s, count = series[order], np.bincount(series, minlength=n)
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    out = np.full(n, np.nan)
    have = count > 0
    out[have] = x[order][(start + np.floor((count - 1) * q).astype(int))[have]]
    assert len(s) == count.sum()
    return out


def filter_series(series: np.ndarray, v: np.ndarray, n: int, cfg: SpikeConfig, fields: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flag (0 none, 2 spike, 3 stuck), predicted level and standardised innovation of each reading.

    series: 0..n-1, sorted, each in time order; v: readings in range. All series advance together. fields: the series are
    those of n / fields sources, field by field.
    """
    flag, level, score = np.zeros(len(v), np.int8), np.full(len(v), np.nan), np.zeros(len(v))
    if not len(v):
        return flag, level, score
    count = np.bincount(series, minlength=n)
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    same = np.concatenate([[False], series[1:] == series[:-1]])
    dx = np.where(same, v - np.concatenate([[0.0], v[:-1]]), 0.0)
    step = same & (np.abs(dx) > 1e-9)
    pairs = np.maximum(count - 1, 1)
    change = np.bincount(series[step], minlength=n) / pairs
    # runs of equal readings
    new = ~same | step
    run = np.cumsum(new) - 1
    length = np.bincount(run)
    long = length[run] >= cfg.stuck
    short_n = np.bincount(series[~long], minlength=n)
    short_runs = np.bincount(series[new & ~long], minlength=n)
    lively = (short_n >= 0.3 * count) & (short_n >= 10) & (short_runs >= cfg.lively * np.maximum(short_n, 1))
    quiet = ~lively & (change < 0.5)
    # how far readings otherwise move: of quiet fields only moves that last count
    lasting = step.copy()
    moves = [(series[step & ~quiet[series]], np.abs(dx[step & ~quiet[series]]))]
    inside = np.zeros(len(v), bool)
    for k in range(1, cfg.longest + 1):
        i = np.flatnonzero(step & quiet[series])
        i = i[(i + k < len(v)) & (i >= 1)]
        i = i[series[np.minimum(i + k, len(v) - 1)] == series[i - 1]]
        dev = np.min([np.abs(v[i + j] - v[i - 1]) for j in range(k)], axis=0) if len(i) else np.zeros(0)
        i = i[(dev > 1e-9) & (np.abs(v[i + k] - v[i - 1]) <= 0.3 * dev)]
        for j in range(k):
            inside[i + j] = True
    lasting &= ~inside & ~np.concatenate([[False], inside[:-1]])
    pick = lasting & quiet[series]
    moves.append((series[pick], np.abs(dx[pick])))
    ms, mx = np.concatenate([m[0] for m in moves]), np.concatenate([m[1] for m in moves])
    mid, high, nm = _median_by(ms, mx, n), _median_by(ms, mx, n, 0.9), np.bincount(ms, minlength=n)
    sd = np.where(quiet, np.sqrt(mid * high), mid / 0.6745)
    usable = (count >= 8) & (nm >= 1)
    sd = np.where(usable & (sd > 0), sd, np.inf)
    calm = np.where(quiet & (nm >= 2), sd, np.inf).reshape(fields, -1).min(axis=0)
    sd = np.where((count >= 8) & quiet, np.minimum(sd, np.tile(calm, fields)), sd)
    # a field that never moves otherwise is held against its source's steadiest field; where none moves, any excursion counts
    least = np.tile(np.where(count >= 8, sd, np.inf).reshape(fields, -1).min(axis=0), fields)
    sd = np.where((count >= 8) & quiet & ~np.isfinite(sd), np.where(np.isfinite(least), least, 1e-9), sd)
    bound = np.where(quiet, cfg.quiet_moves, cfg.spike_sd) * sd
    # noise share from the lag-one covariance of clipped moves: r = -cov, steady-state gain of the local-level model
    c = np.clip(np.where(np.isfinite(sd[series]), dx / sd[series], 0.0), -4, 4)
    both = same & np.concatenate([[False], same[:-1]])
    cov = np.bincount(series[both], (c * np.concatenate([[0.0], c[:-1]]))[both], minlength=n) / np.maximum(np.bincount(series[both], minlength=n), 1)
    var = np.bincount(series[same], (c * c)[same], minlength=n) / pairs
    r = np.clip(-cov, 0.02 * np.maximum(var, 1e-9), 0.45 * np.maximum(var, 1e-9))
    ratio = np.maximum(var - 2 * r, 0.05 * np.maximum(var, 1e-9)) / r
    gain = (ratio + np.sqrt(ratio**2 + 4 * ratio)) / (2 + ratio + np.sqrt(ratio**2 + 4 * ratio))
    gain = np.where(quiet, 1.0, gain)
    # the filters, longest series first, so that those still running are a prefix
    by = np.argsort(-count, kind="stable")
    st, ln, k_, b_, s_ = start[by], count[by], gain[by], bound[by], sd[by]
    m, pend, iv = v[np.minimum(st, len(v) - 1)].copy(), np.zeros(n, np.int64), np.ones(n)
    least = np.full(n, np.inf)  # of the withheld readings, the one nearest to the level
    spikes: list[tuple[np.ndarray, np.ndarray]] = []
    frozen = np.full(len(v), np.inf)
    active = np.searchsorted(-ln, -np.arange(1, int(ln[0]) + 1), side="right")
    for t in range(int(ln[0])):
        a = active[t]
        at = st[:a] + t
        x, mm, p = v[at], m[:a], pend[:a]
        e = x - mm
        ae = np.abs(e)
        level[at] = mm
        score[at] = e / s_[:a]
        big = ae > b_[:a]
        if big.any():
            turned = big & (p > 0) & (ae < 0.5 * least[:a])  # nearer to the old level than to the excursion: back, after a move
            back = (~big | turned) & (p > 0)
            if back.any():
                spikes.append((at[back], p[back].copy()))
            moved = turned | (big & (p >= cfg.longest))
            ok = ~big
            mm[ok] += (k_[:a] * e)[ok]
            mm[moved] = x[moved]
            p[:] = np.where(big & ~moved, p + 1, 0)
            least[:a] = np.where(p > 0, np.minimum(least[:a], ae), np.inf)
            iv[:a][ok] = (0.7 * iv[:a] + 0.3 * (e / s_[:a]) ** 2)[ok]
        else:
            if p.any():
                back = p > 0
                spikes.append((at[back], p[back].copy()))
                p[:] = 0
                least[:a] = np.inf
            mm += k_[:a] * e
            iv[:a] = 0.7 * iv[:a] + 0.3 * (e / s_[:a]) ** 2
        frozen[at] = iv[:a]
    # withheld updates whose level came back; exactly: off the reading before and the one after
    if spikes:
        after, width = np.concatenate([s[0] for s in spikes]), np.concatenate([s[1] for s in spikes])
        for k in range(1, cfg.longest + 1):
            q = after[width == k]
            before = q - k - 1
            ok = before >= 0
            q, before = q[ok], before[ok]
            ok = series[before] == series[q]
            q, before = q[ok], before[ok]
            for j in range(k):
                i = before + 1 + j
                dev = np.minimum(np.abs(v[i] - v[before]), np.abs(v[i] - v[q]))
                flag[i[dev >= bound[series[i]]]] = 2
    # where the innovation variance of a field that otherwise changes at nearly every reading has vanished, a run may be
    # stuck; exactly: at least ``stuck`` equal readings, all but the first
    gone = np.zeros(len(length), bool)
    gone[run[np.flatnonzero((frozen < cfg.vanished) & lively[series])]] = True
    gone &= length >= cfg.stuck
    flag[gone[run] & ~new & (flag == 0)] = 3
    return flag, level, score


def _flag_table(t: pa.Table, fields: int, cfg: SpikeConfig) -> pa.Table:
    """Flagged core readings of whole blocks; t is sorted by (src, block, ts, id)."""
    src, block = t["src"].combine_chunks(), t["block"].to_numpy()
    ids = t["id"].to_numpy()
    edge = np.concatenate([[True], pc.not_equal(src[1:], src[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])])
    again = ~edge & np.concatenate([[False], ids[1:] == ids[:-1]])
    group = np.cumsum(edge) - 1
    core = t["core"].to_numpy()
    n = int(group[-1]) + 1
    series, values, rows, which, ranged = [], [], [], [], []
    for f in range(fields):
        x = t[f"f{f}"].to_numpy()
        keep = np.flatnonzero(~np.isnan(x) & ~again)
        off = (x[keep] < cfg.low) | (x[keep] > cfg.high)
        ranged.append((keep[off], np.full(off.sum(), f)))
        keep = keep[~off & (block[keep] >= 0)]
        series.append(group[keep] + f * n)
        values.append(x[keep])
        rows.append(keep)
        which.append(np.full(len(keep), f))
    s, v, r, w = (np.concatenate(z) for z in (series, values, rows, which))
    flag, level, score = filter_series(s, v, n * fields, cfg, fields)
    hit = np.flatnonzero(flag)
    rr, rf = np.concatenate([z[0] for z in ranged]), np.concatenate([z[1] for z in ranged])
    row, field = np.concatenate([r[hit], rr]), np.concatenate([w[hit], rf])
    reason = np.concatenate([flag[hit], np.ones(len(rr), np.int8)])
    level, score = np.concatenate([level[hit], np.full(len(rr), np.nan)]), np.concatenate([score[hit], np.full(len(rr), np.nan)])
    mine = core[row]
    row, field, reason = row[mine], field[mine], reason[mine]
    value = np.empty(len(row))
    for f in range(fields):
        value[field == f] = t[f"f{f}"].to_numpy()[row[field == f]]
    null = lambda x: pa.array(x, mask=np.isnan(x))
    return pa.table({"id": ids[row], "src": pc.if_else(t["named"].combine_chunks().take(pa.array(row)), src.take(pa.array(row)), pa.scalar(None, pa.string())), "field": field.astype(np.int32), "reason": reason.astype(np.int32), "value": value, "level": null(level[mine]), "score": null(score[mine])})


def flag_implausible(df: DataFrame, id_col: str, source_col: str, ts_col: str, fields: list[str], cfg: SpikeConfig = SpikeConfig()) -> DataFrame:
    """One row per implausible reading: id, source, field, reason ('range', 'spike', 'stuck'), value, level, score.

    A reading is flagged if it lies outside the range; if its standardised innovation against a steady-state local-level
    filter of its source exceeds the bound, its update is withheld, and the level comes back within ``longest`` readings
    (moves that last are accepted as the new level); or if the innovation variance vanishes over ``stuck`` equal readings
    in a field that otherwise changes at nearly every reading (the first of them is kept).

    Nulls and NaN: a null reading is skipped; rows of null id never appear; rows of null source or time are only held
    against the range. A repeat of an id at the same time counts once. Ties in time are ordered by id. An empty table
    gives no rows. Sources with under eight readings of a field have no spikes. Other columns are ignored, whatever
    their names.
    """
    vals = [F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(fields)]
    base = df.where(F.col(id_col).isNotNull()).select(F.col(source_col).cast("string").alias("src"), F.col(ts_col).alias("ts"), F.col(id_col).cast("long").alias("id"), *vals)
    parts = _blocks(base, cfg).withColumn("named", F.col("src").isNotNull()).withColumn("src", F.coalesce("src", F.lit("")))
    parts = parts.withColumn("ts", F.unix_micros("ts")).repartition("src", "block").sortWithinPartitions("src", "block", "ts", "id")
    k = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ("src", "block"), 60_000):
            yield from _flag_table(t, k, cfg).to_batches()

    schema = "id long, src string, field int, reason int, value double, level double, score double"
    found = parts.mapInArrow(run, schema)
    names, reasons = F.array(*map(F.lit, fields)), F.array(*map(F.lit, REASONS))
    found = found.select("id", "src", names[F.col("field")].alias("field"), reasons[F.col("reason") - 1].alias("reason"), "value", "level", "score")
    both = found.dropDuplicates(["id", "field"])
    return both.select(F.col("id").alias(id_col), F.col("src").alias(source_col), "field", "reason", "value", "level", "score")


