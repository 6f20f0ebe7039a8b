import numpy as np

from tideglass.operators.spikes import SpikeConfig, filter_series, flag_implausible

S = "snapshot_id long, market_id string, us long, bid double, ask double, field string"


def frame(spark, rows):
    return spark.createDataFrame(rows, S).selectExpr("snapshot_id", "market_id", "timestamp_micros(us) ts", "bid", "ask", "field")


def walk(n, seed, step=0.004):
    rng = np.random.default_rng(seed)
    return np.clip(0.5 + np.cumsum(rng.normal(0, step, n)), 0.2, 0.8)


def flags(v, **cfg):
    v = np.asarray(v, float)
    return filter_series(np.zeros(len(v), np.int64), v, 1, SpikeConfig(**cfg))[0]


def test_spikes_of_up_to_three_readings():
    x = walk(400, 1)
    for at, k in ((50, 1), (120, 2), (200, 3)):
        x[at : at + k] += 0.1
    got = np.flatnonzero(flags(x) == 2).tolist()
    assert got == [50, 120, 121, 200, 201, 202]


def test_moves_that_last_are_no_spikes():
    x = walk(400, 2)
    x[150:] += 0.1
    x[300:304] += 0.1  # four readings: longer than a spike
    assert not (flags(x) == 2).any()


def test_quiet_fields():
    x = np.full(300, 0.4)
    x[40:] = 0.41
    x[90:] = 0.42
    x[160:] = 0.41
    x[200] = 0.48
    assert np.flatnonzero(flags(x)).tolist() == [200]
    y = np.full(100, 0.4)
    y[50] = 0.6
    assert np.flatnonzero(flags(y)).tolist() == [50]


def test_frozen_runs_only_in_lively_fields():
    x = walk(300, 3)
    x[100:120] = x[100]
    assert np.flatnonzero(flags(x) == 3).tolist() == list(range(101, 120))
    x[200:214] = x[200]  # fourteen equal readings
    assert np.flatnonzero(flags(x) == 3).tolist() == list(range(101, 120))


def test_no_readings_and_few():
    assert len(flags([])) == 0
    assert not flags([0.5]).any() and not flags([0.5, 0.9, 0.5]).any()


def brute(v):
    """Excursions of up to three readings off both neighbours by eight times the median move."""
    q = np.median(np.abs(np.diff(v))[np.abs(np.diff(v)) > 1e-9])
    out = set()
    for k in (1, 2, 3):
        for i in range(1, len(v) - k):
            dev = min(min(abs(v[i + j] - v[i - 1]), abs(v[i + j] - v[i + k])) for j in range(k))
            if dev > 8 * q and abs(v[i + k] - v[i - 1]) < 0.5 * dev:
                out |= set(range(i, i + k))
    return out


def test_equals_brute_force_on_many_series():
    rng = np.random.default_rng(4)
    for seed in range(20):
        x = walk(500, 100 + seed)
        for at in rng.choice(np.arange(10, 480, 12), 8, replace=False):
            x[at : at + int(rng.integers(1, 4))] += rng.choice([-1, 1]) * rng.uniform(0.08, 0.3)
        x = np.clip(x, 0, 1)
        assert set(np.flatnonzero(flags(x) == 2).tolist()) == brute(x)


def test_blocks_of_a_hot_source_agree_with_one_block(spark, rows):
    x = walk(3000, 7, 0.001)
    x[[511, 512, 1023, 1500, 2047]] += 0.2
    x[2040:2046] += 0.1
    x[1000:1030] = x[1000]
    data = [(i, "hot", i * 7_000_000, float(v), None, "f") for i, v in enumerate(x)] + [(9000 + i, f"cold{i}", i, 0.5, 0.6, "f") for i in range(5)]
    df = frame(spark, data)
    whole = rows(flag_implausible(df, "snapshot_id", "market_id", "ts", ["bid", "ask"]), "snapshot_id", "field", "reason")
    parts = rows(flag_implausible(df, "snapshot_id", "market_id", "ts", ["bid", "ask"], SpikeConfig(block_rows=512)), "snapshot_id", "field", "reason")
    assert whole == parts and len(whole) > 30


def test_cases_of_tables(spark, rows):
    x = walk(60, 9)
    data = [(i, "a", i * 1_000_000, float(v), None, "f") for i, v in enumerate(x)]
    data[30] = (30, "a", 30_000_000, 999.0, 0.5, "f")
    data += [data[30], (None, "a", 5, 999.0, 0.5, "f"), (100, None, 5, -1.0, 0.5, "f"), (101, "a", None, 2.0, float("nan"), "f"), (102, None, 5, 0.5, None, "f")]
    got = rows(flag_implausible(frame(spark, data), "snapshot_id", "market_id", "ts", ["bid", "ask"]), "snapshot_id", "field", "reason")
    assert got == [(100, "bid", "range"), (101, "bid", "range"), (30, "bid", "range")]
    assert flag_implausible(frame(spark, []), "snapshot_id", "market_id", "ts", ["bid"]).count() == 0
