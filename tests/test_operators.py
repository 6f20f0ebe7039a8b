"""Operators over series, quotes, texts and studies: hand-worked values, brute force and closed forms."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideglass.functions import num, vectors as V
from tideglass.operators import bars as B
from tideglass.operators import event_study as E
from tideglass.operators import pairs as P
from tideglass.operators import quotes as Q
from tideglass.operators import scoring as S
from tideglass.operators import search as R
from tideglass.operators import simulate as M
from tideglass.operators import touch as T
from tideglass.operators import transcripts as X
from tideglass.operators import vol as Vol
from tideglass.operators.ordered import asof, last_known, running_sum

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_normal_integral(spark):
    x = np.array([-40.0, -9, -7.2, -3, -1, -0.1, 0, 0.5, 2, 8])
    want = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    assert np.allclose(V.ndtr(x), want, rtol=1e-8, atol=1e-15)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = [r[0] for r in df.select(num.ndtr(F.col("x"))).collect()]
    assert np.allclose(got, want, rtol=1e-8, atol=1e-15)
    tails = [r[0] for r in df.select(num.log_ndtr(F.col("x"))).collect()]
    assert np.allclose(tails[1:], np.log(want[1:]), rtol=1e-6) and tails[0] == pytest.approx(-804.6084, abs=1e-3)
    assert np.allclose(V.log_ndtr(x), tails, rtol=1e-9)


def test_special_functions():
    assert V.gamma_p(3.0, 2.5) == pytest.approx(1 - math.exp(-2.5) * (1 + 2.5 + 2.5**2 / 2))
    assert V.gamma_p(np.array([900.0]), np.array([900.0]))[0] == pytest.approx(0.5044, abs=1e-3)
    assert V.beta_i(2.0, 3.0, 0.4) == pytest.approx(0.5248)
    q = V.beta_quantile(np.array([0.05, 0.5, 0.95]), 2.0, 3.0)
    assert np.allclose(V.beta_i(2.0, 3.0, q), [0.05, 0.5, 0.95])
    g = V.inverse_gamma_quantile(np.array([0.1, 0.9]), 4.0, 2.0)
    assert np.allclose(1 - V.gamma_p(4.0, 2.0 / g), [0.1, 0.9])


def test_interpolation(spark):
    df = spark.createDataFrame([(0.0,), (1.5,), (4.0,), (9.0,)], "x double")
    assert [r[0] for r in df.select(num.interpolate(F.col("x"), [1, 2, 4], [10, 20, 0])).collect()] == [10, 15, 0, 0]


def test_running_sum_and_last_known_over_blocks(spark):
    rng = np.random.default_rng(1)
    data = [(str(rng.choice(["a", "hot"], p=[0.1, 0.9])), int(t), None if rng.random() < 0.3 else float(rng.integers(0, 9))) for t in range(300)]
    data += [(None, 5, 1.0), (None, 500, 2.0)]
    df = spark.createDataFrame(data, "k string, t long, v double")
    block = F.floor(F.col("t") / 17)
    sums = running_sum(df, "k", ["t"], block, {"s": F.col("v")}).toPandas()
    last = last_known(df, "k", ["t"], block, {"l": F.col("v")}).toPandas()
    past = last_known(df, "k", ["t"], block, {"l": F.col("v")}, strict=True).toPandas()
    assert len(sums) == len(last) == len(data)
    for k in ("a", "hot", None):
        p = pd.DataFrame([r for r in data if r[0] == k], columns=["k", "t", "v"]).sort_values("t")
        pick = lambda d: d[d["k"].isna() if k is None else d["k"] == k].sort_values("t")
        assert np.allclose(pick(sums)["s"], p["v"].fillna(0).cumsum())
        assert np.allclose(pick(last)["l"], p["v"].ffill(), equal_nan=True)
        assert np.allclose(pick(past)["l"], p["v"].ffill().shift(), equal_nan=True)


def test_asof_before_and_at(spark, rows):
    left = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(5)), (3, "a", at(9)), (4, "b", at(1)), (5, None, at(1)), (6, "a", None)], "id int, k string, ts timestamp")
    right = spark.createDataFrame([("a", at(5), 1.0), ("a", at(5), 2.0), ("a", at(7), 3.0), (None, at(0), 9.0)], "k string, ts timestamp, v double")
    assert rows(asof(left, right, "k", "ts", "v", "v"), "id", "v") == [(1, None), (2, 2.0), (3, 3.0), (4, None), (5, None), (6, None)]
    assert rows(asof(left, right, "k", "ts", "v", "v", inclusive=False), "id", "v") == [(1, None), (2, None), (3, 3.0), (4, None), (5, None), (6, None)]


TICK = "asset string, ts timestamp, price double, volume double, id long"


def ticks(spark, n=600):
    return spark.createDataFrame([("a", at(i), 100.0 + i % 5, 1.0 + i % 3, i) for i in range(n)], TICK)


def test_time_and_dollar_bars(spark):
    t = ticks(spark)
    h = B.time_bars(t, 3600).orderBy("bar").collect()
    assert len(h) == 10 and (h[0].open, h[0].high, h[0].low, h[0].close, h[0].n_trades) == (100.0, 104.0, 100.0, 104.0, 60)
    d = B.dollar_bars(t, 20).toPandas().sort_values("bucket")
    p = t.toPandas().sort_values("id")
    value = p.price * p.volume
    bucket = np.floor(value.cumsum() * 20 / value.sum() + 1e-12).astype(int)
    want = p.groupby(bucket).agg(open=("price", "first"), close=("price", "last"), n=("id", "size"))
    assert d.bucket.tolist() == want.index.tolist() and d.bucket.max() == 20
    assert d.n_ticks.tolist() == want.n.tolist() and d.open.tolist() == want.open.tolist() and d.close.tolist() == want.close.tolist()


def test_common_window_and_runs(spark, rows):
    t = spark.createDataFrame([("a", at(0), 1.0, 1.0, 1), ("a", at(5), 1.0, 1.0, 2), ("a", at(9), 2.0, 1.0, 3), ("b", at(5), 7.0, 1.0, 4), ("b", at(20), 7.0, 1.0, 5)], TICK)
    assert rows(B.common_window(t), "id") == [(2,), (3,), (4,)]
    assert rows(B.run_lengths(t)) == [("a", 1, 1), ("a", 2, 1), ("b", 2, 1)]
    assert rows(B.bar_gaps(B.time_bars(t, 60)).where("gap_h is null"), "asset") == [("a",), ("b",)]


def hours(n, seed=0, asset="a"):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.004, n)))
    return [(asset, i, T0 + dt.timedelta(hours=i), float(c[i] * 1.002), float(c[i] * 0.998), float(c[i]), float(0.004**2 * rng.chisquare(1)), True, T0) for i in range(n)]


GRID = "asset string, h int, ts timestamp, high double, low double, close double, rv double, traded boolean, ingested_at timestamp"


def test_linear_recursion_matches_a_loop(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=700)
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, i long, x double")
    for a in (0.94, 0.05):  # the second overflows a closed form over the whole series
        got = Vol.linear_recursion(df, "k", "i", F.col("x"), a, start=2.0).orderBy("i").toPandas()["y"].to_numpy()
        y, want = 2.0, []
        for v in x:
            y = a * y + v
            want.append(y)
        assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_features_do_not_look_ahead(spark):
    a = hours(400, 1)
    b = a[:300] + [(*r[:5], r[5] * 3, r[6] * 9, *r[7:]) for r in a[300:]]
    f = [Vol.features(spark.createDataFrame(x, GRID), 168).where("h <= 300").select("h", "vol", "rv1", "rv7", "ewma_vol", "alpha", "beta", "coverage").orderBy("h").toPandas() for x in (a, b)]
    pd.testing.assert_frame_equal(*f)
    r = np.diff(np.log([x[5] for x in a]), prepend=np.log(a[0][5]))
    assert f[0]["vol"].iloc[200] == pytest.approx(np.std(r[32:200], ddof=1) * math.sqrt(8760), rel=1e-9)


CFG = T.TouchConfig(warmup_h=168, horizons_d=(1, 2), z=(0.5, 1.0), fold_h=336, least_train=50)


def test_labels_equal_a_scan(spark):
    data = hours(420, 2)
    u = T.universe(spark.createDataFrame(data, GRID), CFG).collect()
    assert len(u) > 100
    for r in u:
        span = data[r.anchor : r.anchor + 24 * r.horizon_d]
        assert r.s0 == data[r.anchor - 1][5] and r.resolve == r.anchor + 24 * r.horizon_d
        assert r.label == int(max(x[3] for x in span) >= r.k if r.direction > 0 else min(x[4] for x in span) <= r.k)


def test_touch_probability_against_paths(spark):
    p = M.touch_by_paths(spark, 20_000, 60, 0.1, 0.8, 0.2).first()
    exact = float(V.touch(100.0, 100 * math.exp(0.2), 0.8, 0.1, 1.0))
    assert abs(p.probability - exact) < 4 * p.se + 1e-9 and p.ended < p.probability
    df = spark.createDataFrame([(100.0, 100 * math.exp(0.2), 0.1, 1), (100.0, 90.0, 0.1, 1), (100.0, 90.0, 0.0, -1)], "s0 double, k double, t double, direction int")
    got = [r.p for r in T.with_touch(df, {"p": F.lit(0.8)}).collect()]
    assert got[0] == pytest.approx(exact, abs=1e-9) and got[1:] == [1.0, 0.0]
    e = M.first_exit_by_paths(spark, 4000, 800, 4.0, 0.5, -0.2, 0.2).first()
    assert e.above + e.below == pytest.approx(1, abs=0.02) and abs(e.above - float(spark.range(1).select(T.first_exit_upper(F.lit(100.0), F.lit(100 * math.exp(-0.2)), F.lit(100 * math.exp(0.2)), F.lit(0.5))).first()[0])) < 0.05


def test_har_fit_equals_least_squares(spark):
    rows = T.har_rows(spark.createDataFrame(hours(500, 4), GRID), CFG)
    got = {r.horizon_d: r for r in T.fit_har(rows, ["horizon_d"]).collect()}
    p = rows.toPandas()
    for d, g in p.groupby("horizon_d"):
        x = np.column_stack([np.ones(len(g)), g[["x1", "x2", "x3"]]])
        c, *_ = np.linalg.lstsq(x, g["target"], rcond=None)
        assert np.allclose([got[d].c0, got[d].c1, got[d].c2, got[d].c3], c, rtol=1e-4, atol=1e-5)
        assert got[d].spread == pytest.approx(np.std(g["target"] - x @ c), rel=1e-4)


def test_walk_forward_uses_the_past_only(spark):
    a = hours(700, 5)
    b = a[:504] + [(*r[:6], r[6] * 50, *r[7:]) for r in a[504:]]
    cfg = T.TouchConfig(warmup_h=168, horizons_d=(1, 2), z=(0.5, 1.0), fold_h=504, least_train=50)
    f = [T.walk_forward(spark.createDataFrame(x, GRID), cfg).where("anchor = 504").orderBy("horizon_d", "z", "direction").toPandas() for x in (a, b)]
    assert len(f[0]) and np.allclose(f[0]["har_mix"], f[1]["har_mix"]) and (f[0]["fold"] == 1).all()


def test_hysteresis_equals_a_state_machine(spark):
    rng = np.random.default_rng(6)
    z = rng.normal(0, 1.5, 400).round(3)
    df = spark.createDataFrame([("p", i, None if i < 5 else float(v)) for i, v in enumerate(z)], "pair string, i long, z double")
    got = [r.pos for r in P.positions(df, 2.0, 0.5).orderBy("i").collect()]
    state, want = 0.0, []
    for i, v in enumerate(z):
        if i < 5:
            want.append(0.0)
            continue
        if state == 0:
            state = -1.0 if v >= 2 else 1.0 if v <= -2 else 0.0
        elif abs(v) <= 0.5:
            state = 0.0
        want.append(state)
    assert got == want
    with pytest.raises(ValueError):
        P.positions(df, 0.5, 0.5)


@pytest.mark.parametrize(("z", "want"), [([None, -2.5, -0.3, 0.0, 0.0], (2, "profit_take")), ([None, -2.5, -3.0, -4.5, -5.0], (3, "stop_loss")), ([None] + [-2.5] * 10, (4, "timeout"))])
def test_barriers(spark, z, want):
    df = spark.createDataFrame([("p", i, v, 0.0 if i == 0 else 1.0) for i, v in enumerate(z)], "pair string, i long, z double, pos double")
    r = P.triple_barrier(df, 0.5, 4.0, 3).collect()
    assert [(x.exit, x.outcome) for x in r] == [want]


def test_costs_and_zscore(spark):
    df = spark.createDataFrame([("p", i, 100.0, 50.0, 1.0, v) for i, v in enumerate([1.0, -1.0, -1.0, 0.0])], "pair string, i long, a double, b double, h double, pos double")
    b = P.backtest(df, 10.0).orderBy("i").toPandas()
    assert np.allclose(-b["net"] * 1e4, [0, 10, 20, 0])
    s = [0.0] * 20 + [5.0] * 10 + [0.0] * 20
    z = P.zscore(spark.createDataFrame([("p", i, v) for i, v in enumerate(s)], "pair string, i long, spread double"), 10).orderBy("i").toPandas()["z"]
    assert z[:10].isna().all() and z[20] == 0 and z[21] > 0


def test_kalman_and_cointegration():
    rng = np.random.default_rng(8)
    b = 50 + np.cumsum(rng.normal(size=600))
    a = 2 * b + 3 + rng.normal(0, 0.5, 600)
    s = P.kalman_filter(a, b)
    assert abs(s[-1, 0] - 2) < 0.1
    assert P.engle_granger(a, b)[1] < 0.01 and P.engle_granger(np.cumsum(rng.normal(size=600)), b)[1] > 0.05
    assert P.mackinnon_p(-3.43) == pytest.approx(0.01, abs=0.002) and P.mackinnon_p(-2.86) == pytest.approx(0.05, abs=0.003)
    w = P.sample_windows(100, 30, 10, 1)
    assert len(set(w)) == 10 and all(e - s == 30 and e <= 100 for s, e in w)
    assert P.newey_west_mean(np.ones(10) + rng.normal(0, 1e-6, 10))[1] > 100


def test_scores(spark):
    rng = np.random.default_rng(9)
    p = rng.uniform(0.05, 0.95, 4000)
    y = (rng.random(4000) < p).astype(int)
    z = np.log(p / (1 - p)) * 2
    df = spark.createDataFrame([("m", float(a), int(b), int(i % 40)) for i, (a, b) in enumerate(zip(1 / (1 + np.exp(-z)), y))], "g string, p double, y int, week int")
    c = S.calibration(df, ["g"]).first()
    assert c.slope == pytest.approx(0.5, abs=0.06) and abs(c.intercept) < 0.12
    parts = S.brier_parts(df, ["g"]).first()
    brier = df.selectExpr("avg(pow(p - y, 2))").first()[0]
    assert parts.reliability - parts.resolution + parts.uncertainty == pytest.approx(brier, abs=0.003)
    b = S.cluster_bootstrap(S.cluster_sums(df, F.col("p"), F.lit(0.5), "week", ["g"]), ["g"]).first()
    assert b.ci_low < b.diff < b.ci_high and b.clusters == 40
    e = spark.createDataFrame([(0.1,), (0.3,), (0.30000000000000004,), (1.0,), (0.0,)], "p double")
    assert [r[0] for r in e.select(S.bin_of(F.col("p"))).collect()] == [1, 2, 3, 9, 0]


def test_quotes(spark, rows):
    q = [0.0035, 0.0055, 0.435, 0.555, 0.0085]
    o = [("e", str(i), x) for i, x in enumerate(q)] + [("f", "0", 0.2), ("f", "1", 0.3), ("g", "0", None), ("h", "0", 1.0), ("h", "1", 0.5)]
    n = Q.normalise(spark.createDataFrame(o, "e string, o string, q double"), "e", "o", "q").orderBy("e", "o").toPandas().set_index("e")
    for p in (n.loc["e", "power"].to_numpy(), n.loc["e", "shin"].to_numpy()):
        assert p.sum() == pytest.approx(1) and (np.diff(p)[[1, 2]] > 0).all()
    k = np.log(n.loc["e", "power"].to_numpy()) / np.log(q)
    assert np.allclose(k, k[0]) and 0 < n.loc["e", "insider"].iloc[0] < 0.1
    assert n.loc["f", "power"].tolist() == n.loc["f", "shin"].tolist() == pytest.approx([0.4, 0.6]) and np.isnan(n.loc["g", "power"])
    assert n.loc["h", "power"].tolist() == pytest.approx([2 / 3, 1 / 3]) and n.loc["h", "shin"].sum() == pytest.approx(1)
    v = np.random.default_rng(1).random(9)
    fit = Q.isotonic_decreasing(v)
    assert (np.diff(fit) <= 1e-12).all() and all(np.mean(v[fit == x]) == pytest.approx(x) for x in set(fit.tolist()))
    assert np.allclose(Q.isotonic_decreasing([0.9, 0.5, 0.6, 0.1]), [0.9, 0.55, 0.55, 0.1])
    assert len(Q.isotonic_decreasing([])) == 0
    df = spark.createDataFrame([("e", 1.0, 0.9), ("e", 2.0, 0.5), ("e", 3.0, 0.6), ("e", 4.0, 0.1), ("f", 1.0, None)], "e string, s double, p double")
    r = Q.repair_ladders(df, "e", "s", "p").collect()
    assert sorted(round(x.fitted, 2) for x in r) == [0.1, 0.55, 0.55, 0.9] and r[0].violations == 1
    old = spark.createDataFrame([(1, "a", 5.0, None), (2, "b", 6.0, True)], "k int, title string, strike double, res boolean")
    new = spark.createDataFrame([(1, "A", 9.0, False), (2, None, 9.0, None), (3, "c", 7.0, None)], "k int, title string, strike double, res boolean")
    assert rows(Q.upsert(old, new, ["k"], ["title"], ["res"])) == [(1, "A", 5.0, False), (2, None, 6.0, True), (3, "c", 7.0, None)]
    assert rows(Q.insert_ignore(old, new.union(new), ["k"]), "k", "strike") == [(1, 5.0), (2, 6.0), (3, 7.0)]
    m = spark.createDataFrame([(0.4, 0.46, 0.1), (0.1, 0.5, 0.2), (None, 0.5, 0.3)], "b double, a double, l double")
    assert [round(x[0], 2) for x in m.select(Q.mid_price(F.col("b"), F.col("a"), F.col("l"))).collect()] == [0.43, 0.2, 0.3]


def test_event_studies(spark):
    bars = spark.createDataFrame([("a", at(59), 100.0), ("a", at(60), 101.0), ("a", at(119), 108.0), ("a", at(120), 110.0)], "k string, ts timestamp, p double")
    ev = spark.createDataFrame([(1, "a", at(60)), (2, "a", at(10)), (3, "a", at(100))], "id int, k string, ts timestamp")
    got = {r.id: r.ret1 for r in E.forward_return(ev, bars, "k", "ts", "p", [1]).collect()}
    assert got[1] == pytest.approx(0.10) and got[2] is None and got[3] is None
    p = spark.createDataFrame([(i, v, 0) for i, v in enumerate([0.04, 0.01, 0.5, 0.02, 0.03])], "i int, p double, g int")
    assert {r.i: r.kept for r in E.benjamini_hochberg(p, "p", ["g"]).collect()} == {0: True, 1: True, 2: False, 3: True, 4: True}
    k = spark.createDataFrame(list(zip("AABBA", "ABBBA")), "a string, b string")
    assert E.kappa(k, "a", "b").first().kappa == pytest.approx(0.32 / 0.52)
    b = spark.createDataFrame([(1, 0, 2.0, 0.02), (2, 0, 0.0, 0.01)], "i int, g int, s double, r double")
    assert [round(x.net, 9) for x in E.bets(b, ["g"], "i", "s", "r", 100.0, 1.0).orderBy("i").collect()] == [0.0, 0.0]
    rng = np.random.default_rng(2)
    s = rng.normal(size=200)
    ic = E.rank_ic(spark.createDataFrame([(0, i, float(a), float(a + e)) for i, (a, e) in enumerate(zip(s, rng.normal(size=200)))], "g int, i int, s double, r double"), ["g"], "i", "s", "r").first()
    assert 0.5 < ic.ic < 0.9 and ic.p_value < 1e-6


def test_search(spark, rows):
    d = spark.createDataFrame([(0, "alpha beta alpha"), (1, "gamma delta beta"), (2, None), (3, "")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "alpha"), (8, "alpha ALPHA"), (9, "zzz")], "qid long, text string")
    got = rows(R.bm25(d.where("doc_id < 2"), q, "doc_id", "text", "qid", "text"))
    assert [(a, b) for a, b, _, _ in got] == [(7, 0), (8, 0)]
    want = math.log(1 + (2 - 1 + 0.5) / 1.5) * 2 * 2.5 / (2 + 1.5)
    assert got[0][2] == pytest.approx(want, abs=1e-8) and got[1][2] == pytest.approx(2 * want, abs=1e-8)
    assert R.bm25(d, q.limit(0), "doc_id", "text", "qid", "text").count() == 0 and R.bm25(d.limit(0), q, "doc_id", "text", "qid", "text").count() == 0
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query long, doc long, rank int")
    b = spark.createDataFrame([(1, 2, 1), (1, 1, 2)], "query long, doc long, rank int")
    assert [r[2] for r in rows(R.fuse([a, b], k=0))] == [1.5, 1.5]
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query long, doc long, rank int")
    m = R.ir_metrics(ranked, spark.createDataFrame([(1, 10), (1, 12)], "query long, doc long")).first()
    assert m.ndcg == pytest.approx(1.5 / (1 + 1 / math.log2(3))) and (m.recall, m.precision, m.mrr) == (1.0, 0.2, 1.0)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0])], "i long, v array<float>")
    assert [r[:2] for r in rows(R.cosine(v, v.where("i = 1"), "i", "v", "i"))] == [(1, 1), (1, 2)]
    text = "intro\n# One\nbody\n```\n# no heading\n```\n## Two\n\n# Three\nlast"
    c = rows(R.chunks(spark.createDataFrame([(1, text)], "d long, t string"), "d", "t"), "chunk", "heading")
    assert c == [(0, None), (1, "One"), (3, "Three")]


def test_transcripts(spark, rows):
    t = "user: see it?\ntool: get_file(notes/a.md) returned 3 lines.\nassistant: yes [source: notes/a.md], and (notes/b.md).\nother line"
    d = spark.createDataFrame([(1, t), (2, "assistant: nothing")], "d long, t string")
    assert rows(X.citations(X.turns(d, "d", "t"))) == [(1, 2, 1, 0.5), (2, 0, 0, 1.0)]
    f = spark.createDataFrame([("x", 1, "a", "lookahead leaks through embargo window"), ("x", 2, "b", "embargo window leaks lookahead badly"), ("x", 3, "b", "unrelated finding entirely"), ("x", 4, "a", "Lookahead leaks, embargo!")], "audit string, i long, checker string, t string")
    assert rows(X.similar_links(f, "i", "t", "checker")) == [(1, 1), (2, 2), (3, 0), (4, 1)]
    got = {r.i: (r.group, r.convergent) for r in X.merge_findings(f, "audit", "i", "t", "checker").collect()}
    assert got == {1: (1, True), 2: (1, True), 3: (3, False), 4: (4, False)}
    k = spark.createDataFrame([("The HEDGE ratio", ["hedge", "candle"]), ("x", [])], "t string, k array<string>")
    assert [r[0] for r in k.select(X.keyword_recall(F.col("t"), F.col("k"))).collect()] == [0.5, 1.0]


def test_beliefs(spark):
    ranks = np.bincount([r["rank"] for r in M.calibration_ranks(spark, 1500, draws=9).collect()], minlength=10)
    assert ranks.sum() == 1500 and abs(ranks - 150).max() < 60
    r = spark.createDataFrame([("a", float(x)) for x in np.random.default_rng(1).normal(0, 0.01, 300)], "k string, r double")
    b = M.variance_belief(r, "k", "r").first()
    assert b.low < math.sqrt(b.variance) < b.high and b.high < 0.011
    j = M.jump_split(r.union(spark.createDataFrame([("a", 0.3)] * 4, "k string, r double")), "k", "r", 1 / 8760).first()
    assert j.jumps == 4 and j.jump_mean == pytest.approx(0.3)
    iv = spark.createDataFrame([(float(V.touch(100.0, 105.0, 0.7, 0.02, 1.0)),), (1.5,)], "p double").select(M.implied_volatility(F.col("p"), F.lit(100.0), F.lit(105.0), F.lit(0.02))).collect()
    assert iv[0][0] == pytest.approx(0.7, abs=1e-6) and iv[1][0] is None


def test_order_key(spark):
    top = 2**63 - 1
    rows = [(None, 0), (-5, top), (0, -top), (0, 0), (0, top), (1, -5), (4 * 10**15, 7)]
    df = spark.createDataFrame(rows, "us long, id long").select(num.order_key(F.col("us"), F.col("id")).alias("k"))
    got = [r.k for r in df.collect()]
    assert got == sorted(got) and len(set(got)) == len(rows)
