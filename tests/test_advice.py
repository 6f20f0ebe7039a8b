"""Whole results where an earlier version left rows out."""

import json

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.test_entry import SF, duck, needs_data, plain  # noqa: F401
from tests.test_operators import GRID, hours
from tideglass.operators import pairs as P
from tideglass.operators import simulate as M
from tideglass.operators import touch as T
from tideglass.operators import unnest as N

CFG = T.TouchConfig(warmup_h=168, horizons_d=(1, 2), z=(0.5, 1.0), fold_h=336, least_train=50)


def test_base_rates_have_no_constant_cutoff(spark):
    grid = spark.createDataFrame(hours(1500, 3) + hours(900, 4, "b"), GRID)
    u = T.universe(grid, CFG).toPandas()
    assert (u["resolve"] >= 1000).any()
    got = {(None if pd.isna(r.fold) else int(r.fold), r.horizon_d, r.direction, r.z): (r.rate, r.n) for r in T.base_rates_by_fold(T.universe(grid, CFG), CFG.fold_h).collect()}
    want = {}
    for fold in [None, *sorted(set(u["fold"]))]:
        past = u if fold is None else u[u["resolve"] < fold * CFG.fold_h]
        want |= {(fold, *k): (pytest.approx(g["label"].mean()), len(g)) for k, g in past.groupby(["horizon_d", "direction", "z"])}
    assert got == want
    assert sum(n for (fold, *_), (_, n) in got.items() if fold is None) == len(u)
    w = T.walk_forward(grid, CFG).select("fold", "horizon_d", "direction", "z", "base_rate").distinct().collect()
    assert w and all(got[tuple(r)[:4]][0] == pytest.approx(r.base_rate) for r in w)


@needs_data
def test_base_rates_by_fold_equals_sql(spark, duck):  # noqa: F811
    a, b = entry.queries()["base_rates_by_fold"](spark, SF).toPandas(), duck.execute(entry.oracle_sql()["base_rates_by_fold"]).df()
    assert len(a) and plain(a) == plain(b)


def test_jump_threshold_is_exact_for_many_returns(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.uniform(-1, 1, 120_000), rng.uniform(-8, 8, 80_001)])
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "r": x}))
    d = np.abs(x - np.median(x))
    want = int((d > 4.5 * 1.4826 * np.median(d)).sum())
    assert M.jump_split(df, "k", "r", 1 / 8760).first().jumps == want


def test_records_deeper_than_the_json_reader():
    n = 20_000
    while True:
        try:
            json.loads('{"a":' * n + "7" + "}" * n)
            n *= 2
        except RecursionError:
            break
    deep = '{"a":' * n + "7" + "}" * n
    for record in (deep, json.dumps(deep), '{"x": ' + json.dumps(deep) + "}"):
        out = []
        N.triples(1, record, N.NestConfig(), lambda *r: out.append(r))
        leaves = [r for r in out if r[-1] == "number"]
        assert [r[6] for r in leaves] == ["7"] and leaves[0][5].count("a") == n
    out = []
    N.triples(1, deep[:-1], N.NestConfig(), lambda *r: out.append(r))
    assert not out


def leaves(record, cfg=N.NestConfig()):
    out = []
    N.triples(1, record, cfg, lambda *r: out.append(r))
    return out


def test_broken_records_give_nothing():
    for s in ["", "[", "[1,]", '{"a" 1}', '{"a":1,}', "{1:2}", "[1] 2", '{"a":}', "[1 2]", '["x]', "]", '{"a":[1}', '{"a":01}', '{"a":tru}', '["\t"]', '{"a":{"b":1}']:
        with pytest.raises(ValueError):
            json.loads(s)
        assert leaves(s) == [], s


def test_triples_equal_a_walk_over_the_parsed_record():
    import random

    r = random.Random(4)
    names = ["a", "b", "a.b", "c[]", "x\\y", "é", ""]

    def value(depth):
        x = r.random()
        if depth and x < 0.35:
            return {r.choice(names): value(depth - 1) for _ in range(r.randrange(4))}
        if depth and x < 0.6:
            return [value(depth - 1) for _ in range(r.randrange(4))]
        return r.choice([None, True, False, 3, -17, 2.5, 1e30, "s", "two words", "5", "[x", "{y"])

    def walk(v, node, name):
        """Node path, leaf name and text of every leaf, by recursion."""
        esc = lambda k: k.replace("\\", "\\\\").replace(".", "\\.").replace("[", "\\[").replace("]", "\\]")
        if isinstance(v, dict):
            for k, x in v.items():
                yield from walk(x, node, f"{name}.{esc(k)}" if name else esc(k))
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from walk(x, f"{node}.{name}[{i}]" if name else f"{node}[{i}]", "")
        elif v is not None:
            yield node, name or "value", v if isinstance(v, str) else json.dumps(v)

    for _ in range(300):
        v = [value(4), {"k": value(4)}]
        got = [(x[2], x[5], x[6]) for x in leaves(json.dumps(v, indent=r.choice([None, 2]))) if x[7] in ("string", "number", "bool")]
        assert got == list(walk(v, "$", ""))


def test_names_with_dots_and_lists_in_strings():
    got = {(x[5], x[6]) for x in leaves('{"a.b": 5, "a": {"b": 6}}') if x[7] == "number"}
    assert got == {("a\\.b", "5"), ("a.b", "6")}
    got = [x for x in leaves('{"id": 7, "prices": "[\\"0.2\\", \\"0.8\\"]", "note": "[sic] so"}')]
    assert [x[6] for x in got if x[1] == "$.prices[]" and x[7] == "string"] == ["0.2", "0.8"]
    assert {(x[5], x[6]) for x in got if x[2] == "$" and x[7] == "string"} == {("prices", '["0.2", "0.8"]'), ("note", "[sic] so")}
    got = leaves('{"events": [{"markets": {"x": {"ticker": "M1", "id": 3}, "y": null, "z": {"ticker": "M2"}}, "event_ticker": "E"}]}')
    assert [(x[2], x[5], x[6]) for x in got if x[7] == "ref"] == [("$.events[0]", "ref", "E"), ("$.events[0].markets[0]", "^ref", "E"), ("$.events[0].markets[0]", "ref", "M1"), ("$.events[0].markets[2]", "^ref", "E"), ("$.events[0].markets[2]", "ref", "M2")]


@needs_data
def test_pair_scan_takes_every_pair(spark):
    from tideglass.plans.pairs import _hours, _rows

    d = SF.replace("sf0.001", "sf0.01")  # the smallest tables have two assets
    names = sorted(r[0] for r in _hours(spark, d).groupBy("asset").count().collect())
    got = entry.queries()["pair_scan"](spark, d).toPandas()
    assert len(names) > 2 and set(got["pair"]) == {f"{a}-{b}" for k, a in enumerate(names) for b in names[k + 1 :]}
    near = P.scan(_rows(spark, d), 120, 12).toPandas().sort_values(["pair", "start"])
    same = P.scan_all(_hours(spark, d), 120, 12).toPandas().sort_values(["pair", "start"])
    pd.testing.assert_frame_equal(same[same["pair"].isin(near["pair"])].reset_index(drop=True), near.reset_index(drop=True))


@needs_data
def test_touch_by_paths_at_each_assets_volatility(spark):
    from tideglass.plans.studies import _hourly_returns

    r = _hourly_returns(spark, SF).toPandas().groupby("asset")["r"].std() * 8760**0.5
    got = entry.queries()["touch_by_paths"](spark, SF).toPandas()
    assert sorted(zip(got["asset"], got["kind"])) == sorted((a, k) for a in r.index for k in ("gbm", "merton"))
    assert np.allclose(got["sigma"], r[got["asset"]])
    g = got[got["kind"] == "gbm"]
    assert (g["n"] == 40_000).all() and (abs(g["probability"] - g["closed_form"]) < 4 * g["se"] + 1e-9).all()
