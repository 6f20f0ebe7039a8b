"""Regular grids, trailing totals, as-known lookups, instants and nested records against brute force."""

import datetime as dt
import json
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from tideglass.operators.as_known import as_known, timeline
from tideglass.operators.instants import best_zone, estimate_zones, parse, parse_time, to_instants, wall_to_utc
from tideglass.operators.regular_grid import HALF, hourly_series
from tideglass.operators.trailing import latest_rows, trailing_totals, volatility_features, wrong_features
from tideglass.operators.unnest import NestConfig, market_refs, pivot_group, to_triples

H = 3_600_000_000
CANDLE = "candle_id long, asset string, us long, close double, n_trades long, ver long, hour long"


def candles(spark, rows):
    return spark.createDataFrame(rows, CANDLE).selectExpr("candle_id", "asset", "timestamp_micros(us) ts", "close", "n_trades", "timestamp_micros(ver) ingested_at", "hour")


def test_grid_against_direct_weights(spark):
    rng = np.random.default_rng(1)
    t = np.sort(rng.integers(0, 12 * H, 60))
    t = t[(t // H != 4) & (t // H != 7) & (t // H != 8)]
    y = 100 + rng.normal(0, 1, len(t)).cumsum()
    data = [(i, "a", int(a), float(b), 1, 0, 1) for i, (a, b) in enumerate(zip(t, y))]
    got = {r.hour_epoch // 3600: r for r in hourly_series(candles(spark, data)).collect()}
    assert sorted(got) == list(range(t[0] // H, t[-1] // H + 1))
    for h, r in got.items():
        x = (t - (h * H + H / 2)) / H
        w = np.where(np.abs(x) < HALF, 1 - (x / HALF) ** 2, 0)
        if w.sum() > 0:
            assert r.support == pytest.approx(w.sum() ** 2 / (w**2).sum(), rel=1e-6)
            a = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]])
            want = np.linalg.solve(a, [(w * y).sum(), (w * x * y).sum()])[0] if np.linalg.det(a) > 1e-9 * w.sum() ** 2 else (w * y).sum() / w.sum()
            assert r.fit == pytest.approx(want, rel=1e-7)
        assert r.missing == (not (t // H == h).any()) == (not r.traded)
        assert r.close == y[t < (h + 1) * H][-1]


def test_the_mark_comes_from_the_kernel(spark):
    g = hourly_series(candles(spark, [(1, "a", 0, 1.0, 1, 0, 9), (2, "a", 3 * H, 1.0, 2, 0, 9), (3, "a", 3 * H + 5, None, 2, 0, 9)]))
    m = g.where("missing").select("asset", "hour_epoch")
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"l{k}" in plan for k in range(5)) and "POWER" in plan.upper()  # power sums of the kernel
    assert [r.hour_epoch for r in m.orderBy("hour_epoch").collect()] == [3600, 7200]
    rng = np.random.default_rng(3)
    t = np.unique(np.concatenate([rng.integers(0, 30 * H, 400), np.arange(0, 30 * H, 5 * H), np.arange(1, 30) * H - 1]))
    two = hourly_series(candles(spark, [(i, "a", int(x), 5.0, 1, 0, 9) for i, x in enumerate(t)]), min_readings=12)
    assert {r.hour_epoch // 3600 for r in two.where("missing").collect()} == {h for h in range(30) if (t // H == h).sum() < 12}


def test_grid_cases(spark):
    data = [
        (1, "a", 0, None, None, 0, 9), (2, "a", 2 * H + 60_000_000, 104.0, 3, 0, 9), (3, "a", 2 * H + 60_000_000, 105.0, 3, 1, 9), (2, "a", 2 * H + 60_000_000, 104.0, 3, 0, 9),
        (4, "a", 5 * H, 50.0, 0, 0, 9), (5, "a", 5 * H + 1, float("nan"), 2, 0, 9), (6, None, 0, 1.0, 1, 0, 9), (7, "a", None, 1.0, 1, 0, 9), (8, "b", 9 * H, 7.0, 1, 0, 9),
    ]
    got = {(r.asset, r.hour_epoch // 3600): r for r in hourly_series(candles(spark, data)).collect()}
    assert sorted(got) == [("a", h) for h in range(6)] + [("b", 9)]
    assert [got["a", h].close for h in range(6)] == [None, None, 105.0, 105.0, 105.0, 105.0]
    assert [got["a", h].missing for h in range(6)] == [True, True, False, True, True, True]
    assert got["a", 0].fit is None and got["a", 0].support == 0 and got["a", 1].rv == 0
    assert hourly_series(candles(spark, [])).count() == 0


def test_realised_variance_over_five_minute_closes(spark):
    data = [(1, "a", 0, 100.0, 1, 0, 0), (2, "a", 6 * 60_000_000, 110.0, 1, 0, 0), (3, "a", 7 * 60_000_000, 121.0, 1, 0, 0), (4, "a", 3 * H, 100.0, 1, 0, 0)]
    got = {r.hour_epoch // 3600: r.rv for r in hourly_series(candles(spark, data)).collect()}
    assert got[0] == pytest.approx(np.log(1.21) ** 2) and got[1] == 0 and got[3] == pytest.approx(np.log(100 / 121) ** 2)


def test_trailing_totals_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = dt.date(2020, 1, 1)
    data = [(str(rng.choice(["a", "b"])), base + dt.timedelta(days=int(rng.integers(0, 40))), float(round(rng.random(), 6)), "x") for _ in range(120)]
    data += [("a", base, None, "x"), (None, base, 1.0, "x"), ("a", None, 1.0, "x")]
    df = spark.createDataFrame(data, "e string, d date, v double, t1 string")
    got = trailing_totals(df, "e", "d", {"t1": ("v", 1), "t7": ("v", 7)}).collect()
    assert got
    for r in got:
        for n, v in ((1, r.t1), (7, r.t7)):
            want = sum(x for e, d, x, _ in data if e == r.e and d is not None and x is not None and r.d - dt.timedelta(days=n) <= d < r.d)
            assert v == pytest.approx(want, abs=1e-9)
            assert want > 0 or v == 0
    days = {r.d for r in got if r.e == "a"}
    first = min(d for e, d, _, _ in data if e == "a" and d is not None)
    assert days == {first + dt.timedelta(days=k) for k in range(1, (max(days) - first).days + 1)}
    assert trailing_totals(df.limit(0), "e", "d", {"t1": ("v", 1)}).count() == 0


def test_superseded_hours_and_wrong_values(spark, rows):
    g = spark.createDataFrame([("a", 0, 0, 1.0, True, 1), ("a", 0, 0, 2.0, True, 2), ("a", 0, 0, 2.0, True, 2), ("a", 1, H, None, False, 1), ("a", 30, 30 * H, 4.0, True, 1)], "asset string, h int, us long, rv double, traded boolean, v long").selectExpr("asset", "h", "timestamp_micros(us) ts", "rv", "traded", "timestamp_micros(v) ingested_at")
    assert rows(latest_rows(g, ["asset", "h"], "ingested_at", ["rv"])) == [("a", 0, 2.0), ("a", 1, None), ("a", 30, 4.0)]
    f = {str(r.anchor_date): r for r in volatility_features(g).collect()}
    assert f["1970-01-02"].rv1d_var == 2.0 and f["1970-01-03"].rv1d_var == 4.0 and f["1970-01-03"].rv7d_var == pytest.approx(6 / 7)
    assert f["1970-01-03"].coverage30 == pytest.approx(2 / 720) and f["1970-01-10"].rv7d_var == 0 and f["1970-01-10"].rv30d_var == pytest.approx(0.2)
    d = dt.date(1970, 1, 2)
    stored = spark.createDataFrame([("a", d, 2.0, 3.0, None, 1 / 720), ("a", d, 2.0, 3.0, None, 1 / 720), ("zz", d, 0.0, 0.1, None, None), (None, d, 9.0, 9.0, 9.0, 9.0)], "asset string, anchor_date date, rv1d_var double, rv7d_var double, rv30d_var double, coverage30 double")
    assert rows(wrong_features(g, stored), "asset", "field") == [("a", "rv7d_var"), ("zz", "rv7d_var")]


def brute_known(events, versions):
    out = {}
    for i, e, t in events:
        if None in (i, e, t):
            continue
        day = t.date()
        live = [(a, s) for f, a, s, u, v in versions if f == e and None not in (f, a, s, v) and s <= day and (u is None or day <= u)]
        if live:
            out[i, e] = max(live)
    return out


@pytest.mark.parametrize(("per", "chunk"), [(3, 100_000), (100_000, 100_000), (5, 7)])
def test_as_known_against_brute_force(spark, per, chunk):
    rng = np.random.default_rng(3)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=int(k))
    versions = [("s" + str(rng.integers(0, 3)), day(rng.integers(0, 30)), day(rng.integers(0, 60)), None if rng.random() < 0.2 else day(rng.integers(0, 90)), None if rng.random() < 0.1 else float(rng.random())) for _ in range(150)]
    versions = [(e, a, s, u if u is None or u >= s else s, v) for e, a, s, u, v in versions]
    versions += versions[:10] + [(None, day(1), day(1), None, 1.0), ("s0", None, day(1), None, 1.0)]
    events = [(i, "s" + str(rng.integers(0, 4)), dt.datetime(2020, 1, 1) + dt.timedelta(hours=int(rng.integers(0, 24 * 90)))) for i in range(80)]
    events += events[:5] + [(200, None, events[0][2]), (201, "s0", None), (None, "s0", events[0][2])]
    ev = spark.createDataFrame([(*e, 1.0) for e in events], "id long, e string, ts timestamp, value double")
    vs = spark.createDataFrame([(*v, "x") for v in versions], "e string, about date, since date, until date, value double, id string")
    got = as_known(ev, vs, "id", "e", "ts", "about", "since", "until", "value", per_salt=per, per_chunk=chunk).collect()
    assert {(r.id, r.e): (r.about, r.since) for r in got} == brute_known(events, versions) and len(got) == len({(r.id, r.e) for r in got})
    assert as_known(ev.limit(0), vs, "id", "e", "ts", "about", "since", "until", "value").count() == 0
    assert as_known(ev, vs.limit(0), "id", "e", "ts", "about", "since", "until", "value").count() == 0


def test_timeline_drops_what_ended():
    days, which = timeline(None, np.array([5, 9]), np.array([0, 10]), np.array([100, 19]))
    at = lambda d: which[np.searchsorted(days, d, side="right") - 1]
    assert (at(5), at(10), at(19), at(20), at(100), at(101)) == (0, 1, 1, 0, 0, -1)


UTC = dt.timezone.utc
us = lambda *a: int((dt.datetime(*a, tzinfo=UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(microseconds=1))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2018-11-04T07:43:00Z", us(2018, 11, 4, 7, 43)),
        ("2021-08-21t02:36:15z", us(2021, 8, 21, 2, 36, 15)),
        ("2026-08-30 18:47:12.338533438Z", us(2026, 8, 30, 18, 47, 12, 338533)),
        ("2020-06-27 15:38:32-03:30", us(2020, 6, 27, 19, 8, 32)),
        ("20230122T151851Z", us(2023, 1, 22, 15, 18, 51)),
        ("Fri, 26 Feb 2021 21:53:40 -0700", us(2021, 2, 27, 4, 53, 40)),
        ("Oct 25, 2026 02:32 CEST", us(2026, 10, 25, 0, 32)),
        ("10/12/2026 01:14 AM CEST", us(2026, 10, 11, 23, 14)),
        ("12 March 2023, 8:11 pm EST", us(2023, 3, 13, 1, 11)),
        ("1663518762", 1663518762 * 10**6),
        ("1710058200.000", 1710058200 * 10**6),
        ("1694406474001", 1694406474001 * 1000),
        ("1615709040155679570", 1615709040155679),
        ("  14.04.2021 05:25Z ", us(2021, 4, 14, 5, 25)),
        ("2020-01-01T24:00:00Z", us(2020, 1, 2)),
    ],
)
def test_texts_with_an_offset(text, want):
    at, timed, offset, _ = parse(text)
    assert timed and at - offset * 60_000_000 == want


@pytest.mark.parametrize("text", ["", " ", "-", "TBD", "null", "25:61", "0000-00-00", "2024-13-05 09:00", "2023-02-30T10:00:00Z", "2019-06-31", "soon", "10/12/2026 13:14 PM CEST", "2020-01-01 10:00 QQT", "1" * 40, "x" * 1000, "123456"])
def test_texts_without_an_instant(text):
    assert parse(text) is None


def test_wall_times_and_the_clock_change():
    wall = lambda *a: us(*a)
    assert wall_to_utc(wall(2021, 11, 7, 1, 30), "America/New_York") == us(2021, 11, 7, 5, 30)  # twice: the first
    assert wall_to_utc(wall(2021, 3, 14, 2, 30), "America/New_York") == us(2021, 3, 14, 7, 30)  # skipped: an hour on
    assert wall_to_utc(0, "No/Where") is None
    assert parse_time("2:00 PM") == 14 * H and parse_time("8:15 am") == 8 * H + 15 * 60_000_000 and parse_time("noon") is None


def test_instants_of_a_table(spark):
    df = spark.createDataFrame([(1, "03/04/2021 10:00:00", "Europe/Berlin", None), (2, "03.04.2021 10:00", None, "x"), (3, None, "UTC", None), (None, "2020-01-01T00:00:00Z", None, None), (4, "2021-04-03", "Bad/Zone", "2:00 PM"), (1, "03/04/2021 10:00:00", "Europe/Berlin", None)], "id long, t string, z string, field string")
    got = {r.id: r.utc_us for r in to_instants(df, "id", ["t"], zone_col="z", time_col="field").collect()}
    assert got == {1: us(2021, 3, 4, 9), 2: us(2021, 4, 3, 10), 4: us(2021, 4, 3, 14)}
    assert to_instants(df.limit(0), "id", ["t"]).count() == 0


def test_missing_zones_are_estimated_from_ingestion_times(spark):
    rng = np.random.default_rng(5)
    rows = []
    for source, zone in (("ny", "America/New_York"), ("berlin", "Europe/Berlin"), ("tokyo", "Asia/Tokyo")):
        for _ in range(80):
            wall = dt.datetime(2021, 1, 1) + dt.timedelta(minutes=int(rng.integers(0, 500_000)))
            utc = wall_to_utc(us(*wall.timetuple()[:6]), zone)
            rows.append((source, wall.strftime("%Y-%m-%d %H:%M:%S"), int(utc + rng.integers(1, 90) * 1_000_000)))
    rows += [("ny", "junk", 0), (None, "2021-01-01 00:00:00", 0), ("ny", "2021-01-01T00:00:00Z", 0)]
    df = spark.createDataFrame(rows, "source string, text string, u long").selectExpr("source", "text", "timestamp_micros(u) seen")
    zones = ["UTC", "America/New_York", "America/Chicago", "Europe/Berlin", "Asia/Tokyo"]
    est = estimate_zones(df, "source", "text", "seen", zones)
    assert {r.source: r.zone for r in est.collect()} == {"ny": "America/New_York", "berlin": "Europe/Berlin", "tokyo": "Asia/Tokyo"}
    ids = df.where("source is not null").selectExpr("monotonically_increasing_id() id", "source", "text", "seen")
    late = to_instants(ids, "id", ["text"], zones=est, source="source").drop("text").join(ids, "id").where("unix_micros(seen) - utc_us not between 0 and 90000000 and text not like '%Z'")
    assert late.count() == 0
    wall = np.array([us(2021, 3, 28, 1, 59), us(2021, 3, 28, 3, 1), us(2021, 3, 28, 3, 5)])
    assert best_zone(wall, None, ["UTC", "Europe/Berlin"]) == "UTC" and best_zone(wall[:0], None, ["UTC"]) == "UTC"


PAYLOAD = {
    "pages": [{"events": [{"id": 7, "markets": [{"id": "a", "tags": [{"id": 1}, {"id": 2}]}, None, {"id": 12, "rate": {"deep": 0.5}}], "relatedMarkets": [{"id": "no"}], "children": [{"id": "c", "markets": '[{"id": "z"}]'}]}]}],
    "milestones": [{"id": "m", "markets": ["a"]}],
}


def test_nested_records(spark, rows):
    odd = json.dumps(json.dumps({"events": [{"event_ticker": "E", "markets": {"k0": {"ticker": "E-1", "event_ticker": "E"}}}, {"event_ticker": "F", "markets": None}]}))
    deep = "[" * 20_000 + "]" * 20_000
    data = [(1, json.dumps(PAYLOAD)), (1, json.dumps(PAYLOAD)), (2, odd), (3, '{"events": [{"id": 1'), (4, ""), (5, None), (None, odd), (6, deep), (7, "[]"), (8, "7")]
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "payload_id long, payload string, doc string")
    assert rows(market_refs(df, "payload_id", "payload")) == sorted([(1, "7", "a"), (1, "7", "12"), (1, "c", "z"), (2, "E", "E-1")], key=repr)
    t = to_triples(df, "payload_id", "payload")
    m = pivot_group(t, ("markets",), {"ref": "ref", "above": "^ref", "deep": "rate.deep"})
    assert rows(m.where("doc = 1 and ref = '12'"), "ref", "above", "deep", "ord") == [("12", "7", "0.5", 2)]
    tags = pivot_group(t, ("tags",), {"ref": "ref", "above": "^ref"})
    assert rows(tags, "ref", "above", "ord") == [("1", "a", 0), ("2", "a", 1)]
    assert set(r.parent for r in tags.collect()) == {"$.pages[0].events[0].markets[0]"}
    assert market_refs(df.limit(0), "payload_id", "payload").count() == 0
    assert NestConfig().keyed == ("markets",)


def test_ranges_by_characters():
    from tideglass.functions.arrow import by_chars

    assert list(by_chars([], 10)) == [] and list(by_chars(["a" * 50], 10)) == [(0, 1)]
    assert list(by_chars(["aaaa", "bbbb", "cccc", "", "d" * 20, "e"], 10)) == [(0, 2), (2, 4), (4, 5), (5, 6)]


def test_days_are_those_of_utc_in_any_session(spark):
    from pyspark.sql import functions as F

    rows = [("a", h, 1_700_000_000 + 3600 * h, 0.5, True, 0) for h in range(60)]
    grid = spark.createDataFrame(rows, "asset string, h int, s long, rv double, traded boolean, v long").selectExpr("asset", "h", "timestamp_seconds(s) ts", "rv", "traded", "timestamp_seconds(v) ingested_at")
    of = lambda: sorted(tuple(r) for r in volatility_features(grid).select(F.col("anchor_date").cast("string"), "rv1d_var", "coverage30").collect())
    want = of()
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert of() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_every_zone_name_is_read():
    import zoneinfo

    for z in sorted(zoneinfo.available_timezones()):
        if "/" in z and not z.startswith(("posix", "right", "SystemV")):
            for text in (f"2024-01-10 02:30 {z}", f"2024-01-10T02:30:00[{z}]"):
                got = parse(text)
                assert got is not None and got[3] == z and got[0] == 1_704_853_800_000_000, text
    assert parse("2024-01-10 02:30 am")[0] == parse("2024-01-10 2:30 A.M.")[0] == 1_704_853_800_000_000
    assert parse("2024-07-10 09:30 ET")[3] == "America/New_York" and parse("Jul 10, 2024 9:30 PM PT")[3] == "America/Los_Angeles"


def test_zones_by_the_order_of_a_row(spark):
    """Half of the rows state New York but were written in Tokyo: the ends, known exactly, show it. Others keep what they state."""
    t0 = dt.datetime(2024, 2, 1)
    rows = []
    for i in range(400):
        written, start = ZoneInfo("Asia/Tokyo"), t0 + dt.timedelta(hours=5 * i)
        end = (start.replace(tzinfo=written) + dt.timedelta(hours=2)).astimezone(dt.timezone.utc)
        rows.append((i, "America/New_York" if i % 2 else "Asia/Tokyo", end.strftime("%Y-%m-%d %H:%M") + " UTC", start.strftime("%Y-%m-%d %H:%M")))
    df = spark.createDataFrame(rows, "id long, z string, starts string, ends string")  # the end is known, the start not
    df = df.selectExpr("id", "z", "ends as a", "starts as b")
    free = {r.id: r.zone for r in to_instants(df, "id", ["a", "b"], zone_col="z").where("field = 'a'").collect()}
    assert free[1] == "America/New_York"
    kept = to_instants(df, "id", ["a", "b"], zone_col="z", order=[("a", "b")]).where("field = 'a'")
    assert {r.zone for r in kept.collect()} == {"Asia/Tokyo"}
    few = to_instants(df.limit(6), "id", ["a", "b"], zone_col="z", order=[("a", "b")]).where("field = 'a' and id % 2 = 1")
    assert {r.zone for r in few.collect()} == {"America/New_York"}  # too little evidence against what is stated
    assert to_instants(df.limit(0), "id", ["a", "b"], zone_col="z", order=[("a", "b")]).count() == 0
