"""Queries of the data-processing problems of the core: p1, p2, p4, p5, p6, p7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators.as_known import as_known
from tideglass.operators.instants import to_instants
from tideglass.operators.regular_grid import hourly_series
from tideglass.operators.spikes import flag_implausible
from tideglass.operators.trailing import volatility_features, wrong_features
from tideglass.operators.unnest import list_name, market_refs, pivot_group, to_triples
from tideglass.plans.registry import Registry
from tideglass.session import table

R = Registry()
QUOTES = ["best_bid", "best_ask", "last_price"]


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return flag_implausible(table(spark, d, "market_snapshot"), "snapshot_id", "market_id", "ts", QUOTES)


@R.add()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).select("snapshot_id", "field")


@R.add()
def p1_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Flagged readings per contract, field and reason."""
    return _flags(spark, d).groupBy("market_id", "field", "reason").agg(F.count(F.lit(1)).alias("readings"))


@R.add(
    """
    with c as (select asset, floor(epoch_us(ts) / 3600000000)::bigint as hour, coalesce(bool_or(close is not null and not isnan(close) and n_trades > 0), false) as live from candle where asset is not null and ts is not null group by 1, 2),
    span as (select asset, min(hour) as lo, max(hour) as hi from c group by 1),
    grid as (select asset, unnest(range(lo, hi + 1)) as hour from span)
    select g.asset, (g.hour * 3600)::bigint as hour_epoch from grid g left join c using (asset, hour) where not coalesce(c.live, false)
    """
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hourly_series(table(spark, d, "candle")).where("missing").select("asset", "hour_epoch")


@R.add(
    """
    with r as (select asset, epoch_us(ts) as us, close as y, close is not null and n_trades > 0 as live, ingested_at, candle_id from candle),
    once as (select asset, us, arg_max(case when live and y > 0 then y end, (ingested_at, candle_id)) filter (where true) as y0,
        (list(case when live and y > 0 then y end order by ingested_at desc, candle_id desc))[1] as y, bool_or(live) as live from r group by 1, 2),
    h as (select asset, us // 3600000000 as hour, count(y) as n, coalesce(bool_or(live), false) as live, arg_max(y, us) filter (where y is not null) as last from once group by 1, 2),
    span as (select asset, min(hour) as lo, max(hour) as hi from h group by 1),
    grid as (select asset, unnest(range(lo, hi + 1)) as hour from span),
    five as (select asset, us // 3600000000 as hour, us // 300000000 as f, arg_max(y, us) as y from once where y is not null group by 1, 2, 3),
    ret as (select asset, hour, pow(ln(y) - lag(ln(y)) over (partition by asset order by f), 2) as r2 from five),
    rv as (select asset, hour, sum(r2) as rv from ret group by 1, 2)
    select g.asset, (g.hour * 3600)::bigint as hour_epoch, last_value(h.last ignore nulls) over (partition by g.asset order by g.hour) as close,
        round(coalesce(rv.rv, 0), 9) as rv, coalesce(h.live, false) as traded, coalesce(h.n, 0)::bigint as readings
    from grid g left join h using (asset, hour) left join rv using (asset, hour)
    """
)
def p2_series(spark: SparkSession, d: str) -> DataFrame:
    """The hourly series: last known close, realised variance, traded, readings."""
    s = hourly_series(table(spark, d, "candle"))
    return s.select("asset", "hour_epoch", "close", F.round("rv", 9).alias("rv"), "traded", "readings")


@R.add(
    """
    with r as (select asset, epoch_us(ts) as us, close as y, close > 0 and n_trades > 0 as ok, ingested_at, candle_id from candle where asset is not null and ts is not null),
    once as (select asset, us, (list(case when ok then y end order by ingested_at desc, candle_id desc))[1] as y, (list(coalesce(ok, false) order by ingested_at desc))[1] as k from r group by 1, 2),
    span as (select asset, min(us // 3600000000) as lo, max(us // 3600000000) as hi from once group by 1), grid as (select asset, unnest(range(lo, hi + 1)) as hour from span),
    live as (select asset, us // 3600000000 as hour, bool_or(close is not null and n_trades > 0) as live from (select asset, epoch_us(ts) as us, close, n_trades from candle where asset is not null and ts is not null) group by 1, 2),
    near as (select g.asset, g.hour, o.y, (o.us - g.hour * 3600000000) / 3.6e9 - 0.5 as x from grid g join (select *, unnest([-1, 0, 1]) + us // 3600000000 as at from once where y is not null) o on o.asset = g.asset and o.at = g.hour),
    w as (select *, 1 - pow(x / 1.5, 2) as w from near), k as (select asset, hour, sum(w) as s0, sum(w * x) as s1, sum(w * x * x) as s2, sum(w * y) as y0, sum(w * x * y) as y1, sum(w * w) as ww from w group by 1, 2)
    select g.asset, (g.hour * 3600)::bigint as hour_epoch, round(case when s0 * s2 - s1 * s1 > 1e-9 * s0 * s0 then (s2 * y0 - s1 * y1) / (s0 * s2 - s1 * s1) when s0 > 1e-12 then y0 / s0 end, 5) as fit,
        round(case when ww > 1e-12 then s0 * s0 / ww else 0 end, 5) as support, not coalesce(l.live, false) as missing
    from grid g left join k using (asset, hour) left join live l using (asset, hour)
    """
)
def p2_smoothed(spark: SparkSession, d: str) -> DataFrame:
    """The kernel's local line and effective support at every hour."""
    return hourly_series(table(spark, d, "candle")).select("asset", "hour_epoch", F.round("fit", 5).alias("fit"), F.round("support", 5).alias("support"), "missing")


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_payload").where("http_status = 200").select("payload_id", "payload")


@R.add()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return market_refs(_payloads(spark, d), "payload_id", "payload").select(F.col("doc").alias("payload_id"), "event_ref", "market_ref")


#: Names of lists of events ('' the record itself); whatever else is repeated, beside markets, is a part.
EVENTS = ("events", "data", "children", "subEvents", "event", "")


@R.add()
def p4_events(spark: SparkSession, d: str) -> DataFrame:
    """Flat events with the event above them, if any."""
    t = to_triples(_payloads(spark, d), "payload_id", "payload").where(list_name("grp").isin(*EVENTS))
    names = {"event_ref": "ref", "above_ref": "^ref", "title": "title", "slug": "slug", "start": "startDate", "end": "endDate", "updated": "last_updated_ts"}
    e = t.groupBy("doc", "node").agg(F.max("parent").alias("parent"), *[F.max(F.when(F.col("name") == leaf, F.col("value"))).alias(o) for o, leaf in names.items()])
    return e.where("event_ref is not null and title is not null").withColumnRenamed("doc", "payload_id")


@R.add()
def p4_markets(spark: SparkSession, d: str) -> DataFrame:
    """Flat markets with their event."""
    names = {"event_ref": "^ref", "market_ref": "ref", "question": "question", "title": "title", "floor_strike": "floor_strike", "strike_type": "strike_type", "close_time": "close_time", "end": "endDate", "bid": "bestBid", "ask": "bestAsk", "fee_rate": "feeSchedule.rate"}
    t = to_triples(_payloads(spark, d), "payload_id", "payload", keep=("markets",))
    m = pivot_group(t, ("markets",), names)
    return m.where("market_ref is not null").drop("grp").withColumnRenamed("doc", "payload_id")


@R.add()
def p4_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every repeated part that is neither event nor market, one row per item and leaf, with the reference above it."""
    t = to_triples(_payloads(spark, d), "payload_id", "payload").where(~list_name("grp").isin(*EVENTS, "markets"))
    above = F.max(F.when(F.col("name") == "^ref", F.col("value")))
    leaf = F.when(F.col("kind").isin("number", "string", "bool"), F.struct("name", "value"))
    nodes = t.groupBy("doc", "node").agg(F.max("parent").alias("parent"), F.max("ord").alias("ord"), F.max("grp").alias("grp"), above.alias("above_ref"), F.collect_set(leaf).alias("leaves"))
    return nodes.select("doc", "node", "parent", "ord", "grp", F.explode("leaves").alias("l"), "above_ref").select("doc", "node", "parent", "ord", "grp", "l.name", "l.value", "above_ref").withColumnRenamed("doc", "payload_id")


_P5 = """
    with g as (select asset, h, arg_max(ts, (ingested_at, ts)) as ts, (list(struct_pack(rv := rv, traded := traded) order by ingested_at desc, ts desc, rv desc nulls last))[1] as x from hourly_grid group by 1, 2),
    daily as (select asset, (ts at time zone 'UTC')::date as day, coalesce(sum(x.rv::decimal(38,20)), 0) as rv, count(*) filter (where x.traded) as hours from g group by 1, 2),
    span as (select asset, min(day) + 1 as lo, max(day) + 31 as hi from daily group by 1),
    days as (select asset, unnest(generate_series(lo, hi, interval 1 day))::date as anchor_date from span),
    f as (select s.asset, s.anchor_date,
        coalesce(sum(d.rv) filter (where d.day >= s.anchor_date - 1), 0) as rv1d_var, coalesce(sum(d.rv) filter (where d.day >= s.anchor_date - 7), 0) / 7 as rv7d_var,
        coalesce(sum(d.rv), 0) / 30 as rv30d_var, coalesce(sum(d.hours), 0) / 720 as coverage30
        from days s left join daily d on d.asset = s.asset and d.day < s.anchor_date and d.day >= s.anchor_date - 30 group by 1, 2)
"""


@R.add(_P5 + "select asset, anchor_date, round(rv1d_var + 1e-15, 12) as rv1d_var, round(rv7d_var + 1e-15, 12) as rv7d_var, round(rv30d_var + 1e-15, 12) as rv30d_var, round(coverage30, 9) as coverage30 from f")
def p5_features(spark: SparkSession, d: str) -> DataFrame:
    """Trailing totals of every asset and day. The sums are exact, so halves do occur: a trace more rounds them alike."""
    f = volatility_features(table(spark, d, "hourly_grid"))
    return f.select("asset", "anchor_date", *[F.round(F.col(c) + 1e-15, 12).alias(c) for c in ("rv1d_var", "rv7d_var", "rv30d_var")], F.round("coverage30", 9).alias("coverage30"))


@R.add(
    _P5
    + """, s as (select distinct * from (unpivot (select asset, anchor_date, rv1d_var, rv7d_var, rv30d_var, coverage30 from vol_features) on rv1d_var, rv7d_var, rv30d_var, coverage30 into name field value stored)),
    r as (unpivot f on rv1d_var, rv7d_var, rv30d_var, coverage30 into name field value good)
    select distinct s.asset, strftime(s.anchor_date, '%Y-%m-%d') as anchor_date, s.field from s left join r using (asset, anchor_date, field)
    where s.stored is not null and abs(s.stored - coalesce(r.good, 0)) > 0.005 * abs(coalesce(r.good, 0))
    """
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    w = wrong_features(table(spark, d, "hourly_grid"), table(spark, d, "vol_features"))
    return w.select("asset", F.date_format("anchor_date", "yyyy-MM-dd").alias("anchor_date"), "field").distinct()


@R.add(
    """
    with f as (select distinct forecast_id, series_id, (ts at time zone 'UTC')::date as day from forecast where series_id is not null),
    m as (select * from macro_observation where value is not null),
    j as (select f.forecast_id, f.series_id, m.obs_date, m.realtime_start, row_number() over (partition by f.forecast_id, f.series_id order by m.obs_date desc, m.realtime_start desc) as k
        from f join m on m.series_id = f.series_id and f.day >= m.realtime_start and f.day <= coalesce(m.realtime_end, date '9999-12-31'))
    select forecast_id, series_id, strftime(obs_date, '%Y-%m-%d') as obs_date, strftime(realtime_start, '%Y-%m-%d') as realtime_start from j where k = 1
    """
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    k = as_known(table(spark, d, "forecast"), table(spark, d, "macro_observation"), "forecast_id", "series_id", "ts", "obs_date", "realtime_start", "realtime_end", "value")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return k.select("forecast_id", "series_id", day("obs_date"), day("realtime_start"))


@R.add()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    events = to_instants(table(spark, d, "venue_event"), "rec_id", ["start_date", "last_updated_ts", "close_time"], zone_col="tz_name", order=[("start_date", "close_time")])
    labels = to_instants(table(spark, d, "reliability_label"), "label_id", ["meeting_date"], default_zone="America/New_York", time_col="statement_time", default_time="14:00")
    rows = lambda x, src, key: x.select(F.lit(src).alias("src"), F.col(key).alias("rec_id"), "field", "utc_us")
    return rows(events, "venue_event", "rec_id").unionByName(rows(labels, "reliability_label", "label_id"))
