"""Queries over pairs of assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators import pairs as P
from tideglass.operators.bars import resample
from tideglass.plans.registry import Registry
from tideglass.session import stored
from tideglass.sources.adapters import CANDLES_SQL, candles

R = Registry()
LOOK, ENTRY, EXIT, STOP, LONGEST, BPS, PPY = 48, 2.0, 0.5, 3.5, 24, 5.0, 8760.0

_ROWS = f"""
    with c as ({CANDLES_SQL}), h as (select asset, epoch_us(ts) // 3600000000 as bar, arg_max(close, ts) as close from c group by 1, 2),
    n as (select asset as asset_a, lead(asset) over (order by asset) as asset_b from (select distinct asset from h)),
    p as (select asset_a || '-' || asset_b as pair, a.bar, a.close as a, b.close as b from n join h a on a.asset = asset_a join h b on b.asset = asset_b and a.bar = b.bar),
    rw as (select *, row_number() over (partition by pair order by bar) - 1 as i, regr_slope(a, b) over (partition by pair) as h from p),
    sp as (select *, a - h * b as spread from rw),
    zs as (select *, case when i >= {LOOK} then case when stddev_pop(spread) over w > 1e-3 * greatest(sqrt(greatest(avg(spread * spread) over e - pow(avg(spread) over e, 2), 0)), 1e-12) then (spread - avg(spread) over w) / stddev_pop(spread) over w else 0 end end as z
        from sp window w as (partition by pair order by i rows between {LOOK} preceding and 1 preceding), e as (partition by pair order by i rows between unbounded preceding and 1 preceding)),
    il as (select *, sum(case when abs(z) <= {EXIT} then 1 else 0 end) over (partition by pair order by i) as island from zs),
    ps as (select *, case when z is null then 0 else coalesce(first_value(case when abs(z) >= {ENTRY} then -sign(z) end ignore nulls) over (partition by pair, island order by i rows between unbounded preceding and current row), 0) end::double as pos from il)
"""


def _hours(spark: SparkSession, d: str) -> DataFrame:
    return resample(candles(spark, d), 3600).select("asset", "bar", "close")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    h = _hours(spark, d)
    return P.pair_rows(h, P.adjacent_pairs(h))


def _signal(spark: SparkSession, d: str) -> DataFrame:
    return P.positions(P.zscore(P.ols_hedge(_rows(spark, d)), LOOK), ENTRY, EXIT)


@R.add(f"{_ROWS} select pair, i::int as i, round(spread, 6) as spread, round(z, 6) as z from zs")
def spread_z(spark: SparkSession, d: str) -> DataFrame:
    return P.zscore(P.ols_hedge(_rows(spark, d)), LOOK).select("pair", "i", F.round("spread", 6).alias("spread"), F.round("z", 6).alias("z"))


@R.add(f"{_ROWS} select pair, i::int as i, pos from ps")
def positions(spark: SparkSession, d: str) -> DataFrame:
    return _signal(spark, d).select("pair", "i", "pos")


_BT = f"""{_ROWS}, b1 as (select *, coalesce(lag(h) over w, h) as hl, coalesce(lag(pos) over w, 0) as held from ps window w as (partition by pair order by i)), b2 as (select *, a + hl * b as notional from b1),
    b3 as (select *, coalesce(held * ((a - coalesce(lag(a) over w, a)) - hl * (b - coalesce(lag(b) over w, b))) / coalesce(lag(notional) over w, notional), 0) as gross from b2 window w as (partition by pair order by i)),
    b4 as (select *, gross - abs(held - coalesce(lag(held) over (partition by pair order by i), 0)) * {BPS / 1e4} as net from b3),
    bt as (select *, exp(sum(ln(1 + net)) over (partition by pair order by i)) - 1 as equity from b4)
"""


@R.add(f"{_BT} select pair, i::int as i, held + 0.0 as held, round(gross, 9) + 0.0 as gross, round(net, 9) + 0.0 as net, round(equity, 8) + 0.0 as equity from bt")
def pair_backtest(spark: SparkSession, d: str) -> DataFrame:
    b = P.backtest(_signal(spark, d), BPS)
    plain = lambda c, n: (F.round(c, n) + F.lit(0.0)).alias(c)  # noqa: E731 - no negative zeros
    return b.select("pair", "i", plain("held", 1), plain("gross", 9), plain("net", 9), plain("equity", 8))


@R.add(
    f"""{_BT}, dd as (select *, equity - max(equity) over (partition by pair order by i) as dd from bt), s as (select pair, avg(net) as m, stddev_pop(net) as s, count(*) as n, min(dd) as mdd, coalesce(avg(case when net <> 0 then (net > 0)::int end), 0) as hit, arg_max(equity, i) as total from dd group by 1)
    select pair, round(case when s > 1e-15 then m / s else 0 end * sqrt({PPY}), 5) as sharpe, round(case when n >= 2 and s > 1e-15 then sqrt((1 + pow(m / s, 2) / 2) / n) * sqrt({PPY}) end, 5) as sharpe_se, round(mdd, 7) as max_drawdown, round(hit, 8) as hit_rate, round(total, 7) as total_return, n from s"""
)
def perf_summary(spark: SparkSession, d: str) -> DataFrame:
    p = P.performance(P.backtest(_signal(spark, d), BPS), PPY, ["pair"])
    r = lambda c, n: F.round(c, n).alias(c)
    return p.select("pair", r("sharpe", 5), r("sharpe_se", 5), r("max_drawdown", 7), r("hit_rate", 8), r("total_return", 7), "n")


_EV = f"""{_ROWS}, en as (select pair, i as entry, sign(pos)::double as direction from (select *, lag(pos) over (partition by pair order by i) as l from ps) where pos <> 0 and l = 0),
    hz as (select en.*, least(entry + {LONGEST}, (select max(i) from ps p where p.pair = en.pair)) as horizon from en),
    st as (select hz.*, p.i, p.z, case when abs(p.z) <= {EXIT} then 'profit_take' when (direction > 0 and p.z <= -{STOP}) or (direction < 0 and p.z >= {STOP}) then 'stop_loss' end as what from hz left join ps p on p.pair = hz.pair and p.i > entry and p.i <= horizon),
    ev as (select pair, entry, direction, coalesce(min(i) filter (where what is not null), max(horizon)) as exit, coalesce(arg_min(what, i) filter (where what is not null), 'timeout') as outcome from st group by 1, 2, 3)
"""


@R.add(f"{_EV} select pair, entry::int as entry, direction, exit::int as exit, outcome, (outcome = 'profit_take')::int as label, (exit - entry)::int as held from ev")
def triple_barrier(spark: SparkSession, d: str) -> DataFrame:
    return P.triple_barrier(_signal(spark, d), EXIT, STOP, LONGEST)


@R.add(f"{_EV}, x as (select p.pair, p.i, arg_max(e.direction, e.entry) as d from ps p left join ev e on e.pair = p.pair and p.i between e.entry and e.exit group by 1, 2) select pair, i::int as i, coalesce(d, 0) as pos from x")
def event_positions(spark: SparkSession, d: str) -> DataFrame:
    s = _signal(spark, d)
    return P.event_positions(s, P.triple_barrier(s, EXIT, STOP, LONGEST))


@R.add(
    f"""{_EV}, f as (select pair, i, abs(z) as abs_z, coalesce(stddev_pop(spread) over w, 0) as spread_vol, coalesce(stddev_pop(h) over w, 0) as hedge_vol from ps window w as (partition by pair order by i rows between 20 preceding and 1 preceding))
    select e.pair, e.entry::int as entry, e.direction, round(abs_z, 6) as abs_z, round(spread_vol, 7) as spread_vol, round(hedge_vol, 7) as hedge_vol, coalesce(entry - lag(entry) over (partition by e.pair order by entry), 20)::int as since from en e join f on f.pair = e.pair and f.i = e.entry"""
)
def entry_features(spark: SparkSession, d: str) -> DataFrame:
    e = P.entry_features(_signal(spark, d))
    return e.select("pair", "entry", "direction", F.round("abs_z", 6).alias("abs_z"), F.round("spread_vol", 7).alias("spread_vol"), F.round("hedge_vol", 7).alias("hedge_vol"), "since")


@R.add(f"{_ROWS}, ct as (select pair, round_even(count(*) * 0.7, 0) as cut from ps group by 1) select pair, count(*) filter (where i < cut) as train, count(*) filter (where i >= cut) as test from ps join ct using (pair) group by 1")
def split_rows(spark: SparkSession, d: str) -> DataFrame:
    return P.split_rows(_rows(spark, d), 0.3).groupBy("pair").agg(F.sum((~F.col("oos")).cast("long")).alias("train"), F.sum(F.col("oos").cast("long")).alias("test"))


@R.add(f"{_EV} select outcome, count(*) as n, round(avg((outcome = 'profit_take')::int), 8) as label_mean, round(avg(exit - entry), 6) as held from ev group by 1")
def barrier_outcomes(spark: SparkSession, d: str) -> DataFrame:
    e = P.triple_barrier(_signal(spark, d), EXIT, STOP, LONGEST)
    return e.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 8).alias("label_mean"), F.round(F.avg("held"), 6).alias("held"))


_Q = 1e-4 / (1 - 1e-4)


@R.add(
    f"""{_ROWS.replace("with ", "with recursive ", 1)}, sd as (select pair, regr_slope(a, b) as h0, regr_intercept(a, b) as c0 from p group by 1),
    k(pair, i, h, c, p11, p12, p22) as (select sd.pair, -1::bigint, h0, c0, 1.0::double - {_Q}, 1.0::double, 1.0::double - {_Q} from sd
        union all select k.pair, k.i + 1, k.h + (p11 + {_Q}) * g.b * g.e / g.v + p12 * g.e / g.v, k.c + (p12 * g.b + p22 + {_Q}) * g.e / g.v,
            (p11 + {_Q}) - pow((p11 + {_Q}) * g.b + p12, 2) / g.v, p12 - ((p11 + {_Q}) * g.b + p12) * (p12 * g.b + p22 + {_Q}) / g.v, (p22 + {_Q}) - pow(p12 * g.b + p22 + {_Q}, 2) / g.v
        from k join rw on rw.pair = k.pair and rw.i = k.i + 1, lateral (select rw.b as b, rw.a - k.h * rw.b - k.c as e, (k.p11 + {_Q}) * rw.b * rw.b + 2 * k.p12 * rw.b + k.p22 + {_Q} + 1e-3 as v) g)
    select k.pair, k.i::int as i, round(k.h, 6) as h, round(k.c, 6) as c, round(rw.a - k.h * rw.b, 6) as spread from k join rw on rw.pair = k.pair and rw.i = k.i where k.i >= 0"""
)
def kalman_hedge(spark: SparkSession, d: str) -> DataFrame:
    k = P.kalman_hedge(_rows(spark, d))
    return k.select("pair", "i", F.round("h", 6).alias("h"), F.round("c", 6).alias("c"), F.round("spread", 6).alias("spread"))


@R.add()
def pair_scan(spark: SparkSession, d: str) -> DataFrame:
    """Cointegration over random windows of every pair of assets."""
    s = P.scan_all(_hours(spark, d), 120, 12)
    return s.select("pair", "start", F.round("stat", 5).alias("stat"), F.round("pvalue", 6).alias("pvalue"))


@R.add()
def pair_scan_summary(spark: SparkSession, d: str) -> DataFrame:
    s = P.scan_summary(P.scan_all(_hours(spark, d), 120, 12))
    return s.select("pair", "n", *[F.round(c, 6).alias(c) for c in ("mean_p", "median_p", "significant", "mean_stat")])


@R.add()
def meta_label(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees on entry features: predicted probability of taking profit and the bet size for the later entries."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    s = _signal(spark, d)
    f = P.entry_features(s).join(P.triple_barrier(s, EXIT, STOP, LONGEST).select("pair", "entry", "label"), ["pair", "entry"])
    f = stored(f, "entries")  # the trees read it many times
    rows = VectorAssembler(inputCols=["abs_z", "spread_vol", "hedge_vol", "since"], outputCol="x").transform(f)
    cut = rows.approxQuantile("entry", [0.7], 0.01)
    cut = cut[0] if cut else 0
    train = rows.where(F.col("entry") <= cut)
    if train.select("label").distinct().count() < 2:
        return rows.select("pair", "entry", "label", F.lit(None).cast("double").alias("probability"), F.lit(0.0).alias("size"))
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=20, maxDepth=2, stepSize=0.1, subsamplingRate=0.8, seed=1).fit(train)
    p = model.transform(rows.where(F.col("entry") > cut)).withColumn("probability", vector_to_array("probability")[1])
    return p.select("pair", "entry", "label", F.round("probability", 6).alias("probability"), F.round(P.conviction(F.col("direction"), F.col("probability")), 6).alias("size"))
