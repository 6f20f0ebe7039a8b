import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tideglass.operators.bars import time_bars
from tideglass.sources import readers as R
from tideglass.streaming import jobs as J


def test_tick_files(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("60,100.5,1\n60,100.5,1\n120,101,2\n")
    (tmp_path / "b.csv").write_text("60,7,1\n")
    t = R.tick_files(spark, {"A": str(tmp_path / "a.csv"), "B": str(tmp_path / "b.csv")})
    assert rows(t.select("asset", F.unix_seconds("ts"), "price")) == [("A", 120, 101.0), ("A", 60, 100.5), ("B", 60, 7.0)]


def test_venue_shapes(spark, rows):
    k = spark.createDataFrame([("x", json.dumps([[1000, "1", "2", "0.5", "1.5", "9"], [2000, "1", "3", "1", "2", "4"]]))], "asset string, body string")
    assert rows(R.klines(k, "body").select("asset", F.unix_millis("ts"), "high", "volume")) == [("x", 1000, 2.0, 9.0), ("x", 2000, 3.0, 4.0)]
    o = spark.createDataFrame([("x", json.dumps({"error": [], "result": {"K": [[60, "1", "2", "0.5", "1.5", "1.2", "9", 3]]}}))], "asset string, body string")
    assert rows(R.keyed_ohlc(o, "body", "K").select("asset", F.unix_seconds("ts"), "close", "volume")) == [("x", 60, 1.5, 9.0)]
    bad = spark.createDataFrame([("x", json.dumps({"error": ["E"], "result": {"K": [[60, "1", "2", "0.5", "1.5", "1.2", "9", 3]]}}))], "asset string, body string")
    with pytest.raises(Exception, match="source error"):
        R.keyed_ohlc(bad, "body", "K").collect()
    h = spark.createDataFrame([("m", json.dumps({"history": [{"t": 5, "p": 0.25}]}))], "market string, body string")
    assert rows(R.price_history(h, "body").select("market", F.unix_seconds("ts"), "last_price")) == [("m", 5, 0.25)]
    s = spark.createDataFrame([("↑ $90,000",), ("↓ 2.61",), ("No change",)], "t string")
    assert [tuple(r) for r in s.select(*R.strike_from(F.col("t"))).collect()] == [("up", 90000.0), ("down", 2.61), (None, None)]
    d = spark.createDataFrame([("0.35",), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(R.dollars(F.col("t"))).collect()] == [0.35, None, None]
    good, rest = R.split_valid(spark.createDataFrame([(0.5,), (2.0,), (None,)], "x double"), F.col("x").between(0, 1))
    assert good.count() == 1 and rest.count() == 2


def test_files_caches_and_artifacts(spark, tmp_path, rows):
    (tmp_path / "l.json").write_text(json.dumps([{"meeting_date": "2024-01-31", "hawkish_dovish_score": 0.5}]))
    assert R.json_array(spark, str(tmp_path / "l.json"), R.LABEL).first().hawkish_dovish_score == 0.5
    (tmp_path / "n.md").write_text("# A\ntext")
    assert R.text_files(spark, [str(tmp_path), str(tmp_path)]).count() == 1
    req = spark.createDataFrame([("m", "one"), ("m", "two")], "model string, text string")
    cache = req.where("text = 'one'").select(F.sha2(F.concat_ws("|", "model", "text"), 256).alias("key"), F.lit("answer").alias("answer"))
    hit, miss = R.cached_by_content(req, cache, ["model", "text"])
    assert rows(hit, "text", "answer") == [("one", "answer")] and rows(miss, "text") == [("two",)]
    art = {"kind": "har", "coef": [1, 2]}
    one = R.save_artifact(str(tmp_path / "m.json"), art)
    assert R.load_artifact(str(tmp_path / "m.json")) == art and one.startswith("har-")
    assert R.read_within(str(tmp_path), "n.md") == "# A\ntext"
    with pytest.raises(PermissionError):
        R.read_within(str(tmp_path), "../etc/passwd")
    R.write_table(req, str(tmp_path / "out"), form="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_replay_source(spark, tmp_path):
    (tmp_path / "events.json").write_text('{"events": []}')
    spark.dataSource.register(R.ReplaySource)
    r = spark.read.format("replay").option("path", str(tmp_path)).option("venue", "v").load().collect()
    assert [(x.venue, x.endpoint, x.payload) for x in r] == [("v", "events", '{"events": []}')]


TICK = "asset string, ts timestamp, price double, volume double, id long"


def ticks(spark, lo, hi):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("ab"[i % 2], t0 + dt.timedelta(minutes=i), 100.0 + i % 7, 1.0, i) for i in range(lo, hi)], TICK)


def test_streamed_bars_equal_batch(spark, tmp_path, rows):
    src = str(tmp_path / "in")
    for lo in (0, 200, 400):
        ticks(spark, lo, lo + 200).coalesce(1).write.mode("append").parquet(src)
    s = J.stream_of(spark, src, ticks(spark, 0, 1).schema)
    got = J.run_to_memory(J.streaming_bars(s), "bars_out", "complete", str(tmp_path / "cp"))
    assert rows(got, "asset", "bar", "open", "close", "n_trades") == rows(time_bars(ticks(spark, 0, 600), 3600), "asset", "bar", "open", "close", "n_trades")


def test_keyed_state_equals_one_pass(spark, tmp_path):
    src = str(tmp_path / "in")
    for lo in (0, 60):
        ticks(spark, lo, lo + 60).coalesce(1).write.mode("append").parquet(src)
    s = J.stream_of(spark, src, ticks(spark, 0, 1).schema)
    got = J.run_to_memory(J.keyed_state(s), "state_out", "append", str(tmp_path / "cp")).where("asset = 'a'").orderBy("us").collect()
    now, want = (2.0, 1e-6, float("nan"), 0.0, -(2**62)), []
    for r in ticks(spark, 0, 120).where("asset = 'a'").orderBy("ts").select(F.unix_micros("ts").alias("us"), "price").collect():
        now = J._step(now, r.us, r.price, 0.99, 0.2, 2.0, 0.5)
        want.append((r.us, now[2], now[3]))
    assert [(r.us, r.level, r.position) for r in got] == want


def test_stream_into_table_ignores_known_keys(spark, tmp_path, rows):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    ticks(spark, 0, 10).coalesce(1).write.mode("append").parquet(src)
    J.into_table(J.stream_of(spark, src, ticks(spark, 0, 1).schema), out, ["id"], cp)
    ticks(spark, 5, 15).coalesce(1).write.mode("append").parquet(src)
    J.into_table(J.stream_of(spark, src, ticks(spark, 0, 1).schema), out, ["id"], cp)
    assert rows(J.read_table(spark, out), "id") == sorted([(i,) for i in range(15)], key=repr)


def test_a_batch_that_broke_off_leaves_the_table_whole(spark, tmp_path, rows):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    ticks(spark, 0, 10).coalesce(1).write.mode("append").parquet(src)
    J.into_table(J.stream_of(spark, src, ticks(spark, 0, 1).schema), out, ["id"], cp)
    broken = tmp_path / "out" / "part-00000000-0000000007"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half a file")
    ticks(spark, 5, 15).coalesce(1).write.mode("append").parquet(src)
    J.into_table(J.stream_of(spark, src, ticks(spark, 0, 1).schema), out, ["id"], cp)
    # another job with a checkpoint of its own adds to the same table
    J.into_table(J.stream_of(spark, src, ticks(spark, 0, 1).schema), out, ["id"], str(tmp_path / "cp2"))
    assert rows(J.read_table(spark, out), "id") == sorted([(i,) for i in range(15)], key=repr)
    (broken / "_SUCCESS").touch()  # a folder that calls itself complete and cannot be read is an error, not an empty table
    ticks(spark, 20, 22).coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(Exception):
        J.into_table(J.stream_of(spark, src, ticks(spark, 0, 1).schema), out, ["id"], cp)


def test_freshness_and_failing_venues(spark):
    now = dt.datetime(2024, 1, 1, 3)
    assert J.fresh(ticks(spark, 0, 200), "ts", now, 3600).count() == 80
    got = J.each_venue({"a": lambda: 3, "b": lambda: 1 / 0})
    assert got["a"] == 3 and isinstance(got["b"], ZeroDivisionError)
