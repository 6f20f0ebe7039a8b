import numpy as np

from tideglass.llm.nearest import LearnedIndex, nearest_in_time

L = "sid long, e string, ts timestamp, note string"
C = "cid long, e string, ts timestamp, note string"




def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema.replace("ts timestamp", "us long")).selectExpr(*[c.split()[0] for c in schema.split(", ") if "ts " not in c], "timestamp_micros(us) ts")


def brute(left, right, tol):
    out = set()
    for s, e, t, _ in left:
        if None in (s, e, t):
            continue
        best = min(((abs(u - t), u, c) for c, f, u, _ in right if None not in (c, f, u) and f == e and abs(u - t) <= tol), default=None)
        if best:
            out.add((s, best[2]))
    return out


def test_learned_index_is_exact():
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(0, 10**6, 500), 10**9 + rng.integers(0, 50, 40)]))
    shard = (keys > 10**8).astype(int)
    index = LearnedIndex(keys, shard, error=4)
    q = np.concatenate([rng.integers(-5, 10**6 + 5, 400), keys, keys + 1, [10**9 + 100]])
    assert (index.lower_bound(q) == np.searchsorted(keys, q)).all()
    assert len(LearnedIndex(np.zeros(0, np.int64), np.zeros(0)).lower_bound(np.array([1, 2]))) == 2


def test_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    left = [(i, str(rng.choice(["a", "b", "hot"], p=[0.1, 0.1, 0.8])), int(rng.integers(0, 9 * 3600 * 10**6)), "x") for i in range(400)]
    left += left[:20] + [(None, "a", 5, "x"), (900, None, 5, "x"), (901, "a", None, "x"), (902, "none", 5, "x")]
    right = [(i, str(rng.choice(["a", "b", "hot"])), int(rng.integers(0, 9 * 3600)) * 10**6, "y") for i in range(500)]
    right += [(1000 + i, e, t, "y") for i, (_, e, t, _) in enumerate(right[:60])] + [(None, "a", 1, "y"), (2000, None, 1, "y"), (2001, "a", None, "y")]
    right += [(3000, "edge", 3600 * 10**6 - 1, "y"), (3001, "edge", 3600 * 10**6 + 1, "y")]
    left += [(910, "edge", 3600 * 10**6, "x"), (911, "edge", 3600 * 10**6 + 120 * 10**6 + 1, "x"), (912, "edge", 3600 * 10**6 + 120 * 10**6 + 2, "x")]
    got = nearest_in_time(frame(spark, left, L), frame(spark, right, C), "sid", "cid", "e", "ts", 120)
    pairs = [tuple(r)[:2] for r in got.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute(left, right, 120 * 10**6)


def test_empty_sides(spark):
    some = [(1, "a", 5, "x")]
    assert nearest_in_time(frame(spark, [], L), frame(spark, some, C), "sid", "cid", "e", "ts", 10).count() == 0
    assert nearest_in_time(frame(spark, some, L), frame(spark, [], C), "sid", "cid", "e", "ts", 10).count() == 0
