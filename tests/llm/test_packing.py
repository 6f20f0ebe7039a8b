import numpy as np

from tideglass.llm.packing import best_two_fit, default_vocabulary, encoding, pack


def test_bins_hold_everything_once():
    rng = np.random.default_rng(4)
    for n, cap in ((1, 10), (300, 64), (2000, 2048)):
        sizes = np.minimum(rng.geometric(4 / cap, n), cap)
        bins = best_two_fit(sizes, cap)
        load = np.bincount(bins, sizes)
        assert (bins >= 0).all() and load.max() <= cap
        assert len(load) <= -(-sizes.sum() // cap) * 1.25 + 1


def test_two_replace_the_smallest():
    # greedy takes 6 and 3 of 10; 3 gives way to 2 + 2, which fill the bin
    sizes = np.array([6, 3, 2, 2])
    bins = best_two_fit(sizes, 10)
    assert np.bincount(bins, sizes).max() == 10
    # the same size twice needs two items of it
    assert np.bincount(best_two_fit(np.array([6, 3, 2]), 10), np.array([6, 3, 2])).max() <= 10


def test_pack_keeps_all_tokens(spark):
    enc = encoding(default_vocabulary())
    texts = {1: "a short note", 2: "word " * 700, 3: "", 4: None, 5: "another", None: "no id", 6: "x" * 30_000}
    df = spark.createDataFrame([(i, t, "n") for i, t in texts.items()] + [(1, texts[1], "again")], "doc_id long, text string, shard string")
    got = pack(df, "doc_id", "text", capacity=128, shard_rows=3).collect()
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    want = {i: len(enc.encode_ordinary(t)) for i, t in texts.items() if i is not None and t is not None}
    want[1] *= 2
    assert total == want
    load = {}
    for r in got:
        load[r.shard, r.container] = load.get((r.shard, r.container), 0) + r.n_tokens
    assert max(load.values()) <= 128
    for i in (2, 6):
        pieces = sorted((r.piece, r.start, r.n_tokens) for r in got if r.doc_id == i)
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and all(s == p * 128 for p, s, _ in pieces)
    assert all(r.piece == 0 for r in got if want[r.doc_id] <= 128)
    assert pack(df.limit(0), "doc_id", "text").count() == 0
