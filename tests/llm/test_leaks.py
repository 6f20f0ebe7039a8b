import os
import random

import numpy as np
import pytest

from tideglass.llm.leaks import PATTERN, ItemIndex, LeakConfig, WuManber, find_leaks, in_order, most_in_order, words

ITEM = "Given that the barrier moved up 60 ticks with 546 contracts still open, what must the Orrin study do with the remaining 87 unpaired legs so that the touch frequency stays above 0.997?"
OTHER = "Which page of the Thistle book first admits that the test fold borrowed 63 rows of the 757 used for fitting, and how were the strike buckets relabelled?"


def test_words_drop_what_does_not_matter():
    assert words("The <b>848</b> **stretched‑copy** slo​pe &#44; café\\nof 0.5 “quoted”") == ["the", "848", "stretchedcopy", "slope", "café", "of", "05", "quoted"]
    assert words("") == [] and words("... --") == []


def test_wu_manber_equals_plain_search():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 7, 3000).astype(np.int32)
    patterns = np.unique(rng.integers(1, 7, (12, PATTERN)), axis=0).astype(np.int32)
    for lanes in (1, 7, 64, 4096):
        where, which = WuManber(patterns, 6).search(ids, lanes)
        got = sorted(zip(where.tolist(), which.tolist()))
        want = sorted((p, k) for k, x in enumerate(patterns) for p in range(len(ids) - PATTERN + 1) if (ids[p : p + PATTERN] == x).all())
        assert got == want


def test_in_order_is_the_longest_common_subsequence():
    a, b = np.array([1, 2, 3, 4]), np.array([9, 1, 3, 9, 2, 4])
    mine, places = in_order(a, b)
    assert len(mine) == most_in_order(a, b) == 3 and (a[mine] == b[places]).all() and (np.diff(places) > 0).all()
    assert most_in_order(a, np.array([], int)) == 0 == len(in_order(a, np.array([], int))[0])
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 5, 12), rng.integers(0, 5, 20)
        best = np.zeros((13, 21), int)
        for i in range(12):
            for j in range(20):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        assert best[-1, -1] == most_in_order(a, b) == len(in_order(a, b)[0])


def test_finds_whole_partial_and_changed_copies(spark, rows):
    w = ITEM.split()
    docs = [
        (1, "Intro text here. " + ITEM + " And after."),
        (2, ITEM.upper().replace(" ", " ")),
        (3, "bla bla " + " ".join(w[: len(w) * 6 // 10]) + " bla"),
        (4, "bla " + " ".join(w[: len(w) // 4]) + " bla bla"),
        (5, ITEM.replace("unpaired legs", "open legs indeed").replace("above", "over")),
        (6, "Given that the barrier moved up 12 ticks, the desk waits for the remaining contracts and reads the note again so that nothing is lost."),
        (7, ""), (8, None), (None, ITEM), (9, "word " * 20_000 + ITEM + " tail" * 20_000), (10, ITEM + " " + OTHER),
    ]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(7, ITEM), (8, OTHER), (9, None), (None, ITEM), (10, "two words"), (11, "")], "item_id long, text string")
    want = [(1, 7), (10, 7), (10, 8), (2, 7), (3, 7), (5, 7), (9, 7)]
    assert sorted(set(rows(find_leaks(d, e, "doc_id", "text", "item_id", "text"), "doc_id", "item_id"))) == sorted(want)
    # several blocks of items give the same
    assert sorted(set(rows(find_leaks(d, e, "doc_id", "text", "item_id", "text", block=1), "doc_id", "item_id"))) == sorted(want)
    assert find_leaks(d.limit(0), e, "doc_id", "text", "item_id", "text").count() == 0
    assert find_leaks(d, e.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_equal_items_each_count():
    index = ItemIndex([(1, ITEM), (2, ITEM), (3, ITEM), (4, ITEM), (5, OTHER)], LeakConfig())
    assert sorted(x[1] for x in index.leaks([words(ITEM)])) == [1, 2, 3, 4]


def test_half_copy_before_a_denser_passage_is_found():
    w = ITEM.split()
    half, third = " ".join(w[: len(w) * 6 // 10]), " ".join(w[: len(w) // 3])
    index = ItemIndex([(1, ITEM), (2, OTHER)], LeakConfig())
    assert [x[1] for x in index.leaks([words(half)])] == [1] and not list(index.leaks([words(f"{third} {third} {third}")]))
    assert [x[1] for x in index.leaks([words(half + " bla" * 200 + f" {third} {third} {third}")])] == [1]


def test_items_of_one_pattern_do_not_stand_in_for_each_other():
    one = "Who signed off the idle rows in the first study on day 46, given the fit was renewed every 59 days on 755 closes and a reject share no better than 0.813?"
    two = "Who signed off the late fills in the second index on day 19, given the fit was renewed every 24 days on 847 closes and a ceiling rate no better than 0.984?"
    index = ItemIndex([(1, one), (2, two), (3, ITEM), (4, OTHER)], LeakConfig())
    assert [x[1] for x in index.leaks([words(one)])] == [1]
    assert sorted(x[1] for x in index.leaks([words(one + " and then " + two)])) == [1, 2]
    near = one.replace("46", "47")  # nearly the same item: both leak
    index = ItemIndex([(1, one), (2, near), (3, ITEM), (4, OTHER)], LeakConfig())
    assert sorted(x[1] for x in index.leaks([words(one)])) == [1, 2]


ITEMS = "/root/testdata/sf0.01/eval_item.parquet"


@pytest.mark.skipif(not os.path.exists(ITEMS), reason="no test tables here")
def test_recall_by_edit():
    """Every item planted once for each way of changing it, between other text."""
    import pyarrow.parquet as pq

    t = pq.read_table(ITEMS)
    items = list(zip(t["item_id"].to_pylist(), t["text"].to_pylist()))
    index = ItemIndex(items, LeakConfig())
    r, fill = random.Random(5), "report series window quarter harvest engine".split()

    def edits(w):
        yield "whole", w
        yield "first 55 %", w[: int(len(w) * 0.55) + 1]
        yield "last 55 %", w[-int(len(w) * 0.55) - 1 :]
        for k in (3, 4):
            yield f"each {k} changed", [r.choice(fill) if j % k == 1 else x for j, x in enumerate(w)]
            yield f"each {k} dropped", [x for j, x in enumerate(w) if j % k != 1]

    texts, keys = [], []
    for i, text in items:
        for name, w in edits(text.split()):
            texts.append(" ".join(["The harvest was early this year and the engine ran."] + w + ["Another window of the series follows here."]))
            keys.append((name, i))
    got = {(n, i) for n, i, *_ in index.leaks([words(x) for x in texts])}
    for name in {k for k, _ in keys}:
        mine = [n for n, k in enumerate(keys) if k[0] == name]
        assert sum((n, keys[n][1]) in got for n in mine) / len(mine) >= 0.97, name
