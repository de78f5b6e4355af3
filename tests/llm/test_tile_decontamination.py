"""Greedy tiling against a plain search for longest runs, and whole pairs."""

import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from assayline.llm import tile_decontamination as td


def plain_tiles(a, b, least):
    free_a, free_b, tiles = [x >= 0 for x in a], [x >= 0 for x in b], []
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j, n)]
                elif n == best and n >= least:
                    found.append((i, j, n))
        if not found:
            return tiles
        for i, j, n in found:
            if all(free_a[i : i + n]) and all(free_b[j : j + n]):
                tiles.append((i, j, n))
                for k in range(n):
                    free_a[i + k] = free_b[j + k] = False


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-1, 3), max_size=25), st.lists(st.integers(-1, 3), max_size=25), st.integers(1, 4))
def test_tiles(a, b, least):
    assert td.greedy_tiles(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), least) == plain_tiles(a, b, least)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=40), st.integers(1, 12))
def test_running_hashes_tell_windows_apart(ids, size):
    got = td.running_hashes(np.array(ids, dtype=np.int64), size)
    windows = [tuple(ids[i : i + size]) for i in range(len(ids) - size + 1)]
    assert len(got) == len(windows) and len(set(got.tolist())) == len(set(windows))


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
W = ITEM.split()
TEXTS = {
    1: "before " + ITEM.upper() + " after",
    2: " ".join(W[8:] + ["cut"] + W[:8]),  # reordered
    3: " ".join(W[:7]),  # 7 of 16 words
    4: " ".join(W[:8]),
    5: "nothing here",
    6: "",
    7: None,
    8: " ".join(W[::-1]),
    9: "beta beta " * 5_000,
    10: "one two",
}


def pairs(spark, texts, items, **kw):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()], "request_id long, raw string, item_id int, row string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    return {(r["request_id"], r["item_id"]): r for r in td.contaminated(docs, tests, **kw).collect()}


def test_contaminated(spark):
    got = pairs(spark, TEXTS, [(100, ITEM), (101, "one two"), (102, None), (103, ""), (104, "...")])
    assert set(got) == {(1, 100), (2, 100), (4, 100), (10, 101)}
    assert got[1, 100]["coverage"] == got[2, 100]["coverage"] == 1.0 and got[2, 100]["tiles"] == 2
    assert got[4, 100]["coverage"] == 0.5 and got[10, 101]["covered_words"] == 2


def test_blocks_of_items_give_the_same_pairs(spark):
    items = [(i, " ".join(W[i:] + W[:i])) for i in range(16)]
    one = pairs(spark, TEXTS, items)
    assert one and one == pairs(spark, TEXTS, items, block_bytes=200)


def test_empty_tables(spark):
    assert pairs(spark, TEXTS, [(1, None)]) == {}
    docs = spark.createDataFrame([], "request_id long, raw string")
    assert td.contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0


def test_repeated_words_take_no_quadratic_time():
    item, text = np.zeros(400, dtype=np.int64), np.zeros(20_000, dtype=np.int64)
    began = time.process_time()
    assert td.greedy_tiles(item, text, 5) == [(0, 0, 400)]
    held = td.Items([(1, "no " * 400)], 5)
    assert [p["coverage"] for p in held.compare("no " * 20_000, 0.5)] == [1.0]
    mixed = np.arange(20_000, dtype=np.int64) % 7
    mixed[::6] = -1
    assert len(td.greedy_tiles(item, mixed, 5)) == 0
    assert time.process_time() - began < 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=60), st.lists(st.integers(0, 1), max_size=60), st.integers(1, 4))
def test_tiles_of_few_words(a, b, least):
    assert td.greedy_tiles(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), least) == plain_tiles(a, b, least)


def test_text_keys_and_null_item_ids(spark):
    docs = spark.createDataFrame([("req-a", ITEM), ("req-b", "x"), (None, "one two")], "request_id string, raw string")
    tests = spark.createDataFrame([("t-1", ITEM), (None, "one two"), (None, ITEM), ("t-2", None)], "item_id string, text string")
    got = {(r["request_id"], r["item_id"]) for r in td.contaminated(docs, tests).collect()}
    assert got == {("req-a", "t-1"), ("req-a", None), (None, None)}
    mixed = spark.createDataFrame([(1, ITEM), (None, "one two")], "item_id long, text string")
    assert {(r["request_id"], r["item_id"]) for r in td.contaminated(docs, mixed).collect()} == {("req-a", 1), (None, None)}
