"""Hard negatives against all products; the query has SQL of its own."""

import numpy as np
import pytest

from assayline.llm import hard_negatives
from assayline.llm.hard_negatives import mine_negatives

SCHEMA = "vec_id long, label int, embedding array<double>, rank string, shard string, place int"


def brute(rows, anchors, positives, negatives, least, most):
    found = set()
    for a in anchors:
        label, x = rows[a]
        scored = sorted((-int(np.dot(x, v)), i, lab) for i, (lab, v) in rows.items() if i != a)
        for p, i, _ in [r for r in scored if r[2] == label][:positives]:
            fit = [(-s, j) for s, j, lab in scored if lab != label and least * -p <= 100 * -s <= most * -p][:negatives]
            found |= {(a, i, n + 1, j, -p, s) for n, (s, j) in enumerate(fit)}
    return found


def frame(spark, rows):
    return spark.createDataFrame([(i, lab, [float(x) for x in v], "x", "y", 1) for i, (lab, v) in rows.items()], SCHEMA)


@pytest.mark.parametrize("shape", [(300, 6, 3), (300, 21, 40)])
def test_equal_to_all_products(spark, shape):
    n, width, top = shape
    rng = np.random.default_rng(7)
    # A third of all rows bears one label; small components make many ties.
    rows = {i: (0 if i % 3 == 0 else int(rng.integers(0, 5)), rng.integers(-top, top + 1, width)) for i in range(n)}
    rows |= {n + i: (i % 4, rows[0][1]) for i in range(40)}
    anchors = [i for i in rows if i % 20 == 0]
    table = frame(spark, rows)
    for shard_rows, anchor_rows in ((64, 4), (10_000, 256)):
        got = mine_negatives(table, table.filter("vec_id % 20 = 0"), positives=3, negatives=4, shard_rows=shard_rows, anchor_rows=anchor_rows)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        records = [tuple(r) for r in got.collect()]
        assert len(records) == len(set(records)) and set(records) == brute(rows, anchors, 3, 4, 30, 90)


def test_bounds_drop_candidates_early():
    rng = np.random.default_rng(1)
    columns = rng.integers(-20, 21, (32, 500)).astype(np.float64)
    columns[0, 250:] -= 1000
    row = {"ids": np.arange(500).tobytes(), "codes": np.zeros(500, np.int32).tobytes(), "names": ["0"], "columns": columns.tobytes(), "width": 32, "n": 500}
    shard, seen = hard_negatives.Shard(row), []
    anchor = {"vec_id": 1000, "label": "0", "embedding": [50.0] + [1.0] * 31}
    keep = shard.scan

    def scan(a, bitmap, narrow):
        def counted(low, high):
            stay = narrow(low, high)
            seen.append(len(low) if stay is None else int(stay.sum()))
            return stay

        return keep(a, bitmap, counted)

    shard.scan = scan
    ids, scores = hard_negatives.nearest(shard, anchor, 5)
    want = sorted((-int(s), i) for i, s in enumerate(np.array(anchor["embedding"]) @ columns))[:5]
    assert list(zip((-scores).tolist(), ids.tolist())) == want
    assert seen[0] <= 250 and seen == sorted(seen, reverse=True)


def test_odd_rows(spark):
    rows = [
        (1, 1, [4.0, 2.0], "", "", 0),
        (1, 1, [4.0, 2.0], "", "", 0),
        (2, 1, [5.0], "", "", 0),
        (3, 2, [2.0, 1.0, 9.0], "", "", 0),
        (4, 2, None, "", "", 0),
        (5, None, [2.0, 1.0], "", "", 0),
        (6, 2, [float("nan"), 1.0], "", "", 0),
        (7, 2, [None, 1.0], "", "", 0),
        (None, 2, [2.0, 1.0], "", "", 0),
        (8, 3, [], "", "", 0),
        (9, 4, [float("inf"), 1.0], "", "", 0),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    # 1 and 2 score 20 with each other; 3 scores 10 with both, within 6 to 18; the empty vector scores 0.
    assert sorted(map(tuple, mine_negatives(table, table).collect())) == [(1, 2, 1, 3, 20, 10), (2, 1, 1, 3, 20, 10)]
    assert mine_negatives(table.limit(0), table.limit(0)).count() == 0
    assert mine_negatives(table, table.limit(0)).count() == 0
    assert mine_negatives(table.filter("vec_id = 1"), table).count() == 0


def test_large_components_stay_exact(spark):
    rows = {1: (0, [2**30, 1]), 2: (0, [2**30, 3]), 3: (1, [2**29, 5]), 4: (1, [2**29, 4])}
    got = mine_negatives(frame(spark, rows), frame(spark, {1: rows[1]})).collect()
    assert [tuple(r)[2:] for r in got] == [(1, 3, 2**60 + 3, 2**59 + 5), (2, 4, 2**60 + 3, 2**59 + 4)]
