"""Windows moved once, payload ledgers, and references as rows."""

import random

from pyspark.sql import functions as F

from assayline.operators import attempts, reference
from assayline.operators.windows import WINDOW_FOLD, window_lines, window_starts


def test_window_lines_against_a_plain_scan(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for name in ("a", "b", None):
        free, start = 0, None
        for n in range(1, 120):
            hit = rng.random() < 0.15
            if hit and n >= free:
                start, free = n, n + 5
            if n < free:
                want.add((name, start, n, f"{name}{n}"))
            rows.append((name, n, f"{name}{n}", hit))
    lines = spark.createDataFrame(rows, "file string, line_no bigint, line string, hit boolean").repartition(5)
    for fold in (5, 8, 4096):
        starts = window_starts(lines, ["file"], "line_no", F.col("hit"), 5, fold_lines=fold, fold_group=2)
        inside = window_lines(lines, starts, ["file"], "line_no", 5, fold)
        assert sorted(inside.select("file", "start_line", "line_no", "line").collect(), key=repr) == sorted(want, key=repr)


def test_text_of_lines_moves_once(spark):
    lines = spark.range(1, 2000).select(F.lit("a").alias("file"), F.col("id").alias("line_no"), F.col("id").cast("string").alias("line"))
    starts = window_starts(lines, ["file"], "line_no", F.col("line_no") % 50 == 0, 3)
    inside = window_lines(lines, starts, ["file"], "line_no", 3)
    blocks = inside.groupBy("file", WINDOW_FOLD, "start_line").agg(F.max("line").alias("last"))
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # words of the filter, and the lines
    assert blocks.count() == 39


def test_a_second_run_reads_no_payload(spark):
    rows = [("a", 1, "x"), ("a", 2, "yy"), (None, 1, "zzz"), ("b", 1, None)]
    df = spark.createDataFrame(rows, "request_id string, attempt int, raw string")
    args = (["request_id"], ["attempt"])
    judge = lambda d: d.withColumn("chars", F.length("raw"))
    first = attempts.judge_unseen(df, None, *args, judge, ["chars"])
    full = {("a", 2, 2), (None, 1, 3), ("b", 1, None)}
    assert {tuple(r)[:3] for r in first.collect()} == full

    sealed = df.withColumn("raw", F.raise_error(F.lit("a payload was read")).cast("string"))
    assert {tuple(r)[:3] for r in attempts.judge_unseen(sealed, first, *args, judge, ["chars"]).collect()} == full

    # One newer row: it alone is read.
    newer = spark.createDataFrame([("a", 3, "wwww"), ("c", 1, "v")], df.schema)
    more = attempts.judge_unseen(df.withColumn("raw", F.lit("old")).unionByName(newer), first, *args, judge, ["chars"])
    assert sorted((tuple(r)[:3] for r in more.collect()), key=repr) == sorted([("a", 3, 4), ("c", 1, 1), (None, 1, 3), ("b", 1, None)], key=repr)
    # A key that is gone keeps its entry; an older row changes nothing.
    kept = attempts.judge_unseen(df.filter("attempt = 1"), more, *args, judge, ["chars"])
    assert sorted(kept.collect(), key=repr) == sorted(more.collect(), key=repr)


def test_a_new_version_judges_again(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 1, "yy")], "request_id string, attempt int, raw string")
    first = attempts.judge_unseen(df, None, ["request_id"], ["attempt"], lambda d: d.withColumn("v", F.lit(1)), ["v"])
    again = attempts.judge_unseen(df, first, ["request_id"], ["attempt"], lambda d: d.withColumn("v", F.lit(2)), ["v"], version="2")
    assert sorted(tuple(r) for r in again.collect()) == [("a", 1, 2, "2"), ("b", 1, 2, "2")]
    assert attempts.judge_unseen(df.limit(0), None, ["request_id"], ["attempt"], lambda d: d.withColumn("v", F.lit(1)), ["v"]).count() == 0


def test_reference_rows_equal_the_map(spark):
    rng = random.Random(5)
    names = [f"VS{i}" for i in range(30)]
    palettes = {"p": {n: f"#{i:06x}" for i, n in enumerate(names) if i % 3}, "q": {"VS1": None, "VS2": "#ABCDEF"}}
    texts = [
        (i, brand, "".join(rng.choice(["é ", "", "\n"]) + f"\\definecolor{{{rng.choice(names)}}}{{HTML}}{{0000{rng.randint(10, 99)}}}" for _ in range(rng.randint(0, 40))) + rng.choice(["", "end"]))
        for i, brand in enumerate(["p", "q", "none", None] * 8)
    ]
    texts += [(100, "p", None), (None, "p", "\\definecolor{VS1}{HTML}{000000}"), (101, "p", "")]
    df = spark.createDataFrame(texts, "request_id long, brand string, raw string")
    rows = spark.createDataFrame([(b, n, h) for b, entries in palettes.items() for n, h in entries.items()], "brand string, role string, hex string")
    maps = spark.createDataFrame(list(palettes.items()), "brand string, colours map<string,string>")
    want = reference.conform(reference.attach_reference(df, maps, ["brand"]), "raw", "colours").select("request_id", "raw", "off_reference")
    for options in ({}, {"part_hits": 3}, {"part_hits": 1, "min_rows": 1, "share": 0.01}):
        got = reference.conform_rows(df, ["request_id"], "raw", rows, ["brand"], **options).select("request_id", "raw", "off_reference")
        assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr), options
    assert reference.conform_rows(df.limit(0), ["request_id"], "raw", rows, ["brand"]).count() == 0
    same = reference.conform_rows(df, ["request_id"], "raw", rows.limit(0), ["brand"])
    assert same.filter("size(off_reference) > 0").count() == 0
    assert sorted(same.select("request_id", "brand", "raw").collect(), key=repr) == sorted(df.collect(), key=repr)
