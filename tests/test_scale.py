import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from assayline.operators.attempts import resolve_attempts
from assayline.operators.render import assemble
from assayline.operators.scale import SLICE, evenly, hot_keys, in_slices, largest_key, numbered, possible, running_total, spread_join
from assayline.operators.shapes import encode_first_seen, first_seen_dictionary
from assayline.operators.tone import contrast_partners
from assayline.session import CLEANUP_CONF, materialise, scratch
from assayline.workload.registry import Tables
from assayline.workload.text_queries import canvas_documents


def skewed(spark, rows=3000):
    """A third of the rows under one key, one key NULL."""
    rng = random.Random(3)
    base = datetime(2024, 1, 1)
    data = [
        (rng.choice(["hot", None, *[f"k{i}" for i in range(4)]]) if i % 3 else "hot", base + timedelta(seconds=rng.randint(0, 500)), i)
        for i in range(rows)
    ]
    return spark.createDataFrame(data, "k string, ts timestamp, id bigint").cache()


def test_numbering_in_slices_equals_one_window(spark):
    df = skewed(spark)
    plain = numbered(df, ["k"], ["ts", "id"])
    assert in_slices(df, ["k"], ["ts", "id"]) is None
    assert in_slices(df, ["k"], ["ts", "id"], 50) is not None
    for per_slice in (50, 7, 1500):
        cut = numbered(df, ["k"], ["ts", "id"], rows_per_slice=per_slice)
        assert cut.count() == df.count()
        assert cut.exceptAll(plain).count() == 0, per_slice


def test_numbering_by_text_date_and_null_order(spark):
    df = spark.createDataFrame(
        [("a", None, 0)] + [("a", f"é{i:04d}", i) for i in range(1, 200)], "k string, t string, id int"
    )
    rows = numbered(df, ["k"], ["t", "id"], rows_per_slice=10).collect()
    assert {(r.id, r.line_no) for r in rows} == {(i, i + 1) for i in range(200)}
    days = df.select("k", F.expr("date_add(date'2024-01-01', id)").alias("d"), "id")
    rows = numbered(days, ["k"], ["d"], rows_per_slice=10).collect()
    assert {(r.id, r.line_no) for r in rows} == {(i, i + 1) for i in range(200)}


def largest_slice(df, keys, order, per_slice):
    return in_slices(df, keys, order, per_slice).groupBy(*keys, SLICE).count().agg(F.max("count")).first()[0]


def test_no_slice_is_large_whatever_the_order_column_holds(spark):
    assert largest_slice(skewed(spark), ["k"], ["ts", "id"], 100) <= 100
    names = spark.range(10_000).select(
        F.lit("doc").alias("k"),
        F.concat(F.lit("dyncolor"), "id").alias("name"),
        F.date_format(F.timestamp_seconds(1_704_067_200 + F.col("id")), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        F.lit(datetime(2024, 1, 1)).alias("one"),
        "id",
    )
    for order in (["name"], ["iso"], ["one", "id"]):
        assert largest_slice(names, ["k"], order, 1000) <= 1000, order


def test_slices_never_decrease(spark):
    rows = in_slices(skewed(spark), ["k"], ["ts", "id"], 20).filter("k = 'hot'").orderBy("ts", "id").collect()
    assert rows[-1][SLICE] - rows[0][SLICE] > 10
    assert all(a[SLICE] <= b[SLICE] for a, b in zip(rows, rows[1:]))


def test_running_total(spark):
    df = skewed(spark, 400)
    total = {"t": F.col("id") % 5}
    plain = running_total(df, ["k"], ["ts", "id"], total)
    assert running_total(df, ["k"], ["ts", "id"], total, 20).exceptAll(plain).count() == 0


def test_hot_keys_and_spread_join(spark):
    df = skewed(spark)
    assert len(hot_keys(df, ["k"], min_rows=1000)) == 1
    assert hot_keys(df, ["k"]) == []
    small = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 9)], "k string, v int")
    for how in ("left", "inner"):
        plain = df.join(small, ["k"], how)
        for least in (0, 1000):
            got = spread_join(df, small, ["k"], how, min_rows=least)
            assert got.count() == plain.count()
            assert got.select(*plain.columns).exceptAll(plain).count() == 0


def test_first_seen_ids_in_slices(spark):
    df = skewed(spark).withColumn("v", F.concat(F.lit("v"), F.col("id") % 97))
    plain = first_seen_dictionary(df, ["k"], "v", ["ts", "id"])
    cut = first_seen_dictionary(df, ["k"], "v", ["ts", "id"], rows_per_slice=9)
    assert cut.count() == plain.count() and cut.exceptAll(plain).count() == 0
    coded = encode_first_seen(df, ["k"], "v", ["ts", "id"], "code", min_rows=0)
    assert coded.count() == df.count()
    assert coded.filter("k = 'hot'").select("v", "code").distinct().count() == 97
    assert coded.filter("k IS NULL AND code IS NULL").count() == 0


def test_assemble_in_parts_loses_nothing(spark):
    df = skewed(spark, 500)
    whole = {r.k: r.text for r in assemble(df, ["k"], ["id"], F.col("id").cast("string"), ",", part_items=1000).collect()}
    parts = {}
    for r in assemble(df, ["k"], ["id"], F.col("id").cast("string"), ",", part_items=7, rows_per_slice=30).collect():
        parts.setdefault(r.k, {})[r.part] = r.text
    assert {k: ",".join(p[i] for i in sorted(p)) for k, p in parts.items()} == whole


def test_partners_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = [("g" if i % 3 else "hot", f"{rng.randrange(2**24):06X}") for i in range(150)]
    rows += [("hot", "808080")] * 5
    df = spark.createDataFrame(rows, "g string, hex string")

    def lum(h):
        def lin(c):
            c = int(c, 16) / 255
            return c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4
        return 0.2126 * lin(h[:2]) + 0.7152 * lin(h[2:4]) + 0.0722 * lin(h[4:])

    want = {}
    for i, (g, h) in enumerate(rows):
        near = sum(
            1
            for j, (g2, h2) in enumerate(rows)
            if i != j and g == g2 and (max(lum(h), lum(h2)) + 0.05) / (min(lum(h), lum(h2)) + 0.05) < 2.5
        )
        want[(g, round(lum(h), 9))] = near
    for per_slice in (None, 20):
        got = contrast_partners(df, ["g"], "hex", rows_per_slice=per_slice)
        assert {(r.g, round(r.lum, 9)): r.partners for r in got.collect()} == want


def test_possible_keeps_every_wanted_row_and_few_others(spark):
    big = spark.range(20_000).select((F.col("id") % 7_001).alias("k"), F.struct(F.when(F.col("id") % 3 > 0, F.col("id")).alias("n")).alias("at"))
    wanted = big.filter("k < 500")
    keys = wanted.count()
    kept = possible(big, wanted, ["k", "at"], keys)
    assert kept.columns == big.columns
    assert kept.filter("k < 500").count() == keys and kept.filter("k >= 500").count() < 0.1 * 20_000
    assert possible(big, wanted.limit(0), ["k", "at"], 0).count() == 0
    assert possible(big, wanted, ["k", "at"], 10**9) is big


def test_texts_of_other_attempts_are_dropped_before_the_shuffle(spark):
    """Of eight texts per request one is chosen; the filter leaves hardly more than those."""
    tries = spark.range(16_000).select(
        (F.col("id") % 2_000).alias("k"), "id", F.lit("busy").alias("status"), F.concat(F.lit("text "), "id").alias("v")
    )
    done = resolve_attempts(tries, ["k"], ["id"], "status", "v", "id")
    assert {r.last_payload for r in done.collect()} == {f"text {i}" for i in range(14_000, 16_000)}
    placed = tries.select("k", F.struct("id").alias("__at"), "v")
    assert 2_000 <= possible(placed, placed.filter("__at.id >= 14000"), ["k", "__at"], 2_000).count() < 3_000


def test_partition_count_does_not_matter(spark):
    df = skewed(spark, 600).withColumn("v", F.concat(F.lit("v"), F.col("id") % 23))
    tries = df.select("k", "id", F.when(F.col("id") % 50 == 7, "ok").otherwise("busy").alias("status"), "v")
    seen = []
    for parts in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spread = df.repartition(parts)
        jobs = (
            resolve_attempts(tries.repartition(parts), ["k"], ["id"], "status", "v", "id", rows_per_slice=40),
            encode_first_seen(spread, ["k"], "v", ["ts", "id"], "code", rows_per_slice=40),
            assemble(spread, ["k"], ["ts", "id"], F.col("v"), ",", part_items=25, rows_per_slice=40),
        )
        seen.append([sorted(map(str, job.collect())) for job in jobs])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_scratch_tables_go_and_kept_ones_stay(spark):
    def there(path):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)

    def folder(df):
        return df.inputFiles()[0].rsplit("/", 1)[0]

    with scratch(spark) as outer:
        with scratch(spark) as keep:
            inner = materialise(spark.range(10))
            kept = keep(inner.groupBy(F.col("id") % 3).count())
        assert not there(folder(inner)) and there(folder(kept)) and kept.count() == 3
        last = outer(kept.select("count"))
    assert not there(folder(kept)) and sorted(r[0] for r in last.collect()) == [3, 3, 4]
    assert spark.conf.get(CLEANUP_CONF, None) is None


def test_many_small_keys_are_not_sliced(spark, tmp_path):
    """A table beyond the limit whose keys are all small is numbered by one window: no slice is written."""
    df = spark.range(5_000).select((F.col("id") % 500).alias("k"), "id")
    assert in_slices(df, ["k"], ["id"], rows_per_slice=100) is None
    assert in_slices(df, ["k"], ["id"], rows_per_slice=9).count() == 5_000
    assert largest_key(df, ["k"]) == 10 and largest_key(df.limit(0), ["k"]) == 0


def test_slim_rows_are_dealt_to_all_cores(spark):
    slim = spark.range(3_000).coalesce(1)
    spread = evenly(slim)
    assert spread.select(F.spark_partition_id()).distinct().count() == 6
    assert sorted(r.id for r in spread.collect()) == list(range(3_000))
    documents = canvas_documents(Tables(spark, "/root/testdata/sf0.01"))
    assert documents.select(F.spark_partition_id()).distinct().count() > 1


def test_first_seen_by_whole_numbers_needs_no_sorted_aggregate(spark):
    """Whole numbers, negative ones and NULL among them, order as a tuple does, and their minima are hashed."""
    values = [None, -(2**31), -7, 0, 3, 2**31 - 1]
    rows = [("g", f"{a},{b}", a, b) for a in values for b in values]
    df = spark.createDataFrame(rows, "g string, v string, a int, b bigint")
    found = first_seen_dictionary(df, ["g"], "v", ["a", "b"])
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    of = lambda x: (x is not None, x or 0)
    want = {v: i for i, (_, v, _, _) in enumerate(sorted(rows, key=lambda r: (of(r[2]), of(r[3]))))}
    assert {r.v: r.id for r in found.collect()} == want
    texts = df.withColumn("a", F.col("a").cast("string"))
    assert first_seen_dictionary(texts, ["g"], "v", ["a", "b"]).count() == len(rows)
