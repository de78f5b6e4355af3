import pytest
from pyspark.sql import functions as F

from assayline.functions.colour import blend, contrast, full_hex, is_hex, luminance
from assayline.functions.text import pascal_case, plain_number, short_number, split_lines, strip_fences, unwrap_fence
from assayline.operators.tone import choose_by_preference, choose_over_rows, classify_tone, contrast_audit, contrast_pair_counts, contrast_pairs


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_luminance(spark):
    values = ["000000", "FFFFFF", "#FF0000", "00ff00", "0000FF", "201F1E", "DD4F51"]
    got = column(spark, values, luminance)
    assert got[:5] == pytest.approx([0, 1, 0.2126, 0.7152, 0.0722], abs=1e-9)
    assert got[5] < 0.02 and 0.15 < got[6] < 0.30


def test_contrast(spark):
    pairs = [("FFFFFF", "000000"), ("4CB6B4", "4CB6B4"), ("5D5956", "FFFFFF"), ("FFFFFF", "5D5956"), ("4038FF", "3B3CD0")]
    df = spark.createDataFrame(pairs, "a string, b string").select(contrast(luminance(F.col("a")), luminance(F.col("b"))).alias("r"))
    got = [r.r for r in df.collect()]
    assert got[0] == pytest.approx(21) and got[1] == 1
    assert got[2] == got[3] > 4.5 and got[4] == pytest.approx(1.18, abs=0.01)


def test_blend_rounds_half_to_even(spark):
    df = spark.createDataFrame([("FF0000", "0000FF"), ("010305", "000000")], "a string, b string")
    shares = (0.0, 1.0, 0.5)
    rows = df.select(*[blend(F.col("a"), F.col("b"), s) for s in shares]).collect()
    assert list(rows[0]) == ["FF0000", "0000FF", "800080"]
    assert rows[1][2] == "000202"


def test_tone_and_tints(spark):
    df = spark.createDataFrame(
        [("201F1E", "#FFFFFF", "#5d5956"), ("#FFFFFF", "#eeeeee", "#5d5956"), ("", None, None), (None, None, None)],
        "bg string, light string, muted string",
    )
    rows = classify_tone(df, "bg", "light", "muted").collect()
    assert [r.tone for r in rows] == ["dark", "light", "dark", "dark"]
    assert (rows[0].fg, rows[0].sub_fg, rows[0].muted_fg, rows[0].faint_fg) == ("FFFFFF", "DBDBDB", "B8B8B8", "8C8C8C")
    assert (rows[1].fg, rows[1].sub_fg, rows[1].faint_fg) == ("1A1A1A", "5D5956", "5D5956")
    assert rows[2].lum == 0.1 and rows[2].fg == "FFFFFF"


def test_choice(spark):
    every = ["dark", "light", "alt"]
    cases = [("000000", every, "dark"), ("FFFFFF", every, "light"), ("B0B0B0", every, "alt"), ("000000", ["light"], "light"),
             ("000000", ["alt", "light"], "alt"), ("000000", [], "dark"), ("000000", None, "dark"), ("000000", ["zz", "odd"], "odd")]
    df = spark.createDataFrame(cases, "hex string, avail array<string>, want string")
    rows = choose_by_preference(df, "avail", "hex").collect()
    assert [r.variant for r in rows] == [r.want for r in rows]
    fixed = choose_by_preference(df, "avail", prefs=["alt"]).collect()
    assert fixed[0].variant == "alt" and fixed[3].variant == "light"


def test_choice_over_rows(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "alt"), ("b", "y"), ("b", "x"), ("c", None)], "g string, v string")
    got = {r.g: r.variant for r in choose_over_rows(df, ["g"], "v", ["dark", "alt"]).collect()}
    assert got == {"a": "alt", "b": "x", "c": "dark"}


def test_contrast_audit(spark):
    df = spark.createDataFrame([("k", {"bg": "#4038FF", "fg": "#3B3CD0", "light": "FFFFFF", "none": ""})], "b string, c map<string,string>")
    rows = {(r.role_a, r.role_b): r for r in contrast_audit(df, "c", ["bg", "fg", "light", "none", "gone"]).collect()}
    assert set(rows) == {("bg", "fg"), ("bg", "light"), ("fg", "light")}
    assert rows[("bg", "fg")].low and not rows[("bg", "light")].low


def test_text_helpers(spark):
    assert column(spark, ["a-b_c", "acme", "oTHER-abc", ""], pascal_case) == ["ABC", "Acme", "OtherAbc", ""]
    assert column(spark, ["#FFF", "#ffffff", "#12", "red", "FFF"], is_hex) == [True, True, False, False, False]
    assert column(spark, ["#1aF", "#abcdef"], full_hex) == ["11AAFF", "ABCDEF"]
    assert column(spark, [1.0, 2.5, -3.0], plain_number, "double") == ["1", "2.5", "-3"]
    numbers = [1.0, 0.125, 2.50, 1234.5678, 0.0004, 100.0, 12345.678, 999999.4]
    numbers += [0.0005, 1.0005, 2.0005, 0.0625, -0.1875, 999.9996, 9999.996, 99999.96, 123.4565, *[(i + 0.5) / 1000 for i in range(40)]]
    assert column(spark, numbers, short_number, "double") == [f"{round(n, 3):g}" for n in numbers]
    assert column(spark, ["```latex\nx\n```", "```tex  y```", "```json z"], strip_fences) == ["x\n", "y", "json z"]
    assert column(spark, ["```json\n{\"a\":1}\n```", "  {} ", "```\n[]\n```\n"], unwrap_fence) == ['{"a":1}', "{}", "[]"]


def test_line_splitting_follows_the_origin(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc", "a\n\nb\n\n", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i", "\n", "a\x0b\n", "\r\n\r\n", "tab\tx\x1fy"]
    assert column(spark, texts, split_lines) == [t.splitlines() for t in texts]


def low_pairs(rows, ratio):
    def lum(h):
        channels = [int(h[i : i + 2], 16) / 255 for i in (0, 2, 4)]
        return sum(w * (c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4) for w, c in zip((0.2126, 0.7152, 0.0722), channels))

    found = {}
    for g, a, x in rows:
        for h, b, y in rows:
            if g is not None and g == h and a < b and x and y:
                r = (max(lum(x), lum(y)) + 0.05) / (min(lum(x), lum(y)) + 0.05)
                if r < ratio:
                    found[g, a, b] = r
    return found


@pytest.mark.parametrize("block_rows", [7, 60, 4096])
def test_low_pairs_of_palette_rows(spark, block_rows):
    # Half of all rows under one brand, many of one colour, some without brand or colour.
    rows = [("hot" if i % 2 else f"b{i % 3}", i, f"{i * 9_000_001 % 16_777_216:06X}" if i % 5 else "4CB6B4") for i in range(240)]
    rows += [(None, 1000, "FFFFFF"), (None, 1001, "FFFFFF"), ("b0", 1002, None), ("b0", 1003, "FFFFFF"), ("b0", 1004, "000000")]
    df = spark.createDataFrame(rows, "brand string, role int, hex string")
    for ratio in (2.5, 1.05, 4.5, 30.0):
        got = contrast_pairs(df, ["brand"], "role", "hex", ratio, block_rows, min_rows=50, share=0.1).collect()
        want = low_pairs(rows, ratio)
        assert len(got) == len(want)
        assert {(r.brand, r.a, r.b): r.ratio for r in got} == pytest.approx(want)


def test_low_pairs_at_the_edge(spark):
    df = spark.createDataFrame([("b", 1, "000000"), ("b", 2, "FFFFFF")], "brand string, role int, hex string")
    assert contrast_pairs(df, ["brand"], "role", "hex", 21.0).count() == 0
    assert contrast_pairs(df, ["brand"], "role", "hex", 21.0001).count() == 1
    assert contrast_pairs(df.limit(0), ["brand"], "role", "hex").count() == 0
    with pytest.raises(ValueError):
        contrast_pairs(df, ["brand"], "role", "hex", 1.0)


def test_low_pairs_come_from_several_tasks(spark, tmp_path):
    """A small file holds many pairs: they are not left to the one task that reads it."""
    spark.range(2000, numPartitions=1).selectExpr("'b' AS brand", "int(id) AS role", "lpad(hex(id * 8191), 6, '0') AS hex").write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    got = contrast_pairs(df, ["brand"], "role", "hex", block_rows=20)
    seen = got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert len(seen) > 1 and max(r.n for r in seen) < 0.5 * sum(r.n for r in seen)
    counted = contrast_pair_counts(df, ["brand"], "role", "hex").first()
    assert sum(r.n for r in seen) == counted.n_low == got.select("a", "b").distinct().count()


def test_a_number_format_stays_a_small_expression(spark):
    plan = spark.range(1).select(short_number(F.col("id") / 7.0))._jdf.queryExecution().toString()
    assert len(plan) < 100_000


def test_pair_counts_equal_the_pairs(spark):
    """Equal colours, quotients at the bound itself, groups without a pair, missing keys; in one window and in slices."""
    rows = [(i % 3 if i % 17 else None, i if i % 13 else None, f"{i * 7919 % 2**24 if i % 5 else 255:06X}") for i in range(400)]
    rows += [(7, 1, "000000"), (7, 2, "FFFFFF"), (8, 1, "808080"), (8, 2, "808080"), (9, 5, "zz")]
    df = spark.createDataFrame(rows, "g int, k int, hex string")
    reached = contrast_pairs(df, ["g"], "k", "hex").agg({"ratio": "max"}).first()[0]
    for ratio in (2.5, reached):
        pairs = contrast_pairs(df, ["g"], "k", "hex", ratio)
        want = pairs.groupBy("g").agg(F.count("*").alias("n_low"), F.max("ratio").alias("highest"), F.min("ratio").alias("lowest"))
        for per_slice in (None, 50):
            got = contrast_pair_counts(df, ["g"], "k", "hex", ratio, rows_per_slice=per_slice)
            assert sorted(got.collect()) == sorted(want.collect()), (ratio, per_slice)


def test_pair_counts_build_no_pair(spark):
    """200,000 colours in one group have billions of pairs."""
    df = spark.range(200_000).select(F.lit(1).alias("g"), "id", F.lpad(F.hex(F.col("id") * 83), 6, "0").alias("hex"))
    assert contrast_pair_counts(df, ["g"], "id", "hex").first().n_low > 10**9
