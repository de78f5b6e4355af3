from pyspark.sql import functions as F

from assayline.operators.files import filter_catalogue, type_files
from assayline.operators.quarantine import accepted, rejected
from assayline.operators.reference import (
    alias_columns,
    attach_reference,
    conform,
    conform_occurrences,
    first_in_reference,
    first_in_reference_rows,
    layered,
    layered_defaults,
    layered_maps,
    load_reference,
    manifest_status,
    occurrences,
    off_reference,
    off_reference_rows,
    pivot_alias,
    reconcile_maps,
    reference_rows,
)

PALETTE = {"bg_primary": "#201f1e", "light": "FFFFFF", "accent_2": "#DD4F51"}
MAP = "map<string,string>"


def definition(role, value):
    return f"\\definecolor{{{role}}}{{HTML}}{{{value}}}"


def conformed(spark, text, palette=PALETTE):
    df = spark.createDataFrame([(text, palette)], f"block string, colors {MAP}")
    row = conform(df, "block", "colors").first()
    return row.block, row.off_reference


def test_conform(spark):
    assert conformed(spark, definition("bg_primary", "000000")) == (definition("bg_primary", "201F1E"), [])
    text = "x " + definition("custom_role", "AbC") + "\n" + definition("light", "12345678") + definition("custom_a", "111") + " y"
    want = "x " + definition("custom_role", "AbC") + "\n" + definition("light", "FFFFFF") + definition("custom_a", "111") + " y"
    assert conformed(spark, text) == (want, ["custom_a", "custom_role"])
    assert conformed(spark, "") == ("", [])
    assert conformed(spark, definition("light", "1"))[0] == definition("light", "1")
    assert conformed(spark, definition("light", "111"), None) == (definition("light", "111"), [])
    assert conformed(spark, definition("light", "111"), {}) == (definition("light", "111"), [])
    three = "".join(definition(r, "0A0A0A") for r in PALETTE)
    assert conformed(spark, three)[0] == "".join(
        definition(r, v.lstrip("#").upper()) for r, v in PALETTE.items()
    )
    assert conformed(spark, definition("light", "FFF") + r" $1 \0")[0] == definition("light", "FFFFFF") + r" $1 \0"


def test_occurrences_and_off_reference(spark):
    text = definition("light", "000") + definition("odd", "111") + definition("odd", "222")
    df = spark.createDataFrame([("a", text, PALETTE), ("b", definition("more", "333"), PALETTE)], f"id string, block string, colors {MAP}")
    found = occurrences(df, ["id", "colors"], "block")
    rows = [(r.id, r.pos, r.name, r.conformed, r.known) for r in conform_occurrences(found, "colors").orderBy("id", "pos").collect()]
    assert rows == [("a", 0, "light", "FFFFFF", True), ("a", 1, "odd", "111", False), ("a", 2, "odd", "222", False), ("b", 0, "more", "333", False)]
    assert [tuple(r) for r in off_reference(found, "colors").collect()] == [("more", 1), ("odd", 2)]
    listed = spark.createDataFrame([("light",), ("odd",)], "name string")
    assert [tuple(r) for r in off_reference_rows(found, listed, ["name"]).collect()] == [("more", 1)]


def test_first_fill(spark):
    fill = r"\fill[%s] (0,0) rectangle (1,1);"
    texts = [fill % "bg_primary", fill % "nope", r"\draw[bg_primary] (0,0) rectangle (1,1);", fill % "nope" + fill % "light",
             r"\fill[bg_primary, opacity=1] (0,0) rectangle (1,1);" + fill % "light", r"\fill[light] (0,0) circle (1);"]
    df = spark.createDataFrame([(i, t, PALETTE) for i, t in enumerate(texts)], f"id int, block string, colors {MAP}")
    want = ["201f1e", "", "", "FFFFFF", "FFFFFF", ""]
    got = first_in_reference(df, "block", "colors").orderBy("id").collect()
    assert [r.background for r in got] == want
    from assayline.operators.reference import FILL
    found = occurrences(df, ["id", "colors"], "block", FILL, {"name": 1})
    rows = {r.id: r.background for r in first_in_reference_rows(found, df, "colors", ["id"]).collect()}
    assert rows == dict(enumerate(want))


def test_load_reference(spark):
    df = spark.createDataFrame(
        [("a", PALETTE), ("b", {**PALETTE, "muted": "#12", "alt": None}), ("c", {})], f"brand string, colors {MAP}"
    )
    loaded = load_reference(df, "colors")
    assert loaded.count() == accepted(loaded).count() + rejected(loaded).count()
    bad = rejected(loaded).collect()
    assert [(r.brand, r.bad_roles, r.reject_reason) for r in bad] == [("b", ["alt", "muted"], "invalid values: alt=null, muted=#12")]
    assert reference_rows(accepted(loaded).select("brand", "colors"), "colors").count() == 3


def test_attach_reference_keeps_rows_without_an_owner(spark):
    df = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "id int, brand string")
    brands = spark.createDataFrame([("a", PALETTE)], f"brand string, colors {MAP}")
    got = {r.id: r.colors for r in attach_reference(df, brands, ["brand"]).collect()}
    assert got == {1: PALETTE, 2: None, 3: None}


def test_aliases(spark):
    near = {"bg_primary": "#4038FF", "accent_2": "#3B3CD0", "muted": "#757576", "light": ""}
    far = {"bg_primary": "#201F1E", "accent_2": "#DD4F51"}
    bare = {"bg_primary": "#4038FF", "accent_2": "#3B3CD0"}
    df = spark.createDataFrame([(i, c) for i, c in enumerate([near, far, bare])], f"id int, colors {MAP}")
    rows = alias_columns(df, "colors").orderBy("id").collect()
    assert [r.VSRed for r in rows] == ["757576", "DD4F51", "5D5956"]
    assert rows[0].VSPaperWhite is None and rows[0].VSBlack == "4038FF" and rows[1].VSTeal is None
    pivoted = pivot_alias(reference_rows(df, "colors"), ["id"]).orderBy("id").collect()
    assert [tuple(r)[1:] for r in pivoted] == [tuple(r)[2:] for r in rows]


def test_layers(spark):
    base = spark.createDataFrame([(1, "a", 1.5), (2, "b", 1.5), (3, "b", None), (4, "z", 0.0)], "id int, k string, h double")
    over = spark.createDataFrame([("a", 4.0), ("b", None)], "k string, h double")
    for least in (None, 0):
        got = layered_defaults(base, [over], ["k"], "h", 3.0, min_rows=least)
        assert {r.id: r.h for r in got.collect()} == {1: 4.0, 2: 1.5, 3: 3.0, 4: 0.0}
    truth = base.select("id", layered("truthy", F.col("h"), F.lit(3.0)).alias("h"))
    assert {r.id: r.h for r in truth.collect()} == {1: 1.5, 2: 1.5, 3: 3.0, 4: 3.0}
    maps = spark.createDataFrame([({"a": None}, {"a": "x", "b": "y"})], f"m {MAP}, n {MAP}")
    row = maps.select(layered_maps(["a", "b", "c"], "m", "n").alias("s")).first().s
    assert (row.a, row.b, row.c) == (None, "y", None)


def test_manifest(spark):
    df = spark.createDataFrame(
        [("k", {"dark": "d.svg", "light": "l.svg", "alt": "a.svg", "bare": "b.svg"}, {"dark": "d", "alt": "a", "bare": "", "extra": "e"})],
        f"brand string, src {MAP}, tgt {MAP}",
    )
    held = spark.createDataFrame([("d.svg",), ("d.svg",), ("l.svg",)], "path string")
    got = manifest_status(reconcile_maps(df, "src", "tgt"), held)
    assert {r.key: r.status for r in got.collect()} == {"dark": "ok", "light": "no_target", "alt": "missing_source", "bare": "no_target"}


def test_file_types(spark):
    paths = ["cover.png", "cover.jpg", "cover.jpeg", "cover.webp", "x.y/cover.PNG", "cover.gif", "cover.bmp", "a.png/cover", ".png"]
    got = type_files(spark.createDataFrame([(p,) for p in paths], "path string"), "path").collect()
    short = {r.path: r.mime and r.mime.split("/")[1] for r in got}
    assert list(short.values()) == ["png", "jpeg", "jpeg", "webp", "png", "gif", None, None, None]
    assert sum(r.reject_reason is not None for r in got) == 3


def test_catalogue(spark):
    doc = """{"data": [
      {"id": "z", "pricing": {"prompt": "0", "completion": "0"}, "architecture": {"modality": "text->image"}, "context_length": 8192},
      {"id": "b", "name": "B", "pricing": {"prompt": 0, "completion": "0"}, "architecture": {"modality": "", "input_modalities": ["text", "Image"]},
       "top_provider": {"max_completion_tokens": 5}},
      {"id": "c", "pricing": {"prompt": "0.00", "completion": "0"}, "architecture": {"modality": "image"}},
      {"id": "d", "pricing": {"prompt": "0"}, "architecture": {"modality": "image"}},
      {"id": "e", "architecture": {"modality": "image"}},
      {"id": "f", "pricing": {"prompt": "0", "completion": "0"}, "architecture": {"modality": "text"}}]}"""
    df = spark.createDataFrame([(doc,), ("not json",), (doc,)], "json string")
    assert [tuple(r) for r in filter_catalogue(df).collect()] == [("b", "B", "?", "5", 2), ("z", "z", "8192", "?", 2)]


def test_truthy_layers_follow_the_type(spark):
    from decimal import Decimal

    from assayline.operators.reference import layered

    df = spark.createDataFrame(
        [("0", Decimal("0.00"), False, 0.0), ("", Decimal("0.10"), True, 2.0), (None, None, None, None)],
        "s string, d decimal(9,2), b boolean, f double",
    )
    got = df.select(
        layered("truthy", F.col("s"), F.lit("last")), layered("truthy", F.col("d"), F.col("f"), F.lit(7.0)).cast("double"),
        layered("truthy", F.col("b"), F.lit(None)),
    ).collect()
    assert [tuple(r) for r in got] == [("0", 7.0, None), ("last", 0.1, True), ("last", 7.0, None)]
