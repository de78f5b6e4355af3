import json

from pyspark.sql import functions as F

from assayline.operators import scale
from assayline.operators.contract import canvas_elements
from assayline.operators.scale import spread_join
from assayline.session import materialise_counted
from assayline.plans.canvas import canvas_cells, canvas_definitions, canvas_listing, colour_definitions, colour_names, judged_documents
from assayline.plans.logos import logo_manifest, logo_shapes


def test_canvas(spark):
    many = [{"type": "circle", "cx": 1, "cy": 1, "radius": 1, "color": f"#0000{i:02x}"} for i in range(11)]
    docs = {
        "a": {"elements": [{"type": "background", "color": "#FFF"}, {"type": "blob", "color": "#123456"},
                           {"type": "line", "x1": 0, "y1": 0, "x2": 1, "y2": 1, "color": "red", "width": 1},
                           {"type": "circle", "cx": 1, "cy": 1, "radius": 1, "color": "#ffffff"}]},
        "b": {"elements": many},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "doc string, json string")
    names = colour_names(canvas_elements(df, ["doc"], "json"), ["doc"])
    got = {(r.doc, r.hex): r.name for r in names.collect()}
    assert got[("a", "FFFFFF")] == "dyncolor0" and got[("a", "123456")] == "dyncolor1" and got[("b", "00000A")] == "dyncolor10"
    text = {r.doc: r.text for r in colour_definitions(names, ["doc"], 100).collect()}
    assert [line.split("}")[0].split("{")[1] for line in text["b"].splitlines()[:4]] == ["dyncolor0", "dyncolor1", "dyncolor10", "dyncolor2"]
    lists = {r.doc: r.text for r in canvas_listing(df, ["doc"], "json", 100).collect()}
    assert set(lists) == {"b"} and lists["b"].startswith("circle dyncolor0\ncircle dyncolor1\n")
    judged = {r.doc: r.reject_reason for r in judged_documents(df, "json").collect()}
    assert judged == {"a": "breaks the contract", "b": None}


def test_canvas_cells(spark):
    pattern = {"type": "pattern", "pattern_type": "circle_grid", "cols": 2, "rows": 2, "x_start": 1, "y_start": 2,
               "x_step": 1, "y_step": 3, "colors": ["red", "#FFF"], "radius": 0.5, "stagger": True}
    docs = {"a": {"elements": [{"type": "background", "color": "red"}, pattern]}, "b": {"elements": [pattern | {"cols": 31}]}}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "doc string, json string")
    got = {(r.doc, r.pos, r.row, r.col): (r.x, r.y, r.colour) for r in canvas_cells(df, ["doc"], "json").collect()}
    assert got == {("a", 1, 0, 0): (1.0, 2.0, "red"), ("a", 1, 0, 1): (2.0, 2.0, "#FFF"),
                   ("a", 1, 1, 0): (1.5, 5.0, "#FFF"), ("a", 1, 1, 1): (2.5, 5.0, "red")}


def test_logos(spark, monkeypatch):
    brands = spark.createDataFrame(
        [("acme-co", {"dark": "d.svg", "light": "l.svg", "alt": "a.svg", "gone": "g.svg"}, {"dark": "d", "light": "l", "gone": "g"}, 1.5),
         ("other", {"dark": "f.svg"}, {"dark": "f"}, None)],
        "brand string, logo_svg map<string,string>, logos map<string,string>, logo_height_cm double",
    )
    inventory = spark.createDataFrame([("acme-co/d.svg",), ("acme-co/l.svg",), ("other/f.svg",)], "path string")
    manifest = logo_manifest(brands, inventory)
    rows = {(r.brand, r.key): r for r in manifest.collect()}
    assert {k: r.status for k, r in rows.items()} == {
        ("acme-co", "dark"): "ok", ("acme-co", "light"): "ok", ("acme-co", "alt"): "no_target",
        ("acme-co", "gone"): "missing_source", ("other", "dark"): "ok",
    }
    assert rows[("acme-co", "dark")].macro == "LogoAcmeCoDark" and rows[("acme-co", "dark")].height == 1.5
    assert rows[("other", "dark")].height == 3.0
    assert {r.height for r in logo_manifest(brands, inventory, 4.0).collect()} == {4.0}
    shapes = spark.createDataFrame(
        [("acme-co/d.svg", 0, "rect", 0.0, 0.0, 10.0, 15.0, "none"), ("acme-co/d.svg", 1, "rect", 1.0, 0.0, 2.0, 5.0, "#aabbccff"),
         ("acme-co/d.svg", 2, "path", 1.0, 0.0, 2.0, 5.0, "#000000"), ("acme-co/d.svg", 3, "rect", 1.0, 0.0, 2.0, 5.0, "#AABBCC"),
         ("acme-co/l.svg", 0, "rect", 0.0, 0.0, 1.0, 1.0, None), ("other/f.svg", 0, "rect", 0.0, 2.0, 1.0, 2.0, "#111111"),
         ("stray.svg", 0, "rect", 0.0, 0.0, 1.0, 1.0, "#111111")],
        "file string, pos int, kind string, x0 double, y0 double, x1 double, y1 double, fill string",
    )
    plain = logo_shapes(manifest, shapes)
    got = {(r.brand, r.key, r.pos): r for r in plain.collect()}
    monkeypatch.setattr(scale, "HOT_MIN_ROWS", 1)
    spread = logo_shapes(logo_manifest(brands, inventory), shapes)
    assert sorted(map(str, spread.select(*plain.columns).collect())) == sorted(map(str, got.values()))
    assert set(got) == {("acme-co", "dark", 1), ("acme-co", "dark", 2), ("acme-co", "dark", 3), ("acme-co", "light", 0), ("other", "dark", 0)}
    fewer = logo_shapes(manifest, shapes.filter("file <> 'acme-co/l.svg'")).filter("key = 'light'").collect()
    assert [(r.brand, r.pos, r.reject_reason) for r in fewer] == [("acme-co", None, "no bounding box")]
    first = got[("acme-co", "dark", 1)]
    assert (first.colour, first.colour_id, first.ny0, first.reject_reason) == ("AABBCC", 0, 1.5, None)
    assert got[("acme-co", "dark", 2)].colour_id == 1 and got[("acme-co", "dark", 3)].colour_id == 0
    assert got[("acme-co", "light", 0)].reject_reason == "no filled shape"
    assert got[("other", "dark", 0)].reject_reason == "no height"


def test_broadcast_is_refused_beyond_its_bound(spark, monkeypatch):
    big = spark.range(300).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(20).select(F.lit(0).cast("bigint").alias("k"), F.col("id").alias("v"))
    plain = big.join(small, ["k"], "left")
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 5)
    refused = spread_join(big, small, ["k"], "left", min_rows=50)
    assert "Union" not in refused._jdf.queryExecution().executedPlan().toString()
    assert refused.count() == plain.count() and refused.exceptAll(plain).count() == 0


def test_rows_are_observed_while_they_are_written(spark):
    for n in (0, 1, 1000):
        table, rows = materialise_counted(spark.range(n).repartition(3))
        assert rows == n == table.count()


def test_canvas_definitions_judge_each_document_once(spark):
    jobs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            jobs.add(batch.num_rows)
            yield batch

    doc = '{"elements": [{"type": "background", "color": "#0a0B0c"}, {"type": "background", "color": "#fff"}]}'
    docs = spark.createDataFrame([("a", doc), ("b", "{}")], "doc string, json string").mapInArrow(seen, "doc string, json string")
    text = {r.doc: (r.part, r["items"], r.text) for r in canvas_definitions(docs, ["doc"], "json", 100).collect()}
    assert text == {"a": (0, 2, "  \\definecolor{dyncolor0}{HTML}{0A0B0C}\n  \\definecolor{dyncolor1}{HTML}{FFFFFF}")}
    assert jobs.value == 2
