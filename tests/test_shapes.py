import json
import random

import pytest
from pyspark.sql import functions as F

from assayline.operators.attempts import REFINE, REFINE_FATAL, REPAIR, REPAIR_FATAL, classify_failures, failure_counts
from assayline.operators.contract import CANVAS, Contract, Field, canvas_elements, check_union, violation_report
from assayline.operators.contract_schema import contract_from_schema
from assayline.operators.render import assemble, definition_lines, error_summary, render_template
from assayline.operators.shapes import (
    element_colours,
    expand_grid,
    encode_first_seen,
    fill_colour,
    first_seen_dictionary,
    height_scale,
    normalise_bbox,
)

GRID = (
    "id int, pattern_type string, cols int, rows int, x_start double, y_start double, x_step double, y_step double, "
    "colors array<string>, color_rule string, stagger boolean, radius double, width double, height double"
)


def grid(i, kind="circle_grid", cols=2, rows=2, colors=("a", "b"), rule=None, stagger=True, radius=0.5, width=None, height=None):
    return (i, kind, cols, rows, 0.0, 0.0, 1.0, 1.0, list(colors), rule, stagger, radius, width, height)


def test_grid(spark):
    rows = [grid(0), grid(1, rule="row"), grid(2, rule="col", colors=("a", "b", "c"), cols=4, rows=1), grid(3, rule="odd"),
            grid(4, stagger=None), grid(5, kind="rect_grid", width=1.0, height=1.0), grid(6, radius=None),
            grid(7, kind="rect_grid", width=1.0), grid(8, kind="blob"), grid(9, kind=None), grid(10, rows=0), grid(11, colors=()),
            grid(12, rows=100_000, cols=100_000), grid(13, cols=31)]
    out = expand_grid(spark.createDataFrame(rows, GRID)).orderBy("id", "row", "col").collect()
    cells = {}
    for r in out:
        if r.reject_reason is None:
            cells.setdefault(r.id, []).append(r)
    assert [(c.x, c.y, c.colour_index) for c in cells[0]] == [(0, 0, 0), (1, 0, 1), (0.5, 1, 1), (1.5, 1, 0)]
    assert [c.colour for c in cells[1]] == ["a", "a", "b", "b"]
    assert [c.colour for c in cells[2]] == ["a", "b", "c", "a"]
    assert [c.colour for c in cells[3]] == ["a", "b", "b", "a"]
    assert [c.x for c in cells[4]] == [0, 1, 0, 1]
    assert len(cells[5]) == 4
    reasons = {r.id: r.reject_reason for r in out if r.reject_reason}
    assert reasons == {
        6: "needed: radius", 7: "needed: height", 8: "unknown_type: blob", 9: "unknown_type: null",
        10: "items: rows, cols, colors", 11: "items: rows, cols, colors", 12: "range: rows, cols", 13: "range: rows, cols",
    }
    assert sum(r.id in reasons for r in out) == 8


def test_bbox(spark):
    df = spark.createDataFrame(
        [("a", 5.0, 10.0, 8.0, 40.0), ("a", 1.0, 20.0, 2.0, 30.0), ("flat", 0.0, 3.0, 9.0, 3.0), ("none", None, None, None, None), (None, 7.0, 0.0, 9.0, 6.0)],
        "f string, x0 double, y0 double, x1 double, y1 double",
    )
    for least in (None, 0):
        rows = {(r.f, r.x0): r for r in normalise_bbox(df, ["f"], ("x0", "x1"), ("y0", "y1"), 3.0, min_rows=least).collect()}
        a = rows[("a", 5.0)]
        assert (a.scale, a.ny0, a.ny1) == (pytest.approx(0.1), pytest.approx(3.0), 0.0)
        assert a.nx0 == pytest.approx(0.4) and rows[("a", 1.0)].nx0 == 0.0
        assert rows[("flat", 0.0)].reject_reason == "no height" and rows[("none", None)].reject_reason == "no bounding box"
        assert rows[("flat", 0.0)].ny0 is None and rows[(None, 7.0)].scale == 0.5


def test_height_scale(spark):
    df = spark.createDataFrame([(1.2, 1.5), (0.0, 1.5), (None, 1.5), (6.0, None)], "w double, n double")
    got = [r[0] for r in df.select(height_scale(F.col("w"), F.col("n"))).collect()]
    assert got == [pytest.approx(0.8), 1.0, 1.0, 2.0]


def test_first_seen_colours(spark):
    elements = spark.createDataFrame(
        [("d", 1, "#ffffff", ["#000", "red"]), ("d", 0, "#FFF", None), ("d", 2, "red", ["#FFF", "#abcdef"]), ("e", 0, "#000000", [])],
        "doc string, pos int, color string, colors array<string>",
    )
    mentions = element_colours(elements, ["doc"], "pos", "color", "colors")
    words = first_seen_dictionary(mentions, ["doc"], "hex", ["pos", "slot"])
    assert {(r.doc, r.hex): r.id for r in words.collect()} == {
        ("d", "FFFFFF"): 0, ("d", "000000"): 1, ("d", "ABCDEF"): 2, ("e", "000000"): 0
    }
    coded = encode_first_seen(mentions, ["doc"], "hex", ["pos", "slot"])
    assert {(r.doc, r.pos, r.slot): r.id for r in coded.collect()}[("d", 2, 1)] == 0


def test_fill_colour(spark):
    df = spark.createDataFrame([("#abcdef80",), ("none",), ("",), (None,), ("#112233",)], "f string")
    assert [r[0] for r in df.select(fill_colour(F.col("f"))).collect()] == ["ABCDEF", None, None, None, "112233"]


def test_assemble_and_summary(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("j", 1, None)], "k string, n int, t string")
    assert [tuple(r) for r in assemble(df, ["k"], ["n"], F.col("t"), "-", part_items=10).collect()] == [("k", 0, 2, "a-b")]
    text = error_summary(df.filter("k = 'k'"), ["k"], ["n"], "t", part_items=10).first().text
    assert text == "--- Error block 1 ---\na\n\n--- Error block 2 ---\nb"


def test_render(spark):
    palette = F.when(F.col("id") == 0, F.create_map(*[F.lit(x) for x in ("bg", "#201f1e", "light", "ffffff")])).when(
        F.col("id") == 1, F.create_map().cast("map<string,string>")
    )
    df = spark.range(3).withColumn("colors", palette)
    rows = render_template(df, "A {{C}} B {{C}}", "{{C}}", definition_lines(F.col("colors")), "free").orderBy("id").collect()
    lines = "   \\definecolor{bg}{HTML}{201F1E}\n   \\definecolor{light}{HTML}{FFFFFF}"
    assert [r.rendered for r in rows] == [f"A {lines} B {lines}", "A free B free", "A free B free"]


def test_failures(spark):
    cases = [("503 UNAVAILABLE", "busy", False), ("429 quota", "rate", False), ("404 NOT_FOUND", "missing", False),
             ("401 bad", "auth", True), ("Invalid API Key", "auth", True), ("model Overloaded", "busy", False),
             ("503 and 401", "auth", True), ("503 and 429", "busy", False), ("boom", "unexpected", True), (None, None, False)]
    df = spark.createDataFrame(cases, "m string, want string, stop boolean")
    rows = classify_failures(df, "m").collect()
    assert [(r.failure, r.fatal) for r in rows] == [(r.want, r.stop) for r in rows]
    refine = {r.m: r.fatal for r in classify_failures(df, "m", REFINE, REFINE_FATAL).collect()}
    assert [m for m, stop in refine.items() if stop] == ["401 bad", "503 and 401"]
    repair = {r.m: r.fatal for r in classify_failures(df, "m", REPAIR, REPAIR_FATAL).collect()}
    assert not repair["429 quota"] is True and repair["404 NOT_FOUND"] and repair["model Overloaded"]
    assert {r.failure: r.n for r in failure_counts(classify_failures(df, "m"), []).collect()}["auth"] == 3


def faults(spark, *docs):
    df = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "id int, json string")
    out = {}
    for r in check_union(df, ["id"], "json").collect():
        out.setdefault(r.id, set()).add((r.pos, r.rule, r.field))
    return out


def test_contract(spark):
    ok = {"elements": [
        {"type": "background", "color": "#FFF"},
        {"type": "rectangle", "x1": -5, "y1": 0, "x2": 26.0, "y2": 34.7, "color": "dark red", "rotation": 45},
        {"type": "circle", "cx": 1, "cy": 1, "radius": 30, "color": "blue!50"},
        {"type": "triangle", "x1": 0, "y1": 0, "x2": 1, "y2": 1, "x3": 2, "y3": 2, "color": "white"},
        {"type": "line", "x1": 0, "y1": 0, "x2": 1, "y2": 1, "color": "white", "width": 0.4},
        {"type": "pattern", "pattern_type": "circle_grid", "cols": 1, "rows": 30.0, "x_start": 0, "y_start": 0, "x_step": 1,
         "y_step": 1, "colors": ["#000", "red"], "radius": 1, "stagger": True, "color_rule": "row"},
    ]}
    bad_pattern = {"type": "pattern", "color": "#000", "shape": "dots", "x_step": 1, "y_step": 0}
    got = faults(
        spark,
        ok,
        {"elements": [{"type": "background", "color": "#FFFF"}, bad_pattern]},
        "{\"elements\": [{",
        {"elements": [], "book_title": "x"},
        {"items": []},
        {"elements": "x"},
        [1],
        {"elements": [{"type": "star"}, 5, {"color": "red"}, {"type": "circle", "cx": True, "cy": "1", "radius": 0, "color": None}]},
        {"elements": [{"type": "pattern", "pattern_type": "rect_grid", "cols": 31, "rows": 1.5, "x_start": 0, "y_start": 0, "x_step": 1,
                       "y_step": 1, "colors": ["a"] * 5, "color_rule": "diag"}]},
    )
    assert got == {
        1: {(0, "colour", "color"), (1, "range", "y_step"), (1, "extra", "color"), (1, "extra", "shape")}
           | {(1, "missing", f) for f in ("pattern_type", "cols", "rows", "x_start", "y_start", "colors")},
        2: {(None, "corrupt", None)},
        3: {(None, "extra", "book_title"), (None, "items", "elements")},
        4: {(None, "extra", "items"), (None, "missing", "elements")},
        5: {(None, "type", "elements")},
        6: {(None, "type", None)},
        7: {(0, "unknown_type", "type"), (1, "type", None), (2, "unknown_type", "type"), (3, "type", "cx"), (3, "type", "cy"),
            (3, "range", "radius"), (3, "type", "color")},
        8: {(0, "range", "cols"), (0, "type", "rows"), (0, "items", "colors"), (0, "enum", "color_rule"),
            (0, "needed", "width"), (0, "needed", "height")},
    }


def test_canvas_elements_and_report(spark):
    doc = json.dumps({"elements": [{"type": "background", "color": "x1"}, {"type": "blob"}]})
    df = spark.createDataFrame([("d", doc)], "id string, json string")
    assert [(r.pos, r.type) for r in canvas_elements(df, ["id"], "json").select("pos", "type").collect()] == [(0, "background"), (1, "blob")]
    assert [tuple(r) for r in violation_report(check_union(df, ["id"], "json", CANVAS)).collect()] == [("blob", "unknown_type", 1)]


@pytest.mark.parametrize("per_slice", [None, 40])
@pytest.mark.parametrize("header", [None, "# %d\n"])
def test_pages_by_bytes(spark, per_slice, header):
    rng = random.Random(5)
    rows = [("k", i, rng.choice(["", "é", "word " * rng.randint(1, 30), "x" * 400])) for i in range(600)] + [(None, 1, "a"), ("n", 1, None)]
    df = spark.createDataFrame(rows, "k string, n int, t string")
    whole = {r.k: r.text for r in assemble(df, ["k"], ["n"], F.col("t"), "\n", header, part_items=1000).collect()}
    pages = assemble(df, ["k"], ["n"], F.col("t"), "\n", header, part_bytes=256, rows_per_slice=per_slice).orderBy("k", "part").collect()
    for k, text in whole.items():
        assert "\n".join(p.text for p in pages if p.k == k) == text
    assert len({(p.k, p.part) for p in pages}) == len(pages) and {p.k for p in pages} == {None, "k"}
    for p in pages:
        assert len(p.text.encode()) <= 256 or p.items == 1
    assert max(p.items for p in pages) > 2


def test_pages_need_one_size(spark):
    df = spark.createDataFrame([("k", 1, "t")], "k string, n int, t string")
    for sizes in ({}, {"part_items": 1, "part_bytes": 1}):
        with pytest.raises(ValueError):
            assemble(df, ["k"], ["n"], F.col("t"), **sizes)


PALETTE_SCHEMA = {
    "type": "object", "required": ["items"], "additionalProperties": False,
    "properties": {"items": {"type": "array", "minItems": 1, "items": {"oneOf": [{"$ref": "#/$defs/Fill"}, {"$ref": "#/$defs/Stack"}]}}},
    "$defs": {
        "Hue": {"type": "string", "pattern": "^#[0-9a-f]{6}$"},
        "Share": {"type": "number", "minimum": 0, "maximum": 1},
        "Fill": {
            "type": "object", "required": ["type", "hue"], "additionalProperties": False,
            "properties": {"type": {"const": "fill"}, "hue": {"$ref": "#/$defs/Hue"}, "alpha": {"$ref": "#/$defs/Share", "description": "opacity"}},
        },
        "Stack": {
            "type": "object", "required": ["type", "layers", "mode", "n"], "additionalProperties": False,
            "properties": {
                "type": {"const": "stack"},
                "layers": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"$ref": "#/$defs/Hue"}},
                "mode": {"enum": ["add", "mix"]}, "n": {"type": "integer", "exclusiveMinimum": 0}, "on": {"type": "boolean"},
            },
            "allOf": [{"if": {"properties": {"mode": {"const": "mix"}}}, "then": {"required": ["on"]}}],
        },
    },
}


def test_contract_from_schema(spark):
    got = contract_from_schema(json.dumps(PALETTE_SCHEMA))
    assert got == Contract(
        types={
            "fill": {"hue": Field("colour"), "alpha": Field("number", least=0.0, most=1.0, required=False)},
            "stack": {
                "layers": Field("colours", min_items=1, max_items=2), "mode": Field("string", values=("add", "mix")),
                "n": Field("integer", above=0.0), "on": Field("boolean", required=False),
            },
        },
        colour="^#[0-9a-f]{6}$", needs={("stack", "mode", "mix"): ("on",)}, root="items",
    )
    docs = {
        "good": {"items": [{"type": "fill", "hue": "#00ff00"}, {"type": "stack", "layers": ["#00ff00"], "mode": "add", "n": 1}]},
        "bad": {"items": [{"type": "fill", "hue": "red", "alpha": 2}, {"type": "stack", "layers": [], "mode": "mix", "n": 1}, {"type": "x"}]},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "id string, json string")
    found = {(r.id, r.pos, r.rule, r.field) for r in check_union(df, ["id"], "json", got).collect()}
    assert found == {("bad", 0, "colour", "hue"), ("bad", 0, "range", "alpha"), ("bad", 1, "items", "layers"), ("bad", 1, "needed", "on"), ("bad", 2, "unknown_type", "type")}


def as_schema(contract):
    """A schema document that states what a contract states."""
    hue = {"$ref": "#/$defs/Hue"}

    def of(f):
        plain = {"type": f.kind, "minimum": f.least, "maximum": f.most, "exclusiveMinimum": f.above, "enum": list(f.values) or None}
        if f.kind == "colour":
            return hue
        if f.kind == "colours":
            return {"type": "array", "minItems": f.min_items, "maxItems": f.max_items, "items": hue}
        return {k: v for k, v in plain.items() if v is not None}

    kinds = []
    for kind, spec in contract.types.items():
        then = [
            {"if": {"properties": {sel: {"const": choice}}}, "then": {"required": list(sizes)}}
            for (t, sel, choice), sizes in contract.needs.items() if t == kind
        ]
        kinds.append({
            "type": "object", "required": ["type", *[n for n, f in spec.items() if f.required]], "additionalProperties": False,
            "properties": {"type": {"const": kind}} | {n: of(f) for n, f in spec.items()}, **({"allOf": then} if then else {}),
        })
    return {
        "type": "object", "required": [contract.root], "additionalProperties": False,
        "properties": {contract.root: {"type": "array", "minItems": 1, "items": {"oneOf": kinds}}}, "$defs": {"Hue": {"type": "string", "pattern": contract.colour}},
    }


def test_canvas_contract_comes_back_from_its_schema():
    assert contract_from_schema(as_schema(CANVAS)) == CANVAS


def test_schemas_that_a_contract_cannot_state_are_refused():
    def changed(**of_fill):
        doc = json.loads(json.dumps(PALETTE_SCHEMA))
        doc["$defs"]["Fill"] |= of_fill
        return doc

    fill = PALETTE_SCHEMA["$defs"]["Fill"]["properties"]
    for doc in (
        changed(additionalProperties=True),
        changed(properties=fill | {"alpha": {"type": "number", "multipleOf": 2}}),
        changed(properties=fill | {"alpha": {"$ref": "#/$defs/None"}}),
        changed(properties={"hue": fill["hue"]}),
        changed(properties=fill | {"other": {"type": "string", "pattern": "x"}}),
        changed(required=["type", "hue", "nowhere"]),
        PALETTE_SCHEMA | {"additionalProperties": True},
    ):
        with pytest.raises(ValueError):
            contract_from_schema(doc)
