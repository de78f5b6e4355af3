"""Queries over parts, events and line items: encoding, grids, boxes, assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayline.functions.text import pascal_case, plain_number, rounded, short_number
from assayline.operators import render, shapes
from assayline.workload.registry import part_hex, part_hex_sql, query

_K = "json_extract_string(props, '$.k')::INT"


def _k():
    return F.get_json_object("props", "$.k").cast("int")


# --- first-seen encoding -----------------------------------------------------

_DICTIONARY_SQL = """
    SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first_row) - 1 AS id
    FROM (SELECT user_id, event_type, min(rn) AS first_row
          FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events) GROUP BY ALL)
"""


@query("first_seen_dictionary", _DICTIONARY_SQL)
def first_seen_dictionary(t):
    return shapes.first_seen_dictionary(t.events, ["user_id"], "event_type", ["ts", "event_id"])


@query(
    "first_seen_codes",
    f"SELECT event_id, d.id FROM events e JOIN ({_DICTIONARY_SQL}) d USING (user_id, event_type)",
)
def first_seen_codes(t):
    slim = t.events.select("user_id", "event_type", "ts", "event_id")
    return shapes.encode_first_seen(slim, ["user_id"], "event_type", ["ts", "event_id"]).select("event_id", "id")


# Elements of an order: one colour and a list of two from its line items; short hex, lower case
# and plain names occur.
@query(
    "colour_dictionary",
    """
    WITH m AS (SELECT l_orderkey, l_linenumber AS pos, l_partkey,
                      ['#' || lower(printf('%06X', l_partkey % 7 * 1118481)),
                       '#' || printf('%X%X%X', l_partkey % 5, l_partkey % 5, l_partkey % 5), 'red',
                       '#' || printf('%06X', l_suppkey % 16777216)] AS cs FROM lineitem),
    u AS (SELECT l_orderkey, pos, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS slot FROM m),
    h AS (SELECT l_orderkey, pos, slot, CASE WHEN length(c) = 4
                 THEN upper(c[2] || c[2] || c[3] || c[3] || c[4] || c[4]) ELSE upper(substr(c, 2)) END AS hex
          FROM u WHERE regexp_matches(c, '^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$')),
    f AS (SELECT l_orderkey, hex, min(pos * 10 + slot) AS o FROM h GROUP BY ALL)
    SELECT l_orderkey, hex, row_number() OVER (PARTITION BY l_orderkey ORDER BY o, hex) - 1 AS id FROM f
    """,
)
def colour_dictionary(t):
    digit = F.hex(F.col("l_partkey") % 5)
    elements = t.lineitem.select(
        "l_orderkey",
        F.col("l_linenumber").alias("pos"),
        F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("l_partkey") % 7 * 1118481), 6, "0"))).alias("color"),
        F.array(
            F.concat(F.lit("#"), digit, digit, digit),
            F.lit("red"),
            F.concat(F.lit("#"), F.lpad(F.hex(F.col("l_suppkey") % 16777216), 6, "0")),
        ).alias("colors"),
    )
    mentions = shapes.element_colours(elements, ["l_orderkey"], "pos", "color", "colors")
    return shapes.first_seen_dictionary(mentions, ["l_orderkey"], "hex", ["pos", "slot"])


# --- grids -------------------------------------------------------------------

_GRID_BASE = f"""
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'circle_grid' WHEN 3 THEN 'blob' ELSE 'rect_grid' END AS kind,
           1 + p_size % 5 AS cols, CASE p_partkey % 31 WHEN 7 THEN 100000 ELSE 1 + p_partkey % 4 END AS rows, CASE p_partkey % 4 WHEN 0 THEN 'row' WHEN 1 THEN 'col'
           WHEN 2 THEN 'checker' ELSE 'odd' END AS rule, p_partkey % 2 = 0 AS stagger,
           CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 0.5 END AS size,
           list_transform(range(1 + p_size % 3), lambda i: {part_hex_sql("i")}) AS colors, p_size FROM part
"""
_GRID_REASON = """
    CASE WHEN kind = 'blob' THEN 'unknown_type: blob'
         WHEN kind = 'circle_grid' AND size IS NULL THEN 'needed: radius'
         WHEN kind = 'rect_grid' AND size IS NULL THEN 'needed: width, height'
         WHEN rows > 30 THEN 'range: rows, cols' END
"""


def _grids(t):
    size = F.when(F.col("p_partkey") % 10 != 0, F.lit(0.5))
    colours = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.try_element_at(
        F.array(*[part_hex(n) for n in range(3)]), i + 1))
    rule = F.col("p_partkey") % 4
    turn = F.col("p_size") % 4
    return t.part.select(
        "p_partkey",
        F.when(turn == 0, "circle_grid").when(turn == 3, "blob").otherwise("rect_grid").alias("pattern_type"),
        (1 + F.col("p_size") % 5).alias("cols"),
        F.when(F.col("p_partkey") % 31 == 7, 100_000).otherwise(1 + F.col("p_partkey") % 4).cast("int").alias("rows"),
        F.lit(1.5).alias("x_start"),
        F.col("p_size").cast("double").alias("y_start"),
        F.lit(0.5).alias("x_step"),
        F.lit(0.25).alias("y_step"),
        F.slice(colours, F.lit(1), 1 + F.col("p_size") % 3).alias("colors"),
        F.when(rule == 0, "row").when(rule == 1, "col").when(rule == 2, "checker").otherwise("odd").alias("color_rule"),
        (F.col("p_partkey") % 2 == 0).alias("stagger"),
        size.alias("radius"),
        size.alias("width"),
        size.alias("height"),
    )


@query(
    "grid_cells",
    f"""
    WITH g AS (SELECT * FROM ({_GRID_BASE}) WHERE {_GRID_REASON} IS NULL),
    r AS (SELECT *, unnest(range(rows)) AS row FROM g), c AS (SELECT *, unnest(range(cols)) AS col FROM r),
    i AS (SELECT *, CASE rule WHEN 'row' THEN row WHEN 'col' THEN col ELSE row + col END % len(colors) AS ci FROM c)
    SELECT p_partkey, row::INT AS row, col::INT AS col,
           round(1.5 + col * 0.5 + CASE WHEN stagger AND row % 2 = 1 THEN 0.25 ELSE 0 END, 6)::DOUBLE AS x,
           round(p_size + row * 0.25, 6)::DOUBLE AS y, colors[ci + 1] AS colour FROM i
    """,
)
def grid_cells(t):
    cells = shapes.expand_grid(_grids(t)).filter("reject_reason IS NULL")
    return cells.select("p_partkey", "row", "col", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "colour")


@query(
    "grid_rejects",
    f"SELECT p_partkey, {_GRID_REASON} AS reject_reason FROM ({_GRID_BASE}) WHERE {_GRID_REASON} IS NOT NULL",
)
def grid_rejects(t):
    return shapes.expand_grid(_grids(t)).filter("reject_reason IS NOT NULL").select("p_partkey", "reject_reason")


def _round6(value: str) -> str:
    return f"floor({value} * 1000000 + 0.5) / 1000000"


# --- boxes -------------------------------------------------------------------


@query(
    "bounding_boxes",
    f"""
    WITH s AS (SELECT event_id, user_id, {_K}::DOUBLE AS x0, {_K} + 2.0::DOUBLE AS x1, value AS y0, value + ({_K}) % 9 AS y1 FROM events),
    b AS (SELECT user_id, min(least(x0, x1)) AS xm, min(least(y0, y1)) AS ym, max(greatest(y0, y1)) AS yx FROM s GROUP BY user_id)
    SELECT event_id, {_round6("(x0 - xm) * (3.0::DOUBLE / (yx - ym))")} AS nx0, {_round6("(x1 - xm) * (3.0::DOUBLE / (yx - ym))")} AS nx1,
           {_round6("(yx - y0) * (3.0::DOUBLE / (yx - ym))")} AS ny0, {_round6("(yx - y1) * (3.0::DOUBLE / (yx - ym))")} AS ny1
    FROM s JOIN b USING (user_id) WHERE yx > ym
    """,
)
def bounding_boxes(t):
    k = _k().cast("double")
    boxes = t.events.select(
        "event_id", "user_id", k.alias("x0"), (k + 2.0).alias("x1"), F.col("value").alias("y0"), (F.col("value") + k % 9).alias("y1")
    )
    placed = shapes.normalise_bbox(boxes, ["user_id"], ("x0", "x1"), ("y0", "y1"), 3.0)
    return placed.filter("reject_reason IS NULL").select(
        "event_id", *[rounded(F.col(c), 6).alias(c) for c in ("nx0", "nx1", "ny0", "ny1")]
    )


@query(
    "flat_groups",
    """
    SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING max(l_quantity) = min(l_quantity)
    """,
)
def flat_groups(t):
    boxes = t.lineitem.select("l_orderkey", F.col("l_quantity").alias("y"), F.col("l_tax").alias("x"))
    placed = shapes.normalise_bbox(boxes, ["l_orderkey"], ("x", "x"), ("y", "y"), 3.0)
    return placed.filter("reject_reason IS NOT NULL").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


# --- assembly and formats ----------------------------------------------------


@query(
    "assembled_orders",
    """
    SELECT l_orderkey, 0::BIGINT AS part, count(*) AS items,
           string_agg(l_linenumber || ':' || l_partkey || l_returnflag, ';' ORDER BY l_linenumber, l_partkey, l_returnflag) AS text
    FROM lineitem GROUP BY l_orderkey
    """,
)
def assembled_orders(t):
    text = F.concat(F.col("l_linenumber"), F.lit(":"), F.col("l_partkey"), F.col("l_returnflag"))
    return render.assemble(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_returnflag"], text, ";", part_items=100_000)


@query(
    "number_formats",
    """
    SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR
                      ELSE p_retailprice::VARCHAR END AS plain,
           regexp_replace(regexp_replace(printf('%.3f', p_size / 8.0::DOUBLE), '0+$', ''), '\\.$', '') AS short,
           regexp_replace(regexp_replace(printf('%.3f', (p_partkey % 900 + 0.5::DOUBLE) / 1000), '0+$', ''), '\\.$', '') AS halves,
           upper(left(p_brand, 1)) || lower(substr(p_brand, 2)) || upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS pascal
    FROM part
    """,
)
def number_formats(t):
    return t.part.select(
        "p_partkey",
        plain_number(F.col("p_retailprice")).alias("plain"),
        short_number(F.col("p_size") / 8.0).alias("short"),
        short_number((F.col("p_partkey") % 900 + F.lit(0.5)) / 1000).alias("halves"),
        pascal_case(F.concat(F.col("p_brand"), F.lit("-"), F.col("p_type"))).alias("pascal"),
    )
