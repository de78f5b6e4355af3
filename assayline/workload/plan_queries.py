"""Whole jobs on derived tables.

Covers: line items as attempts, orders as requests, parts as brands; failures, truncated and
empty texts, unknown and faulty brands all occur. Canvas: one document per part. Logos: two
variants per part, line items as their shapes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assayline.functions.text import rounded
from assayline.operators.blocks import COVER_MARKER
from assayline.plans.canvas import canvas_cells, canvas_definitions, canvas_listing, judged_documents
from assayline.plans.covers import conform_responses, resolved_requests
from assayline.plans.logos import logo_manifest, logo_shapes
from assayline.workload.registry import ROLES, luminance_sql, palette_rows_sql, part_palette, query
from assayline.workload.text_queries import CANVAS_FAULT_SQL, canvas_documents

# Items on a page of assembled text.
PAGE = 100_000

MACROS = "\\BookTitle \\BookSubtitle \\BookDescription \\BookAuthor \\BookDate"
FILL = "\\fill[{}] (-1,-1) rectangle (22,31);"

_RESPONSES_SQL = f"""
    SELECT l_orderkey AS request_id, CASE l_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'none' WHEN 2 THEN '' ELSE 'b' || l_orderkey // 8 END AS brand,
           l_linenumber * 100000000000 + l_partkey AS attempt, 'm' || l_linenumber AS model,
           CASE l_partkey % 12 WHEN 0 THEN '503 UNAVAILABLE' WHEN 1 THEN 'over quota' WHEN 2 THEN '401 bad key' WHEN 6 THEN 'boom' END AS error,
           CASE WHEN l_partkey % 12 IN (0, 1, 2, 6) THEN NULL WHEN l_partkey % 12 = 3 THEN '' WHEN l_partkey % 12 = 5 THEN 'prose'
                ELSE '```latex' || chr(10) || '{COVER_MARKER}{{%' || chr(10)
                     || '\\definecolor{{light}}{{HTML}}{{FEFEFE}}' || chr(10) || '\\definecolor{{own}}{{HTML}}{{123456}}' || chr(10)
                     || '\\begin{{tikzpicture}}' || chr(10)
                     || CASE l_partkey % 3 WHEN 0 THEN '{FILL.format("light")}' WHEN 1 THEN '{FILL.format("nope")}{FILL.format("neutral")}' ELSE '' END || chr(10)
                     || CASE l_partkey % 4 WHEN 0 THEN '% LOGO_PLACEMENT x=2.0 y=27 height=1.2 bg=light'
                                           WHEN 1 THEN '% LOGO_PLACEMENT x=1 y=2 height=0 bg=accent_1' ELSE '' END || chr(10)
                     || '{MACROS}' || CASE WHEN l_partkey % 5 = 0 THEN '' ELSE ' \\BookVersion' END
                     || CASE WHEN l_partkey % 7 = 0 THEN ' (1920,1)' ELSE '' END || chr(10) || '\\end{{tikzpicture}}%' || chr(10)
                     || CASE WHEN l_partkey % 12 = 4 THEN '' ELSE '}}' END END AS raw,
           l_partkey
    FROM lineitem
"""


def responses(t):
    part = F.col("l_partkey")
    turn = part % 12
    text = F.concat(
        F.lit("```latex\n" + COVER_MARKER + "{%\n\\definecolor{light}{HTML}{FEFEFE}\n\\definecolor{own}{HTML}{123456}\n\\begin{tikzpicture}\n"),
        F.when(part % 3 == 0, FILL.format("light")).when(part % 3 == 1, FILL.format("nope") + FILL.format("neutral")).otherwise(""),
        F.lit("\n"),
        F.when(part % 4 == 0, "% LOGO_PLACEMENT x=2.0 y=27 height=1.2 bg=light")
        .when(part % 4 == 1, "% LOGO_PLACEMENT x=1 y=2 height=0 bg=accent_1")
        .otherwise(""),
        F.lit("\n" + MACROS),
        F.when(part % 5 == 0, "").otherwise(" \\BookVersion"),
        F.when(part % 7 == 0, " (1920,1)").otherwise(""),
        F.lit("\n\\end{tikzpicture}%\n"),
        F.when(turn == 4, "").otherwise("}"),
    )
    error = F.when(turn == 0, "503 UNAVAILABLE").when(turn == 1, "over quota").when(turn == 2, "401 bad key").when(turn == 6, "boom")
    order = F.col("l_orderkey") % 10
    brand = F.when(order == 1, "none").when(order == 2, "").when(order != 0, F.concat(F.lit("b"), F.expr("l_orderkey div 8")))
    return t.lineitem.select(
        F.col("l_orderkey").alias("request_id"),
        brand.alias("brand"),
        (F.col("l_linenumber") * F.lit(100000000000) + part).alias("attempt"),
        F.concat(F.lit("m"), F.col("l_linenumber")).alias("model"),
        error.alias("error"),
        F.when(turn.isin(0, 1, 2, 6), F.lit(None)).when(turn == 3, "").when(turn == 5, "prose").otherwise(text).alias("raw"),
    )


LOGO_BITS = {"dark": 1, "light": 2, "alt": 4}


def brands(t):
    logos = F.map_filter(
        F.create_map(*[x for v, b in LOGO_BITS.items() for x in (F.lit(v), F.when(F.col("p_size").bitwiseAND(F.lit(b)) != 0, F.lit("file")))]),
        lambda _, v: v.isNotNull(),
    )
    return t.part.select(
        F.concat(F.lit("b"), F.col("p_partkey")).alias("brand"),
        F.col("p_name").alias("company"),
        F.col("p_type").alias("series"),
        # Some brands are listed without colours, some with a native height of zero.
        F.when(F.col("p_partkey") % 19 == 0, F.create_map().cast("map<string,string>")).otherwise(part_palette()).alias("colors"),
        logos.alias("logos"),
        F.when(F.col("p_partkey") % 23 == 0, 0.0).when(F.col("p_size") % 3 != 0, 1.5).alias("logo_height_cm"),
        F.lit(None).cast("array<double>").alias("logo_position"),
    )


_CHAIN_SQL = f"""
    r AS ({_RESPONSES_SQL}),
    n AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY attempt) AS rn,
                 l_partkey % 12 IN (7, 8, 9, 10, 11) AS good, l_partkey % 12 IN (2, 6) AS fatal FROM r),
    c AS (SELECT request_id, min(rn) FILTER (WHERE good OR fatal) AS cut FROM n GROUP BY request_id),
    k AS (SELECT n.* FROM n JOIN c USING (request_id) WHERE cut IS NULL OR rn <= cut),
    q AS (SELECT request_id, brand, CASE WHEN bool_or(good) THEN 'ok' WHEN bool_or(fatal) THEN 'aborted' ELSE 'exhausted' END AS outcome,
                 count(*) AS attempts, max(model) FILTER (WHERE good) AS winner,
                 arg_max(raw, rn) FILTER (WHERE raw <> '') AS last_payload,
                 max(l_partkey) FILTER (WHERE good) AS p
          FROM k GROUP BY request_id, brand)
"""


@query(
    "resolved_requests",
    f"WITH {_CHAIN_SQL} SELECT request_id, brand, outcome, attempts, winner, md5(last_payload) AS payload FROM q",
)
def resolved(t):
    return resolved_requests(responses(t)).select(
        "request_id", "brand", "outcome", "attempts", "winner", F.md5("last_payload").alias("payload")
    )


_LUM = luminance_sql("h")
_COVER_SQL = f"""
    WITH {_CHAIN_SQL},
    pr AS (SELECT * FROM ({palette_rows_sql()}) WHERE p_partkey % 19 <> 0),
    pw AS (SELECT p_partkey, {", ".join(f"max(substr(hex, 2)) FILTER (WHERE role = '{x}') AS {x}" for x in ROLES)},
                  'invalid values: ' || string_agg(role || '=' || hex, ', ' ORDER BY role)
                      FILTER (WHERE NOT regexp_matches(hex, '^#?[0-9A-Fa-f]{{6}}$')) AS fault
           FROM pr GROUP BY p_partkey),
    b AS (SELECT 'b' || p.p_partkey AS brand, p.p_size, pw.p_partkey AS coloured, p.p_partkey % 23 = 0 AS flat,
                 pw.* EXCLUDE (p_partkey) FROM part p LEFT JOIN pw USING (p_partkey)),
    j AS (SELECT q.*, b.* EXCLUDE (brand), b.brand AS listed,
                 CASE WHEN outcome <> 'ok' THEN outcome || ': no complete block' WHEN q.brand <> '' AND b.brand IS NULL THEN 'unknown brand'
                      WHEN fault IS NOT NULL THEN fault
                      WHEN coloured IS NOT NULL AND flat AND p % 4 = 0 THEN 'no native height' END AS reject_reason
          FROM q LEFT JOIN b ON b.brand = q.brand),
    f AS (SELECT *, reject_reason IS NULL AND coloured IS NOT NULL AS branded, reject_reason IS NULL AS taken FROM j),
    g AS (SELECT *, CASE WHEN NOT branded THEN '' WHEN p % 3 = 0 THEN coalesce(light, '') WHEN p % 3 = 1 THEN coalesce(neutral, '') ELSE '' END AS background,
                 CASE WHEN branded THEN coalesce(CASE p % 4 WHEN 0 THEN light WHEN 1 THEN accent_1 END, bg_primary, '808080') END AS under FROM f),
    l AS (SELECT *, (SELECT {_LUM} FROM (SELECT under AS h)) AS logo_lum,
                 (SELECT {_LUM} FROM (SELECT CASE WHEN branded THEN coalesce(nullif(background, ''), bg_primary) END AS h)) AS ground_lum,
                 list_filter(['dark', 'light', 'alt'], lambda v: CASE v WHEN 'dark' THEN p_size % 2 = 1
                     WHEN 'light' THEN p_size // 2 % 2 = 1 ELSE p_size // 4 % 2 = 1 END) AS avail FROM g)
    , o AS (SELECT *, CASE WHEN branded THEN coalesce(list_filter(CASE WHEN logo_lum < 0.35 THEN ['dark', 'alt', 'light']
                WHEN logo_lum > 0.6 THEN ['light', 'alt', 'dark'] ELSE ['alt', 'dark', 'light'] END,
                lambda v: list_contains(avail, v))[1], 'dark') END AS variant FROM l)
    SELECT request_id, outcome, attempts, winner, reject_reason, variant,
           CASE WHEN branded AND list_contains(avail, 'alt') THEN 'alt' ELSE variant END AS footer_variant,
           CASE WHEN branded AND list_contains(avail, 'dark') THEN 'dark' ELSE variant END AS watermark_variant,
           CASE WHEN NOT taken THEN NULL WHEN NOT branded THEN '' WHEN light IS NULL THEN 'light own' ELSE 'own' END AS off_reference,
           CASE WHEN branded THEN CASE WHEN p % 4 = 0 THEN floor(1.2::DOUBLE / CASE WHEN p_size % 3 <> 0 THEN 1.5 ELSE 3.0 END * 10000 + 0.5) / 10000.0::DOUBLE ELSE 1.0 END END AS scale,
           background,
           CASE WHEN branded THEN CASE WHEN coalesce(ground_lum, 0.1) < 0.35 THEN 'dark' ELSE 'light' END END AS tone,
           CASE WHEN taken THEN array_to_string(list_filter([CASE WHEN p % 4 IN (2, 3) THEN 'annotation' END,
                CASE WHEN p % 4 = 1 THEN 'annotation_role' END, CASE WHEN p % 5 = 0 THEN 'macros' END,
                CASE WHEN p % 7 = 0 THEN 'range' END], lambda w: w IS NOT NULL), ' ') END AS warnings
    FROM o
"""


@query("covers", _COVER_SQL)
def covers(t):
    done = conform_responses(responses(t), brands(t))
    return done.select(
        "request_id", "outcome", "attempts", "winner", "reject_reason",
        F.array_join("off_reference", " ").alias("off_reference"),
        "variant", "footer_variant", "watermark_variant", rounded(F.col("scale"), 4).alias("scale"), "background", "tone",
        F.array_join("warnings.rule", " ").alias("warnings"),
    )


# --- canvas documents --------------------------------------------------------

_BACKGROUND = "printf('%06X', p_partkey % 16777216)"


@query(
    "judged_documents",
    f"""
    SELECT p_partkey, coalesce(n, 0) AS violations, CASE WHEN n > 0 THEN 'breaks the contract' END AS reject_reason
    FROM part LEFT JOIN (SELECT p_partkey, count(*) AS n FROM ({CANVAS_FAULT_SQL}) GROUP BY p_partkey) USING (p_partkey)
    """,
)
def judged(t):
    return judged_documents(canvas_documents(t), "json").drop("json")


_ACCEPTED_SQL = f"SELECT * FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM ({CANVAS_FAULT_SQL}))"
_SECOND_HEX = f"(p_partkey % 6 = 5 AND {_BACKGROUND} <> 'FFFFFF')"


@query(
    "canvas_listing",
    f"""
    SELECT p_partkey, 0::BIGINT AS part, 2::BIGINT AS items,
           'background dyncolor0' || chr(10) || CASE p_partkey % 6 WHEN 0 THEN 'circle white' ELSE 'pattern' END AS text
    FROM ({_ACCEPTED_SQL})
    """,
)
def listing(t):
    return canvas_listing(canvas_documents(t), ["p_partkey"], "json", PAGE)


@query(
    "colour_definitions",
    f"""
    SELECT p_partkey, 0::BIGINT AS part, CASE WHEN {_SECOND_HEX} THEN 2 ELSE 1 END::BIGINT AS items,
           '  \\definecolor{{dyncolor0}}{{HTML}}{{' || {_BACKGROUND} || '}}'
           || CASE WHEN {_SECOND_HEX} THEN chr(10) || '  \\definecolor{{dyncolor1}}{{HTML}}{{FFFFFF}}' ELSE '' END AS text
    FROM ({_ACCEPTED_SQL})
    """,
)
def definitions(t):
    return canvas_definitions(canvas_documents(t), ["p_partkey"], "json", PAGE)


@query(
    "canvas_cells",
    f"""
    WITH g AS (SELECT p_partkey, 1 + p_size % 5 AS cols FROM ({_ACCEPTED_SQL}) WHERE p_partkey % 6 = 5),
    r AS (SELECT *, unnest(range(2)) AS row FROM g), c AS (SELECT *, unnest(range(cols)) AS col FROM r)
    SELECT p_partkey, 1 AS pos, row::INT AS row, col::INT AS col, 1 + col * 1.5::DOUBLE + CASE row WHEN 1 THEN 0.75 ELSE 0 END AS x,
           2.5::DOUBLE + row * 0.5::DOUBLE AS y, ['#FFF', 'red'][(row + col) % 2 + 1] AS colour FROM c
    """,
)
def cells(t):
    return canvas_cells(canvas_documents(t), ["p_partkey"], "json").select("p_partkey", "pos", "row", "col", "x", "y", "colour")


# --- logos -------------------------------------------------------------------

_FILE_SQL = "'b' || l_partkey || '/' || CASE WHEN l_linenumber % 2 = 0 THEN 'dark' ELSE 'light' END || '.svg'"
_MANIFEST_SQL = f"""
    SELECT 'b' || p_partkey AS brand, key, 'b' || p_partkey || '/' || key || '.svg' AS source,
           'LogoB' || p_partkey || upper(left(key, 1)) || substr(key, 2) AS macro,
           CASE WHEN p_size % 3 = 0 THEN 3.0 ELSE 1.5 END::DOUBLE AS height,
           CASE WHEN key = 'light' AND p_size % 4 = 0 THEN 'no_target'
                WHEN 'b' || p_partkey || '/' || key || '.svg' NOT IN (SELECT {_FILE_SQL} FROM lineitem WHERE l_quantity < 45) THEN 'missing_source'
                ELSE 'ok' END AS status
    FROM part, (VALUES ('dark'), ('light')) AS v(key)
"""


def _logo_file():
    key = F.when(F.col("l_linenumber") % 2 == 0, "dark").otherwise("light")
    return F.concat(F.lit("b"), F.col("l_partkey"), F.lit("/"), key, F.lit(".svg"))


def _manifest(t):
    held = t.lineitem.filter("l_quantity < 45").select(_logo_file().alias("path"))
    owners = t.part.select(
        F.concat(F.lit("b"), F.col("p_partkey")).alias("brand"),
        F.create_map(*[F.lit(x) for x in ("dark", "dark.svg", "light", "light.svg")]).alias("logo_svg"),
        F.create_map(F.lit("dark"), F.lit("d"), F.lit("light"), F.when(F.col("p_size") % 4 == 0, "").otherwise("l")).alias("logos"),
        F.when(F.col("p_size") % 3 != 0, 1.5).alias("logo_height_cm"),
    )
    return logo_manifest(owners, held)


@query("logo_manifest", _MANIFEST_SQL)
def manifest(t):
    return _manifest(t).select("brand", "key", "source", "macro", "height", "status")


@query(
    "logo_shapes",
    f"""
    WITH m AS (SELECT * FROM ({_MANIFEST_SQL}) WHERE status = 'ok'),
    e AS (SELECT * FROM lineitem WHERE l_partkey % 29 <> 0),
    s AS (SELECT {_FILE_SQL} AS source, l_orderkey AS pos, l_quantity AS x0, l_quantity + 1 AS x1, l_extendedprice AS y0,
                 l_extendedprice + l_linenumber AS y1, CASE l_suppkey % 4 WHEN 0 THEN NULL ELSE printf('%06X', l_suppkey * 7) END AS colour
          FROM e),
    d AS (SELECT m.brand, m.key, m.height, s.* EXCLUDE (source) FROM m JOIN s USING (source)),
    b AS (SELECT brand, key, min(x0) AS xm, min(y0) AS ym, max(y1) AS yx, count(colour) AS filled FROM d GROUP BY ALL),
    f AS (SELECT brand, key, colour, min(pos) AS first_pos FROM d WHERE colour IS NOT NULL GROUP BY ALL),
    w AS (SELECT brand, key, colour, row_number() OVER (PARTITION BY brand, key ORDER BY first_pos, colour) - 1 AS colour_id FROM f)
    SELECT d.brand, d.key, d.pos, d.colour, w.colour_id, floor((d.x0 - xm) * (height / (yx - ym)) * 1000000 + 0.5) / 1000000 AS nx0,
           floor((yx - d.y1) * (height / (yx - ym)) * 1000000 + 0.5) / 1000000 AS ny1, CASE WHEN filled = 0 THEN 'no filled shape' END AS reject_reason
    FROM d JOIN b USING (brand, key) LEFT JOIN w USING (brand, key, colour) WHERE d.colour IS NOT NULL OR filled = 0
    UNION ALL SELECT brand, key, NULL, NULL, NULL, NULL, NULL, 'no bounding box' FROM m WHERE source NOT IN (SELECT source FROM s)
    """,
)
def placed_shapes(t):
    fill = F.when(F.col("l_suppkey") % 4 == 0, "none").otherwise(
        F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("l_suppkey") * 7), 6, "0")), F.lit("80"))
    )
    # Some files hold no shape at all.
    shapes = t.lineitem.filter("l_partkey % 29 <> 0").select(
        _logo_file().alias("file"),
        F.col("l_orderkey").alias("pos"),
        F.col("l_quantity").alias("x0"),
        (F.col("l_quantity") + 1).alias("x1"),
        F.col("l_extendedprice").alias("y0"),
        (F.col("l_extendedprice") + F.col("l_linenumber")).alias("y1"),
        fill.alias("fill"),
    )
    placed = logo_shapes(_manifest(t), shapes)
    return placed.select(
        "brand", "key", "pos", "colour", "colour_id", rounded(F.col("nx0"), 6).alias("nx0"), rounded(F.col("ny1"), 6).alias("ny1"), "reject_reason"
    )
