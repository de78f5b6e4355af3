"""Queries over parts as brands: reference loading, tone, contrast, choice, aliases, layers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from assayline.operators import reference, render, tone
from assayline.workload.registry import (
    ROLES,
    luminance_sql,
    palette_rows_sql,
    part_hex,
    part_hex_sql,
    part_palette,
    query,
)


def _brands(t, faulty=True):
    return t.part.select("p_partkey", "p_brand", "p_size", part_palette(faulty).alias("colors"))


# --- loading -----------------------------------------------------------------


@query(
    "reference_rejects",
    f"""
    SELECT p_partkey, count(*) AS n_bad,
           'invalid values: ' || string_agg(role || '=' || hex, ', ' ORDER BY role) AS reject_reason
    FROM ({palette_rows_sql()}) WHERE NOT regexp_matches(hex, '^#?[0-9A-Fa-f]{{6}}$') GROUP BY p_partkey
    """,
)
def reference_rejects(t):
    loaded = reference.load_reference(_brands(t), "colors")
    return loaded.filter("reject_reason IS NOT NULL").select(
        "p_partkey", F.size("bad_roles").cast("bigint").alias("n_bad"), "reject_reason"
    )


@query(
    "reference_rows",
    f"""
    WITH r AS ({palette_rows_sql()})
    SELECT role, count(*) AS n FROM r
    WHERE p_partkey NOT IN (SELECT p_partkey FROM r WHERE NOT regexp_matches(hex, '^#?[0-9A-Fa-f]{{6}}$')) GROUP BY role
    """,
)
def reference_rows(t):
    loaded = reference.load_reference(_brands(t), "colors").filter("reject_reason IS NULL")
    rows = reference.reference_rows(loaded.select("p_partkey", "colors"), "colors")
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


# --- tone --------------------------------------------------------------------

_LUM = f"SELECT p_partkey, {part_hex_sql()} AS hex, {luminance_sql(part_hex_sql())} AS lum FROM part"


def _tint_sql(share: float) -> str:
    level = f"round_even(255 * {1 - share!r}::DOUBLE + 0 * {share!r}::DOUBLE, 0)::INT"
    return f"printf('%02X%02X%02X', {level}, {level}, {level})"


_TONE_SQL = f"""
    SELECT p_partkey, round(lum, 6) AS lum, CASE WHEN lum < 0.35 THEN 'dark' ELSE 'light' END AS tone,
           CASE WHEN lum < 0.35 THEN 'FFFFFF' ELSE '1A1A1A' END AS fg,
           CASE WHEN lum < 0.35 THEN {_tint_sql(0.14)} ELSE '757576' END AS sub_fg,
           CASE WHEN lum < 0.35 THEN {_tint_sql(0.28)} ELSE '757576' END AS muted_fg,
           CASE WHEN lum < 0.35 THEN {_tint_sql(0.45)} ELSE '757576' END AS faint_fg
    FROM ({_LUM})
"""


@query("tone", _TONE_SQL)
def tone_of_parts(t):
    classed = tone.classify_tone(t.part.select("p_partkey", part_hex().alias("hex")), "hex")
    return classed.withColumn("lum", F.round("lum", 6)).drop("hex")


@query("tone_counts", f"SELECT tone, count(*) AS n FROM ({_TONE_SQL}) GROUP BY tone")
def tone_counts(t):
    return tone.tone_counts(tone.classify_tone(t.part.select(part_hex().alias("hex")), "hex"))


def _mix_sql(share: float, start: int) -> str:
    def part(i):
        return f"('0x' || substr({part_hex_sql(i)}, {start}, 2))::INTEGER"

    return f"round_even({part(5)} * {1 - share!r}::DOUBLE + {part(0)} * {share!r}::DOUBLE, 0)::INT"


@query(
    "blend",
    f"""
    SELECT p_partkey, printf('%02X%02X%02X', {_mix_sql(0.14, 1)}, {_mix_sql(0.14, 3)}, {_mix_sql(0.14, 5)}) AS mixed,
           printf('%02X%02X%02X', {_mix_sql(0.5, 1)}, {_mix_sql(0.5, 3)}, {_mix_sql(0.5, 5)}) AS half
    FROM part
    """,
)
def blend(t):
    from assayline.functions.colour import blend as mix

    return t.part.select(
        "p_partkey", mix(part_hex(5), part_hex(0), 0.14).alias("mixed"), mix(part_hex(5), part_hex(0), 0.5).alias("half")
    )


# --- contrast ----------------------------------------------------------------

_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS role_a, '{b}' AS role_b" for a, b in combinations(ROLES, 2)
)


@query(
    "contrast_audit",
    f"""
    WITH r AS ({palette_rows_sql(faulty=False)}), l AS (SELECT *, {luminance_sql("substr(hex, 2)")} AS lum FROM r)
    SELECT p.role_a, p.role_b, count(*) AS n,
           count(*) FILTER (WHERE (greatest(a.lum, b.lum) + 0.05) / (least(a.lum, b.lum) + 0.05) < 2.5) AS n_low,
           round(max((greatest(a.lum, b.lum) + 0.05) / (least(a.lum, b.lum) + 0.05)), 4) AS highest
    FROM ({_PAIRS}) p JOIN l a ON a.role = p.role_a JOIN l b ON b.role = p.role_b AND b.p_partkey = a.p_partkey
    GROUP BY ALL
    """,
)
def contrast_audit(t):
    audit = tone.contrast_audit(_brands(t, faulty=False).select("p_partkey", "colors"), "colors", ROLES)
    return audit.groupBy("role_a", "role_b").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("low").alias("n_low"),
        F.round(F.max("ratio"), 4).alias("highest"),
    )


@query(
    "contrast_partners",
    f"""
    WITH l AS (SELECT p_partkey, p_brand, {luminance_sql(part_hex_sql())} + 0.05 AS y FROM part),
    c AS (SELECT a.p_brand, a.p_partkey, a.y,
                 count(*) FILTER (WHERE b.p_partkey <> a.p_partkey AND b.y < a.y * 2.5 AND a.y < b.y * 2.5) AS partners
          FROM l a JOIN l b USING (p_brand) GROUP BY ALL)
    SELECT p_brand, round(y - 0.05, 6) AS lum, count(*) AS n, max(partners) AS partners FROM c GROUP BY p_brand, y
    """,
)
def contrast_partners(t):
    return tone.contrast_partners(t.part.select("p_brand", part_hex().alias("hex")), ["p_brand"], "hex").withColumn(
        "lum", F.round("lum", 6)
    )


_LOW_PAIRS = f"""
    WITH l AS (SELECT p_partkey, p_brand, {luminance_sql(part_hex_sql())} + 0.05 AS y FROM part)
    SELECT a.p_brand, a.p_partkey AS a, b.p_partkey AS b, greatest(a.y, b.y) / least(a.y, b.y) AS ratio
    FROM l a JOIN l b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND greatest(a.y, b.y) / least(a.y, b.y) < 2.5
"""


def _colours(t):
    return t.part.select("p_partkey", "p_brand", part_hex().alias("hex"))


@query("contrast_pairs", f"SELECT p_brand, a, b, round(ratio, 4) AS ratio FROM ({_LOW_PAIRS})")
def contrast_pairs(t):
    return tone.contrast_pairs(_colours(t), ["p_brand"], "p_partkey", "hex").withColumn("ratio", F.round("ratio", 4))


@query(
    "contrast_pair_counts",
    f"SELECT p_brand, count(*) AS n_low, round(max(ratio), 4) AS highest, round(min(ratio), 4) AS lowest FROM ({_LOW_PAIRS}) GROUP BY p_brand",
)
def contrast_pair_counts(t):
    counts = tone.contrast_pair_counts(_colours(t), ["p_brand"], "p_partkey", "hex")
    return counts.withColumns({"highest": F.round("highest", 4), "lowest": F.round("lowest", 4)})


# --- choice ------------------------------------------------------------------


@query(
    "preferred_variant",
    f"""
    WITH l AS (SELECT p_partkey, p_size, {luminance_sql(part_hex_sql())} AS lum FROM part),
    a AS (SELECT *, list_filter(['dark', 'light', 'alt', 'bare'],
                 lambda v: CASE v WHEN 'dark' THEN p_size % 2 = 1 WHEN 'light' THEN p_size // 2 % 2 = 1
                             WHEN 'alt' THEN p_size // 4 % 2 = 1 ELSE p_size // 8 % 2 = 1 END) AS avail FROM l)
    SELECT p_partkey, coalesce(
        list_filter(CASE WHEN lum < 0.35 THEN ['dark', 'alt', 'light'] WHEN lum > 0.6 THEN ['light', 'alt', 'dark']
                         ELSE ['alt', 'dark', 'light'] END, lambda v: list_contains(avail, v))[1],
        list_min(avail), 'dark') AS variant
    FROM a
    """,
)
def preferred_variant(t):
    bits = {"dark": 1, "light": 2, "alt": 4, "bare": 8}
    held = F.array_compact(
        F.array(*[F.when(F.col("p_size").bitwiseAND(F.lit(b)) != 0, F.lit(v)) for v, b in bits.items()])
    )
    df = t.part.select("p_partkey", part_hex().alias("hex"), held.alias("avail"))
    return tone.choose_by_preference(df, "avail", "hex").select("p_partkey", "variant")


@query(
    "preferred_over_rows",
    """
    SELECT l_orderkey, CASE min(CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 END)
                       WHEN 1 THEN 'N' WHEN 2 THEN 'A' ELSE min(l_returnflag) END AS variant
    FROM lineitem GROUP BY l_orderkey
    """,
)
def preferred_over_rows(t):
    return tone.choose_over_rows(t.lineitem, ["l_orderkey"], "l_returnflag", ["N", "A"])


# --- aliases -----------------------------------------------------------------

_ALIAS_SQL = f"""
    WITH r AS ({palette_rows_sql(faulty=False)}),
    w AS (SELECT p_partkey, {", ".join(f"max(substr(hex, 2)) FILTER (WHERE role = '{x}') AS {x}" for x in ROLES)}
          FROM r GROUP BY p_partkey),
    l AS (SELECT *, {luminance_sql("accent_2")} AS la, {luminance_sql("bg_primary")} AS lb FROM w)
    SELECT p_partkey, bg_primary AS "VSBlack", bg_secondary AS "VSGraphite", accent_1 AS "VSTeal",
           CASE WHEN (greatest(la, lb) + 0.05) / (least(la, lb) + 0.05) < 2.5 AND la IS NOT NULL AND lb IS NOT NULL
                THEN coalesce(muted, '5D5956') ELSE accent_2 END AS "VSRed",
           neutral AS "VSSilver", light AS "VSPaperWhite", muted AS "VSMutedText"
    FROM l
"""


@query("alias_columns", _ALIAS_SQL)
def alias_columns(t):
    return reference.alias_columns(_brands(t, faulty=False), "colors").select("p_partkey", *reference.ALIAS_ROLES)


@query("alias_pivot", _ALIAS_SQL)
def alias_pivot(t):
    rows = reference.reference_rows(_brands(t, faulty=False).select("p_partkey", "colors"), "colors")
    return reference.pivot_alias(rows, ["p_partkey"])


# A second map with its own link, background and fallback.
OTHER_ALIASES = reference.Aliases(
    roles={"Ink": "neutral", "Paper": "light", "Mark": "accent_1"},
    link="Mark",
    background="light",
    muted="bg_secondary",
    muted_default="000000",
    least_ratio=4.5,
)


@query(
    "alias_other",
    f"""
    WITH r AS ({palette_rows_sql(faulty=False)}),
    w AS (SELECT p_partkey, {", ".join(f"max(substr(hex, 2)) FILTER (WHERE role = '{x}') AS {x}" for x in ROLES)}
          FROM r GROUP BY p_partkey),
    l AS (SELECT *, {luminance_sql("accent_1")} AS la, {luminance_sql("light")} AS lb FROM w)
    SELECT p_partkey, neutral AS "Ink", light AS "Paper",
           CASE WHEN (greatest(la, lb) + 0.05) / (least(la, lb) + 0.05) < 4.5 AND la IS NOT NULL AND lb IS NOT NULL
                THEN coalesce(bg_secondary, '000000') ELSE accent_1 END AS "Mark"
    FROM l
    """,
)
def alias_other(t):
    aliased = reference.alias_columns(_brands(t, faulty=False), "colors", aliases=OTHER_ALIASES)
    return aliased.select("p_partkey", *OTHER_ALIASES.roles)


# --- layers ------------------------------------------------------------------


@query(
    "layered_defaults",
    """
    SELECT o_orderkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_acctbal END,
                                CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, 3.0) AS height
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey
    """,
)
def layered_defaults(t):
    base = t.orders.select(
        "o_orderkey", F.col("o_custkey").alias("owner"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("height")
    )
    override = t.customer.select(
        F.col("c_custkey").alias("owner"), F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")).alias("height")
    )
    return reference.layered_defaults(base, [override], ["owner"], "height", 3.0).select("o_orderkey", "height")


@query(
    "layered_presence",
    """
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_type ELSE 'base' END AS kind,
           CASE WHEN p_size % 5 = 0 THEN p_brand ELSE 'any' END AS brand
    FROM part
    """,
)
def layered_presence(t):
    none = F.lit(None).cast("string")
    first = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("kind"), none)).when(
        F.col("p_size") % 3 == 1, F.create_map(F.lit("kind"), F.col("p_type"))
    ).otherwise(F.create_map().cast("map<string,string>"))
    second = F.when(F.col("p_size") % 5 == 0, F.create_map(F.lit("brand"), F.col("p_brand"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    third = F.create_map(F.lit("kind"), F.lit("base"), F.lit("brand"), F.lit("any"))
    df = t.part.select("p_partkey", first.alias("a"), second.alias("b"), third.alias("c"))
    merged = df.withColumn("s", reference.layered_maps(["kind", "brand"], "a", "b", "c"))
    return merged.select("p_partkey", "s.kind", "s.brand")


# A text '0' is a value, a zero of any numeric type is not.
@query(
    "layered_truthy",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount <> 0 THEN l_discount WHEN l_tax <> 0 THEN l_tax ELSE 3.0 END::DOUBLE AS rate,
           CASE l_partkey % 3 WHEN 0 THEN '0' WHEN 1 THEN l_shipmode ELSE l_returnflag END AS label
    FROM (SELECT *, CASE l_partkey % 2 WHEN 0 THEN 'mode' ELSE 'other' END AS l_shipmode FROM lineitem)
    """,
)
def layered_truthy(t):
    exact = F.col("l_discount").cast("decimal(12,2)")
    label = F.when(F.col("l_partkey") % 3 == 0, "0").otherwise("")
    mode = F.when(F.col("l_partkey") % 3 != 1, F.lit(None)).when(F.col("l_partkey") % 2 == 0, "mode").otherwise("other")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        reference.layered("truthy", exact, F.col("l_tax"), F.lit(3.0)).cast("double").alias("rate"),
        reference.layered("truthy", label, mode, F.col("l_returnflag")).alias("label"),
    )


# --- reconciliation ----------------------------------------------------------


@query(
    "reconcile_status",
    """
    SELECT o_orderstatus, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'no_target'
           WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'missing_source'
           ELSE 'ok' END AS status, count(*) AS n
    FROM orders GROUP BY ALL
    """,
)
def reconcile_status(t):
    src = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    tgt = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    held = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return reference.status_report(
        reference.reconcile(src, tgt, held, ["o_custkey"], ["o_orderkey"]), ["o_orderstatus"]
    )


@query(
    "manifest_status",
    """
    WITH k AS (SELECT p_partkey, p_size, key, 'part/' || p_partkey || '/' || i AS source, i
               FROM part, (VALUES (1, 'dark'), (2, 'light'), (3, 'alt')) AS v(i, key)),
    h AS (SELECT DISTINCT 'part/' || l_partkey || '/' || l_linenumber AS source FROM lineitem WHERE l_quantity > 40)
    SELECT p_partkey, key, source, CASE WHEN p_size % 4 = i THEN 'no_target'
           WHEN source NOT IN (SELECT source FROM h) THEN 'missing_source' ELSE 'ok' END AS status
    FROM k
    """,
)
def manifest_status(t):
    names = ("dark", "light", "alt")
    path = {i: F.concat(F.lit("part/"), F.col("p_partkey"), F.lit(f"/{i}")) for i in (1, 2, 3)}
    src = F.create_map(*[x for i, n in enumerate(names, 1) for x in (F.lit(n), path[i])])
    # The target of one key is empty where the size says so, and absent counts the same.
    tgt = F.create_map(
        *[
            x
            for i, n in enumerate(names, 1)
            for x in (F.lit(n), F.when(F.col("p_size") % 4 == i, F.lit("")).otherwise(F.concat(F.lit("out/"), path[i])))
        ]
    )
    brands = t.part.select("p_partkey", src.alias("src"), tgt.alias("tgt"))
    held = t.lineitem.filter("l_quantity > 40").select(
        F.concat(F.lit("part/"), F.col("l_partkey"), F.lit("/"), F.col("l_linenumber")).alias("path")
    )
    manifest = reference.reconcile_maps(brands, "src", "tgt")
    return reference.manifest_status(manifest, held).select("p_partkey", "key", "source", "status")


# --- rendering ---------------------------------------------------------------


@query(
    "template",
    f"""
    WITH r AS ({palette_rows_sql(faulty=False)}),
    d AS (SELECT p_partkey, string_agg('   \\definecolor{{' || role || '}}{{HTML}}{{' || substr(hex, 2) || '}}', chr(10) ORDER BY i) AS lines
          FROM r WHERE p_size % 5 <> 0 GROUP BY p_partkey)
    SELECT p_partkey, 'Use:' || chr(10) || coalesce(lines, 'any colour') || chr(10) || 'for ' || p_brand AS rendered
    FROM part LEFT JOIN d USING (p_partkey)
    """,
)
def template(t):
    colours = F.when(F.col("p_size") % 5 != 0, F.col("colors")).otherwise(F.create_map().cast("map<string,string>"))
    brands = _brands(t, faulty=False).withColumn("colors", colours)
    text = F.concat(F.lit("Use:\n{{COLOURS}}\nfor "), F.col("p_brand"))
    return render.render_template(
        brands, text, "{{COLOURS}}", render.definition_lines(F.col("colors")), "any colour"
    ).select("p_partkey", "rendered")
