"""Queries over pages and documents: typing, extraction, rules, annotations, conforming."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayline.functions.text import split_lines
from assayline.operators import blocks, contract, files, reference, scale, windows
from assayline.workload.registry import query

# --- typing ------------------------------------------------------------------

LANGUAGE_SEGMENT = r"^[a-z]+://[^/]+/([a-z]+)(?:/|$)"
LANGUAGE_TYPES = {"en": "text/en", "fr": "text/fr", "de": "text/de"}


@query(
    "file_types",
    r"""
    SELECT k AS type_key, CASE k WHEN 'en' THEN 'text/en' WHEN 'fr' THEN 'text/fr' WHEN 'de' THEN 'text/de' END AS mime,
           count(*) AS n
    FROM (SELECT lower(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)(?:/|$)', 1)) AS k FROM pages) GROUP BY ALL
    """,
)
def file_types(t):
    typed = files.type_files(t.pages, "url", LANGUAGE_TYPES, LANGUAGE_SEGMENT)
    return typed.groupBy("type_key", "mime").agg(F.count(F.lit(1)).alias("n"))


@query(
    "file_type_rejects",
    r"""
    SELECT page_id, lower(regexp_extract(url, '[^/](\.[^./]+)$', 1)) AS type_key FROM pages
    WHERE lower(regexp_extract(url, '[^/](\.[^./]+)$', 1)) NOT IN ('.html', '.jpg', '.jpeg', '.png', '.webp', '.gif')
    """,
)
def file_type_rejects(t):
    known = {**files.IMAGE_TYPES, ".html": "text/html"}
    typed = files.type_files(t.pages, "url", known)
    return typed.filter(F.col("reject_reason").isNotNull()).select("page_id", "type_key")


# --- balanced blocks ---------------------------------------------------------
# Four variants of each page: as it is, cut inside the block, another marker, nested braces.

STYLE_MARKER = "<style>p"
VARIANT_SQL = """
    SELECT page_id, CASE page_id % 4
        WHEN 1 THEN left(html, instr(html, 'margin:0}') + 7)
        WHEN 2 THEN replace(html, '<style>p', '<style>q')
        WHEN 3 THEN replace(html, '{margin:0}', '% {a{margin:0}b{}}')
        ELSE html END AS raw FROM pages
"""
# Token-wise walk: each token ends in a brace; the block ends where the depth first returns to 0.
BLOCK_SQL = f"""
    WITH v AS ({VARIANT_SQL}),
    c AS (SELECT page_id, regexp_replace(regexp_replace(raw, '```(?:latex|tex)?\\s*', '', 'g'), '```', '', 'g') AS raw FROM v),
    m AS (SELECT page_id, raw, instr(raw, '<style>p') AS pos FROM c),
    b AS (SELECT page_id, raw, pos, substr(raw, pos + 8) AS rest,
                 regexp_replace(substr(raw, pos + 8), '^[ \\t\\n\\r%]+', '') AS body FROM m),
    u AS (SELECT * FROM b WHERE pos > 0 AND body LIKE '{{%'),
    k AS (SELECT page_id, regexp_extract_all(body, '[^{{}}]*[{{}}]') AS toks FROM u),
    e AS (SELECT page_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM k),
    d AS (SELECT page_id, i, sum(CASE right(tok, 1) WHEN '{{' THEN 1 ELSE -1 END) OVER w AS depth,
                 sum(length(tok)) OVER w AS used
          FROM e WINDOW w AS (PARTITION BY page_id ORDER BY i)),
    f AS (SELECT page_id, min(used) AS used FROM d WHERE depth = 0 GROUP BY page_id)
    SELECT b.page_id,
           CASE WHEN f.used IS NOT NULL
                THEN substr(b.raw, b.pos, 8 + length(b.rest) - length(b.body) + f.used::BIGINT) END AS block,
           CASE WHEN u.page_id IS NULL THEN 'not_found' WHEN f.used IS NULL THEN 'truncated' ELSE 'ok' END AS status
    FROM b LEFT JOIN u USING (page_id) LEFT JOIN f USING (page_id)
"""


def _variants(t):
    html = F.col("html")
    cut = F.expr("left(html, instr(html, 'margin:0}') + 7)")
    renamed = F.replace(html, F.lit(STYLE_MARKER), F.lit("<style>q"))
    nested = F.replace(html, F.lit("{margin:0}"), F.lit("% {a{margin:0}b{}}"))
    turn = F.col("page_id") % 4
    raw = F.when(turn == 1, cut).when(turn == 2, renamed).when(turn == 3, nested).otherwise(html)
    return t.pages.select("page_id", raw.alias("raw"))


@query("balanced_blocks", BLOCK_SQL)
def balanced_blocks(t):
    return blocks.extract_balanced(_variants(t), "raw", STYLE_MARKER).select("page_id", "block", "status")


@query("block_status", f"SELECT status, count(*) AS n FROM ({BLOCK_SQL}) GROUP BY status")
def block_status(t):
    return blocks.status_counts(blocks.extract_balanced(_variants(t), "raw", STYLE_MARKER))


# --- rules -------------------------------------------------------------------
# Pages with one construct changed, by page id, so that every rule meets faulty rows.

RULE_PAGE_SQL = """
    SELECT page_id, CASE page_id % 8
        WHEN 1 THEN replace(html, '<article', '<section')
        WHEN 2 THEN replace(html, '</article', '</section')
        WHEN 3 THEN replace(html, '<!-- ad ', '<!--ad ')
        WHEN 4 THEN replace(html, '<!-- ad ', '<!-- ad bg=none ')
        WHEN 5 THEN replace(replace(html, '<nav', '<div'), '<footer', '<div')
        WHEN 6 THEN replace(html, '<!-- ad ', '<!-- ad bg=en ')
        WHEN 7 THEN replace(html, '<!-- ad ', '(1920.5) <!-- ad ')
        ELSE html END AS html FROM pages
"""


def _rule_pages(t):
    html = F.col("html")

    def swap(old, new, col=html):
        return F.replace(col, F.lit(old), F.lit(new))

    turn = F.col("page_id") % 8
    changed = (
        F.when(turn == 1, swap("<article", "<section"))
        .when(turn == 2, swap("</article", "</section"))
        .when(turn == 3, swap("<!-- ad ", "<!--ad "))
        .when(turn == 4, swap("<!-- ad ", "<!-- ad bg=none "))
        .when(turn == 5, swap("<footer", "<div", swap("<nav", "<div")))
        .when(turn == 6, swap("<!-- ad ", "<!-- ad bg=en "))
        .when(turn == 7, swap("<!-- ad ", "(1920.5) <!-- ad "))
        .otherwise(html)
    )
    return t.pages.select("page_id", changed.alias("html"))


PAGE_PARTS = ("<head>", "<title>", "<nav", "<h1>", "<footer", "</html>")


def page_rules():
    html = F.col("html")
    role = F.nullif(F.regexp_extract(html, "(?d)<!-- ad .*?bg=([a-z]+)", 1), F.lit(""))
    declared = F.regexp_extract_all(html, F.lit('lang="([a-z]+)"'), 1)
    missing = F.filter(F.array(*[F.lit(p) for p in PAGE_PARTS]), lambda p: ~F.contains(html, p))
    suspects = blocks.suspect_number_texts(html, strip=())
    return {
        "begin": F.when(~F.contains(html, F.lit("<article")), F.lit("no article start")),
        "end": F.when(~F.contains(html, F.lit("</article>")), F.lit("no article end")),
        "annotation": F.when(~F.contains(html, F.lit("<!-- ad ")), F.lit("no annotation")),
        "annotation_role": F.when(~F.array_contains(declared, role), F.concat(F.lit("role "), role)),
        "parts": blocks.listed("missing ", missing),
        "range": blocks.listed("numbers ", F.slice(suspects, 1, 5)),
    }


RULE_SQL = f"""
    WITH p AS ({RULE_PAGE_SQL}),
    x AS (SELECT page_id, html, regexp_extract(html, '<!-- ad .*?bg=([a-z]+)', 1) AS role,
                 regexp_extract_all(html, 'lang="([a-z]+)"', 1) AS declared,
                 list_filter(['<head>', '<title>', '<nav', '<h1>', '<footer', '</html>'], lambda s: NOT contains(html, s)) AS missing,
                 list_filter(regexp_extract_all(html, '(?:^|[^a-zA-Z{{])(\\d{{3,}}\\.?\\d*)', 1), lambda n: n::DOUBLE > 150) AS suspects
          FROM p)
    SELECT page_id, 'begin' AS rule, 'no article start' AS message FROM x WHERE NOT contains(html, '<article')
    UNION ALL SELECT page_id, 'end', 'no article end' FROM x WHERE NOT contains(html, '</article>')
    UNION ALL SELECT page_id, 'annotation', 'no annotation' FROM x WHERE NOT contains(html, '<!-- ad ')
    UNION ALL SELECT page_id, 'annotation_role', 'role ' || role FROM x WHERE role <> '' AND NOT list_contains(declared, role)
    UNION ALL SELECT page_id, 'parts', 'missing ' || array_to_string(missing, ', ') FROM x WHERE len(missing) > 0
    UNION ALL SELECT page_id, 'range', 'numbers ' || array_to_string(suspects[1:5], ', ') FROM x WHERE len(suspects) > 0
"""


@query("rule_warnings", RULE_SQL)
def rule_warnings(t):
    checked = blocks.validate_rules(_rule_pages(t), page_rules())
    return checked.select("page_id", F.inline("warnings"))


@query("rule_report", f"SELECT rule, count(*) AS n FROM ({RULE_SQL}) GROUP BY rule")
def rule_report(t):
    return blocks.rule_report(blocks.validate_rules(_rule_pages(t), page_rules()))


@query(
    "suspect_numbers",
    r"""
    SELECT doc_id, len(s) AS n, array_to_string(s[1:5], ' ') AS first_five
    FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '(?:^|[^a-zA-Z{])(\d{3,}\.?\d*)', 1),
                                     lambda x: x::DOUBLE > 150) AS s FROM documents)
    WHERE len(s) > 0
    """,
)
def suspect_numbers(t):
    found = blocks.suspect_numbers(t.documents.select("doc_id", "text"), "text", strip=())
    return found.filter(F.size("suspects") > 0).select(
        "doc_id", F.size("suspects").cast("bigint").alias("n"), F.array_join("first_suspects", " ").alias("first_five")
    )


# --- annotations -------------------------------------------------------------


@query(
    "annotations",
    r"""
    SELECT page_id, try_cast(nullif(regexp_extract(url, 'page=([0-9]+)&ref=([a-z]+)', 1), '') AS DOUBLE) AS page,
           nullif(regexp_extract(url, 'page=([0-9]+)&ref=([a-z]+)', 2), '') AS ref
    FROM pages
    """,
)
def annotations(t):
    parsed = blocks.parse_annotation(
        t.pages.select("page_id", "url"),
        "url",
        r"page=([0-9]+)&ref=([a-z]+)",
        (("page", 1, "double"), ("ref", 2, "string")),
        "found",
    )
    return parsed.select("page_id", "found.page", "found.ref")


# --- conforming --------------------------------------------------------------

TAG = r"<([a-z0-9]+)>"
TAG_NAMES = {"p": "PARA", "h1": "HEAD", "li": "ITEM", "b": "BOLD", "br": "BREAK"}
TAG_CASE = "CASE tag WHEN 'p' THEN 'PARA' WHEN 'h1' THEN 'HEAD' WHEN 'li' THEN 'ITEM' WHEN 'b' THEN 'BOLD' WHEN 'br' THEN 'BREAK' END"


def _tagged_pages(t):
    return t.pages.select("page_id", "html", reference.literal_map(TAG_NAMES).alias("names"))


@query(
    "conform_counts",
    f"""
    SELECT coalesce({TAG_CASE}, tag) AS conformed, {TAG_CASE} IS NOT NULL AS known, count(*) AS n
    FROM (SELECT unnest(regexp_extract_all(html, '<([a-z0-9]+)>', 1)) AS tag FROM pages) GROUP BY ALL
    """,
)
def conform_counts(t):
    found = reference.occurrences(_tagged_pages(t), ["names"], "html", TAG, {"name": 1})
    return (
        reference.conform_occurrences(found, "names", "name", "name")
        .groupBy("conformed", "known")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "conform_text",
    """
    SELECT page_id, md5(replace(replace(replace(replace(replace(html, '<p>', '<PARA>'), '<h1>', '<HEAD>'),
                    '<li>', '<ITEM>'), '<b>', '<BOLD>'), '<br>', '<BREAK>')) AS digest,
           array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(html, '<([a-z0-9]+)>', 1),
               lambda x: x NOT IN ('p', 'h1', 'li', 'b', 'br')))), ' ') AS off_reference
    FROM pages
    """,
)
def conform_text(t):
    done = reference.conform(
        _tagged_pages(t), "html", "names", TAG, 1, lambda _, value: F.concat(F.lit("<"), value, F.lit(">"))
    )
    return done.select("page_id", F.md5("html").alias("digest"), F.array_join("off_reference", " ").alias("off_reference"))


# A glossary of all words of the benchmark; words of a turn that it lists are replaced by their codes.
WORD = "([a-z]{4,})"


@query(
    "conform_text_rows",
    f"""
    WITH g AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD}', 1)) AS name FROM benchmark),
    t AS (SELECT conv_id, turn, regexp_split_to_array(text, '{WORD}') AS gaps, regexp_extract_all(text, '{WORD}', 1) AS names FROM conversations),
    h AS (SELECT conv_id, turn, unnest(gaps) AS gap, unnest(list_append(names, NULL)) AS name, unnest(range(len(gaps))) AS i FROM t)
    SELECT conv_id, turn, md5(string_agg(gap || CASE WHEN h.name IS NULL THEN '' WHEN g.name IS NULL THEN h.name
                                              ELSE '#' || left(md5(g.name), 6) END, '' ORDER BY i)) AS digest,
           coalesce(string_agg(DISTINCT h.name, ' ' ORDER BY h.name) FILTER (WHERE g.name IS NULL AND h.name IS NOT NULL), '') AS off_reference
    FROM h LEFT JOIN g ON g.name = h.name GROUP BY ALL
    """,
)
def conform_text_rows(t):
    words = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), 1)).alias("name")).distinct()
    glossary = words.withColumn("code", F.concat(F.lit("#"), F.left(F.md5("name"), F.lit(6))))
    turns = t.conversations.select("conv_id", "turn", "text")
    done = reference.conform_rows(turns, ["conv_id", "turn"], "text", glossary, [], "name", "code", WORD, 1, lambda _, code: code)
    return done.select("conv_id", "turn", F.md5("text").alias("digest"), F.array_join("off_reference", " ").alias("off_reference"))


@query(
    "off_reference",
    f"""
    SELECT tag AS name, count(*) AS n
    FROM (SELECT unnest(regexp_extract_all(html, '<([a-z0-9]+)>', 1)) AS tag FROM pages)
    WHERE {TAG_CASE} IS NULL GROUP BY tag
    """,
)
def off_reference(t):
    found = reference.occurrences(_tagged_pages(t), ["names"], "html", TAG, {"name": 1})
    return reference.off_reference(found, "names")


@query(
    "off_reference_rows",
    """
    SELECT l_partkey, count(*) AS n FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY l_partkey
    """,
)
def off_reference_rows(t):
    used = t.lineitem.select("l_partkey")
    listed = t.part.filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return reference.off_reference_rows(used, listed, ["l_partkey"])


FIRST_NAMES = {"ul": "#LIST", "article": "#BODY"}
FIRST_SQL = """
    SELECT page_id, coalesce(CASE list_filter(regexp_extract_all(html, '<([a-z0-9]+)>', 1),
               lambda x: x IN ('ul', 'article') AND NOT (x = 'ul' AND page_id % 3 = 0))[1]
               WHEN 'ul' THEN 'LIST' WHEN 'article' THEN 'BODY' END, '') AS background
    FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(html, '<', '[') ELSE html END AS html FROM pages)
"""


def _owned_pages(t):
    names = reference.literal_map(FIRST_NAMES)
    owned = F.when(F.col("page_id") % 3 == 0, F.map_filter(names, lambda k, _: k != "ul")).otherwise(names)
    html = F.when(F.col("page_id") % 5 == 0, F.replace("html", F.lit("<"), F.lit("["))).otherwise(F.col("html"))
    return t.pages.select("page_id", html.alias("html"), owned.alias("names"))


@query("first_in_reference", FIRST_SQL)
def first_in_reference(t):
    return reference.first_in_reference(_owned_pages(t), "html", "names", TAG).select("page_id", "background")


@query("first_in_reference_rows", FIRST_SQL)
def first_in_reference_rows(t):
    pages = _owned_pages(t)
    found = reference.occurrences(pages, ["page_id", "names"], "html", TAG, {"name": 1})
    return reference.first_in_reference_rows(found, pages, "names", ["page_id"])


# --- contract ----------------------------------------------------------------

EVENT_CONTRACT = contract.Contract(
    types={
        "click": {"k": contract.Field("integer", least=0, most=89), "target": contract.Field("string")},
        "view": {"k": contract.Field("integer", least=10, most=99)},
        "purchase": {"k": contract.Field("number", above=0), "note": contract.Field("string", required=False)},
        "error": {"code": contract.Field("integer")},
    }
)
CONTRACT_SQL = """
    WITH e AS (SELECT event_id, event_type AS type, json_extract_string(props, '$.k')::INT AS k FROM events)
    SELECT event_id, type, 'missing' AS rule, 'target' AS field FROM e WHERE type = 'click'
    UNION ALL SELECT event_id, type, 'range', 'k' FROM e
        WHERE (type = 'click' AND k > 89) OR (type = 'view' AND k < 10) OR (type = 'purchase' AND k <= 0)
    UNION ALL SELECT event_id, type, 'missing', 'code' FROM e WHERE type = 'error'
    UNION ALL SELECT event_id, type, 'extra', 'k' FROM e WHERE type = 'error'
    UNION ALL SELECT event_id, type, 'unknown_type', 'type' FROM e WHERE type = 'signup'
"""


@query("contract_violations", CONTRACT_SQL)
def contract_violations(t):
    return contract.check_elements(t.events, ["event_id"], "event_type", "props", EVENT_CONTRACT)


@query("contract_report", f"SELECT type, rule, count(*) AS n FROM ({CONTRACT_SQL}) GROUP BY ALL")
def contract_report(t):
    return contract.violation_report(
        contract.check_elements(t.events, ["event_id"], "event_type", "props", EVENT_CONTRACT)
    )


# Canvas documents built from parts: a background and a second element whose kind, ranges,
# colour and keys go wrong for some keys.
CANVAS_SQL = """
    SELECT p_partkey, '{"elements":[{"type":"background","color":"#' || printf('%06X', p_partkey % 16777216) || '"},'
        || CASE p_partkey % 5
             WHEN 0 THEN '{"type":"circle","cx":' || (p_size - 6) || ',"cy":2.5,"radius":' || (p_size % 4) || ',"color":"white"}'
             WHEN 1 THEN '{"type":"line","x1":0,"y1":' || p_size || ',"x2":"9","y2":1,"color":"9x","width":0.4}'
             WHEN 2 THEN '{"type":"pattern","pattern_type":"rect_grid","cols":' || p_size || ',"rows":2.0,"x_start":1,"y_start":1,"x_step":1,"y_step":0,"colors":["#FFF",7],"width":1,"stagger":"no"}'
             WHEN 3 THEN '{"type":"blob","color":"red"}'
             ELSE '{"type":"rectangle","x1":1,"y1":1,"x2":2,"y2":2,"color":"black","shape":"x"}' END
        || ']' || CASE WHEN p_size % 10 = 0 THEN ',"title":"t"' ELSE '' END
        || CASE WHEN p_size % 17 = 0 THEN '' ELSE '}' END AS json FROM part
"""
CANVAS_FAULT_SQL = f"""
    WITH c AS (SELECT p_partkey, p_size, p_partkey % 6 AS turn, p_size % 17 = 0 AS corrupt FROM part),
    v AS (SELECT * FROM c WHERE NOT corrupt)
    SELECT p_partkey, NULL::INT AS pos, NULL AS type, 'corrupt' AS rule, NULL AS field FROM c WHERE corrupt
    UNION ALL SELECT p_partkey, NULL, NULL, 'extra', 'title' FROM v WHERE p_size % 10 = 0
    UNION ALL SELECT p_partkey, 1, 'circle', 'range', 'cx' FROM v WHERE turn = 0 AND (p_size - 6 > 26 OR p_size - 6 < -5)
    UNION ALL SELECT p_partkey, 1, 'circle', 'range', 'radius' FROM v WHERE turn = 0 AND p_size % 4 = 0
    UNION ALL SELECT p_partkey, 1, 'line', 'range', 'y1' FROM v WHERE turn = 1 AND p_size > 34.7
    UNION ALL SELECT p_partkey, 1, 'line', 'type', 'x2' FROM v WHERE turn = 1
    UNION ALL SELECT p_partkey, 1, 'line', 'colour', 'color' FROM v WHERE turn = 1
    UNION ALL SELECT p_partkey, 1, 'pattern', 'range', 'cols' FROM v WHERE turn = 2 AND p_size > 30
    UNION ALL SELECT p_partkey, 1, 'pattern', 'range', 'y_step' FROM v WHERE turn = 2
    UNION ALL SELECT p_partkey, 1, 'pattern', 'colour', 'colors' FROM v WHERE turn = 2
    UNION ALL SELECT p_partkey, 1, 'pattern', 'type', 'stagger' FROM v WHERE turn = 2
    UNION ALL SELECT p_partkey, 1, 'pattern', 'needed', 'height' FROM v WHERE turn = 2
    UNION ALL SELECT p_partkey, 1, 'blob', 'unknown_type', 'type' FROM v WHERE turn = 3
    UNION ALL SELECT p_partkey, 1, 'rectangle', 'extra', 'shape' FROM v WHERE turn = 4
"""


def canvas_documents(t):
    # Keys and sizes of very many parts fit one split of a file; their documents are judged on all cores.
    part = scale.evenly(t.part.select("p_partkey", "p_size"))
    size = F.col("p_size").cast("string")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    turn = F.col("p_partkey") % 6
    second = (
        F.when(turn == 0, text('{"type":"circle","cx":', (F.col("p_size") - 6).cast("string"), ',"cy":2.5,"radius":',
                               (F.col("p_size") % 4).cast("string"), ',"color":"white"}'))
        .when(turn == 1, text('{"type":"line","x1":0,"y1":', size, ',"x2":"9","y2":1,"color":"9x","width":0.4}'))
        .when(turn == 2, text('{"type":"pattern","pattern_type":"rect_grid","cols":', size,
                              ',"rows":2.0,"x_start":1,"y_start":1,"x_step":1,"y_step":0,"colors":["#FFF",7],"width":1,"stagger":"no"}'))
        .when(turn == 3, F.lit('{"type":"blob","color":"red"}'))
        .when(turn == 4, F.lit('{"type":"rectangle","x1":1,"y1":1,"x2":2,"y2":2,"color":"black","shape":"x"}'))
        .otherwise(text('{"type":"pattern","pattern_type":"rect_grid","cols":', (1 + F.col("p_size") % 5).cast("string"),
                        ',"rows":2,"x_start":1,"y_start":2.5,"x_step":1.5,"y_step":0.5,"colors":["#FFF","red"],"width":1,"height":1,"stagger":true}'))
    )
    return part.select(
        "p_partkey",
        text(
            '{"elements":[{"type":"background","color":"#',
            F.lpad(F.hex(F.col("p_partkey") % 16777216), 6, "0"),
            '"},',
            second,
            "]",
            F.when(F.col("p_size") % 10 == 0, ',"title":"t"').otherwise(""),
            F.when(F.col("p_size") % 17 == 0, "").otherwise("}"),
        ).alias("json"),
    )


@query("canvas_violations", CANVAS_FAULT_SQL)
def canvas_violations(t):
    return contract.check_union(canvas_documents(t), ["p_partkey"], "json")


# --- lines of documents ------------------------------------------------------

LINE_SQL = """
    SELECT doc_id, i AS line_no, line FROM (
        SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
        FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS ls FROM documents))
    QUALIFY NOT (line = '' AND i = max(i) OVER (PARTITION BY doc_id))
"""


def document_lines(t):
    return t.documents.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("pos", "line")).select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line"
    )


@query(
    "first_lines",
    f"""
    SELECT doc_id, line, min(line_no) AS line_no FROM ({LINE_SQL}) GROUP BY doc_id, line
    """,
)
def first_lines(t):
    return windows.first_occurrence(document_lines(t), ["doc_id"], ["line"], ["line_no"])
