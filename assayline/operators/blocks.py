"""Text checks that need no shuffle: block extraction, rules, number scan, annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.text import strip_fences, to_number

# Markers and patterns of the cover artifact.
COVER_MARKER = "\\newcommand{\\RenderDynamicCover}"
PICTURE_BEGIN = "\\begin{tikzpicture}"
PICTURE_END = "\\end{tikzpicture}"
PLACEMENT_MARK = "% LOGO_PLACEMENT"
PLACEMENT_ROLE = r"% LOGO_PLACEMENT.*?bg=([A-Za-z0-9_]+)"
DECLARED_ROLE = r"\\definecolor\{([A-Za-z0-9_]+)\}"
REQUIRED_MACROS = (
    "\\BookTitle",
    "\\BookSubtitle",
    "\\BookDescription",
    "\\BookAuthor",
    "\\BookDate",
    "\\BookVersion",
)
PLACEMENT = (
    r"%\s*LOGO_PLACEMENT\s+"
    r"x=([0-9]+\.?[0-9]*)\s+"
    r"y=([0-9]+\.?[0-9]*)\s+"
    r"height=([0-9]+\.?[0-9]*)\s+"
    r"bg=([A-Za-z0-9_]+)"
)
COLOUR_DEFINITION = r"\\definecolor\{[^}]+\}\{HTML\}\{[0-9A-Fa-f]+\}"
ARC = r"arc\s*\([^)]*\)"
# The guard follows the first digit it guards, so the scan stops at digits only.
LONG_NUMBER = r"(\d(?<![a-zA-Z{]\d)\d{2,}\.?\d*)"
NUMBER_LIMIT = 150.0

# (name, group, type) of the placement fields.
PLACEMENT_FIELDS = (("x", 1, "double"), ("y", 2, "double"), ("height", 3, "double"), ("bg", 4, "string"))


def extract_balanced(
    df: DataFrame, col: str, marker: str = COVER_MARKER, fences: tuple[str, ...] | None = ("latex", "tex")
) -> DataFrame:
    """Add ``block`` and ``status`` (``ok``, ``truncated``, ``not_found``).

    The block runs from the first marker through the brace that closes the one after it. Braces
    are counted as characters. The fold sees one token per brace, not one per character.
    """
    text = strip_fences(F.col(col), fences) if fences else F.col(col)
    found = df.withColumn("__text", text).withColumn("__at", F.instr("__text", F.lit(marker)))
    rest = F.expr(f"substring(__text, __at + {len(marker)})")
    opened = found.withColumn("__body", F.when(F.col("__at") > 0, F.ltrim(rest, F.lit(" \t\n\r%"))))

    def step(state: Column, token: Column) -> Column:
        closes = F.endswith(token, F.lit("}"))
        depth = state["depth"] + F.when(closes, -1).when(F.endswith(token, F.lit("{")), 1).otherwise(0)
        moved = F.struct(
            depth.alias("depth"),
            (state["used"] + F.length(token)).alias("used"),
            (closes & (depth == 0)).alias("closed"),
        )
        return F.when(state["closed"], state).otherwise(moved)

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("used"), F.lit(False).alias("closed"))
    tokens = F.split("__body", r"(?<=[{}])", -1)
    walked = opened.withColumn(
        "__walk", F.when(F.startswith("__body", F.lit("{")), F.aggregate(tokens, start, step))
    )
    skipped = F.length("__text") - F.col("__at") + 1 - F.length("__body")
    return walked.select(
        *df.columns,
        F.when(
            F.col("__walk.closed"), F.substring(F.col("__text"), F.col("__at"), skipped + F.col("__walk.used"))
        ).alias("block"),
        F.when(F.col("__walk").isNull(), "not_found")
        .when(F.col("__walk.closed"), "ok")
        .otherwise("truncated")
        .alias("status"),
    )


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def suspect_number_texts(
    col: Column, limit: float = NUMBER_LIMIT, strip: Sequence[str] = (COLOUR_DEFINITION, ARC)
) -> Column:
    """Number texts above ``limit`` in reading order; only a number's first digit is guarded."""
    for pattern in strip:
        col = F.regexp_replace(col, "(?U)" + pattern, "")
    texts = F.regexp_extract_all(col, F.lit("(?U)" + LONG_NUMBER), 1)
    return F.filter(texts, lambda text: to_number(text) > limit)


def suspect_numbers(
    df: DataFrame,
    col: str,
    limit: float = NUMBER_LIMIT,
    strip: Sequence[str] = (COLOUR_DEFINITION, ARC),
    top: int = 5,
) -> DataFrame:
    """Add ``suspects`` (all of them) and ``first_suspects`` (the ``top`` shown in a report)."""
    return df.withColumn("suspects", suspect_number_texts(F.col(col), limit, strip)).withColumn(
        "first_suspects", F.slice("suspects", 1, top)
    )


def listed(prefix: str, items: Column) -> Column:
    """The prefix and the items, or NULL when there are none; ``items`` is evaluated once."""
    return F.concat(F.lit(prefix), F.nullif(F.array_join(items, ", "), F.lit("")))


def cover_rules(col: str) -> dict[str, Column]:
    """Rules of the cover block: each gives a message, or NULL when the block passes."""
    block = F.col(col)

    def absent(text: str) -> Column:
        return ~F.contains(block, F.lit(text))

    role = F.nullif(F.regexp_extract(block, "(?d)" + PLACEMENT_ROLE, 1), F.lit(""))
    declared = F.array_sort(F.array_distinct(F.regexp_extract_all(block, F.lit(DECLARED_ROLE), 1)))
    undeclared = (F.size(declared) > 0) & ~F.array_contains(declared, role)
    missing = F.filter(
        F.array(*[F.lit(m) for m in REQUIRED_MACROS]), lambda macro: ~F.contains(block, macro)
    )
    suspects = suspect_number_texts(block)
    return {
        "begin": F.when(absent(PICTURE_BEGIN), F.lit(f"{PICTURE_BEGIN} is missing")),
        "end": F.when(absent(PICTURE_END), F.lit(f"{PICTURE_END} is missing")),
        "annotation": F.when(absent(PLACEMENT_MARK), F.lit(f"{PLACEMENT_MARK} is missing")),
        "annotation_role": F.when(
            F.contains(block, F.lit(PLACEMENT_MARK)) & undeclared,
            F.format_string("placement role %s is not declared; declared: %s", role, F.array_join(declared, ", ")),
        ),
        "macros": listed("missing macros: ", missing),
        "range": listed("numbers out of range: ", F.slice(suspects, 1, 5)),
    }


def validate_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``warnings``, an array of (rule, message), empty for a clean row."""
    checks = [F.struct(F.lit(name).alias("rule"), message.alias("message")) for name, message in rules.items()]
    return df.withColumn("warnings", F.filter(F.array(*checks), lambda c: c["message"].isNotNull()))


def rule_report(df: DataFrame) -> DataFrame:
    """Rows per rule that raised a warning."""
    return (
        df.select(F.explode("warnings.rule").alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def parse_annotation(
    df: DataFrame,
    col: str,
    pattern: str = PLACEMENT,
    fields: Sequence[tuple[str, int, str]] = PLACEMENT_FIELDS,
    name: str = "placement",
) -> DataFrame:
    """Add a struct of typed fields from the first match, NULL when the pattern does not match."""
    whole = "(?U)" + pattern
    parts = [
        F.regexp_extract(col, whole, group).try_cast(kind).alias(field) for field, group, kind in fields
    ]
    return df.withColumn(name, F.when(F.col(col).rlike(whole), F.struct(*parts)))
