"""Ordered assembly and template rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.colour import clean_hex
from assayline.operators.reference import DEFINITION_PARTS
from assayline.operators.scale import numbered, running_total


def assemble(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    text: Column,
    sep: str = "\n",
    header: str | None = None,
    *,
    part_items: int | None = None,
    part_bytes: int | None = None,
    rows_per_slice: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Join the texts of each key in ``order``: (key, part, items, text).

    ``header`` is a format with one ``%d`` that is put before the n-th text. Rows whose text is
    NULL are dropped before counting. Texts come in pages, which the caller sizes by ``part_items`` rows
    or by ``part_bytes`` UTF-8 bytes; joining the parts of a key in order with ``sep`` gives the whole text.

    Pages by bytes are cut from running sums, so a key of any size is paged in parallel. A page holds at
    most ``part_bytes``; only a single text above that, which no cut between texts can divide, makes a larger
    page, and is alone on it. Their ``part`` numbers rise, with gaps.
    """
    if (part_items is None) == (part_bytes is None):
        raise ValueError("size the pages by part_items or by part_bytes")
    shown = df.select(*key, *order, text.alias("__text")).filter("__text IS NOT NULL")
    if part_items is not None:
        lines = numbered(shown, key, order, "__n", rows_per_slice, rows)
        part = F.expr(f"(__n - 1) div {part_items}")
    else:
        # The number in a heading is not known yet: room for the longest one.
        around = len(sep.encode()) + (0 if header is None else len((header % (2**63 - 1)).encode()))
        size = F.octet_length("__text").cast("bigint") + around
        # Texts of at most half a page go by the half page in which they start; each longer one parts those before it from those after.
        half = max(1, part_bytes // 2)
        long = (size > half).cast("bigint")
        sums = {"__n": F.lit(1).cast("bigint"), "__end": size, "__longs": long}
        lines = running_total(shown, key, order, sums, rows_per_slice, rows)
        part = F.floor((F.col("__end") - size) / F.lit(half)) + 2 * F.col("__longs") - long
    if header is not None:
        body = F.concat(F.format_string(header, F.col("__n")), F.col("__text"))
    else:
        body = F.col("__text")
    items = F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), body.alias("t"))))
    return (
        lines.withColumn("part", part)
        .groupBy(*key, "part")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.array_join(F.transform(items, lambda i: i["t"]), sep).alias("text"),
        )
    )


def error_summary(blocks: DataFrame, key: Sequence[str], order: Sequence[str], block: str = "block", **sizing) -> DataFrame:
    """Error blocks of a key as one report, each under a numbered heading (a fixed value)."""
    return assemble(blocks, key, order, F.col(block), "\n\n", "--- Error block %d ---\n", **sizing)


def definition_lines(colours: Column) -> Column:
    """Colour definitions of a palette map, one per line, indented; NULL for an empty map."""
    first, middle, last = DEFINITION_PARTS
    lines = F.transform(
        F.map_entries(colours),
        lambda e: F.concat(F.lit("   " + first), e["key"], F.lit(middle), clean_hex(e["value"]), F.lit(last)),
    )
    return F.when(F.size(colours) > 0, F.array_join(lines, "\n"))


def render_template(
    df: DataFrame, template: str | Column, placeholder: str, lines: Column, free_choice: str, name: str = "rendered"
) -> DataFrame:
    """Put ``lines`` (or the free-choice text when there are none) in every place the template
    names. The template is a literal; each row brings its own lines."""
    base = F.lit(template) if isinstance(template, str) else template
    filled = F.coalesce(F.nullif(lines, F.lit("")), F.lit(free_choice))
    return df.withColumn(name, F.replace(base, F.lit(placeholder), filled))
