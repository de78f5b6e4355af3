"""Distinct error incidents per key of an ordered event table, and log reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.operators.render import error_summary
from assayline.operators.scale import numbered
from assayline.operators.windows import CONTEXT_LINES, WINDOW_FOLD, error_blocks, first_occurrence, window_lines, window_starts
from assayline.session import materialise


def incident_windows(
    events: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    trigger: Column,
    subject: str,
    value: str,
    k: int = CONTEXT_LINES,
    dedup: bool = True,
    rows_per_slice: int | None = None,
    **folding,
) -> DataFrame:
    """Non-overlapping windows of ``k`` events from each trigger: (key, start_line, subject,
    events, total). With ``dedup`` only the first window per subject of the trigger stays."""
    slim = events.select(*key, *order, F.coalesce(trigger, F.lit(False)).alias("__opens"), subject, value)
    # Read for the triggers and again for the lines in windows; numbered once.
    lines = materialise(numbered(slim, key, order, "line_no", rows_per_slice))
    starts = window_starts(lines, key, "line_no", F.col("__opens"), k, **folding)
    inside = window_lines(lines, starts, key, "line_no", k, folding.get("fold_lines"))
    windows = inside.groupBy(*key, WINDOW_FOLD, "start_line").agg(
        F.max(F.when(F.col("line_no") == F.col("start_line"), F.col(subject))).alias("subject"),
        F.count(F.lit(1)).alias("events"),
        F.sum(value).alias("total"),
    ).drop(WINDOW_FOLD)
    return first_occurrence(windows, key, ["subject"], ["start_line"]) if dedup else windows


def incident_counts(windows: DataFrame, key: Sequence[str]) -> DataFrame:
    return windows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("incidents"),
        F.sum("events").alias("events"),
        F.round(F.sum("total"), 2).alias("total"),
    )


def log_reports(lines: DataFrame, key: Sequence[str], part_items: int, keys: DataFrame | None = None, **folding) -> DataFrame:
    """One report per log, in pages of ``part_items`` blocks: its distinct error blocks under numbered
    headings. ``keys`` lists all logs, so that one without lines gets its placeholder."""
    blocks = materialise(error_blocks(lines, key, keys=keys, **folding))
    placed = blocks.withColumn("at", F.coalesce(F.col("start_line"), F.lit(0)))
    return error_summary(placed, key, ["at"], part_items=part_items)
