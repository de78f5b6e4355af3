"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, in any case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_text(text: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(quoted(text).cast("string"), F.lit(""))


def slices(batches: Batches, rows: int = 128) -> Batches:
    """The batches cut into a few rows each, so that what a task builds from them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def batches_of(build: Callable[[list[dict]], list[dict]], schema: pa.Schema) -> Callable[[Batches], Batches]:
    """A function for mapInArrow from one on lists of rows."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = build(batch.to_pylist())
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def known_to_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where it lies, whatever their folder.

    On a cluster the package travels as any other code does (``--py-files``).
    """
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def bytes_total(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of a text column, summed by Spark."""
    return df.select(F.sum(F.octet_length(quoted(text)))).first()[0] or 0
