"""Writers: composed artifacts, raw payloads and quarantine."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compose(comment: Column, *sections: Column) -> Column:
    """Header line, then the sections that are there, then a final newline."""
    header = F.concat(F.lit("% "), comment, F.lit(" - generated, edits will be lost\n"))
    return F.concat(header, *[F.coalesce(s, F.lit("")) for s in sections], F.lit("\n"))


def write_artifacts(df: DataFrame, path: str, by: Sequence[str] = ("brand",), mode: str = "overwrite") -> None:
    """Artifacts as Parquet, partitioned. Rows are rebalanced by the partition columns first: small
    brands give one file each, and a large brand is split over many tasks. Overwriting replaces the
    brands at hand and leaves others alone."""
    whole = df.hint("rebalance", *by)
    whole.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_texts(df: DataFrame, path: str, name: str = "request_id", text: str = "artifact") -> None:
    """One text file per artifact, in a folder ``name=value`` of its own under ``path``.

    Spark's committer moves files into place when their tasks have succeeded, so a retried task leaves
    no second copy, and writing the same names again replaces their files and no others. Files hold the
    text byte for byte where it ends in a newline, as composed ones do; others get one at the end. A
    ``name`` belongs to one row (of several, the texts follow each other); rows without a text are left out.
    """
    ended = F.regexp_replace(F.col(text), r"\n\z", "")  # the sink ends each row with a newline
    rows = df.filter(F.col(text).isNotNull()).select(F.col(name), ended.alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).text(path)


def _write_batch(df: DataFrame, path: str, batch: str | None, mode: str) -> None:
    if batch is None:
        df.write.mode(mode).parquet(path)
        return
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"a batch id holds letters, digits, _ . and - only: {batch!r}")
    # Its folder is replaced as a whole, so a batch that turns out smaller, or empty, leaves nothing behind.
    df.drop("batch").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def append_responses(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Raw payloads are kept before anything judges them.

    With a ``batch`` id a job that runs again replaces the rows it wrote under that id; without one its
    rows are appended each time. The id comes back as the column ``batch``.
    """
    _write_batch(df, path, batch, "append")


def write_quarantine(
    df: DataFrame, path: str, reason: str = "reject_reason", mode: str = "append", batch: str | None = None
) -> None:
    """Rows with a reason; ``batch`` as in ``append_responses``."""
    _write_batch(df.filter(F.col(reason).isNotNull()), path, batch, mode)
