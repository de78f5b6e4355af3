"""Splitting accepted rows from rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accepted(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    return df.filter(F.col(reason).isNull()).drop(reason)


def rejected(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    return df.filter(F.col(reason).isNotNull())
