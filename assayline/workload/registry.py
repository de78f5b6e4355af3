"""Registry of queries and their SQL, and the input columns several of them derive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


# --- colours and palettes of parts ---------------------------------------------------------
# Parts serve as brands: seven roles with colours computed from the key. Some values are cut
# short (invalid) and some roles are absent.

ROLES = ("bg_primary", "bg_secondary", "accent_1", "accent_2", "neutral", "light", "muted")
SPREAD, STEP, COLOURS = 2654435761, 12345701, 16777216


def part_hex(i: int = 0) -> Column:
    number = (F.col("p_partkey") % COLOURS * SPREAD + i * STEP) % COLOURS
    return F.lpad(F.hex(number), 6, "0")


def part_hex_sql(i: int | str = 0) -> str:
    return f"printf('%06X', (p_partkey % {COLOURS} * {SPREAD} + {i} * {STEP}) % {COLOURS})"


def part_palette(faulty: bool = True) -> Column:
    entries: list[Column] = []
    for i, role in enumerate(ROLES):
        value = F.when((F.col("p_partkey") + i) % 13 != 0, F.concat(F.lit("#"), part_hex(i)))
        if faulty:
            short = F.left(value, F.lit(4))
            value = F.when((F.col("p_size") + i) % 11 == 0, short).otherwise(value)
        entries += [F.lit(role), value]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())


def palette_rows_sql(faulty: bool = True) -> str:
    """Rows (p_partkey, p_brand, p_size, i, role, hex) of the palettes above."""
    roles = ", ".join(f"({i}, '{r}')" for i, r in enumerate(ROLES))
    full = "'#' || " + part_hex_sql("i")
    value = f"CASE WHEN (p_size + i) % 11 = 0 THEN left({full}, 4) ELSE {full} END" if faulty else full
    return (
        f"SELECT p_partkey, p_brand, p_size, i, role, {value} AS hex "
        f"FROM part, (VALUES {roles}) AS r(i, role) WHERE (p_partkey + i) % 13 <> 0"
    )


def luminance_sql(hex_expr: str) -> str:
    def channel(start: int) -> str:
        c = f"(('0x' || substr({hex_expr}, {start}, 2))::INTEGER / 255.0::DOUBLE)"
        return f"(CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END)"

    return f"(0.2126::DOUBLE * {channel(1)} + 0.7152::DOUBLE * {channel(3)} + 0.0722::DOUBLE * {channel(5)})"
