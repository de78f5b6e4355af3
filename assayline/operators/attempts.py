"""Attempt chains, failure classes and latest payloads."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.operators.scale import SLICE, in_slices, join_null_safe, possible
from assayline.session import materialise_counted


@dataclass(frozen=True)
class FailureClass:
    label: str
    exact: tuple[str, ...] = ()
    any_case: tuple[str, ...] = ()

    def matches(self, message: Column) -> Column:
        lowered = F.lower(message)
        tests = [F.contains(message, F.lit(s)) for s in self.exact]
        tests += [F.contains(lowered, F.lit(s)) for s in self.any_case]
        hit = tests[0]
        for test in tests[1:]:
            hit = hit | test
        return hit


# Substrings of failure messages, in order of precedence, and what aborts a chain.
FIRST_PASS = (
    FailureClass("auth", ("401",), ("authentication", "invalid api key")),
    FailureClass("busy", ("503", "UNAVAILABLE"), ("overloaded",)),
    FailureClass("rate", ("429", "RESOURCE_EXHAUSTED"), ("quota",)),
    FailureClass("missing", ("404", "NOT_FOUND")),
)
FIRST_PASS_FATAL = ("auth", "unexpected")
REFINE = (FailureClass("auth", ("401",), ("authentication",)),)
REFINE_FATAL = ("auth",)
REPAIR = (
    FailureClass("busy", ("503", "UNAVAILABLE")),
    FailureClass("rate", ("429", "RESOURCE_EXHAUSTED")),
)
REPAIR_FATAL = ("unexpected",)
UNEXPECTED = "unexpected"


def classify_failures(
    df: DataFrame,
    msg_col: str,
    classes: Sequence[FailureClass] = FIRST_PASS,
    fatal: Sequence[str] = FIRST_PASS_FATAL,
    other: str = UNEXPECTED,
) -> DataFrame:
    """Add ``failure`` (NULL without a message) and ``fatal``."""
    message = F.col(msg_col)
    label = F.when(message.isNull(), F.lit(None).cast("string"))
    for rule in classes:
        label = label.when(rule.matches(message), rule.label)
    return df.withColumn("failure", label.otherwise(other)).withColumn(
        "fatal", F.coalesce(F.col("failure").isin(*fatal), F.lit(False))
    )


def failure_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, "failure").agg(F.count(F.lit(1)).alias("n"))


def resolve_attempts(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    status_col: str,
    payload_col: str,
    attempt_col: str,
    ok: str | Sequence[str] = "ok",
    fatal: Sequence[str] = ("fatal",),
    rows_per_slice: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """One row per key: ``outcome`` (``ok``, ``aborted``, ``exhausted``), ``attempts`` used,
    ``winner`` (the successful attempt) and ``last_payload`` (last non-empty text seen).

    Attempts after the first ok or fatal one count for nothing. Ordering works on flags alone, and
    each slice of a key is resolved on its own before the few slice results of the key are merged,
    so a key may be any size. The resolved keys are written; payloads join them at the end by key and
    place in the order, so no window sorts them and no key gathers them.
    A filter over the chosen places drops the texts of all other attempts before they are shuffled.

    Attempts that share a place in the order count one by one: those that succeed first, then fatal ones,
    then by ``attempt_col``; of their texts the greatest is the place's.
    """
    wins = [ok] if isinstance(ok, str) else list(ok)
    won = F.coalesce(F.col(status_col).isin(wins), F.lit(False))
    lost = F.coalesce(F.col(status_col).isin(list(fatal)), F.lit(False))
    text = F.nullif(F.col(payload_col), F.lit(""))
    flags = df.select(
        *key,
        F.struct(*order).alias("__order"),
        won.alias("__ok"),
        lost.alias("__fatal"),
        text.isNotNull().alias("__text"),
        F.col(attempt_col).alias("__attempt"),
    )
    sliced = in_slices(flags, key, ["__order"], rows_per_slice, rows)
    rows_of = flags if sliced is None else sliced
    part = list(key) if sliced is None else [*key, SLICE]
    turn = ["__order", F.desc("__ok"), F.desc("__fatal"), "__attempt"]
    earlier = W.partitionBy(*part).orderBy(*turn).rowsBetween(W.unboundedPreceding, -1)
    over = F.coalesce(F.max(F.col("__ok") | F.col("__fatal")).over(earlier), F.lit(False))
    ended = rows_of.withColumn("__over", over).filter("NOT __over").groupBy(*part).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.max(F.when(F.col("__ok"), F.struct(F.lit("ok").alias("o"), F.col("__attempt").alias("w")))).alias("__won"),
        F.max("__fatal").alias("__lost"),
        F.max(F.when(F.col("__text"), F.col("__order"))).alias("__at"),
    )
    if sliced is not None:
        stopped = F.col("__won").isNotNull() | F.col("__lost")
        cut = F.min(F.when(stopped, F.col(SLICE))).over(W.partitionBy(*key))
        ended = (
            ended.withColumn("__cut", cut)
            .filter(f"__cut IS NULL OR {SLICE} <= __cut")
            .groupBy(*key)
            .agg(
                F.sum("attempts").alias("attempts"),
                F.max("__won").alias("__won"),
                F.max("__lost").alias("__lost"),
                F.max("__at").alias("__at"),
            )
        )
    # The one payload that each key ends with, met by key and place: no key is hot there.
    ended, keys = materialise_counted(ended)
    payloads = df.select(*key, F.struct(*order).alias("__at"), text.alias("last_payload")).filter(
        "last_payload IS NOT NULL"
    )
    place = [*key, "__at"]
    wanted = possible(payloads, ended.filter("__at IS NOT NULL"), place, keys)
    held = join_null_safe(ended, wanted.groupBy(*place).agg(F.max("last_payload").alias("last_payload")), place, "left")
    return held.select(
        *key,
        F.when(F.col("__won").isNotNull(), "ok").when(F.col("__lost"), "aborted").otherwise("exhausted").alias("outcome"),
        "attempts",
        F.col("__won.w").alias("winner"),
        "last_payload",
    )


def latest_payload(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last written row per key, whatever its status."""
    rest = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
        .select(*key, "__row.*")
    )


def reuse_check(df: DataFrame, status_col: str = "status", ok: str = "ok") -> DataFrame:
    """Add ``reusable`` and, for other rows, ``reuse_error``. Apply after ``latest_payload``."""
    status = F.col(status_col)
    return df.withColumn("reusable", F.coalesce(status == ok, F.lit(False))).withColumn(
        "reuse_error", F.when(~F.coalesce(status == ok, F.lit(False)), F.coalesce(status, F.lit("not_found")))
    )


def judge_unseen(
    df: DataFrame,
    ledger: DataFrame | None,
    key: Sequence[str],
    order: Sequence[str],
    judge: Callable[[DataFrame], DataFrame],
    verdicts: Sequence[str],
    version: str = "1",
) -> DataFrame:
    """The ledger of judged payloads after this run: (key, order, verdicts, ``judged_by``), written.

    A payload is known by its key and its place in ``order``, which must be unique per key. Per key the
    last row counts, as in ``latest_payload``. ``judge`` adds the columns ``verdicts`` to the rows that
    ``ledger``, the result of an earlier run, does not hold under the same ``version``; all other entries are
    taken over, also those of keys that ``df`` no longer has. So a run over a table judged before reads keys and
    places alone, and a raised ``version`` has every payload of ``df`` judged anew.

    NULL keys and places are values like any other. Without a ledger everything is judged; a ledger whose
    key is older in ``df`` than in the ledger keeps its entry.
    """
    place = F.struct(*order)
    latest = df.select(*key, place.alias("__at")).groupBy(*key).agg(F.max("__at").alias("__at"))
    columns = [*key, *order, *verdicts, "judged_by"]
    if ledger is not None:
        entries = ledger.select(*key, place.alias("__held"), (F.col("judged_by") == version).alias("__same"))
        met = join_null_safe(latest, entries, key, "left")
        latest = met.filter("__same IS NULL OR NOT __same OR __at > __held").drop("__held", "__same")
    unseen, number = materialise_counted(latest)
    if ledger is not None and not number:
        return ledger.select(*columns)
    on = [*key, "__at"]
    rows = possible(df.withColumn("__at", place), unseen, on, number)
    chosen = join_null_safe(rows, unseen, on, "left_semi").drop("__at")
    entries = judge(chosen).withColumn("judged_by", F.lit(version)).select(*columns)
    if ledger is not None:
        stay = join_null_safe(ledger, unseen.select(*key), key, "left_anti")
        entries = stay.select(*columns).unionByName(entries)
    return materialise_counted(entries)[0]
