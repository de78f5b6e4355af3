"""Secret scan of every version of a response, driven by a ledger of scanned blobs.

A version's text is addressed by its SHA-256. A blob is read once per rule version, however many
requests and attempts hold it; the ledger of past scans takes (blob, rule version) pairs out
before any text is matched. Findings are kept per blob and joined back to all versions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm.common import quoted, whole_text


@dataclass(frozen=True)
class Rule:
    """One kind of secret. ``least`` is the length that ``group`` must reach for a match to count.

    A text without any of ``hints`` (tested in lower case where ``any_case``) is not matched at all.
    """

    kind: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False
    hints: tuple[str, ...] = ()

    @property
    def label(self) -> str:
        return f"{self.kind}@{self.version}"


# Kinds in the order in which spans of one start are listed.
BASE_RULES = (
    Rule(
        "assign",
        1,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=8,
        group=2,
        any_case=True,
        hints=("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=16, hints=("AKIA",)),
    # Runs under 32 are dropped, and none of them can hide a longer one: the bound may stand in the pattern.
    Rule("hex", 1, r"[0-9a-f]{32,}", least=32),
)
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", hints=("-----BEGIN ",)),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("gh",)),
    Rule("chat", 1, r"xox[abeoprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hints=("eyJ",)),
    Rule("maps", 1, r"AIza[A-Za-z0-9_-]{35}", hints=("AIza",)),
    Rule("payment", 1, r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", hints=("k_live_", "k_test_")),
)
RULES = BASE_RULES + MORE_RULES

LEDGER = "blob string, rules array<string>, findings array<struct<kind:string, start:long, end:long>>"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def blob_id(raw: str = "raw") -> Column:
    """Content address of a version; a null text is the empty blob."""
    return F.sha2(whole_text(raw).cast("binary"), 256)


def find_secrets(text: str, rules: tuple[Rule, ...]) -> list[dict]:
    """Leftmost non-overlapping matches of each rule, in code points, by start and rule order."""
    found, lower = [], None
    for rank, rule in enumerate(rules):
        if rule.any_case and lower is None:
            lower = text.lower()
        if rule.hints and not any(h in (lower if rule.any_case else text) for h in rule.hints):
            continue
        # ASCII keeps letters beyond A-Z from matching in the other case.
        pattern = re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), rank, rule.kind, m.end()))
    return [{"kind": kind, "start": start, "end": end} for start, _, kind, end in sorted(found)]


def scan_unseen(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    *,
    raw: str = "raw",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """New ledger rows (blob, rules, findings): the pairs of blob and rule version not yet in ``ledger``.

    ``versions`` holds every attempt of every request. Equal texts are merged before and after the
    shuffle, so a text with very many copies is neither gathered nor scanned twice. A blob known
    under all rules is left out before its text moves on. Null texts count as empty; an empty
    table gives no row.
    """
    blobs = versions.select(whole_text(raw).alias("raw"), blob_id(raw).alias("blob")).groupBy("blob").agg(F.any_value("raw").alias("raw"))
    labels = [r.label for r in rules]
    todo = F.array(*map(F.lit, labels))
    if ledger is not None:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
        todo = F.array_except(todo, F.coalesce("seen", F.array().cast("array<string>")))
    by_label = dict(zip(labels, rules))

    @F.pandas_udf("array<struct<kind:string, start:long, end:long>>")
    def scan(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([find_secrets(t, tuple(by_label[w] for w in some)) for t, some in zip(texts, wanted)])

    return (
        blobs.withColumn("rules", todo)
        .filter(F.size("rules") > 0)
        .select("blob", "rules", scan("raw", "rules").alias("findings"))
    )


def findings_by_version(
    versions: DataFrame,
    ledger: DataFrame,
    *,
    key: str = "request_id",
    attempt: str = "attempt",
    raw: str = "raw",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row per version: key, attempt, blob and its findings under ``rules`` from the ledger.

    Only blobs that hold something enter the join; all other versions get an empty list. Findings
    are ordered by start and then rule order. Repeated rows of ``versions`` give repeated rows.
    """
    order = F.array(*(F.lit(r.kind) for r in rules))
    label = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.label)))
    held = (
        ledger.filter(F.size("findings") > 0)
        .select("blob", "rules", F.explode("findings").alias("f"))
        .filter(F.array_contains("rules", F.try_element_at(label, F.col("f.kind"))))
        .groupBy("blob")
        .agg(F.sort_array(F.collect_set(F.struct("f.start", F.array_position(order, F.col("f.kind")).alias("rank"), "f.end", "f.kind"))).alias("found"))
        .withColumn("findings", F.transform("found", lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"))))
        .drop("found")
    )
    nothing = F.array().cast("array<struct<kind:string, start:long, end:long>>")
    return (
        versions.select(quoted(key).alias(key), quoted(attempt).alias(attempt), blob_id(raw).alias("blob"))
        .join(held, "blob", "left")
        .withColumn("findings", F.coalesce("findings", nothing))
    )


def spans_text(findings: Column) -> Column:
    """``kind:start:end`` of all findings, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def redact(raw: Column, findings: Column) -> Column:
    """The text with every found span replaced by ``[kind]``; overlapping spans merge into the first.

    ``findings`` are ordered by start. A null text stays null.
    """
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(done: Column, f: Column) -> Column:
        fresh_span = f["start"] >= done["at"]
        kept = F.substring(raw, (done["at"] + 1).cast("int"), (f["start"] - done["at"]).cast("int"))
        mark = F.concat(F.lit("["), f["kind"], F.lit("]"))
        return F.struct(
            F.when(fresh_span, F.concat(done["out"], kept, mark)).otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], f["end"]).alias("at"),
        )

    rest = lambda done: F.concat(done["out"], F.substring(raw, (done["at"] + 1).cast("int"), F.length(raw)))
    return F.when(F.size(findings) > 0, F.aggregate(findings, zero, step, rest)).otherwise(raw)
