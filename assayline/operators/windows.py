"""Error windows over ordered lines and first-occurrence dedup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.functions.text import strip_space
from assayline.operators.scale import join_null_safe, possible
from assayline.session import materialise, materialise_counted

# Line starts that open an error block of a typesetter log, any case, and the
# block length and placeholder of a log without one.
ERROR_LINE = (
    r"(?iuUd)\A(?:!|Package \w[\w@]* Error:|LaTeX Error:|Runaway argument\?|Emergency stop\.|.*Fatal error)"
)
CONTEXT_LINES = 10
NO_ERROR_TEXT = "[no structured error pattern found in log]"

# Lines of one key per fold, and folds per group of folds.
FOLD_LINES = 4096
FOLD_GROUP = 1024

WINDOW_FOLD = "__fold"


def error_line(col: str) -> Column:
    return F.col(col).rlike(ERROR_LINE)


def window_starts(
    lines: DataFrame,
    key: Sequence[str],
    line_no: str,
    trigger: Column,
    k: int = CONTEXT_LINES,
    fold_lines: int | None = None,
    fold_group: int | None = None,
) -> DataFrame:
    """Starts of non-overlapping windows of ``k`` lines: (key, line_no).

    A trigger opens a window unless it lies in the one before it. ``line_no`` is dense per key
    and 1-based. Whether a trigger opens a window depends on all earlier ones, but across a cut
    between lines only the number of lines still covered (0 to k-1) matters. So each run of
    ``fold_lines`` lines is folded alone for every such number, the short results are chained
    per group and then per key, and a second pass reads off the starts. A fold never holds more
    than ``fold_lines`` numbers of a key, however long its log.
    """
    lines_per = FOLD_LINES if fold_lines is None else fold_lines
    per_group = FOLD_GROUP if fold_group is None else fold_group
    if k > lines_per:
        raise ValueError("a window must not be longer than a fold")
    folds = (
        lines.filter(trigger)
        .select(
            *key,
            F.expr(f"(`{line_no}` - 1) div {lines_per}").alias("fold"),
            ((F.col(line_no) - 1) % lines_per).cast("int").alias("at"),
        )
        .groupBy(*key, "fold")
        .agg(F.array_sort(F.collect_list("at")).alias("hits"))
    )
    # The few trigger numbers are read several times below; the numbering behind them is not.
    folds = materialise(folds)
    last = folds.agg(F.max("fold")).first()[0] or 0
    carried = _entering_folds(folds, key, k, lines_per, per_group, last) if last else folds.withColumn("carry", F.lit(0))

    def open_windows(state: Column, hit: Column) -> Column:
        return F.when(
            hit >= state["free"],
            F.struct((hit + k).alias("free"), F.array_append(state["starts"], hit).alias("starts")),
        ).otherwise(state)

    fresh = F.struct(F.col("carry").alias("free"), F.array().cast("array<int>").alias("starts"))
    opened = carried.select(
        *key,
        "fold",
        F.explode(F.aggregate("hits", fresh, open_windows, lambda s: s["starts"])).alias("start"),
    )
    return opened.select(*key, (F.col("fold") * lines_per + F.col("start") + 1).alias(line_no))


def _entering_folds(
    folds: DataFrame, key: Sequence[str], k: int, lines_per: int, per_group: int, last: int
) -> DataFrame:
    """Add ``carry`` to every fold: the lines at its start that an earlier window still covers."""
    every = F.sequence(F.lit(0), F.lit(k - 1))

    # Covered lines on leaving a fold, for each number of covered lines on entering it.
    def step(free: Column, hit: Column) -> Column:
        return F.transform(free, lambda f: F.when(hit >= f, hit + k).otherwise(f))

    leaving = F.transform(
        F.aggregate("hits", every, step), lambda free: F.greatest(free - lines_per, F.lit(0))
    )
    grouped = (
        folds.select(*key, "fold", F.expr(f"fold div {per_group}").alias("grp"), leaving.alias("next"))
        .groupBy(*key, "grp")
        .agg(F.array_sort(F.collect_list(F.struct("fold", "next"))).alias("steps"))
    )
    first = F.col("grp") * per_group

    # A fold without triggers covers nothing, so a gap in the numbers resets to zero.
    def enter(items: str, number: str, carry: Column, name: str) -> Column:
        """Array of (number, covered lines on entry) by walking the items from ``carry``."""
        start = F.struct(
            F.lit(None).cast("bigint").alias("last"),
            carry.alias("carry"),
            F.array().cast(f"array<struct<{number}:bigint,{name}:int>>").alias("seen"),
        )

        def walk(state: Column, item: Column) -> Column:
            apart = state["last"].isNotNull() & (item[number] != state["last"] + 1)
            now = F.when(apart, F.lit(0)).otherwise(state["carry"])
            return F.struct(
                item[number].alias("last"),
                F.get(item["next"], now).alias("carry"),
                F.array_append(state["seen"], F.struct(item[number].alias(number), now.alias(name))).alias("seen"),
            )

        return F.aggregate(items, start, walk, lambda state: state["seen"])

    if last < per_group:
        entered = grouped.withColumn("entry", F.lit(0))
    else:
        groups = grouped.select(*key, "grp", _through_group("steps", first, per_group, every, k).alias("next"))
        by_key = groups.groupBy(*key).agg(
            F.array_sort(F.collect_list(F.struct("grp", "next"))).alias("groups")
        )
        entry = by_key.select(*key, F.inline(enter("groups", "grp", F.lit(0), "entry")))
        entered = join_null_safe(grouped, entry, [*key, "grp"])
    # Only a group that has its first fold continues the group before it.
    continues = F.element_at("steps", 1)["fold"] == first
    fold_entry = entered.select(
        *key, F.inline(enter("steps", "fold", F.when(continues, F.col("entry")).otherwise(0), "carry"))
    )
    return join_null_safe(folds, fold_entry, [*key, "fold"])


def _through_group(steps: str, first: Column, per_group: int, every: Column, k: int) -> Column:
    """Covered lines on leaving a group of folds, for each number on entering it."""

    def chain(state: Column, item: Column) -> Column:
        apart = item["fold"] != state["fold"] + 1
        onward = F.transform(
            state["next"], lambda c: F.get(item["next"], F.when(apart, F.lit(0)).otherwise(c))
        )
        return F.struct(item["fold"].alias("fold"), onward.alias("next"))

    start = F.struct((first - 1).alias("fold"), every.alias("next"))
    nothing = F.array_repeat(F.lit(0), k)
    return F.aggregate(
        steps,
        start,
        chain,
        lambda end: F.when(end["fold"] == first + per_group - 1, end["next"]).otherwise(nothing),
    )


def window_lines(
    lines: DataFrame,
    starts: DataFrame,
    key: Sequence[str],
    line_no: str,
    k: int = CONTEXT_LINES,
    fold_lines: int | None = None,
) -> DataFrame:
    """Lines inside windows, with ``start_line`` and the fold of that start (``WINDOW_FOLD``).

    Lines that can lie in no window are dropped where they are read. The others move once, by key
    and fold, the first ``k - 1`` lines of a fold also to the fold before, whose last window may
    reach them. The starts join them there as marker rows, and a running maximum spreads each over its lines.
    Grouping the result by key, ``WINDOW_FOLD`` and ``start_line`` needs no further exchange.
    """
    lines_per = FOLD_LINES if fold_lines is None else fold_lines
    if k > lines_per:
        raise ValueError("a window must not be longer than a fold")
    opened, number = materialise_counted(starts.select(*key, line_no))
    wanted = opened.select(*key, F.explode(F.sequence(F.col(line_no), F.col(line_no) + (k - 1))).alias(line_no))
    near = possible(lines, wanted, [*key, line_no], number * k)
    fold = F.expr(f"(`{line_no}` - 1) div {lines_per}")
    at_border = (fold > 0) & ((F.col(line_no) - 1) % lines_per < k - 1)
    placed = near.withColumn(WINDOW_FOLD, F.explode(F.when(at_border, F.array(fold, fold - 1)).otherwise(F.array(fold))))
    markers = opened.withColumns({WINDOW_FOLD: fold, "__start": F.col(line_no)})
    both = placed.unionByName(markers, allowMissingColumns=True)
    # A marker comes before the line it stands for.
    upto = W.partitionBy(*key, WINDOW_FOLD).orderBy(line_no, F.col("__start").isNull()).rowsBetween(W.unboundedPreceding, 0)
    spread = both.withColumn("start_line", F.max("__start").over(upto))
    return spread.filter((F.col("__start").isNull()) & (F.col(line_no) < F.col("start_line") + k)).drop("__start")


def error_blocks(
    lines: DataFrame,
    key: Sequence[str],
    line_no: str = "line_no",
    line: str = "line",
    trigger: Column | None = None,
    k: int = CONTEXT_LINES,
    dedup: bool = True,
    placeholder: bool = True,
    keys: DataFrame | None = None,
    **folding,
) -> DataFrame:
    """Error blocks of numbered log lines: (key, start_line, trigger_text, block).

    Blocks with the same stripped first line in one key are kept once, the first; they still
    cover their lines. A key without any trigger yields one placeholder row; ``keys`` lists
    all keys once, so that logs without a line are among them.
    """
    opens = error_line(line) if trigger is None else trigger
    starts = window_starts(lines, key, line_no, opens, k, **folding)
    inside = window_lines(lines, starts, key, line_no, k, folding.get("fold_lines"))
    numbered_text = F.array_sort(F.collect_list(F.struct(F.col(line_no).alias("n"), F.col(line).alias("t"))))
    blocks = inside.groupBy(*key, WINDOW_FOLD, "start_line").agg(
        strip_space(F.max(F.when(F.col(line_no) == F.col("start_line"), F.col(line)))).alias("trigger_text"),
        strip_space(F.array_join(F.transform(numbered_text, lambda r: r["t"]), "\n")).alias("block"),
    ).drop(WINDOW_FOLD)
    if dedup:
        blocks = first_occurrence(blocks, key, ["trigger_text"], ["start_line"])
    if placeholder:
        heard = lines.groupBy(*key).agg(F.max(F.coalesce(opens, F.lit(False))).alias("__any"))
        if keys is not None:
            heard = join_null_safe(keys.select(*key), heard, key, "left")
        quiet = heard.filter("NOT coalesce(__any, false)").select(*key, F.lit(NO_ERROR_TEXT).alias("block"))
        blocks = blocks.unionByName(quiet, allowMissingColumns=True)
    return blocks


def first_occurrence(df: DataFrame, group: Sequence[str], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per group and key, the row that comes first. ``min_by`` merges before the shuffle, so
    copies of a hot key do not travel."""
    by = [*group, *key]
    rest = [c for c in df.columns if c not in by]
    return (
        df.groupBy(*by)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
        .select(*by, "__row.*")
        .select(*df.columns)
    )
