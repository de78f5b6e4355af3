"""Mixing sources to target weights: raking of token mass, then sampling by calibrated probability.

Iterative proportional fitting on the cells (one per combination of the margins' values): each
sweep scales the mass of every value of every margin to its target. A response is drawn as many times
in expectation as brings its cell from its present mass to the fitted one: cells that hold less than
their share are repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import fresh, quoted
from assayline.session import materialise

NONE = "(none)"


def tempered_targets(cells: DataFrame, margin: str, alpha: float) -> DataFrame:
    """(value, share): present shares of token mass raised to ``alpha``; 1 keeps, 0 evens out."""
    mass = cells.groupBy(F.col(margin).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(alpha)).alias("m"))
    total = mass.agg(F.sum("m")).first()[0] or 1.0
    return mass.select("value", (F.col("m") / F.lit(total)).alias("share"))


def cells_of(responses: DataFrame, margins: list[str], tokens: str) -> DataFrame:
    """(margins..., tokens): token mass per combination; null margin values count as ``(none)``."""
    names = [f"m{i}" for i in range(len(margins))]
    rows = responses.select(
        *(F.coalesce(quoted(m).cast("string"), F.lit(NONE)).alias(n) for m, n in zip(margins, names)),
        F.greatest(F.coalesce(quoted(tokens).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("tokens"),
    )
    return rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")


def rake(cells: DataFrame, targets: list[DataFrame], *, sweeps: int = 30, tolerance: float = 1e-4) -> DataFrame:
    """``cells`` with ``mass``: shares whose sums per margin value meet ``targets`` (value, share).

    ``targets[i]`` belongs to column ``m<i>``. Values without a target, or with target 0, get no mass;
    targets are scaled to the values that occur. Sweeps stop when no margin is off by more than
    ``tolerance`` in sum, or after ``sweeps`` (targets that no table with these empty cells can
    meet never settle; the last margin is then met and the others nearly so).
    """
    names = [f"m{i}" for i in range(len(targets))]
    held = []
    for name, target in zip(names, targets):
        known = target.select(F.coalesce("value", F.lit(NONE)).alias(name), F.col("share").cast("double").alias("share")).groupBy(name).agg(F.sum("share").alias("share"))
        known = known.join(cells.select(name).distinct(), name).filter("share > 0")
        known = materialise(known)
        total = known.agg(F.sum("share")).first()[0] or 1.0
        held.append(known.select(name, (F.col("share") / F.lit(total)).alias("share")))
    state = cells
    for name, target in zip(names, held):
        state = state.join(target.select(name), name, "left_semi")
    state = materialise(state.withColumn("mass", F.col("tokens")))
    for _ in range(sweeps):
        now, gaps = state, []
        for name, target in zip(names, held):
            sums = now.groupBy(name).agg(F.sum("mass").alias("was")).join(target, name)
            scale = materialise(sums.select(name, (F.col("share") / F.col("was")).alias("factor"), F.abs(F.col("share") - F.col("was")).alias("gap")))
            now = now.join(scale.select(name, "factor"), name).withColumn("mass", F.col("mass") * F.col("factor")).drop("factor")
            gaps.append(scale.agg(F.sum("gap").alias("gap")))
        state = materialise(now)
        worst = gaps[0]
        for gap in gaps[1:]:
            worst = worst.unionAll(gap)
        if (worst.agg(F.max("gap")).first()[0] or 0.0) <= tolerance:
            break
    return state


def mixing_probabilities(
    responses: DataFrame,
    *,
    margins: list[str],
    tokens: str,
    key: str = "request_id",
    targets: dict[str, DataFrame] | None = None,
    alpha: float = 0.5,
    keep: float | None = None,
    sweeps: int = 30,
    tolerance: float = 1e-4,
    seed: int = 7,
) -> DataFrame:
    """``responses`` with ``mix_weight``, ``mix_probability``, ``mix_kept`` and ``mix_copies``.

    ``mix_weight`` is the fitted share of a row's cell over its present share. That weight times a common
    rate is the expected number of copies; tokens times ``mix_copies`` meet the targets in expectation.
    ``keep`` is the rate: the copies hold this share of all tokens. Where a cell must grow by more
    than 1 / ``keep`` its rows come more than once: ``mix_copies`` is the whole part, and one more when a
    hash of the row's key and ``seed`` lies under the rest. By default the rate is the largest that
    repeats nothing. ``mix_probability`` is that of one copy or more (the expected number, at most 1),
    ``mix_kept`` says whether there is one. ``targets`` maps a margin to (value, share); margins
    without get their present shares to the power ``alpha``. Rows repeated under one key share their
    fate. Rows without tokens (null or not positive) have weight and probability 0; an empty table gives
    no row. Input columns of the four names are replaced.
    """
    made = ("mix_weight", "mix_probability", "mix_kept", "mix_copies")
    responses = responses.select(*(quoted(c) for c in responses.columns if c.lower() not in made))
    cells = materialise(cells_of(responses, margins, tokens))
    wanted = [(targets or {}).get(m) for m in margins]
    wanted = [tempered_targets(cells, f"m{i}", alpha) if t is None else t for i, t in enumerate(wanted)]
    fitted = rake(cells, wanted, sweeps=sweeps, tolerance=tolerance)
    mass, total = fitted.agg(F.sum("mass")).first()[0] or 0.0, cells.agg(F.sum("tokens")).first()[0] or 0.0
    weights = fitted.withColumn("w", (F.col("mass") / F.lit(mass or 1.0)) / (F.col("tokens") / F.lit(total or 1.0)))
    top = weights.agg(F.max("w")).first()[0] or 1.0
    rate = keep if keep is not None else 1.0 / top
    names = fresh(responses, *(f"cell_{i}" for i in range(len(margins))), "cell_w")
    weights = weights.select(*(F.col(f"m{i}").alias(n) for i, n in enumerate(names[:-1])), F.col("w").alias(names[-1]))
    on = None
    for m, n in zip(margins, names):
        same = F.coalesce(quoted(m).cast("string"), F.lit(NONE)) == F.col(n)
        on = same if on is None else on & same
    has_tokens = F.coalesce(quoted(tokens).cast("double") > 0, F.lit(False))
    weight = F.when(has_tokens, F.coalesce(F.col(names[-1]), F.lit(0.0))).otherwise(F.lit(0.0))
    # 53 bits of a hash of the key, as a number in [0, 1).
    draw = F.shiftrightunsigned(F.xxhash64(quoted(key).cast("string"), F.lit(seed)), 11) / F.lit(float(1 << 53))
    expected = F.col("mix_weight") * F.lit(rate)
    if keep is None:  # rounding must not repeat the rows of the largest weight
        expected = F.least(F.lit(1.0), expected)
    return (
        responses.join(weights, on, "left")
        .withColumn("mix_weight", weight)
        .withColumn("mix_probability", F.least(F.lit(1.0), expected))
        .withColumn("mix_kept", draw < F.col("mix_probability"))
        .withColumn("mix_copies", (F.floor(expected) + (draw < expected - F.floor(expected)).cast("long")).cast("long"))
        .drop(*names)
    )
