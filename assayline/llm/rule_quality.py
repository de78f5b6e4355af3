"""Quality of responses by a sparse ensemble of rules.

Trees over statistics of the text propose conjunctive rules (every path from a root is one), a lasso
logistic fit keeps and weighs a few of them, and these are compiled into one Spark column expression.
What accepts a response (an extracted block that passed its checks, a reviewer) is the label to learn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import fresh, quoted, whole_text
from assayline.session import materialise

# --- statistics -------------------------------------------------------------------------------

STATISTICS = (
    "n_chars",
    "n_words",
    "word_length",
    "letter_share",
    "upper_share",
    "digit_share",
    "space_share",
    "mark_share",
    "symbol_share",
    "short_word_share",
    "vocabulary_growth",
    "repeated_word_share",
    "line_words",
    "distinct_line_share",
)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def text_statistics(raw: str) -> Column:
    """A struct of doubles over the whole text; shares and the growth are 0 to 1, all are 0 for null and empty texts."""
    text = whole_text(raw)
    left = lambda t, drop: F.length(F.regexp_replace(t, drop, ""))
    share = lambda part, whole: part / F.greatest(whole, F.lit(1))
    count = lambda items, keep: F.size(F.filter(items, keep))

    def of_words(words: Column) -> Column:
        n = F.size(words)
        return F.struct(
            n.alias("n"),
            share(F.aggregate(words, F.lit(0).cast("long"), lambda sum_, w: sum_ + F.length(w)), n).alias("length"),
            share(count(words, lambda w: F.length(w) <= 3), n).alias("short"),
            # Logarithm of the distinct words over that of all: nearly the same for long and short texts.
            F.when(n > 1, F.log(F.size(F.array_distinct(words))) / F.log(n)).otherwise(n).alias("growth"),
            share(count(words, lambda w, i: w == F.get(words, i - 1)), n).alias("repeated"),
        )

    def of_lines(lines: Column) -> Column:
        n = F.size(lines)
        return F.struct(n.alias("n"), share(F.size(F.array_distinct(lines)), n).alias("distinct"))

    def of_text(t: Column) -> Column:
        return F.struct(
            F.length(t).alias("n"),
            (F.length(t) - left(t, r"\p{L}+")).alias("letters"),
            left(t, r"\P{Lu}+").alias("upper"),
            left(t, r"[^0-9]+").alias("digits"),
            (F.length(t) - left(t, r"\s+")).alias("spaces"),
            left(t, r"[^!?]+").alias("marks"),
            left(t, r"[\p{L}\p{N}\s.,;:!?'\"()-]+").alias("symbols"),
            bound(F.filter(F.split(t, r"\s+"), lambda w: w != ""), of_words).alias("w"),
            bound(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""), of_lines).alias("l"),
        )

    def named(s: Column) -> Column:
        n = s["n"]
        values = (
            n,
            s["w"]["n"],
            s["w"]["length"],
            share(s["letters"], n),
            share(s["upper"], s["letters"]),
            share(s["digits"], n),
            share(s["spaces"], n),
            share(s["marks"], n),
            share(s["symbols"], n),
            s["w"]["short"],
            s["w"]["growth"],
            s["w"]["repeated"],
            share(s["w"]["n"], s["l"]["n"]),
            s["l"]["distinct"],
        )
        return F.struct(*(v.cast("double").alias(name) for name, v in zip(STATISTICS, values)))

    return bound(bound(text, of_text), named)


# --- rules ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """All of ``low < statistic <= high``; an open end is None."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def within(self, name: str, low: float | None, high: float | None) -> Rule:
        """This rule and one bound more."""
        held = {n: (lo, hi) for n, lo, hi in self.bounds}
        lo, hi = held.get(name, (None, None))
        lo = low if lo is None else lo if low is None else max(lo, low)
        hi = high if hi is None else hi if high is None else min(hi, high)
        held[name] = (lo, hi)
        return Rule(tuple((n, *held[n]) for n in sorted(held)))

    def column(self, statistics: Column) -> Column:
        tests = [t for n, lo, hi in self.bounds for t in ([statistics[n] > lo] if lo is not None else []) + ([statistics[n] <= hi] if hi is not None else [])]
        whole = tests[0]
        for test in tests[1:]:
            whole = whole & test
        return whole

    def __str__(self) -> str:
        return " and ".join(f"{'' if lo is None else f'{lo:g} < '}{n}{'' if hi is None else f' <= {hi:g}'}" for n, lo, hi in self.bounds)


@dataclass
class Ensemble:
    """Weighted rules and an intercept on the logistic scale."""

    intercept: float = 0.0
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self, statistics: Column) -> Column:
        """The probability of label 1, as one column expression."""
        terms = [F.when(rule.column(statistics), F.lit(w)).otherwise(0.0) for rule, w in self.weights.items()]
        total = F.lit(self.intercept)
        if terms:
            total = F.aggregate(F.array(*terms), total, lambda sum_, term: sum_ + term)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def paths(node, names: tuple[str, ...], rule: Rule = Rule(())) -> Iterator[Rule]:
    """The rule of every node below the root of one of Spark's trees."""
    if node.subtreeDepth() == 0:
        return
    split = node.split()
    name, at = names[split.featureIndex()], split.threshold()
    for child, below in ((node.leftChild(), rule.within(name, None, at)), (node.rightChild(), rule.within(name, at, None))):
        yield below
        yield from paths(child, names, below)


def fit_rules(
    labelled: DataFrame,
    *,
    statistics: str = "statistics",
    label: str = "accepted",
    key: str = "request_id",
    fit_rows: int = 100_000,
    trees: int = 24,
    depth: int = 3,
    penalty: float = 0.001,
    seed: int = 7,
) -> Ensemble:
    """Rules and weights learned from rows with a ``label`` of 0 or 1 and a struct of ``statistics``.

    Of more than ``fit_rows`` labelled rows about that many are used, by a hash of their key. A random forest of ``trees``
    of ``depth`` proposes rules, logistic regression with an L1 penalty of ``penalty`` weighs them, both
    by Spark; only rules and weights reach the driver. Rows whose label is null or another value, or
    whose statistics are null, teach nothing; repeated rows count each time. If one label alone is
    there, or none, the ensemble has no rule and its score is that label's smoothed share.
    """
    rows = labelled.select(quoted(key).alias("key"), quoted(statistics).alias("s"), quoted(label).cast("double").alias("label"))
    rows = materialise(rows.filter("label IN (0, 1) AND s IS NOT NULL"))
    count = rows.count()
    if count > fit_rows:
        rows = materialise(rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < F.lit(int(fit_rows / count * (1 << 40)))))
    seen, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < seen:
        return Ensemble(math.log((ones + 1) / (seen - ones + 1)))
    names = tuple(rows.schema["s"].dataType.names)
    learned = materialise(rows.select("s", "label", array_to_vector(F.array(*(F.col(f"s.`{n}`").cast("double") for n in names))).alias("features")))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=seed).fit(learned)
    found = {rule: None for tree in forest.trees for rule in paths(tree._call_java("rootNode"), names)}
    rules = sorted(found, key=str)
    if not rules:
        return Ensemble(math.log((ones + 1) / (seen - ones + 1)))
    tests = materialise(learned.select("label", array_to_vector(F.array(*(r.column(F.col("s")).cast("double") for r in rules))).alias("features")))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=100).fit(tests)
    weights = dict(zip(rules, lasso.coefficients.toArray().tolist()))
    return Ensemble(float(lasso.intercept), {rule: w for rule, w in weights.items() if w})


def with_statistics(responses: DataFrame, *, raw: str = "raw") -> DataFrame:
    """``responses`` without ``raw``, with a struct ``statistics`` in its place; a column of that name is replaced."""
    kept = [quoted(c) for c in responses.columns if c.lower() not in (raw.lower(), "statistics")]
    return responses.select(*kept, text_statistics(raw).alias("statistics"))


def score_responses(judged: DataFrame, ensemble: Ensemble, *, statistics: str = "statistics", threshold: float = 0.3) -> DataFrame:
    """``judged`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``threshold`` on) in place of the statistics.

    Rows of null statistics score as if no rule held. Rows are scored one by one and none moves, so ties
    and repeated rows get equal answers. Columns of these names are replaced.
    """
    (name,) = fresh(judged, "rule_score")
    kept = [quoted(c) for c in judged.columns if c.lower() not in (statistics.lower(), "score", "predicted")]
    scored = judged.select(*kept, ensemble.score(quoted(statistics)).alias(name))
    return scored.select(*kept, F.col(name).alias("score"), (F.col(name) >= threshold).cast("int").alias("predicted"))
