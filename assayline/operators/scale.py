"""Helpers that keep one hot key from landing in one task.

``hot_keys``      names the keys that hold a large share of the rows,
``in_slices``     cuts the rows of every key into slices along its order,
``running_total`` sums along an order per key, slice by slice in large tables,
``possible``      drops rows that cannot meet a key before they are shuffled, and
``spread_join``   joins hot keys without shuffling them.

Sizing a table takes one count and, for hot keys of large tables, one sampled aggregate. It
steers the plan only: results are the same for any list of hot keys and any slice bounds.
Tables below the thresholds get the plain one-shuffle plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.session import materialise, shuffles_removed

# A key is hot above both limits, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 4000
HOT_MIN_ROWS = 4_000_000
SAMPLE_ROWS = 4_000_000
# Rows, and bytes of them as JSON, that may be broadcast for the hot keys; beyond either the
# shuffled join takes all keys.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 32 << 20
SAMPLE_SEED = 17
# Words of 64 bits in a key filter, at eight bits a key; more keys than fill them get no filter.
FILTER_WORDS = 2_000_000
KEYS_PER_WORD = 8

SLICE = "__slice"


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def _among(keys: Sequence[str], hashes: Sequence[int]) -> Column:
    names = ", ".join(f"`{k}`" for k in keys)
    return F.expr(f"xxhash64({names}) IN ({', '.join(map(str, hashes))})")


def hot_keys(
    df: DataFrame, keys: Sequence[str], min_rows: int | None = None, share: float | None = None
) -> list[int]:
    """Hashes of the keys with more than ``min_rows`` rows and more than ``share`` of all rows:
    at most ``1 / share`` of them."""
    least = HOT_MIN_ROWS if min_rows is None else min_rows
    part = HOT_SHARE if share is None else share
    rows = df.count()
    if rows <= least:
        return []
    rate = min(1.0, SAMPLE_ROWS / rows)
    slim = df.select(key_hash(keys).alias("h"))
    sample = slim if rate == 1.0 else slim.sample(rate, seed=SAMPLE_SEED)
    found = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(least, rows * part) * rate)
    # The least BIGINT has no literal; leaving that one key out only changes the plan.
    return sorted(r["h"] for r in found.collect() if r["h"] != -(2**63))


def largest_key(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the key that has most of them; counts merge before the shuffle, and only keys are read."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    with shuffles_removed(df.sparkSession):
        return counts.agg(F.max("__n")).first()[0] or 0


def evenly(df: DataFrame, rows_per_task: int = 500) -> DataFrame:
    """The rows dealt to all cores, for costly work on rows so slim that their file is read by one task.

    Up to four tasks a core, and more only where they would hold over 100,000 rows.
    """
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(-(-rows // rows_per_task), max(4 * cores, -(-rows // 100_000)))))


def in_slices(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_slice: int | None = None,
    rows: int | None = None,
    bound: DataFrame | None = None,
) -> DataFrame | None:
    """``df`` with a slice number that never decreases along ``order`` in a key; None where no key has
    more than ``rows_per_slice`` rows. A table of no more rows needs no look at its keys; else they are counted.

    Rows are dealt by ranges of the whole tuple of keys and order, whatever its types, to twice the
    number of slices that the rows ask for: bounds come from a sample, and slices may turn out
    uneven. A key of any size is cut wherever a bound falls into it. The result is written, so that
    every reader sees the same bounds. ``rows`` is a known upper bound that saves counting ``df``, and ``bound``
    a table with all its keys and no fewer rows of each, where that is cheaper to count by key.
    """
    per_slice = HOT_MIN_ROWS if rows_per_slice is None else rows_per_slice
    held = df.count() if rows is None else rows
    if held <= per_slice or largest_key(df if bound is None else bound, keys) <= per_slice:
        return None
    dealt = df.repartitionByRange(-(-2 * held // per_slice), *keys, *order)
    return materialise(dealt.withColumn(SLICE, F.spark_partition_id()))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    rows_per_slice: int | None = None,
    rows: int | None = None,
    highest: Sequence[str] = (),
    bound: DataFrame | None = None,
) -> DataFrame:
    """Add inclusive running sums per key along ``order`` (which must be unique per key); of the
    totals named in ``highest`` running maxima.

    In a large table each slice of a key is its own window, and a carry row brings in the sum of
    the slices before it, so no task holds more than one slice of a key.
    """
    fold = {n: F.max if n in highest else F.sum for n in totals}
    valued = df.select("*", *[c.alias(f"__v_{n}") for n, c in totals.items()])
    sliced = in_slices(valued, keys, order, rows_per_slice, rows, df if bound is None else bound)
    if sliced is None:
        window = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return valued.select(*df.columns, *[fold[n](f"__v_{n}").over(window).alias(n) for n in totals])

    before = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carry = (
        sliced.groupBy(*keys, SLICE)
        .agg(*[fold[n](f"__v_{n}").alias(f"__s_{n}") for n in totals])
        .select(*keys, SLICE, *[fold[n](f"__s_{n}").over(before).alias(f"__v_{n}") for n in totals])
        .filter(F.coalesce(*[F.col(f"__v_{n}") for n in totals]).isNotNull())
    )
    both = sliced.withColumn("__row", F.lit(1)).unionByName(
        carry.withColumn("__row", F.lit(0)), allowMissingColumns=True
    )
    window = W.partitionBy(*keys, SLICE).orderBy("__row", *order).rowsBetween(W.unboundedPreceding, 0)
    summed = both.select("*", *[fold[n](f"__v_{n}").over(window).alias(n) for n in totals])
    return summed.filter("__row = 1").select(*df.columns, *totals)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "line_no",
    rows_per_slice: int | None = None,
    rows: int | None = None,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Dense 1-based row numbers per key along a unique ``order``."""
    return running_total(df, keys, order, {name: F.lit(1).cast("bigint")}, rows_per_slice, rows, bound=bound)


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which a NULL key meets a NULL key."""
    other = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(other, match, how).drop(*[f"__r_{c}" for c in on])


def possible(big: DataFrame, wanted: DataFrame, on: Sequence[str], keys: int) -> DataFrame:
    """The rows of ``big`` whose key may be one of the ``keys`` keys of ``wanted``, unmoved.

    A Bloom filter in words of 64 bits, two bits a key, is aggregated from ``wanted`` and broadcast: about
    one foreign row in twenty passes, no wanted row is lost, and a NULL is a value like any other. Its size
    follows from ``keys``; where it would pass ``FILTER_WORDS`` (16 million keys), ``big`` comes back whole.
    The join that must follow gives the same result either way.
    """
    words = -(-keys // KEYS_PER_WORD)
    if words > FILTER_WORDS:
        return big
    code = key_hash(on)
    word = F.pmod(code, F.lit(max(1, words)).cast("long"))
    names = ", ".join(f"`{c}`" for c in on)
    one_bit = "shiftleft(1L, cast(shiftrightunsigned(xxhash64({0}), {1}) & 63 AS int))"
    bits = F.expr(" | ".join(one_bit.format(names, at) for at in (40, 52)))
    held = wanted.select(word.alias("__word"), bits.alias("__bits")).groupBy("__word").agg(F.bit_or("__bits").alias("__held"))
    met = big.withColumns({"__filter_word": word, "__filter_bits": bits}).join(F.broadcast(held), F.col("__filter_word") == F.col("__word"))
    return met.filter(F.col("__held").bitwiseAND(F.col("__filter_bits")) == F.col("__filter_bits")).select(*big.columns)


def spread_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    min_rows: int | None = None,
    share: float | None = None,
    hot: list[int] | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Join rows with a table of at most one row per key.

    Hot keys of ``big`` number at most ``1 / share``, so their rows of ``small`` are few. They are
    counted and then broadcast, so ``big`` is not shuffled for them; all other keys take the
    shuffled join, and so do the hot ones should ``small`` break its promise. ``hot`` takes
    the result of an earlier ``hot_keys`` on the same key columns.
    """
    def join(rows: DataFrame, values: DataFrame) -> DataFrame:
        return join_null_safe(rows, values, on, how) if null_safe else rows.join(values, list(on), how)

    if hot is None:
        hot = hot_keys(big, on, min_rows, share)
    if not hot:
        return join(big, small)
    is_hot = _among(on, hot)
    held = small.filter(is_hot)
    written = F.octet_length(F.to_json(F.struct(F.col("*"))))
    size = held.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(written).alias("b")).first()
    if size["n"] > BROADCAST_ROWS or (size["b"] or 0) > BROADCAST_BYTES:
        return join(big, small)
    spread = join(big.filter(is_hot), F.broadcast(held))
    return spread.unionByName(join(big.filter(~is_hot), small.filter(~is_hot)))
