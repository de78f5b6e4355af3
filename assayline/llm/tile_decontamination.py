"""Benchmark decontamination of responses by greedy string tiling.

A response and a test item are compared as sequences of words. Seeds (runs of ``least`` words)
that both hold pick the pairs; then the longest common runs are marked one after the other, never
overlapping, until none of ``least`` words is left. The share of the item's words under tiles is
its coverage. As tiles may lie in any order, a passage with its sentences moved is still found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assayline.llm.common import Batches, quoted

WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)

COUNTS = pa.schema(
    [
        ("item_words", pa.int64()),
        ("covered_words", pa.int64()),
        ("tiles", pa.int64()),
        ("longest", pa.int64()),
        ("coverage", pa.float64()),
    ]
)
COUNTS_SQL = "item_words long, covered_words long, tiles long, longest long, coverage double"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def running_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` word numbers, modulo 2**64."""
    if len(ids) < size:
        return np.empty(0, dtype=np.uint64)
    values = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    # Doubling: hashes of 1, 2, 4, ... words, joined along the bits of ``size``.
    part, done, taken, n = values, None, 0, 1
    power = BASE
    while n <= size:
        if size & n:
            if done is None:
                done = part.copy()
            else:
                rest = part[taken : taken + len(part)]
                done = done[: len(rest)] * power + rest
            taken += n
        if 2 * n <= size:
            part = part[: len(part) - n] * power + part[n:]
            power = np.uint64(int(power) ** 2 % 2**64)
        n *= 2
    return done[: len(ids) - size + 1]


def greedy_tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in a, start in b, length) of two sequences of numbers.

    Each round finds the longest common runs of unmarked elements and marks them in order of their
    start in a, then in b, skipping those that a tile of the same round already touches. Elements
    under 0 match nothing. The length of a round is found by halving: running hashes propose equal
    windows, the elements confirm them.
    """
    free_a, free_b = a >= 0, b >= 0
    tiles = []
    top = min(len(a), len(b))
    while True:
        low, high, best = least, top, None
        while low <= high:
            size = (low + high) // 2
            matches = _Windows(a, b, free_a, free_b, size)
            if matches.any():
                best, low = matches, size + 1
            else:
                high = size - 1
        if best is None:
            return tiles
        top = low - 1
        tiles += best.mark(free_a, free_b)


class _Windows:
    """Windows of ``size`` unmarked elements of two sequences, those of b grouped by their hash."""

    def __init__(self, a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, size: int):
        self.a, self.b, self.size = a, b, size
        hashes = []
        for x, free in ((a, free_a), (b, free_b)):
            taken = np.concatenate([[0], np.cumsum(~free)])
            hashes.append((running_hashes(x, size), np.nonzero(taken[size:] == taken[:-size])[0]))
        (ha, at_a), (hb, at_b) = hashes
        self.order = at_b[np.argsort(hb[at_b], kind="stable")]
        keys = hb[self.order]
        left, right = np.searchsorted(keys, ha[at_a]), np.searchsorted(keys, ha[at_a], "right")
        some = left < right
        self.at, self.left, self.right = at_a[some].tolist(), left[some].tolist(), right[some].tolist()

    def equal(self, i: int, j: int) -> bool:
        return np.array_equal(self.a[i : i + self.size], self.b[j : j + self.size])

    def any(self) -> bool:
        """Whether a window of a occurs in b. Equal hashes are confirmed, in all but freak cases at the first try."""
        return any(self.equal(i, self.order[n]) for i, lo, hi in zip(self.at, self.left, self.right) for n in range(lo, hi))

    def mark(self, free_a: np.ndarray, free_b: np.ndarray) -> list[tuple[int, int, int]]:
        """Mark equal windows by start in a, then in b, and return them.

        All tiles of a round are of one size, so a touched window is touched at one of its ends, and stays
        touched: each group of equal windows of b is walked once, however often its words repeat.
        """
        size, tiles, reached = self.size, [], {}
        for i, lo, hi in zip(self.at, self.left, self.right):
            if not (free_a[i] and free_a[i + size - 1]):
                continue
            n = reached.get(lo, lo)
            while n < hi and not (free_b[self.order[n]] and free_b[self.order[n] + size - 1]):
                n += 1
            reached[lo] = n
            for m in range(n, hi):
                j = int(self.order[m])
                if free_b[j] and free_b[j + size - 1] and self.equal(i, j):
                    tiles.append((i, j, size))
                    free_a[i : i + size] = free_b[j : j + size] = False
                    break
        return tiles


class Items:
    """A block of test items: word numbers and the table of their seeds."""

    def __init__(self, rows: list[tuple], least: int):
        self.least, self.vocabulary, self.ids, self.words = least, {}, [], []
        for item_id, text in rows:
            words = words_of(text)
            self.ids.append(item_id)
            self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], dtype=np.int64))
        hashes = [running_hashes(w, self.least_of(w)) for w in self.words]
        self.sizes = sorted({self.least_of(w) for w in self.words if len(w)})
        # Items shorter than ``least`` are seeded, and matched, as a whole.
        self.seeds = {}
        for size in self.sizes:
            of = [(h, np.full(len(h), k), np.arange(len(h))) for k, (h, w) in enumerate(zip(hashes, self.words)) if len(w) and self.least_of(w) == size]
            h, item, at = (np.concatenate(x) for x in zip(*of))
            order = np.argsort(h, kind="stable")
            self.seeds[size] = (h[order], item[order], at[order])

    def least_of(self, words: np.ndarray) -> int:
        return max(1, min(self.least, len(words)))

    def compare(self, text: str | None, threshold: float) -> Iterator[dict]:
        ids = np.array([self.vocabulary.get(w, -1) for w in words_of(text)], dtype=np.int64)
        for size in self.sizes:
            keys, item, at = self.seeds[size]
            known = np.concatenate([[0], np.cumsum(ids < 0)])
            here = np.nonzero(known[size:] == known[:-size])[0] if len(ids) >= size else np.empty(0, dtype=np.int64)
            if not len(here):
                continue
            own = np.unique(running_hashes(ids, size)[here])
            hit = np.searchsorted(own, keys)
            shared = own[np.minimum(hit, len(own) - 1)] == keys
            of, where = item[shared], at[shared]
            by_item = np.argsort(of, kind="stable")
            met, first = np.unique(of[by_item], return_index=True)
            for k, starts in zip(met.tolist(), np.split(where[by_item], first[1:])):
                words = self.words[k]
                under = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(under, starts, 1)
                np.add.at(under, np.minimum(starts + size, len(words)), -1)
                # Words under shared seeds bound what tiles can cover.
                if np.count_nonzero(np.cumsum(under)[:-1]) < threshold * len(words):
                    continue
                tiles = greedy_tiles(words, ids, size)
                covered = sum(t[2] for t in tiles)
                if tiles and covered >= threshold * len(words):
                    yield {
                        "item_id": self.ids[k],
                        "item_words": len(words),
                        "covered_words": covered,
                        "tiles": len(tiles),
                        "longest": max(t[2] for t in tiles),
                        "coverage": covered / len(words),
                    }


def item_blocks(items: DataFrame, block_bytes: int, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The test items, ids of any type or null, in blocks of about ``block_bytes``, dealt by a hash of their id."""
    rows = items.select(quoted(item_id).alias("item_id"), quoted(text).cast("string").alias("text")).filter("text is not null").distinct()
    total = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        held = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        if held:
            yield sorted(((r["item_id"], r["text"]) for r in held), key=lambda r: (r[1], r[0] is not None, str(r[0])))


def contaminated(
    responses: DataFrame,
    items: DataFrame,
    *,
    key: str = "request_id",
    raw: str = "raw",
    item_id: str = "item_id",
    item_text: str = "text",
    least: int = 5,
    threshold: float = 0.5,
    block_bytes: int = 4_194_304,
) -> DataFrame:
    """(key, item_id, item_words, covered_words, tiles, longest, coverage) of pairs at or above ``threshold``.

    ``coverage`` is the share of the item's words under tiles of at least ``least`` words (an item of
    fewer words must occur whole). Words are runs of letters, digits and underscores in lower case.
    Null and wordless texts match nothing, rows repeated in ``responses`` give repeated pairs, equal
    items count once. Keys and item ids keep their types and may be null: an item without an id is found
    like any other. Responses are read once per block of items and never move: the items, one
    bounded block at a time, go to them.
    """
    spark, parts = responses.sparkSession, []
    rows = responses.select(quoted(key).alias(key), quoted(raw).cast("string").alias("raw"))
    key_type, id_type = rows.schema[key].dataType, items.schema[item_id].dataType
    schema = f"`{key}` {key_type.simpleString()}, item_id {id_type.simpleString()}, {COUNTS_SQL}"
    id_arrow = to_arrow_type(id_type)
    for block in item_blocks(items, block_bytes, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Batches, shared=shared) -> Batches:
            held = Items(shared.value, least)
            for batch in batches:
                at, found = [], []
                for n, text in enumerate(batch.column(1).to_pylist()):
                    for pair in held.compare(text, threshold):
                        at.append(n)
                        found.append(pair)
                if found:
                    ids = pa.array([pair.pop("item_id") for pair in found], id_arrow)
                    counts = pa.RecordBatch.from_pylist(found, schema=COUNTS)
                    names = [key, "item_id", *COUNTS.names]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), ids, *counts.columns], names=names)

        parts.append(rows.mapInArrow(scan, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result
