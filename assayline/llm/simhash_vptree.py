"""Near-duplicate responses by SimHash, searched with vantage-point trees.

A fingerprint has 64 bits. Two that differ in at most ``radius`` bits differ in at most half as many
(rounded down) in one of their two halves, so each half has a tree of its own. A tree routes a
half by its Hamming distance to a vantage point: near ones to one side, the others to the other.
By the triangle inequality only halves whose distance lies within the bound of the border can
have a partner across it; they alone are also sent to the other side. The top of each tree deals
fingerprints to shards, the rest of it is built and searched inside a shard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayline.llm.common import Batches, quoted, slices
from assayline.session import materialise, scratch, shuffles_removed

NOT_WORD = re.compile(r"[\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
HALVES = (np.uint64(0), np.uint64(32))
LOW32 = np.uint64(0xFFFFFFFF)
SEED = 42


# --- fingerprints -----------------------------------------------------------------------------


def shingle_hashes(raw: str | None, size: int) -> np.ndarray:
    """XXH64 (UTF-8, seed 42) of every run of ``size`` words, repeats included; of all words if fewer."""
    words = [w.encode() for w in NOT_WORD.split((raw or "").translate(LOWER)) if w]
    if not words:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), dtype=np.uint64, count=len(starts))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; zero without hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[at : at + 65_536]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(responses: DataFrame, *, key: str = "request_id", raw: str = "raw", words: int = 3) -> DataFrame:
    """(key, fingerprint long): SimHash of the word shingles of each whole text; 0 without words.

    Words are separated by ASCII white space, A-Z in lower case; a null text has no words.
    """
    rows = responses.select(quoted(key).alias(key), quoted(raw).cast("string").alias("raw"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [majority(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
            prints = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=[key, "fingerprint"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, fingerprint long")


# --- trees ------------------------------------------------------------------------------------


def distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int64)


def choose(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """Vantage point and border (the median distance) of a node; None if no border parts the points."""
    for vantage in (points[0], ~points[0] & LOW32, points[len(points) // 2]):
        far = distance(points, vantage)
        border = int(np.median(far))
        inside = np.count_nonzero(far <= border)
        if inside == len(points):
            border, inside = border - 1, np.count_nonzero(far < border)
        if 0 < inside < len(points):
            return np.uint64(vantage), border
    return None


class Router:
    """The top of a tree: a heap of (vantage, border); leaves are shards."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.nodes: list[tuple | int] = []
        self.leaves = 0
        self._grow(np.unique(sample), shards)

    def _grow(self, points: np.ndarray, shards: int) -> int:
        at = len(self.nodes)
        border = choose(points) if shards > 1 and len(points) > 1 else None
        if border is None:
            self.nodes.append(self.leaves)
            self.leaves += 1
            return at
        self.nodes.append(())
        near = distance(points, border[0]) <= border[1]
        sides = self._grow(points[near], shards // 2), self._grow(points[~near], shards - shards // 2)
        self.nodes[at] = (*border, *sides)
        return at

    def route(self, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, positions of points it must see, which of them live there)."""
        stack = [(0, np.arange(len(points)), np.ones(len(points), dtype=bool))]
        while stack:
            at, held, home = stack.pop()
            node = self.nodes[at]
            if not isinstance(node, tuple):
                yield node, held, home
                continue
            vantage, border, inner, outer = node
            far = distance(points[held], vantage)
            near = far <= border
            for child, seen, own in ((inner, far <= border + reach, near), (outer, far > border - reach, ~near)):
                if seen.any():
                    stack.append((child, held[seen], home[seen] & own[seen]))


def search(points: np.ndarray, home: np.ndarray, reach: int, leaf: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays (a, b) of pairs of 32-bit points, one at home, that may be within ``reach``.

    A tree over all points with branches pruned by the triangle bound: every pair within
    ``reach`` meets in a leaf in which one of the two is at home. Pairs may repeat.
    """
    stack = [(np.arange(len(points)), home)]
    while stack:
        held, own = stack.pop()
        if not own.any():
            continue
        here = points[held]
        border = choose(here[own]) if np.count_nonzero(own) > leaf else None
        if border is None:
            yield held[own], held
            continue
        far = distance(here, border[0])
        near = far <= border[1]
        for seen, side in ((far <= border[1] + reach, near), (far > border[1] - reach, ~near)):
            stack.append((held[seen], (own & side)[seen]))


class Forest:
    """Union-find over positions."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[x]
            if np.array_equal(up, x):
                return x
            self.root[x] = self.root[up]
            x = self.root[x]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite a[i] with b[i] for all i."""
        while len(a):
            a, b = self.find(a), self.find(b)
            keep = a != b
            a, b = a[keep], b[keep]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))


PACKED = pa.schema([("shard", pa.int64()), ("prints", pa.binary()), ("home", pa.binary())])
EDGE = pa.schema([("view", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def spanning_links(prints: DataFrame, *, views: int = 1, radius: int = 3, shard_points: int = 32_768, sample_points: int = 16_384) -> DataFrame:
    """Edges (view, a, b), a > b, that join exactly the fingerprints linked by differences of at most ``radius`` bits.

    ``prints`` holds distinct (view int, fingerprint long), views from 0; only fingerprints of one view
    are compared. Not all pairs come out: each shard
    keeps a spanning forest of the links it finds, at most one edge per fingerprint it sees, and
    together these connect what all pairs would. The routers are fitted on a bounded sample of about
    ``sample_points`` by hash (none where one shard holds all); they steer the work only, results
    do not depend on them.
    """
    spark, reach = prints.sparkSession, radius // 2
    count = prints.count() // views
    shards = max(1, -(-count // shard_points))
    share = min(1.0, sample_points / max(count, 1)) if shards > 1 else 0.0
    drawn = prints.select("fingerprint").filter(F.pmod(F.xxhash64("fingerprint"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).limit(2 * sample_points)
    sample = np.sort(np.array([r[0] for r in drawn.collect()], dtype=np.int64)).view(np.uint64)
    routers = [Router((sample >> shift) & LOW32, shards) if len(sample) else Router(np.zeros(1, np.uint64), 1) for shift in HALVES]
    shared = spark.sparkContext.broadcast(routers)
    width = 2 * max(r.leaves for r in routers)

    def deal(batches: Batches) -> Batches:
        for batch in batches:
            view_of, prints_of = (batch.column(i).to_numpy() for i in range(2))
            for view in np.unique(view_of):
                points = prints_of[view_of == view].view(np.uint64)
                for half, (shift, router) in enumerate(zip(HALVES, shared.value)):
                    for shard, held, home in router.route((points >> shift) & LOW32, reach):
                        at = int(view) * width + 2 * shard + half
                        row = {"shard": at, "prints": points[held].tobytes(), "home": np.packbits(home).tobytes()}
                        yield pa.RecordBatch.from_pylist([row], schema=PACKED)

    def link(table: pa.Table) -> pa.Table:
        view, half = table["shard"][0].as_py() // width, table["shard"][0].as_py() % 2
        points = [np.frombuffer(x, dtype=np.uint64) for x in table["prints"].to_pylist()]
        home = np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(p)) for x, p in zip(table["home"].to_pylist(), points)])
        points = np.concatenate(points)
        order = np.argsort(points, kind="stable")
        points, home = points[order], home[order].astype(bool)
        forest = Forest(len(points))
        for own, seen in search((points >> HALVES[half]) & LOW32, home, reach):
            for at in range(0, len(own), 256):
                row, col = np.nonzero(np.bitwise_count(points[own[at : at + 256], None] ^ points[None, seen]) <= radius)
                a, b = own[at + row], seen[col]
                apart = a != b
                forest.join(a[apart], b[apart])
        every = np.arange(len(points))
        root = forest.find(every)
        linked = root != every
        ends = points.view(np.int64)
        a, b = ends[linked], ends[root[linked]]
        views_of = pa.array(np.full(len(a), view, dtype=np.int32))
        return pa.Table.from_arrays([views_of, pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], schema=EDGE)

    dealt = prints.select("view", "fingerprint").mapInArrow(deal, "shard long, prints binary, home binary")
    return dealt.repartition(views * width, "shard").groupBy("shard").applyInArrow(link, "view int, a long, b long").distinct()


# --- components -------------------------------------------------------------------------------


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b).

    Large-star and small-star steps: neighbours above a node move to its smallest neighbour, then a node and
    those below it. Stars settle after about the logarithm of the size; each round is written.
    """
    star = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    for _ in range(rounds):
        both = star.unionAll(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = materialise(large)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        moved = small.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(low.select("a", F.col("low").alias("b")))
        star = materialise(moved.filter("a <> b").distinct())
        now = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    low = star.groupBy("a").agg(F.min("b").alias("root"))
    return low.select(F.col("a").alias("node"), "root").unionAll(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicate_classes(prints: DataFrame, *, key: str = "request_id", radius: int = 3) -> DataFrame:
    """(key, fingerprint, component_id): the smallest key reachable over fingerprints within ``radius`` bits.

    ``prints`` holds (key, fingerprint). Equal fingerprints are one node, so groups of copies of any size
    are merged before the search; text-free rows keep a fingerprint of zero, linked like any other. A null key counts in
    no minimum; a component of null keys alone has a null id. Repeated rows give repeated rows.
    """
    rows = materialise(prints.select(quoted(key).alias(key), "fingerprint"))
    nodes = materialise(rows.groupBy("fingerprint").agg(F.min(key).alias("least")))
    links = spanning_links(nodes.select(F.lit(0).alias("view"), "fingerprint"), radius=radius)
    roots = components(links).withColumnRenamed("node", "fingerprint")
    tied = nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    ids = materialise(tied.groupBy("root").agg(F.min("least").alias("component_id")))
    named = materialise(tied.select("fingerprint", "root").join(ids, "root").select("fingerprint", "component_id"))
    return rows.join(named, "fingerprint").select(key, "fingerprint", "component_id")


# --- near-duplicates by similarity ------------------------------------------------------------

SKETCH = pa.schema(
    [
        ("same", pa.binary()),
        ("size", pa.int32()),
        ("wide", pa.binary()),
        ("prints", pa.list_(pa.int64())),
        ("parts", pa.list_(pa.struct([("size", pa.int32()), ("parity", pa.binary()), ("rare", pa.list_(pa.int64())), ("known", pa.list_(pa.int64()))]))),
    ]
)
HELD = pa.schema([("id", pa.int64()), ("raw", pa.string())])
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
BROADCAST_KEYS = 1_000_000  # of 24 bytes each
PARITY_BITS = 512
PART_SHINGLES = 640  # a parity sketch of so many tells sets apart; of over a thousand it is full
SLACK = 1e-6


def sample_prints(hashes: np.ndarray, views: int, sample: int) -> list[int]:
    """A SimHash per view, of the ``sample`` shingles that come first in the view's own order."""
    found = []
    for view in range(views):
        # splitmix64 from a start of the view's own: no two orders are tied to each other.
        mixed = hashes + np.uint64(0x9E3779B97F4A7C15 * (view + 1) % 2**64)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        first = hashes if len(hashes) <= sample else hashes[np.argpartition(mixed, sample - 1)[:sample]]
        found.append(majority(first))
    return found


def parity_sketch(hashes: np.ndarray) -> bytes:
    """Per bucket of hashes whether it holds an odd number: two sketches differ in no more bits than the sets in members."""
    counts = np.bincount((hashes % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def wide_parity(hashes: np.ndarray) -> bytes:
    """A parity sketch with a bucket for each shingle or more, a power of two: it tells large sets apart too."""
    buckets = max(PARITY_BITS, 1 << max(0, len(hashes) - 1).bit_length())
    counts = np.bincount((hashes % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def apart_at_least(x: bytes, y: bytes) -> int:
    """A lower bound on the members that two sets do not share; the wider sketch is folded to the other's width."""
    a, b = (np.frombuffer(s, dtype=np.uint8) for s in (x, y))
    width = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(s.reshape(-1, width), axis=0) for s in (a, b))
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """So many of the first shingles, rarest first, that two sets of ``similarity`` or more share one of them.

    ``common`` holds the shingles known to be frequent, sorted, with their ``counts``; others count as 0.
    Those not known to be frequent come first, the known ones second.
    """
    size = len(hashes)
    known, rank = np.zeros(size, dtype=bool), np.zeros(size, dtype=np.int64)
    if size and len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        known = common[at] == hashes
        rank = np.where(known, counts[at], 0)
    first = np.lexsort((hashes, rank))[: size - int(np.ceil(similarity * size - SLACK)) + 1 if size else 0]
    return hashes[first[~known[first]]], hashes[first[known[first]]]


def level(size: int) -> int:
    """So many halvings bring ``size`` shingles down to ``PART_SHINGLES`` a part."""
    return (max(0, size - 1) // PART_SHINGLES).bit_length()


def set_parts(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> list[dict]:
    """The set cut by hash into 2 ** level parts, each with size, parity and ``prefix``.

    Members not shared add up over the parts, and so does what ``similarity`` allows of them: two sets that are as
    similar have a part in which they are, too. A set is cut at its own level and at that of the smallest set it may
    match; tokens bear the level, so only parts of one level meet.
    """
    found = []
    for k in range(level(int(np.ceil(similarity * len(hashes) - SLACK))), level(len(hashes)) + 1):
        slot, mark = (hashes >> np.uint64(32)) & np.uint64((1 << k) - 1), np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
        order = np.argsort(slot, kind="stable")
        for part in np.split(hashes[order], np.searchsorted(slot[order], np.arange(1, 1 << k, dtype=np.uint64))):
            if len(part):
                rare, known = ((p ^ mark).view(np.int64) for p in prefix(part, common, counts, similarity))
                found.append({"size": len(part), "parity": parity_sketch(part), "rare": rare, "known": known})
    return found


def close_pairs(table: pa.Table, similarity: float, nearest: bool) -> pa.Table:
    """Pairs of different components in the cells of ``table`` whose parts have sizes and parities that leave ``similarity`` possible.

    With ``nearest``, of a member's pairs with one other component only the one with the closest parities.
    ``prev`` is the token listed before this one for the part (the token itself if it is the first): two parts with the
    same one before have met there, so a pair comes out where a run of common tokens begins.
    """
    token, prev, i, j, block, ids, comp, size = (table[c].to_numpy() for c in ("token", "prev", "i", "j", "block", "id", "comp", "size"))
    parity = np.frombuffer(b"".join(table["parity"].to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
    order = np.lexsort((ids, j, i, token))
    cuts = np.nonzero((np.diff(token[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0))[0] + 1
    bound, found = (1 - similarity) / (1 + similarity), set()
    for cell in np.split(order, cuts):
        left, right = cell[block[cell] == i[cell]], cell[block[cell] == j[cell]]
        for at in range(0, len(left), 128):
            x, y = left[at : at + 128, None], right[None, :]
            new = (comp[x] != comp[y]) & ((prev[x] != prev[y]) | (prev[x] == token[x]))
            row, col = np.nonzero(new & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - SLACK))
            row, col = left[at + row], right[col]
            for start in range(0, len(row), 262_144):
                x, y = row[start : start + 262_144], col[start : start + 262_144]
                apart = np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int64)
                near = apart <= bound * (size[x].astype(np.int64) + size[y]) + SLACK
                x, y, apart = x[near], y[near], apart[near]
                if nearest:
                    first = np.lexsort((ids[y], apart, comp[y], ids[x]))
                    x, y = x[first], y[first]
                    new = np.ones(len(x), dtype=bool)
                    new[1:] = (np.diff(ids[x]) != 0) | (np.diff(comp[y]) != 0)
                    x, y = x[new], y[new]
                found.update(zip(np.maximum(ids[x], ids[y]).tolist(), np.minimum(ids[x], ids[y]).tolist()))
    a, b = zip(*found) if found else ((), ())
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=PAIR)


def near_duplicates(
    responses: DataFrame,
    *,
    key: str = "request_id",
    raw: str = "raw",
    words: int = 5,
    similarity: float = 0.8,
    views: int = 8,
    sample: int = 3,
    radius: int = 3,
    sample_texts: int = 8_000,
    common_shingles: int = 500_000,
    block_texts: int = 2_048,
) -> DataFrame:
    """(key, component_id) per response: the smallest key among it and its near copies, theirs included.

    Two texts are near copies if their sets of ``words``-word shingles have a Jaccard similarity of
    ``similarity`` or more. All such pairs count. Two steps find them:

    - Most are joined cheaply. Each text has ``views`` fingerprints, each over the ``sample`` shingles that
      come first in an order of its own. Within a group of one fingerprint every text is compared with
      one text, another one in every view.
    - The rest by an exact join. Long sets are cut by hash into parts of some hundred shingles; two near copies are as
      similar in one part at least. Of each part the rarest shingles are listed, so many that two near copies share
      one of them (prefix filter). Texts listed under one shingle that are of different components so far
      meet, unless sizes or parities of these parts rule the similarity out: first each
      with the nearest of every other component, then, in the components as they are by then, all.

    Pairs that wide parity sketches leave possible are confirmed by the whole shingle sets. What is frequent is learned from about ``sample_texts``
    texts by hash, at most ``common_shingles`` shingles; it steers the work only. A long list is dealt in blocks
    of about ``block_texts``; its largest component does not meet itself. Equal sets are one node, so copies are
    merged before the search. Texts that share rare shingles and stay apart do meet in pairs: the work then
    grows with the square of such a list, the rows only with the pairs left possible.
    Keys may be of any type that has an order, which decides what is smaller; inside, rows bear numbers. Rows
    repeated under one key are one document (the one of the smallest digest); null keys
    take no part. Wordless texts count as copies of each other. The result is written, and all tables before it removed.
    """
    with scratch(responses.sparkSession) as keep:
        return keep(
            _near_duplicates(
                responses, key, raw, words, similarity, views, sample, radius, sample_texts, common_shingles, block_texts
            )
        )


def _near_duplicates(
    responses: DataFrame,
    key: str,
    raw: str,
    words: int,
    similarity: float,
    views: int,
    sample: int,
    radius: int,
    sample_texts: int,
    common_shingles: int,
    block_texts: int,
) -> DataFrame:
    spark = responses.sparkSession
    rows = responses.select(quoted(key).alias("key"), quoted(raw).cast("string").alias("raw")).filter("key IS NOT NULL")
    shingles = lambda t: np.unique(shingle_hashes(t, words))
    digest = lambda s: xxhash.xxh128_digest(s.tobytes())

    # What is frequent, from a bounded sample of the texts. Copies in it only make shingles seem more frequent.
    def tokens(batches: Batches) -> Batches:
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], names=["token"])

    share = min(1.0, sample_texts / max(rows.count(), 1))
    drawn = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).select("raw")
    with shuffles_removed(spark):
        counted = drawn.mapInArrow(tokens, "token long").groupBy("token").agg(F.count("*").alias("n"))
        often = counted.filter("n > 1").orderBy(F.desc("n"), "token").limit(common_shingles).toPandas()
    often_tokens = often["token"].to_numpy(dtype=np.int64).view(np.uint64)
    sort = np.argsort(often_tokens)
    shared = spark.sparkContext.broadcast((often_tokens[sort], often["n"].to_numpy(dtype=np.int64)[sort]))

    def sketch(batches: Batches) -> Batches:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            prints = [np.array(sample_prints(s, views, sample), dtype=np.uint64).view(np.int64) for s in sets]
            parts = [set_parts(s, *shared.value, similarity) for s in sets]
            columns = [[f(s) for s in sets] for f in (digest, len, wide_parity)] + [prints, parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, SKETCH))], names=["key", *SKETCH.names])

    of_key = rows.schema["key"].dataType.simpleString()
    of_part = "struct<size: int, parity: binary, rare: array<long>, known: array<long>>"
    fields = f"key {of_key}, same binary, size int, wide binary, prints array<long>, parts array<{of_part}>"
    sketched = materialise(rows.mapInArrow(sketch, fields).withColumn("row", F.monotonically_increasing_id()))
    slim = ("row", "same", "size", "wide", "prints")
    texts = materialise(sketched.groupBy("key").agg(F.min_by(F.struct(*slim), F.struct("same", "row")).alias("s")).select("key", "s.*"))
    classes = texts.groupBy("same").agg(F.min_by(F.struct("key", "row", "size", "wide", "prints"), "key").alias("s"))
    classes = materialise(classes.select("same", "s.key", F.col("s.row").alias("first"), "s.size", "s.wide", "s.prints"))
    members = materialise(classes.select("first", F.posexplode("prints").alias("view", "fingerprint")))
    order = F.xxhash64("first", "view")
    # One text per fingerprint and view, by a hash that differs from view to view.
    heads = materialise(members.groupBy("view", "fingerprint").agg(F.min_by("first", order).alias("head"), F.count("*").alias("n")))
    within = members.join(heads.filter("n > 1").select("view", "fingerprint", "head"), ["view", "fingerprint"]).select(F.col("first").alias("a"), F.col("head").alias("b"))
    links = materialise(spanning_links(heads.select("view", "fingerprint"), views=views, radius=radius))
    ends = heads.select("view", "fingerprint", "head")
    across = links.join(ends.withColumnsRenamed({"fingerprint": "a", "head": "x"}), ["view", "a"]).join(ends.withColumnsRenamed({"fingerprint": "b", "head": "y"}), ["view", "b"])
    pairs = within.unionAll(across.select(F.col("x").alias("a"), F.col("y").alias("b"))).filter("a <> b")

    def chosen_texts(batches: Batches) -> Batches:
        for batch in slices(batches):
            # Another text may stand under the same key.
            good = [digest(shingles(t)) == same for t, same in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=HELD.names).filter(pa.array(good, pa.bool_()))

    def verify(batches: Batches) -> Batches:
        for batch in slices(batches):
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = shingles(x), shingles(y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    def possible(batches: Batches) -> Batches:
        for batch in batches:
            sizes = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            apart = np.array([apart_at_least(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())])
            good = apart <= (1 - similarity) / (1 + similarity) * sizes + SLACK
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        for end in "ab":
            pairs = pairs.join(classes.select(F.col("first").alias(end), F.col("size").alias(f"size_{end}"), F.col("wide").alias(f"wide_{end}")), end)
        pairs = materialise(pairs.select("a", "b", "size_a", "size_b", "wide_a", "wide_b").mapInArrow(possible, "a long, b long"))
        wanted = pairs.select(F.col("a").alias("first")).unionAll(pairs.select(F.col("b").alias("first"))).distinct()
        chosen = materialise(classes.join(wanted, "first", "left_semi").select("key", "first", "same"))
        # Few keys go to the texts; beyond a bound both sides are shuffled.
        near = F.broadcast(chosen) if chosen.count() <= BROADCAST_KEYS else chosen
        held = rows.join(near, "key").select(F.col("first").alias("id"), "raw", "same").mapInArrow(chosen_texts, "id long, raw string")
        held = materialise(held.groupBy("id").agg(F.min("raw").alias("raw")))
        both = pairs.join(held.withColumnsRenamed({"id": "a", "raw": "x"}), "a").join(held.withColumnsRenamed({"id": "b", "raw": "y"}), "b")
        return materialise(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"))

    def tied(edges: DataFrame) -> DataFrame:
        """(same, key, first, comp): every class with the smallest one it is tied to."""
        roots = materialise(components(edges))
        named = classes.select("same", "key", "first").join(roots.withColumnsRenamed({"node": "first", "root": "least"}), "first", "left")
        return materialise(named.select("same", "key", "first", F.coalesce("least", "first").alias("comp")))

    edges = confirmed(pairs)
    named = tied(edges)

    # Shingles not known to be frequent are counted, all in one exchange; those that one class alone lists can
    # tie nothing. Known ones stay without being counted, so no hot one meets in one place.
    entry = lambda known: lambda token: F.struct(token.alias("token"), F.lit(known).alias("known"))
    lists = F.concat(F.transform("rare", entry(False)), F.transform("known", entry(True)))
    of_classes = sketched.join(classes.select(F.col("first").alias("row")), "row", "left_semi")
    parts = of_classes.select(F.col("row").alias("id"), F.posexplode("parts").alias("part", "p")).select("id", "part", "p.*")
    listed = parts.select("id", "part", F.explode(lists).alias("t"))
    alone = Window.partitionBy("token", F.when(F.col("known"), F.col("id")))
    postings = listed.select("t.token", "t.known", "id", "part").withColumn("n", F.count("*").over(alone))
    before = F.lag("token").over(Window.partitionBy("id", "part").orderBy("token"))
    postings = postings.filter("known OR n > 1").select("token", "id", "part")
    postings = materialise(postings.withColumn("prev", F.coalesce(before, "token")))
    parts = materialise(parts.select("id", "part", "size", "parity"))

    def meeting(nearest: bool):
        return lambda table: close_pairs(table, similarity, nearest)

    # A list's minor components in blocks from 0, its largest in blocks after these.
    cells = """
        flatten(array(
            transform(sequence(0, least(block, minors - 1)), x -> struct(x AS i, block AS j)),
            CASE WHEN block < minors AND block < blocks - 1
                 THEN transform(sequence(block + 1, blocks - 1), x -> struct(block AS i, x AS j))
                 ELSE cast(array() AS array<struct<i: int, j: int>>) END))
    """
    for nearest in (True, False):
        of = postings.join(parts.join(named.select(F.col("first").alias("id"), "comp"), "id"), ["id", "part"])
        sizes = of.groupBy("token", "comp").agg(F.count("*").alias("n"))
        lists = sizes.groupBy("token").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.max("n").alias("most"), F.sum("n").alias("n")).filter("n > most")
        lists = materialise(lists.withColumns({"minors": F.ceil((F.col("n") - F.col("most")) / block_texts).cast("int"), "majors": F.ceil(F.col("most") / block_texts).cast("int")}))
        if lists.isEmpty():
            break
        spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        block = F.when(F.col("comp") == F.col("major"), F.col("minors") + spread("majors")).otherwise(spread("minors"))
        dealt = of.join(lists, "token").withColumns({"block": block, "blocks": F.col("minors") + F.col("majors")})
        dealt = dealt.select("token", "prev", "n", "block", "id", "comp", "size", "parity", F.explode(F.expr(cells)).alias("cell")).select("*", "cell.*")
        # Short lists share groups of about a block.
        groups = max(1, lists.filter(F.col("n") <= block_texts).agg(F.sum("n")).first()[0] or 0) // block_texts + 1
        dealt = dealt.withColumn("cell", F.when(F.col("n") <= block_texts, F.pmod(F.xxhash64("token"), F.lit(groups))).otherwise(F.xxhash64("token", "i", "j")))
        pairs = dealt.groupBy("cell").applyInArrow(meeting(nearest), "a long, b long")
        edges = edges.unionAll(confirmed(pairs))
        named = tied(edges)
    least = named.groupBy("comp").agg(F.min("key").alias("component_id"))
    ids = materialise(named.select("same", "comp").join(least, "comp").select("same", "component_id"))
    return texts.select("key", "same").join(ids, "same").select(F.col("key").alias(key), "component_id")


def hexadecimal(fingerprint: str = "fingerprint"):
    """16 lowercase hex digits of the unsigned value."""
    return F.lpad(F.lower(F.hex(F.col(fingerprint))), 16, "0")
