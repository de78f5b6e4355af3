"""Exact top-k search by inner product: tiles of queries times shards of vectors.

The project keeps no vectors, so this operator is general: any table of (vec_id, embedding).
Vectors are packed into tiles (small matrices) and tiles are dealt to shards. Each shard meets every
block of queries once; a product keeps k scores per query, and these short lists are merged as a tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayline.llm.common import Batches, quoted, slices
from assayline.session import materialise

CODED = "vec_id long, small binary, wide array<double>"
TILE = "tile long, n int, width int, wide boolean, ids binary, matrix binary"
LIST = "query_id long, vec_id long, score long, node long"
EXACT = 2.0**53  # doubles add integers exactly below this
EXACT_SINGLE = 2.0**24  # and floats of four bytes below this
BLOCK = 512  # rows and columns of a product that is searched at once: it stays in a core's cache
FOLDED = 64  # BLOCK over a power of two


def usable(embedding: Column) -> Column:
    """Not null, and every component is a finite number."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(good, F.lit(False))


def code_vectors(batches: Batches) -> Batches:
    """(vec_id, embedding) to (vec_id, ``small`` or ``wide``), without vectors that hold a null, NaN or infinity.

    Whole numbers of 16 bits become bytes that compare as the components do; other vectors stay as they are.
    """

    def every(good: np.ndarray, ends: np.ndarray) -> np.ndarray:
        bad = np.concatenate([[0], np.cumsum(~good)])[ends - ends[0]]
        return bad[1:] == bad[:-1]

    for batch in batches:
        values = batch["embedding"].flatten().to_numpy(zero_copy_only=False)
        batch = batch.filter(pa.array(every(np.isfinite(values), batch["embedding"].offsets.to_numpy())))
        lists, rows = batch["embedding"], np.arange(batch.num_rows)
        values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        whole = (np.abs(values) < 2**15) & (values == np.rint(values))
        held, ends = every(whole, ends), (ends - ends[0]).astype(np.int64)
        data = np.where(whole, values + 2**15, 0).astype(">u2").tobytes()
        small = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(2 * ends), pa.py_buffer(data)])
        small = small.take(pa.array(rows, mask=~held)).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch["vec_id"], small, lists.take(pa.array(rows, mask=held))], names=["vec_id", "small", "wide"])


def decoded(small: bytes) -> np.ndarray:
    return (np.frombuffer(small, dtype=">u2").astype(np.int32) - 2**15).astype(np.int16)


def tiles_of(rows: pa.RecordBatch) -> list[dict]:
    """One tile of the ``small`` vectors and one of the others. An id with both kinds keeps the smaller vector.

    No ``wide`` vector is empty: an empty one is ``small``.
    """
    ids, small, wide = rows["vec_id"].to_numpy(), rows["small"].to_pylist(), rows["wide"].to_pylist()
    as_wide = np.array([bool(w) and (s is None or w < decoded(s).tolist()) for s, w in zip(small, wide)], dtype=bool)
    made = []
    for kind in (False, True):
        if len(at := np.flatnonzero(as_wide == kind)):
            held = [(wide if kind else small)[i] for i in at]
            values = np.concatenate(held) if kind else decoded(b"".join(held))
            lengths = np.array([len(x) for x in held]) // (1 if kind else 2)
            matrix = np.zeros((len(at), max(1, lengths.max())), dtype=np.float64 if kind else np.int16)
            matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = values
            made.append({"tile": int(ids[at].min()), "n": len(at), "width": matrix.shape[1], "wide": kind, "ids": ids[at].tobytes(), "matrix": matrix.tobytes()})
    return made


def pack_tiles(vectors: DataFrame, tile_rows: int) -> DataFrame:
    """Rows (vec_id, embedding) to tiles of ``tile_rows`` vectors at most, each id once, with its smallest vector.

    A tile is named by its smallest id. Small whole numbers, the usual case, move as two bytes each.
    """

    def pack(batches: Batches) -> Batches:
        for rows in slices(batches, tile_rows):
            yield pa.RecordBatch.from_pylist(tiles_of(rows), schema=TILE_ARROW)

    coded = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).mapInArrow(code_vectors, CODED)
    # Null lists are slow to hand over, empty ones are not.
    none = F.array().cast("array<double>")
    once = coded.groupBy("vec_id").agg(F.min("small").alias("small"), F.coalesce(F.min("wide"), none).alias("wide"))
    return materialise(once.mapInArrow(pack, TILE))


TILE_ARROW = pa.schema([("tile", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("wide", pa.bool_()), ("ids", pa.binary()), ("matrix", pa.binary())])
LIST_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("node", pa.int64())])


def largest(scores: np.ndarray, k: int) -> np.ndarray:
    """Marks the k largest of each row; of equal ones the first."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, dtype=bool)
    bar = np.partition(scores, -k, axis=1)[:, -k, None]
    above, level = scores > bar, scores == bar
    return above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))


def above_bar(scores: np.ndarray, bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all that can be among a row's k best: larger than its bar.

    The columns are folded in halves to their maxima first, so that few rows and columns are looked at
    where few exceed the bar; where many do, as in a first block, the k best of each row are enough.
    """
    folded = scores
    while folded.shape[1] > FOLDED:
        half = folded.shape[1] // 2
        folded = np.maximum(folded[:, :half], folded[:, half:])
    row, fold = np.divmod(np.flatnonzero(folded > bar[:, None]), FOLDED)
    if len(row) > 4 * k * len(scores):
        return np.nonzero(largest(scores, k) & (scores > bar[:, None]))
    seen, column = np.nonzero(scores.reshape(len(scores), -1, FOLDED)[row, :, fold] > bar[row, None])
    return row[seen], column * FOLDED + fold[seen]


def number_kind(q: np.ndarray, m: np.ndarray) -> type:
    """The fastest numbers whose products of these matrices are exact; a score past 64 bits has no defined value."""
    if q.dtype == m.dtype == np.int16:
        # No partial sum of a product is larger than the product of the lengths of both vectors.
        lengths = [np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64).max(initial=0)) for x in (q, m)]
        if lengths[0] * lengths[1] < EXACT_SINGLE:
            return np.float32
    most = [max(float(x.max(initial=0)), -float(x.min(initial=0))) for x in (q, m)]
    return np.float64 if most[0] * most[1] * m.shape[1] < EXACT else np.int64


def best_of_tile(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, vector, score) of one product; ``ids`` ascend, so ties keep the smaller id.

    Narrower vectors count as padded with zeros. A query never meets its own id. The product is made
    in blocks; after the first one only what exceeds a query's k-th score so far is looked at.
    """
    width = max(q.shape[1], m.shape[1])
    q, m = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (q, m))
    kind = number_kind(q, m)
    m = m.astype(kind)
    low = np.iinfo(kind).min if kind is np.int64 else -np.inf
    own = np.searchsorted(ids, q_ids)
    own[ids[np.minimum(own, len(ids) - 1)] != q_ids] = -1
    found = []
    for first in range(0, len(q), BLOCK):
        part, mine = q[first : first + BLOCK].astype(kind), own[first : first + BLOCK]
        best, places = np.full((len(part), k), low, dtype=kind), np.full((len(part), k), -1)
        scores = np.empty((len(part), BLOCK), dtype=kind)
        for at in range(0, len(m), BLOCK):
            some = m[at : at + BLOCK]
            np.matmul(part, some.T, out=scores[:, : len(some)])
            scores[:, len(some) :] = low
            has = np.flatnonzero((mine >= at) & (mine < at + BLOCK))
            scores[has, mine[has] - at] = low
            row, col = above_bar(scores, best[:, -1], k)
            if not len(row):
                continue
            # The lists so far and what is new, worst first within each row; the last k stay.
            touched = np.bincount(row, minlength=len(part)) > 0
            hit, index = np.flatnonzero(touched), np.cumsum(touched) - 1
            rows = np.concatenate([np.repeat(np.arange(len(hit)), k), index[row]])
            values = np.concatenate([best[hit].ravel(), scores[row, col]])
            where = np.concatenate([places[hit].ravel(), at + col])
            order = np.lexsort((-where, values, rows))
            kept = order[np.cumsum(np.bincount(rows))[:, None] - 1 - np.arange(k)]
            best[hit], places[hit] = values[kept], where[kept]
        row, col = np.nonzero(places >= 0)
        found.append((q_ids[first + row], ids[places[row, col]], best[row, col].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def matrix_of(tiles: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some tiles, ascending, and their vectors."""
    n, width, wide = (tiles[c].to_pylist() for c in ("n", "width", "wide"))
    ids = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.int64) for x in tiles["ids"]])
    matrix, at = np.zeros((len(ids), max(width)), dtype=np.float64 if any(wide) else np.int16), 0
    for rows, columns, real, x in zip(n, width, wide, tiles["matrix"]):
        matrix[at : at + rows, :columns] = np.frombuffer(x.as_buffer(), dtype=np.float64 if real else np.int16).reshape(rows, columns)
        at += rows
    order = np.argsort(ids)
    return ids[order], matrix[order]


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, tile_rows: int = 4096, fan_in: int = 16, group_bytes: int = 64 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): per query its ``k`` best vectors other than itself, all if fewer.

    Both tables hold (vec_id long, embedding array<double>) with integers as components; the score
    is their inner product, ties go to the smaller vec_id, ranks start at 1. Vectors that are null or
    hold a null, NaN or infinity take no part. A repeated vec_id counts once, with its smallest
    vector. Vectors of unequal length count as padded with zeros. Empty tables give no row.

    Tiles are dealt by a hash into shards and query blocks of about ``group_bytes`` of floats, into more
    shards where cores would be idle. Every shard meets every block (all rows against the stated queries),
    so a query tile is copied once per shard, a vector tile once per block, and not once per tile of the other
    side. A meeting is one group, bounded however large the tables. Lists of k are merged ``fan_in`` nodes at a time.
    """
    shards, asked = (
        pack_tiles(t.select(quoted("vec_id").cast("long").alias("vec_id"), quoted("embedding").cast("array<double>").alias("embedding")), tile_rows)
        for t in (vectors, queries)
    )

    def groups(tiles: DataFrame, least: int) -> int:
        """Into how many groups tiles are dealt: ``least`` or more for their bytes, at most one each."""
        size = F.sum(F.col("n").cast("long") * F.col("width") * F.when(F.col("wide"), 8).otherwise(4))
        total, number = tiles.agg(size, F.count(F.lit(1))).first()
        return max(1, -(-(total or 0) // group_bytes), min(number, least))

    n_shards, n_blocks = groups(shards, 4 * shards.sparkSession.sparkContext.defaultParallelism), groups(asked, 1)
    of = lambda n: F.pmod(F.xxhash64("tile"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    shards = shards.withColumn("block", every(n_blocks)).withColumn("meeting", of(n_shards) * n_blocks + F.col("block"))
    asked = asked.withColumn("node", every(n_shards)).withColumn("meeting", F.col("node") * n_blocks + of(n_blocks))

    def meet(key: tuple, shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            return LIST_ARROW.empty_table()
        q, v, s = best_of_tile(*matrix_of(block), *matrix_of(shard), k)
        return pa.Table.from_arrays([pa.array(q), pa.array(v), pa.array(s), pa.array(np.full(len(q), key[0].as_py() // n_blocks))], schema=LIST_ARROW)

    # More places than meetings, so that a hash seldom sends two to one place; of very many meetings some share one.
    tasks = min(4 * n_shards * n_blocks, 10_000)
    dealt = [t.select("meeting", "n", "width", "wide", "ids", "matrix").repartition(tasks, "meeting").groupBy("meeting") for t in (shards, asked)]
    lists = dealt[0].cogroup(dealt[1]).applyInArrow(meet, LIST)
    nodes = n_shards
    while True:
        nodes = -(-nodes // fan_in)
        lists = lists.withColumn("node", F.floor(F.col("node") / fan_in))
        best = Window.partitionBy("query_id", "node").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        if nodes <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
