"""Hard negatives by a vertical scan of vectors, pruned dimension by dimension.

The project keeps no vectors, so this operator is general: any table of (vec_id, label, embedding).
A shard holds its vectors by columns. An anchor reads the columns in the order of its own magnitudes,
the largest first. After each few columns every candidate has a partial score, and the least and
most that the unread columns can still add bound its final one. Candidates whose bounds miss all
that is wanted leave the bitmap; those that stay to the end have exact scores.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayline.llm.common import Batches, quoted
from assayline.llm.topk_search import EXACT, usable
from assayline.session import materialise

STEP = 8  # columns read between two looks at the bounds

SHARD = "shard long, n int, width int, ids binary, names array<string>, codes binary, columns binary"
SHARD_ARROW = pa.schema(
    [
        ("shard", pa.int64()),
        ("n", pa.int32()),
        ("width", pa.int32()),
        ("ids", pa.binary()),
        ("names", pa.list_(pa.string())),
        ("codes", pa.binary()),
        ("columns", pa.binary()),
    ]
)
FOUND = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")])

Narrow = Callable[[np.ndarray, np.ndarray], np.ndarray | None]


class Shard:
    """Vectors by columns, ids ascending, labels as codes."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.codes = np.frombuffer(row["codes"], dtype=np.int32)
        self.code_of = {name: i for i, name in enumerate(row["names"])}
        self.columns = np.frombuffer(row["columns"]).reshape(row["width"], row["n"])
        self.least, self.most = self.columns.min(axis=1, initial=0), self.columns.max(axis=1, initial=0)

    def scan(self, anchor: list[float], bitmap: np.ndarray, narrow: Narrow) -> tuple[np.ndarray, np.ndarray]:
        """(ids, exact scores) of the candidates of ``bitmap`` that ``narrow`` leaves.

        ``narrow`` gets the bounds of all candidates left and returns which of them stay, or None for
        all. Vectors of other widths count as padded with zeros.
        """
        width = min(len(anchor), len(self.columns))
        a, columns, least, most = np.asarray(anchor[:width], dtype=np.float64), self.columns[:width], self.least[:width], self.most[:width]
        if np.abs(a).max(initial=0) * max(-least.min(initial=0), most.max(initial=0)) * width >= EXACT:
            # Beyond exact doubles; a score past 64 bits has no defined value.
            a, columns, least, most = (x.astype(np.int64) for x in (a, columns, least, most))
        order = np.argsort(-np.abs(a), kind="stable")[: np.count_nonzero(a)]
        ends = np.sort(np.stack([a * least, a * most])[:, order], axis=0)
        # What the columns from each place on can add.
        rest = np.concatenate([np.cumsum(ends[:, ::-1], axis=1)[:, ::-1], np.zeros((2, 1), ends.dtype)], axis=1)
        alive = np.flatnonzero(bitmap)
        partial = np.zeros(len(alive), dtype=a.dtype)
        for at in range(0, len(order), STEP):
            read = order[at : at + STEP]
            if 2 * len(alive) > len(bitmap):
                partial = partial + (a[read] @ columns[read])[alive]
            else:
                partial = partial + a[read] @ columns[np.ix_(read, alive)]
            left = min(at + STEP, len(order))
            stay = narrow(partial + rest[0, left], partial + rest[1, left])
            if stay is not None:
                alive, partial = alive[stay], partial[stay]
            if not len(alive):
                break
        return self.ids[alive], partial.astype(np.int64)


def kth_largest(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k]


def first_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def nearest(shard: Shard, anchor: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best other vectors of the anchor's label."""

    def narrow(low: np.ndarray, high: np.ndarray) -> np.ndarray | None:
        return high >= kth_largest(low, k) if len(low) > k else None

    same = (shard.codes == shard.code_of.get(anchor["label"], -1)) & (shard.ids != anchor["vec_id"])
    ids, scores = shard.scan(anchor["embedding"], same, narrow)
    best = first_of(ids, scores, k)
    return ids[best], scores[best]


def in_windows(shard: Shard, anchor: dict, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per window (lowest, highest score) the k best vectors of other labels inside it."""
    open_windows = {w for w in windows if w[0] <= w[1]}

    def narrow(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), dtype=bool)
        for floor, top in open_windows:
            below = low[high <= top]  # surely not above the window
            bar = max(floor, kth_largest(below, k)) if len(below) >= k else floor
            stay |= (high >= bar) & (low <= top)
        return stay

    others = shard.codes != shard.code_of.get(anchor["label"], -1)
    ids, scores = shard.scan(anchor["embedding"], others & bool(open_windows), narrow)
    found = []
    for floor, top in windows:
        held = np.flatnonzero((scores >= floor) & (scores <= top))
        best = held[first_of(ids[held], scores[held], k)]
        found.append((ids[best], scores[best]))
    return found


def by_columns(vectors: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """Rows (vec_id, label, embedding) to shards of about ``shard_rows``, dealt by a hash of the id; their number."""
    shards = max(1, -(-vectors.count() // shard_rows))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        lists = table["embedding"].combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        matrix = np.zeros((len(lengths), lengths.max()), dtype=np.float64)
        matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
        labels = table["label"].combine_chunks().dictionary_encode()
        row = {
            "shard": table["shard"][0].as_py(),
            "n": len(lengths),
            "width": matrix.shape[1],
            "ids": table["vec_id"].to_numpy().astype(np.int64).tobytes(),
            "names": labels.dictionary.to_pylist(),
            "codes": labels.indices.to_numpy().astype(np.int32).tobytes(),
            "columns": np.ascontiguousarray(matrix.T).tobytes(),
        }
        return pa.Table.from_pylist([row], schema=SHARD_ARROW)

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    return materialise(dealt.groupBy("shard").applyInArrow(pack, SHARD)), shards


def meet(shards: DataFrame, number: int, anchors: DataFrame, anchor_rows: int, look: Callable[[Shard, dict], list[tuple]]) -> DataFrame:
    """What ``look`` finds for every anchor in every shard. Anchors travel to the shards in tiles."""
    tiles = max(1, -(-anchors.count() // anchor_rows))
    fields = F.struct(*(c for c in anchors.columns))
    tiled = anchors.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).alias("tile")).agg(F.collect_list(fields).alias("anchors"))
    copies = tiled.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(number - 1)).cast("array<long>")))
    pairs = shards.repartition(number, "shard").join(copies.repartition(number, "shard"), "shard")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                shard, found = Shard(row), []
                for anchor in row["anchors"]:
                    found += look(shard, anchor)
                columns = zip(*found) if found else ([] for _ in FOUND)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=FOUND)

    return pairs.select(*shards.columns, "anchors").mapInArrow(run, ", ".join(f"{f.name} long" for f in FOUND))


def mine_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    *,
    positives: int = 5,
    negatives: int = 10,
    least_share: int = 30,
    most_share: int = 90,
    shard_rows: int = 8_192,
    anchor_rows: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both tables hold (vec_id long, label, embedding array<double>) with integers as components; a score is
    the integer inner product with the anchor, higher ones come first, ties by the smaller vec_id. An
    anchor's positives are its first ``positives`` other vectors of its label. For each of them come the
    first ``negatives`` vectors of other labels that score ``least_share`` to ``most_share`` hundredths
    of the positive, ranked from 1; fewer if there are fewer, so a positive of negative score has none.

    Labels are compared as text. Rows with a null vec_id, label or vector, or a null, NaN or infinity
    in it, take no part. A repeated vec_id counts once, with its smallest (label, vector). Vectors of unequal
    length count as padded with zeros. Other columns are ignored; empty tables give no row.

    Every shard meets the stated anchors once for the positives and once for the windows, and hands
    on the best few per anchor; these are ranked over all shards. No label or source is a key of any
    exchange, so a hot label changes nothing.
    """

    def once(table: DataFrame) -> DataFrame:
        rows = table.select(
            quoted("vec_id").cast("long").alias("vec_id"),
            quoted("label").cast("string").alias("label"),
            quoted("embedding").cast("array<double>").alias("embedding"),
        ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
        return materialise(rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*"))

    asked = once(anchors)
    shards, number = by_columns(once(vectors), shard_rows)

    def positives_of(shard: Shard, anchor: dict) -> list[tuple]:
        return [(anchor["vec_id"], i, s, None, None) for i, s in zip(*(x.tolist() for x in nearest(shard, anchor, positives)))]

    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = meet(shards, number, asked, anchor_rows, positives_of).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    wanted = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    ready = materialise(asked.join(wanted.withColumnRenamed("anchor_id", "vec_id"), "vec_id"))

    def negatives_of(shard: Shard, anchor: dict) -> list[tuple]:
        scores = [p["positive_score"] for p in anchor["positives"]]
        windows = [(-(-least_share * s // 100), most_share * s // 100) for s in scores]
        found = in_windows(shard, anchor, windows, negatives)
        return [(anchor["vec_id"], p["positive_id"], p["positive_score"], i, s) for p, f in zip(anchor["positives"], found) for i, s in zip(*(x.tolist() for x in f))]

    place = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    hard = meet(shards, number, ready, anchor_rows, negatives_of).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
