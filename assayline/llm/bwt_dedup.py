"""Removal of repeated passages: Burrows-Wheeler transform with threshold-bounded interval expansion.

A byte goes if a string of ``least`` bytes that covers it also starts in a response with a smaller key.

1. Responses are packed into blocks. In every window of ``least`` bytes the anchor is the leftmost
   smallest hash of ``gram`` bytes, so equal windows have equal anchors. Windows in a row with one
   anchor form a segment.
2. Anchors are dealt to buckets by hash. Those in one response only end here.
3. Segments of shared anchors go to the bucket of their anchor, each distinct one once per block.
   All places of a repeated window meet there. A bucket sorts the suffixes of its distinct segments,
   takes the transform and derives the common prefixes of neighbours by value, 0, 1, 2, ...: a border
   of value v between two suffixes sets the borders that lie one step further back to v + 1. At ``least``
   it stops; borders not yet set join suffixes that share ``least`` bytes. The smallest key of such
   a group is what each of its windows needs to know.
4. The smallest keys return to the blocks, where covered bytes are cut out.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from assayline.llm.common import Batches, bytes_total, quoted
from assayline.operators.scale import numbered
from assayline.session import materialise

NO_KEY = np.iinfo(np.int64).max
END = 0xFF  # no byte of UTF-8
CHUNK = 262_144

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_POSITION = np.uint64((1 << 24) - 1)


# --- packing ----------------------------------------------------------------------------------


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays with their types and lengths, compressed."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sq", a.dtype.str[1:3].encode(), a.size) for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(data: bytes) -> list[np.ndarray]:
    plain = zstandard.ZstdDecompressor().decompress(data)
    count, at, found = plain[0], 1 + 10 * plain[0], []
    for i in range(count):
        kind, size = struct.unpack_from("<2sq", plain, 1 + 10 * i)
        dtype = np.dtype(kind.decode())
        found.append(np.frombuffer(plain, dtype=dtype, count=size, offset=at))
        at += size * dtype.itemsize
    return found


BLOCK = pa.schema([("block", pa.int64()), ("payload", pa.binary())])


def pack_blocks(responses: DataFrame, key: str, raw: str, block_bytes: int) -> DataFrame:
    """(block, payload) of keys, null flags, lengths and texts, in the order in which they are read."""
    rows = responses.select(quoted(key).cast("long").alias("key"), quoted(raw).cast("string").alias("raw"))

    def run(batches: Batches) -> Batches:
        first, made = TaskContext.get().partitionId() << 32, 0
        keys, texts, size = [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.array([NO_KEY if k is None else k for k in keys], dtype=np.int64)
            none = np.array([k is None for k in keys], dtype=np.uint8)
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            payload = pack(ids, none, lengths, np.frombuffer(b"".join(texts), dtype=np.uint8), level=3)
            return pa.RecordBatch.from_pylist([{"block": first + made, "payload": payload}], schema=BLOCK)

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = (t or "").encode()
                if keys and size + len(text) > block_bytes:
                    yield close()
                    made += 1
                    keys, texts, size = [], [], 0
                keys.append(k)
                texts.append(text)
                size += len(text)
        if keys:
            yield close()

    return materialise(rows.mapInArrow(run, "block long, payload binary"))


# --- anchors ----------------------------------------------------------------------------------


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """Mixed hashes of all runs of ``gram`` bytes (a power of two)."""
    h = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    power, n = _MULTIPLY, 1
    while n < gram:
        h = h[:-n] * power + h[n:]
        power = np.uint64(int(power) * int(power) % 2**64)
        n *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def segments(text: np.ndarray, ends: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, place of the anchor, its hash) of each segment; windows never cross an end.

    Work goes by chunks, so a segment may be parted in two at a chunk's edge; both parts keep the anchor.
    """
    windows = least - gram + 1
    firsts, lasts, places, anchors = [], [], [], []
    for at in range(0, max(0, len(text) - least + 1), CHUNK):
        part = text[at : at + CHUNK + least - 1]
        h = gram_hashes(part, gram)
        low = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while 2 * n <= windows:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        if n < windows:
            low = np.minimum(low[: n - windows], low[windows - n :])
        start = np.arange(at, at + len(low))
        place = (low & _POSITION).astype(np.int64)
        fits = start + least <= ends[np.searchsorted(ends, start, side="right")] if len(ends) > 1 else np.ones(len(start), dtype=bool)
        start, place = start[fits], place[fits]
        if not len(start):
            continue
        new = np.empty(len(start), dtype=bool)
        new[0] = True
        new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.nonzero(new)[0]
        last = np.concatenate([first[1:], [len(start)]]) - 1
        firsts.append(start[first])
        lasts.append(start[last])
        places.append(place[first] + at)
        anchors.append(h[place[first]])
    if not firsts:
        return *(np.empty(0, np.int64),) * 3, np.empty(0, np.uint64)
    return tuple(map(np.concatenate, (firsts, lasts, places, anchors)))


def address(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper and tag in the lower 32 bits; the tag is apart from what chose the bucket.

    Two anchors with one tag only look shared: their segments are then compared in vain.
    """
    low, tag = anchors & np.uint64(0xFFFFFFFF), anchors >> np.uint64(32)
    return (low % np.uint64(buckets)) << np.uint64(32) | tag


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values; no runs in no values."""
    if not len(sorted_values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.nonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))[0]
    return first, np.concatenate([first[1:], [len(sorted_values)]]).astype(np.int64)


# --- the transform ----------------------------------------------------------------------------


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` or more bytes that follow; doubling from eight bytes."""
    n = len(text)
    key = np.zeros(n, dtype=np.uint64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    known = 8
    while True:
        order = np.argsort(key)
        if known >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]])).astype(np.uint64)
        key = rank << np.uint64(32)
        if known < n:
            key[: n - known] |= rank[known:]
        known *= 2


def prefix_groups(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): sorted suffixes and where each group of suffixes with ``least`` equal bytes begins.

    Breadth-first over the value v of common prefixes. ``back[t]`` is the place, in the transform, of the
    character that extends a suffix to the t-th one in order. Neighbours t-1 and t of one first character
    share v + 1 bytes if v is the smallest value between the places they come from; as values come in
    rising order, the first border met there sets it.
    """
    order = suffix_order(text, least)
    transform = text[order - 1]
    back = np.argsort(transform, kind="stable")
    first = transform[back]
    n = len(text)
    is_set = np.ones(n, dtype=bool)
    is_set[1:] = first[1:] != first[:-1]
    marks = is_set.copy()
    open_ = np.nonzero(~is_set)[0]
    low, high = back[open_ - 1].astype(np.int32), back[open_].astype(np.int32)
    met = np.empty(n, dtype=np.int32)
    for _ in range(1, least):
        np.cumsum(marks, out=met)
        hit = met[high] > met[low]
        new = open_[hit]
        if not len(new):
            break
        is_set[new] = True
        marks[:] = False
        marks[new] = True
        stay = ~hit
        open_, low, high = open_[stay], low[stay], high[stay]
    return order, np.nonzero(is_set)[0]


def meeting(parts: list[bytes], offsets: np.ndarray, least: int, gram: int) -> np.ndarray:
    """Which segments may share a window with another one, by what surrounds their anchors.

    A shared window holds the anchor and ``least - gram`` bytes more, so at least half of these on one of its
    sides: the segment agrees with another in ``gram`` and that many bytes there (taken as the
    largest power of two up to it).
    """
    reach = gram
    while 2 * reach <= gram + (least - gram) // 2:
        reach *= 2
    text = np.frombuffer(b"".join(parts), dtype=np.uint8)
    lengths = np.array([len(p) for p in parts])
    begins = np.cumsum(lengths) - lengths
    if len(text) < reach:
        return np.ones(len(parts), dtype=bool)
    hashes, may = gram_hashes(text, reach), np.zeros(len(parts), dtype=bool)
    for start in (offsets, offsets + gram - reach):
        fits = np.nonzero((start >= 0) & (start + reach <= lengths))[0]
        _, place, count = np.unique(hashes[begins[fits] + start[fits]], return_inverse=True, return_counts=True)
        may[fits[count[place] > 1]] = True
    return may


def least_keys(parts: list[bytes], keys: np.ndarray, least: int) -> list[np.ndarray]:
    """For each window of each segment the smallest key under which these ``least`` bytes occur."""
    if not parts:
        return []
    text = np.frombuffer(bytes([END]).join(parts) + bytes([END]), dtype=np.uint8)
    lengths = np.array([len(p) for p in parts])
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    counts = lengths - least + 1
    held = np.full(len(text), NO_KEY, dtype=np.int64)
    places = np.repeat(begins - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    held[places] = np.repeat(keys, counts)
    order, starts = prefix_groups(text, least)
    lowest = np.minimum.reduceat(held[order], starts)
    sizes = np.diff(np.concatenate([starts, [len(text)]]))
    best = np.empty(len(text), dtype=np.int64)
    best[order] = np.repeat(lowest, sizes)
    return np.split(best[places], np.cumsum(counts)[:-1])


# --- the job ----------------------------------------------------------------------------------

KEEP_SQL = "`{key}` long, n_bytes long, spans array<struct<start:long, end:long>>, kept binary"


def _ranked_keys(responses: DataFrame, key: str) -> DataFrame:
    """(name, rank) of the distinct keys in their order; large tables are ranked range by range."""
    names = responses.select(quoted(key).alias("name")).filter("name is not null").distinct()
    return materialise(numbered(names, [], ["name"], "rank"))


def cut_repeats(
    responses: DataFrame,
    *,
    key: str = "request_id",
    raw: str = "raw",
    least: int = 50,
    gram: int = 16,
    block_bytes: int = 4_194_304,
    bucket_bytes: int = 4_194_304,
) -> DataFrame:
    """(key, n_bytes, spans, kept): removed byte ranges of each response and the bytes that stay.

    Texts are taken as UTF-8 bytes, null as empty. A byte is removed if it is covered by ``least`` bytes that
    also start in a response with a smaller ``key``, on the input as it stands; matches never
    cross responses. A null key counts as larger than all others. Rows repeated under one key do not
    cut each other. ``spans`` are maximal, ordered and end-exclusive; ``kept`` is binary, as a cut may part a
    character. Texts shorter than ``least`` and an empty table lose nothing. Keys that are no whole numbers
    are numbered in their own order first, and come back as they were.
    """
    kind = responses.schema[key].dataType
    if not isinstance(kind, IntegralType):
        ranks = _ranked_keys(responses, key)
        sizes = {"least": least, "gram": gram, "block_bytes": block_bytes, "bucket_bytes": bucket_bytes}
        rows = responses.select(quoted(key).alias("named"), quoted(raw).alias("raw")).join(ranks, F.col("named") == F.col("name"), "left")
        cut_rows = cut_repeats(rows.select("rank", "raw"), key="rank", raw="raw", **sizes)
        named = cut_rows.withColumnRenamed("rank", "at").join(ranks, F.col("at") == F.col("rank"), "left")
        return named.select(F.col("name").alias(key), "n_bytes", "spans", "kept")
    buckets = max(1, -(-bytes_total(responses, raw) // bucket_bytes))
    blocks = pack_blocks(responses, key, raw, block_bytes)

    def offer(batches: Batches) -> Batches:
        """Distinct anchors of a block by bucket, with a flag for those in two of its responses."""
        for batch in batches:
            for row in batch.to_pylist():
                _, _, lengths, text = unpack(row["payload"])
                ends = np.cumsum(lengths)
                first, _, _, anchors = segments(text, ends, least, gram)
                owner = np.searchsorted(ends, first, side="right").astype(np.int32)
                at = address(anchors, buckets)
                order = np.argsort(at, kind="stable")
                at, owner = at[order], owner[order]
                begin, end = runs(at)
                distinct, twice = at[begin], owner[begin] != owner[end - 1]
                bucket, tag = (distinct >> np.uint64(32)).astype(np.int64), distinct.astype(np.uint32)
                rows = [
                    {"bucket": int(bucket[b]), "block": row["block"], "payload": tag[b:e].tobytes() + np.packbits(twice[b:e]).tobytes(), "n": int(e - b)}
                    for b, e in zip(*runs(bucket))
                ]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=OFFER)

    def shared(table: pa.Table) -> pa.Table:
        """Tags of a bucket that two responses hold, by block."""
        held, flags, owner = [], [], []
        for i, (data, n) in enumerate(zip(table["payload"].to_pylist(), table["n"].to_pylist())):
            held.append(np.frombuffer(data, dtype=np.uint32, count=n))
            flags.append(np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=4 * n), count=n))
            owner.append(np.full(n, i, dtype=np.int32))
        tags, flags, owner = np.concatenate(held), np.concatenate(flags), np.concatenate(owner)
        order = np.argsort(tags, kind="stable")
        begin, end = runs(tags[order])
        common = (np.maximum.reduceat(flags[order], begin) > 0) | (end - begin > 1)
        kept = order[np.repeat(common, end - begin)]
        kept = kept[np.argsort(owner[kept], kind="stable")]
        ids, bucket = table["block"].to_pylist(), table["bucket"][0].as_py()
        rows = [{"bucket": bucket, "block": ids[owner[kept[b]]], "payload": tags[kept[b:e]].tobytes()} for b, e in zip(*runs(owner[kept]))]
        return pa.Table.from_pylist(rows, schema=PIECE)

    def shared_segments(text: np.ndarray, ends: np.ndarray, tables: list[tuple[int, bytes]]) -> tuple | None:
        """Segments of a block whose anchors are shared: their first windows, numbers of their texts, and
        per text (in bucket order, as both callers rely on) the bucket, the offset of the anchor and the bytes."""
        known = [np.empty(0, np.uint64)]
        for bucket, data in tables:
            known.append(np.frombuffer(data, dtype=np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
        known = np.sort(np.concatenate(known))
        first, last, anchor, hashes = segments(text, ends, least, gram)
        at = address(hashes, buckets)
        if not len(known) or not len(at):
            return None
        there = known[np.minimum(np.searchsorted(known, at), len(known) - 1)] == at
        first, last, anchor, at = first[there], last[there], anchor[there], at[there]
        if not len(first):
            return None
        plain, seen = text.tobytes(), {}
        number = np.array([seen.setdefault(plain[a:b], len(seen)) for a, b in zip(first.tolist(), (last + least).tolist())], dtype=np.int64)
        offset, bucket = np.empty(len(seen), dtype=np.uint16), np.empty(len(seen), dtype=np.int64)
        offset[number] = anchor - first
        bucket[number] = at >> np.uint64(32)
        parts, order = list(seen), np.argsort(bucket, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return first, place[number], bucket[order], offset[order], [parts[i] for i in order]

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        """Distinct segments of shared anchors by bucket, with the smallest key of the block for each."""
        rows, tables = [], list(zip(right["bucket"].to_pylist(), right["payload"].to_pylist()))
        for block, payload in zip(left["block"].to_pylist(), left["payload"].to_pylist()):
            keys, _, lengths, text = unpack(payload)
            ends = np.cumsum(lengths)
            found = shared_segments(text, ends, tables)
            if found is None:
                continue
            first, place, bucket, offset, parts = found
            lowest = np.full(len(parts), NO_KEY, dtype=np.int64)
            np.minimum.at(lowest, place, keys[np.searchsorted(ends, first, side="right")])
            sizes = np.array([len(p) for p in parts], dtype=np.int32)
            for b, e in zip(*runs(bucket)):
                payload = pack(offset[b:e], lowest[b:e], sizes[b:e], np.frombuffer(b"".join(parts[b:e]), dtype=np.uint8))
                rows.append({"bucket": int(bucket[b]), "block": block, "payload": payload})
        return pa.Table.from_pylist(rows, schema=PIECE)

    def settle(table: pa.Table) -> pa.Table:
        """The smallest key per window of every segment of a bucket, sent back by block."""
        seen, keys, offsets, blocks_of = {}, [], [], []
        for payload in table["payload"].to_pylist():
            offset, lowest, sizes, text = unpack(payload)
            plain, at, numbers = text.tobytes(), 0, []
            for o, k, size in zip(offset.tolist(), lowest.tolist(), sizes.tolist()):
                part = plain[at : at + size]
                at += size
                n = seen.setdefault(part, len(seen))
                if n == len(keys):
                    keys.append(k)
                    offsets.append(o)
                elif k < keys[n]:
                    keys[n] = k
                numbers.append(n)
            blocks_of.append(numbers)
        parts, keys = list(seen), np.array(keys, dtype=np.int64)
        several = np.nonzero(meeting(parts, np.array(offsets), least, gram))[0]
        found = dict(zip(several.tolist(), least_keys([parts[i] for i in several], keys[several], least)))
        rows = []
        for block, numbers in zip(table["block"].to_pylist(), blocks_of):
            lows = [found[n] if n in found else np.full(len(parts[n]) - least + 1, keys[n]) for n in numbers]
            sizes = np.array([len(x) for x in lows], dtype=np.int32)
            # Answers are told from tags by the sign.
            rows.append({"bucket": -1 - table["bucket"][0].as_py(), "block": block, "payload": pack(sizes, np.concatenate(lows))})
        return pa.Table.from_pylist(rows, schema=PIECE)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        """The responses of a block without their covered bytes."""
        keys, none, lengths, text = unpack(left["payload"][0].as_py())
        ends = np.cumsum(lengths)
        begins = ends - lengths
        starts = np.zeros(len(text) + 1, dtype=np.int32)
        sent = list(zip(right["bucket"].to_pylist(), right["payload"].to_pylist()))
        found = shared_segments(text, ends, [x for x in sent if x[0] >= 0])
        if found is not None:
            first, place, *_ = found
            answers = sorted((-1 - bucket, data) for bucket, data in sent if bucket < 0)
            sizes, lows = (np.concatenate(x) for x in zip(*(unpack(p) for _, p in answers)))
            offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            count = sizes[place]
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            windows = np.repeat(first, count) + step
            owner = np.searchsorted(ends, windows, side="right")
            starts[windows[lows[np.repeat(offsets[place], count) + step] < keys[owner]]] = 1
        so_far = np.cumsum(starts[:-1])
        covered = so_far > np.concatenate([np.zeros(min(least, len(text)), so_far.dtype), so_far[:-least]]) if len(text) else np.empty(0, bool)
        rows = []
        for k, is_null, b, e in zip(keys.tolist(), none.tolist(), begins.tolist(), ends.tolist()):
            own = covered[b:e]
            edges = np.diff(np.concatenate([[0], own.view(np.int8), [0]]))
            spans = [{"start": s, "end": t} for s, t in zip(np.nonzero(edges == 1)[0].tolist(), np.nonzero(edges == -1)[0].tolist())]
            rows.append({key: None if is_null else k, "n_bytes": e - b, "spans": spans, "kept": text[b:e][~own].tobytes()})
        return pa.Table.from_pylist(rows, schema=kept_schema)

    kept_schema = pa.schema(
        [(key, pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
    )
    piece = "bucket long, block long, payload binary"
    offers = blocks.mapInArrow(offer, f"{piece}, n long")
    common = materialise(offers.groupBy("bucket").applyInArrow(shared, piece))
    pieces = blocks.groupBy("block").cogroup(common.groupBy("block")).applyInArrow(gather, piece)
    answers = materialise(pieces.groupBy("bucket").applyInArrow(settle, piece))
    # Segments are found once more at the end: that is cheaper than to keep them.
    sent = common.unionAll(answers).groupBy("block")
    return blocks.groupBy("block").cogroup(sent).applyInArrow(cut, KEEP_SQL.format(key=key))


OFFER = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("payload", pa.binary()), ("n", pa.int64())])
PIECE = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])
