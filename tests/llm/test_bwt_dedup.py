"""Repeat removal against a dictionary of all windows; groups of the transform against sorting."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayline.llm import bwt_dedup as bd
from assayline.llm.queries import op10_bwt_dedup


def plain_cut(texts, least):
    data = {k: (t or "").encode() for k, t in texts.items()}
    lowest = {}
    for k in sorted(data):
        for i in range(len(data[k]) - least + 1):
            lowest.setdefault(data[k][i : i + least], k)
    out = {}
    for k, d in data.items():
        gone = bytearray(len(d))
        for i in range(len(d) - least + 1):
            if lowest[d[i : i + least]] < k:
                gone[i : i + least] = b"\x01" * least
        spans, kept = [], bytes(b for b, g in zip(d, gone) if not g)
        for i, g in enumerate(gone):
            if g and (i == 0 or not gone[i - 1]):
                spans.append([i, i + 1])
            elif g:
                spans[-1][1] = i + 1
        out[k] = (len(d), [tuple(s) for s in spans], kept)
    return out


def cut(spark, texts, **kw):
    table = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()], "request_id long, raw string, block int, payload string")
    return {r["request_id"]: (r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in bd.cut_repeats(table, **kw).collect()}


@settings(max_examples=120, deadline=None)
@given(st.binary(min_size=1, max_size=200).map(lambda b: bytes(x % 3 for x in b)), st.sampled_from([1, 4, 9, 16]))
def test_prefix_groups(data, least):
    text = np.frombuffer(data + bytes([bd.END]), dtype=np.uint8)
    order, starts = bd.prefix_groups(text, least)
    full = text.tobytes()
    inside = [i for i in range(len(full)) if i + least <= len(full)]
    label = np.empty(len(text), dtype=int)
    label[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(text))))
    for i in inside:
        for j in inside:
            assert (label[i] == label[j]) == (full[i : i + least] == full[j : j + least])


def passages(seed=2):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeé"), 6)) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words, n))
    common, other = say(30), say(12)
    texts = {i: f"{say(20)} {common if i % 3 == 0 else ''} {say(5)} {other if i % 4 == 0 else ''}" for i in range(60)}
    return texts | {
        100: texts[7],
        101: texts[7],
        102: "",
        103: None,
        104: "ab" * 500,
        105: "ab" * 40 + "x",
        106: "short",
        107: common[:49],
        108: common[:50],
        109: "y" + common[5:60] + "z" + common[3:57],
        50_000: say(4_000) + common + say(10),
    }


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 600, "bucket_bytes": 2_000}])
def test_cut(spark, sizes):
    texts = passages()
    assert cut(spark, texts, **sizes) == plain_cut(texts, 50)


def test_other_lengths_and_chunks(spark, monkeypatch):
    texts = passages(4)
    assert cut(spark, texts, least=20, gram=8, block_bytes=3_000) == plain_cut(texts, 20)
    monkeypatch.setattr(bd, "CHUNK", 37)
    text = np.frombuffer((passages()[104] + passages()[0]).encode(), dtype=np.uint8)
    first, last, _, _ = bd.segments(text, np.array([1000, len(text)]), 50, 16)
    windows = sorted(w for a, b in zip(first.tolist(), last.tolist()) for w in range(a, b + 1))
    assert windows == [i for i in range(len(text) - 49) if i + 50 <= 1000 or i >= 1000]


def test_null_and_repeated_keys(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    table = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long + long)], "request_id long, raw string")
    got = sorted((str(r["request_id"]), r["n_bytes"] - len(r["kept"])) for r in bd.cut_repeats(table).collect())
    n = len(long)
    # Eleven bytes around the seam are under windows that cross it only where no window of the first text reaches.
    assert got[:2] == [("1", 0), ("1", 0)] and got[3] == ("None", n) and got[2] == ("2", 2 * n)
    assert bd.cut_repeats(table.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = plain_cut(texts, 50)
    got = op10_bwt_dedup(spark, folder).collect()
    assert len(got) == len(texts) and any(r["n_removed"] for r in got)
    for r in got:
        n, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("slice_rows", [None, 2])
def test_text_keys(spark, monkeypatch, slice_rows):
    """Keys of the table of responses are text: ``req-10`` comes before ``req-9``, a null key last."""
    if slice_rows:
        monkeypatch.setattr("assayline.operators.scale.HOT_MIN_ROWS", slice_rows)
    same = "a passage that several responses hold and that is longer than the least"
    texts = {"req-9": "x" + same, "req-10": same + "y", "": "z " + same, "req-a": None, "req-b": "short", "Z": same[:40]}
    table = spark.createDataFrame([*texts.items(), (None, same)], "request_id string, raw string")
    got = {r["request_id"]: (r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in bd.cut_repeats(table, least=20).collect()}
    want = plain_cut({k or "": t for k, t in texts.items()} | {"~": same}, 20)
    want[None] = want.pop("~")
    assert got == want and got["req-9"][2] == b"x"


def test_only_short_texts(spark):
    """Blocks without a single window: nothing is offered, nothing is cut."""
    texts = {1: "short", 2: "", 3: None, 4: "short"}
    assert cut(spark, texts) == plain_cut(texts, 50)
