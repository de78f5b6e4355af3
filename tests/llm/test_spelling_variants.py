"""Spelling variants against all pairs, on planted names and on random words."""

import random
import re
import zlib
from collections import Counter

import pytest

from assayline.llm.queries import QUERIES
from assayline.llm.spelling_variants import count_words, group_variants, rotations

FOLDER = "/root/testdata/sf0.001"
RESPONSES = "request_id string, attempt int, model string, raw string, word string, n string"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, lift=10):
    forms, out = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= lift * n else None
        forms[w] = form
        out[w] = [form, None, n, len(others), counts[form] if form else None]
    for w, row in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        row[1] = root
    return {(w, *row) for w, row in out.items()}


def got(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return set(map(tuple, rows))


def test_random_words_equal_all_pairs(spark):
    rng = random.Random(5)
    counts = {}
    for length in (1, 2, 3, 4, 5):
        for _ in range(60):
            counts["".join(rng.choice("aabÿ") for _ in range(length))] = rng.choice([1, 1, 2, 9, 10, 11, 100, 110, 5000])
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    for parts in (1, 7):
        assert got(group_variants(table.repartition(parts))) == plain(counts)


def test_chain_of_forms(spark):
    counts = {"a" * 7 + "b" * i + "c" * (9 - i): 10**i for i in range(10)}
    rows = got(group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert rows == plain(counts)
    assert {r[2] for r in rows} == {"a" * 7 + "b" * 9}


def test_ties_repeats_nulls_and_empty(spark):
    rows = [("primary", 50), ("primaru", 50), ("primarx", 2), ("primarx", 3), (None, 9), ("", 1), ("q", 10)]
    table = spark.createDataFrame(rows, "word string, n long")
    want = {"primary": 50, "primaru": 50, "primarx": 5, "": 1, "q": 10}
    assert got(group_variants(table)) == plain(want)
    assert ("primarx", "primaru", "primaru", 5, 2, 50) in plain(want)
    assert group_variants(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        group_variants(table, lift=1)


def test_rotations_of_a_word(spark):
    found = rotations(spark.createDataFrame([("abc", 4)], "word string, n long")).collect()
    assert sorted(map(tuple, found)) == sorted(
        [("abc$", "", 4), ("bc$a", "", 4), ("c$ab", "", 4), ("$abc", "", 4), ("bc$", "a", 4), ("c$a", "b", 4), ("$ab", "c", 4)]
    )


def test_counts_of_odd_responses(spark):
    long_text = "versatus " * 200_000
    rows = [
        ("r1", 1, "m", "\\definecolor{Secondary}{HTML}{C3002F} secondary SECONDARY", "x", "y"),
        ("r1", 1, "m", "\\definecolor{Secondary}{HTML}{C3002F} secondary SECONDARY", "x", "y"),
        ("r2", 1, "m", None, None, None),
        ("r3", 2, "m", "", None, None),
        (None, 1, "m", "Ölfarbe ölfarbe ölfarben secondary1secondary", None, None),
        ("r4", 1, "m", long_text, None, None),
    ]
    table = spark.createDataFrame(rows, RESPONSES)
    # Only A-Z change case: the capital and the small umlaut stay different words.
    assert {tuple(r) for r in count_words(table).collect()} == {("definecolor", 2), ("secondary", 8), ("versatus", 200_000)}
    once = {tuple(r) for r in count_words(table, min_count=1).collect()}
    assert {("Ölfarbe", 1), ("ölfarbe", 1), ("ölfarben", 1)} <= once
    assert count_words(table.limit(0)).count() == 0


def test_slips_are_counted_as_planted(spark):
    texts = {f"req-{i}": "background margin colours" for i in range(200)} | {None: "background"}
    table = spark.createDataFrame([(k, t) for k, t in texts.items()], "request_id string, raw string")
    want = Counter()
    for k, t in texts.items():
        for w in t.split():
            h = zlib.crc32(f"{k or ''}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 5 == 0 else w] += 1
    counted = {r["word"]: r["n"] for r in count_words(table, min_count=1, slip_every=5).collect()}
    assert counted == {w: n for w, n in want.items() if len(w) >= 7}


def test_query_equals_plain_version(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{r['doc_id']}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    df = QUERIES["op13_permuterm_variants"](spark, FOLDER)
    assert dict(df.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert got(df) == plain(counts)
