"""Fingerprints, trees, components and groups against all pairs."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from assayline.llm import simhash_vptree as sv
from assayline.llm.queries import op6_simhash_vptree
from assayline.schemas import RESPONSES


def plain_print(text, size):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    runs = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius):
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("text", ["", None, "one", "One two", "a b c", "a\u00a0b c\x0bd e a b c d e", "É é " * 5, "w " * 70_000])
def test_fingerprint(text):
    for size in (3, 5):
        assert sv.majority(sv.shingle_hashes(text, size)) == plain_print(text, size)


def crowded(n, seed=1):
    """Random fingerprints and chains and balls of near ones."""
    rng = np.random.default_rng(seed)
    prints = [int(x) for x in rng.integers(0, 2**64, n, dtype=np.uint64)]
    for centre in prints[: n // 10]:
        x = centre
        for _ in range(6):
            x ^= sum({1 << int(b) for b in rng.integers(0, 64, 3)})
            prints.append(x)
    return sorted(set(prints))


@pytest.mark.parametrize("shard_points", [40, 5_000])
def test_links_connect_what_all_pairs_connect(spark, shard_points):
    prints = crowded(600)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(0, x) for x in signed], "view int, fingerprint long")
    edges = sv.spanning_links(table, shard_points=shard_points).collect()
    want = plain_groups(dict(zip(prints, prints)), 3)
    of = lambda x: x % 2**64
    for e in edges:
        assert want[of(e["a"])] == want[of(e["b"])] and (of(e["a"]) ^ of(e["b"])).bit_count() <= 64
    groups = {r["node"]: r["root"] for r in sv.components(spark.createDataFrame(edges, "view int, a long, b long")).collect()}
    got = {}
    for p, s in zip(prints, signed):
        got.setdefault(groups.get(s, s), set()).add(p)
    plain = {}
    for p, root in want.items():
        plain.setdefault(root, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, plain.values()))
    assert len(edges) < 40 * len(prints)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100)]
    star = [(1000, 1001 + i) for i in range(100)]
    got = {r["node"]: r["root"] for r in sv.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {1000 + i: 1000 for i in range(101)}
    assert sv.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    prints = {k: plain_print(t, 3) for k, t in texts.items()}
    want = plain_groups(prints, 3)
    got = op6_simhash_vptree(spark, folder).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {k: (f"{prints[k]:016x}", want[k]) for k in texts} and len(got) == len(texts)


def test_null_empty_and_repeated(spark):
    rows = [(5, None), (4, ""), (4, ""), (None, "a b c d"), (9, "a b c d"), (7, " \n "), (1, "q r s t u v")]
    table = spark.createDataFrame([(k, t, 0) for k, t in rows], "request_id long, raw string, fingerprint int")
    got = sv.near_duplicate_classes(sv.fingerprints(table)).collect()
    assert sorted((str(r["request_id"]), r["component_id"]) for r in got) == [("1", 1), ("4", 4), ("4", 4), ("5", 4), ("7", 4), ("9", 9), ("None", 9)]
    assert sv.near_duplicate_classes(sv.fingerprints(table.limit(0))).count() == 0


def plain_similar(texts, size=5, least=0.8):
    sets = {k: set(sv.shingle_hashes(t, size).tolist()) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common >= least * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_near_duplicates_equal_all_pairs(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 300)]
    for i in range(150):  # one group of near copies, all different
        words = list(base)
        words[int(rng.integers(0, 300))] = f"x{i}"
        texts[10_000 + i] = " ".join(words)
    texts |= {20_000: "", 20_001: None, 20_002: "short", 20_003: "short"}
    table = spark.createDataFrame([(k, t, 0, "x") for k, t in texts.items()], "request_id long, raw string, view int, same string")
    got = {r["request_id"]: r["component_id"] for r in sv.near_duplicates(table).collect()}
    assert got == plain_similar(texts)


def test_near_duplicates_of_odd_rows(spark):
    table = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "z")], "request_id long, raw string")
    got = sorted(map(tuple, sv.near_duplicates(table).collect()))
    assert got == [(1, 1), (2, 2)]
    assert sv.near_duplicates(table.limit(0)).count() == 0
    assert sv.fingerprints(table).select(F.max("fingerprint")).first()[0] is not None


def test_edited_copies_of_one_base_that_are_far_from_each_other(spark):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 200)]
    texts = {0: " ".join(base)}
    for i in range(1, 301):  # about 0.82 to the base, 0.66 to each other
        words = list(base)
        for at in rng.choice(np.arange(5, 195), 4, replace=False):
            words[int(at)] = f"x{i}_{at}"
        texts[i] = " ".join(words)
    table = spark.createDataFrame(list(texts.items()), "request_id long, raw string")
    want = plain_similar(texts)
    assert sum(root == 0 for root in want.values()) > 250
    for block_texts in (2_048, 40):
        assert {r["request_id"]: r["component_id"] for r in sv.near_duplicates(table, block_texts=block_texts).collect()} == want


def test_views_are_independent():
    rng, apart = np.random.default_rng(3), 0
    for _ in range(2_000):  # similarity 0.9
        both, own = rng.integers(0, 2**64, 180, dtype=np.uint64), rng.integers(0, 2**64, 20, dtype=np.uint64)
        a, b = np.concatenate([both, own[:10]]), np.concatenate([both, own[10:]])
        apart += not any(x == y for x, y in zip(sv.sample_prints(a, 8, 3), sv.sample_prints(b, 8, 3)))
    assert apart <= 2


def test_isolated_pairs_at_the_threshold(spark):
    rng, texts = np.random.default_rng(8), {}
    for i in range(400):
        words = [f"w{w}" for w in rng.integers(0, 10**6, 203)]
        texts[2 * i] = " ".join(words)
        for at in (20, 60, 100, 140):
            words[at] = "x"
        texts[2 * i + 1] = " ".join(words)
    table = spark.createDataFrame(list(texts.items()), "request_id long, raw string")
    got = {r["request_id"]: r["component_id"] for r in sv.near_duplicates(table).collect()}
    assert got == plain_similar(texts) and all(got[2 * i + 1] == 2 * i for i in range(400))


def test_keys_of_text_and_their_order(spark):
    base = [f"w{i}" for i in range(40)]
    texts = {"req-b": base, "req-a": [*base, "x"], "Req-c": base, "req-10": ["u", "v"], "req-9": ["u", "v"]}
    rows = [(k, 1, "m", None, " ".join(w), None) for k, w in texts.items()] + [(None, 1, "m", None, " ".join(base), None)]
    got = {r["request_id"]: r["component_id"] for r in sv.near_duplicates(spark.createDataFrame(rows, RESPONSES)).collect()}
    assert got == {"req-a": "Req-c", "req-b": "Req-c", "Req-c": "Req-c", "req-10": "req-10", "req-9": "req-10"}


def test_sketches_never_rule_out_a_near_pair():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (600, 600), (600, 5_000), (3_000, 2_800), (20_000, 20_000)):
        both = rng.integers(0, 2**64, min(n, m) * 9 // 10, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, k - len(both), dtype=np.uint64)])) for k in (n, m))
        apart = len(np.setxor1d(a, b))
        bound = sv.apart_at_least(sv.wide_parity(a), sv.wide_parity(b))
        assert bound <= apart and bound >= 0.4 * min(apart, min(n, m))
    assert sv.apart_at_least(sv.wide_parity(np.empty(0, np.uint64)), sv.wide_parity(both)) <= len(both)


def cell(sets, similarity=0.8):
    """All postings of ``sets`` in one cell, as the exact join deals short lists."""
    none, rows = np.empty(0, np.uint64), []
    for id_, members in enumerate(sets):
        for part in sv.set_parts(members, none, none.astype(np.int64), similarity):
            tokens = np.sort(np.concatenate([part["rare"], part["known"]])).tolist()
            for token, prev in zip(tokens, tokens[:1] + tokens):
                rows.append({"token": token, "prev": prev, "n": 2, "block": 0, "id": id_, "comp": id_, "size": part["size"], "parity": part["parity"], "cell": 0, "i": 0, "j": 0})
    return pa.Table.from_pylist(rows)


def test_long_sets_that_share_a_passage_give_no_pair():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 2**64, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 2**64, n, dtype=np.uint64)])) for n in rng.integers(2_500, 3_500, 60)]
    # A sketch of a whole set is full: it lets them all through.
    apart = [sv.apart_at_least(sv.parity_sketch(a), sv.parity_sketch(b)) for a in sets for b in sets]
    assert max(apart) < (1 - 0.8) / (1 + 0.8) * 2 * min(map(len, sets))
    assert sv.close_pairs(cell(sets), 0.8, False).num_rows == 0


def test_near_sets_meet_in_a_part():
    rng = np.random.default_rng(6)
    for n in (1, 500, 640, 641, 700, 1_280, 1_300, 5_000, 20_000):
        both = rng.integers(0, 2**64, n, dtype=np.uint64)
        for more in (0, n // 4):  # the one within the other, 0.8 at the least
            a, b = both, np.concatenate([both, rng.integers(0, 2**64, more, dtype=np.uint64)])
            pairs = sv.close_pairs(cell([np.unique(a), np.unique(b)]), 0.8, False)
            assert pairs.to_pylist() == [{"a": 1, "b": 0}], (n, more)


def test_a_pair_comes_out_where_common_tokens_begin():
    """Texts at 0.6 to 0.8 with hundreds of common tokens: a few rows a pair, not one for each token."""
    rng = np.random.default_rng(9)
    sets = [rng.integers(0, 2**64, 400, dtype=np.uint64)]
    sets.append(np.concatenate([sets[0][:365], rng.integers(0, 2**64, 35, dtype=np.uint64)]))
    table = cell([np.unique(s) for s in sets])
    tokens = table.group_by("token").aggregate([("id", "count")])["id_count"].to_pylist()
    shared = sum(n == 2 for n in tokens)
    rows = sum(sv.close_pairs(table.filter(pc.equal(table["token"], t)), 0.8, False).num_rows for t in set(table["token"].to_pylist()))
    assert shared > 40 and 0 < rows < shared / 2


def test_long_texts_equal_all_pairs(spark):
    rng, texts = np.random.default_rng(12), {}
    passage = [f"p{i}" for i in range(80)]
    for i, n in enumerate((600, 650, 700, 900, 1_300, 1_400, 2_600, 4_000)):
        words = [f"w{w}" for w in rng.integers(0, 10**7, n)]
        for k, edits in enumerate((0, n // 60, n // 48, n // 44, n // 30)):
            copy = list(words)
            for at in rng.choice(n, edits, replace=False):
                copy[int(at)] = f"x{i}_{k}_{at}"
            texts[10 * i + k] = " ".join(copy + passage)
        texts[10 * i + 9] = " ".join(words[: int(n * 0.9)] + passage)
    table = spark.createDataFrame(list(texts.items()), "request_id long, raw string")
    got = {r["request_id"]: r["component_id"] for r in sv.near_duplicates(table).collect()}
    assert got == plain_similar(texts) and len(set(got.values())) < len(got)
