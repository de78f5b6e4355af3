"""Fitted margins against plain iterative fitting; probabilities and draws."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayline.llm import raking
from assayline.llm.queries import op8_raking, topic_of

ROWS = [(i, f"s{i % 5 if i % 3 else 0}", ("en", "fr", None)[i % 3 if i % 7 else 0], f"t{i % 2}", 10 + i % 40) for i in range(400)]
SCHEMA = "request_id long, source string, lang string, topic string, tokens long, m0 string, w double"


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA)


def plain(rows, targets, sweeps=200):
    cells = {}
    for _, s, la, t, n in rows:
        k = (s, la or raking.NONE, t)
        cells[k] = cells.get(k, 0) + n
    mass = {k: float(v) for k, v in cells.items()}
    for _ in range(sweeps):
        for d, target in enumerate(targets):
            sums = {}
            for k, v in mass.items():
                sums[k[d]] = sums.get(k[d], 0) + v
            mass = {k: v * target[k[d]] / sums[k[d]] for k, v in mass.items()}
    total = sum(cells.values())
    return {k: mass[k] / (cells[k] / total) for k in cells}


def test_weights_meet_the_targets(spark):
    targets = [{f"s{i}": 0.2 for i in range(5)}, {"en": 0.5, "fr": 0.3, raking.NONE: 0.2}, {"t0": 0.6, "t1": 0.4}]
    frames = {m: spark.createDataFrame(list(t.items()), "value string, share double") for m, t in zip(("source", "lang", "topic"), targets)}
    got = raking.mixing_probabilities(table(spark), margins=["source", "lang", "topic"], tokens="tokens", targets=frames, tolerance=1e-9).collect()
    want = plain(ROWS, targets)
    assert len(got) == len(ROWS)
    for r in got:
        assert r["mix_weight"] == pytest.approx(want[r["source"], r["lang"] or raking.NONE, r["topic"]], rel=1e-6)
        assert 0.0 <= r["mix_probability"] <= 1.0
    assert max(r["mix_probability"] for r in got) == pytest.approx(1.0)
    for d, (column, target) in enumerate(zip(("source", "lang", "topic"), targets)):
        for value, share in target.items():
            mass = sum(r["mix_probability"] * r["tokens"] for r in got if (r[column] or raking.NONE) == value)
            assert mass / sum(r["mix_probability"] * r["tokens"] for r in got) == pytest.approx(share, rel=1e-6), d


def test_draws(spark):
    rows = [(i, "a" if i % 4 else "b", "en", "t", 10) for i in range(20_000)]
    mixed = raking.mixing_probabilities(table(spark, rows), margins=["source", "lang"], tokens="tokens", keep=0.5)
    got = {r["source"]: r for r in mixed.groupBy("source").agg(F.avg(F.col("mix_kept").cast("int")).alias("kept"), F.avg("mix_probability").alias("p")).collect()}
    for r in got.values():
        assert r["kept"] == pytest.approx(r["p"], abs=0.02)
    # Square roots of the shares 3/4 and 1/4.
    assert got["a"]["p"] == pytest.approx(0.5 * (3**0.5 / (1 + 3**0.5)) / 0.75, rel=1e-3)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "a", "en", "t", 0), (3, "a", "en", "t", -5), (4, "a", "en", "t", 7), (4, "a", "en", "t", 7), (None, "a", "en", "t", 7)]
    got = raking.mixing_probabilities(table(spark, rows), margins=["source", "lang", "topic"], tokens="tokens").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["mix_probability"] == (1.0 if r["tokens"] == 7 else 0.0) and r["mix_kept"] == (r["tokens"] == 7)
    empty = raking.mixing_probabilities(table(spark, []), margins=["source"], tokens="tokens")
    assert empty.count() == 0


def test_targets_without_support_are_scaled_away(spark):
    frames = {"source": spark.createDataFrame([("s0", 1.0), ("nowhere", 3.0), ("s1", 0.0)], "value string, share double")}
    got = raking.mixing_probabilities(table(spark), margins=["source"], tokens="tokens", targets=frames).collect()
    assert {r["source"] for r in got if r["mix_probability"] > 0} == {"s0"}


def margins_met(rows, copies, share):
    """Kept share and margins of ``rows`` (source, lang, topic, tokens, copies) against square roots of the present ones."""
    total, kept = sum(r["tokens"] for r in rows), sum(r["tokens"] * copies(r) for r in rows)
    assert kept / total == pytest.approx(share, abs=0.05)
    for margin in ("source", "lang", "topic"):
        now, got = {}, {}
        for r in rows:
            now[r[margin]] = now.get(r[margin], 0) + r["tokens"]
            got[r[margin]] = got.get(r[margin], 0) + r["tokens"] * copies(r)
        roots = sum(n**0.5 for n in now.values())
        for value, n in now.items():
            assert got[value] / kept == pytest.approx(n**0.5 / roots, abs=0.03), (margin, value)


def test_query_meets_targets_and_share(spark):
    got = op8_raking(spark, "/root/testdata/sf0.01").collect()
    margins_met(got, lambda r: r["mix_copies"], 0.5)
    assert all(r["mix_kept"] == (r["mix_copies"] > 0) for r in got)


def test_stage_meets_targets_and_share(spark):
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).alias("tokens")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    drawn = corpus_pipeline.mixture(spark, docs, "").groupBy("doc_id").count()
    rows = docs.select("doc_id", "source", "lang", topic_of("text").alias("topic"), words).join(drawn, "doc_id", "left").fillna(0, ["count"])
    margins_met(rows.collect(), lambda r: r["count"], corpus_pipeline.KEEP_TOKENS)
