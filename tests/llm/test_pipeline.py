"""The pipeline's stages against plain Python, on the small tables and on odd rows."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayline.llm import secret_ledger
from tests.llm.test_simhash_vptree import plain_similar

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def steps(spark):
    docs, found = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, FOLDER).cache()
        found.append((name, before, docs))
    return found


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(steps):
    assert 4 <= len(steps) <= 5
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns


def test_language_keeps_nearly_all(steps):
    _, before, after = steps[0]
    assert after.count() >= 0.97 * before.count()


def test_one_of_each_group_stays(steps):
    _, before, after = steps[1]
    groups = plain_similar(texts(before))
    assert set(texts(after)) == {k for k, root in groups.items() if k == root}


def test_benchmark_passages_go(spark, steps):
    _, before, after = steps[2]
    say = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [say(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    gone = set(texts(before)) - set(texts(after))
    whole = {k for k, t in texts(before).items() if any(i in say(t) for i in items)}
    assert whole <= gone
    seeds = {tuple(i.split()[j : j + 5]) for i in items for j in range(len(i.split()) - 4)}
    for k in gone:
        words = say(texts(before)[k]).split()
        assert any(tuple(words[j : j + 5]) in seeds for j in range(len(words)))


def test_secrets_are_replaced(steps):
    _, before, after = steps[3]
    was, now = texts(before), texts(after)
    assert set(was) == set(now)
    for k, t in was.items():
        found = secret_ledger.find_secrets(t, secret_ledger.RULES)
        assert (t == now[k]) == (not found)
        assert not [f for f in secret_ledger.find_secrets(now[k], secret_ledger.RULES)]
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if was[r["doc_id"]] != r["text"])


def test_mixture_draws_from_what_is_there(steps):
    _, before, after = steps[4]
    assert 0 < after.count() < before.count() and set(texts(after)) <= set(texts(before))
    assert after.filter("mix_probability <= 0 OR mix_probability > 1").count() == 0


def by_row(df):
    return sorted(map(str, (tuple(r) for r in df.select("doc_id", "text", "source").collect())))


def test_rows_are_dropped_by_their_text_not_their_id(spark):
    item = next(r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() if len(r["text"].split()) > 20)
    clean = " ".join(f"word{i}" for i in range(60))
    near = clean.replace("word59", "other")
    rows = [(None, item, "a"), (1, item, "a"), (1, clean, "b"), (None, clean, "c"), (2, near, "d"), (2, near, "d"), (1, clean, "b"), (None, "own " * 9, "e")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], DOCS)
    left = corpus_pipeline.decontaminate(spark, docs, FOLDER)
    assert left.columns == docs.columns and by_row(left) == by_row(docs.filter(F.col("text") != item))
    # Clean and near are one group under its smallest id, of which one row stays; a text under null alone stays too.
    once = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert by_row(once) == sorted(map(str, [(1, item, "a"), (1, clean, "b"), (None, "own " * 9, "e")]))


def test_language_found_fills_the_gaps(spark, steps):
    before, after = (
        {r["doc_id"]: r["lang"] for r in df.collect()} for df in (steps[0][1], steps[0][2])
    )
    assert all(after[k] == (before[k] or after[k]) and after[k] for k in after)


def test_odd_rows_and_empty_table(spark):
    rows = [
        (1, "der die das und nicht ein mit von token=abcdefgh12", "de", "s", 3, "x", 1, "b"),
        (1, "der die das und nicht ein mit von token=abcdefgh12", "de", "s", 3, "x", 1, "b"),
        (2, None, None, None, None, None, None, None),
        (3, "", "de", "s", 0, "x", 2, ""),
        (None, "the and of that with for this is a page of words", "en", None, None, "y", None, "c"),
        (4, "w " * 50_000 + "the and of that with", "en", "s", 9, "z", 7, "d"),
    ]
    table = spark.createDataFrame(rows, f"{DOCS}, lang_pred string, mix_copy long, dedup_blob string")
    for docs in (table, table.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, FOLDER).cache()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == columns, name
        assert docs.count() >= 0 and [c for c in docs.columns if c.lower() == "mix_copy"] == ["mix_copy"]
