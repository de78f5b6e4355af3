"""Held-out accuracy, and texts that teach or tell nothing."""

import zlib

import pytest
import zstandard

from assayline.llm import zstd_language as zl
from assayline.llm.queries import op9_zstd_language


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op9_zstd_language(spark, folder).collect()
    assert len(got) == len(labels)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == labels[r["doc_id"]] for r in out) / len(out) >= 0.95
    assert sum(r["rejected"] for r in got) <= 0.005 * len(got)
    assert all(0.0 <= r["score"] <= 1.0 for r in got)


def test_odd_rows(spark):
    rows = [(1, "der die das und nicht ein", "de"), (2, "the and of that is with", "en"), (3, None, "en"), (4, "123 !!", "en"), (5, "THE AND OF", None), (6, "", None), (2, "the and of that is with", "en")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "request_id long, raw string, lang string, score string, found int")
    content = zl.learn_dictionaries(table)
    assert set(content) == {"de", "en"}
    got = zl.identify_language(table, content).collect()
    by_id = {r["request_id"]: r for r in got}
    assert len(got) == len(rows) and by_id[5]["found"] == 1
    assert [by_id[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6)] == ["de", "en", "und", "und", "en", "und"]
    assert [by_id[i]["rejected"] for i in (3, 4, 6)] == [True] * 3
    assert {r["lang_pred"] for r in zl.identify_language(table, {}).collect()} == {"und"}
    assert zl.learn_dictionaries(table.limit(0)) == {} and zl.identify_language(table.limit(0), content).count() == 0


def test_ties_are_rejected():
    coders = zl.compressors({"a": b"xyz ", "b": b"xyz "}, 6)
    assert zl.judge("xyz", coders, 0.002) == ("a", 0.0, True)


def test_dictionaries_are_bounded(spark):
    table = spark.createDataFrame([(i, f"wort{'abc' * 50} " * 20, "de") for i in range(50)], "request_id long, raw string, lang string")
    assert len(zl.learn_dictionaries(table, texts_per_language=10, dictionary_bytes=4096)["de"]) == 4096 + zl.PRIMERS * zl.PRIMER_BYTES


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumnRenamed("doc_id", "request_id").withColumnRenamed("text", "raw")
    return docs, zl.learn_dictionaries(docs)


def test_equals_plain_compression(spark, learned):
    """Each text compressed anew against every dictionary, without prepared coders."""
    docs, content = learned
    texts = docs.filter("length(raw) < 6000").select("request_id", "raw")
    tail = zl.PRIMERS * zl.PRIMER_BYTES
    coders = {}
    for lang, held in content.items():
        words = zstandard.ZstdCompressionDict(held[:-tail], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primers = [held[len(held) - tail + i * zl.PRIMER_BYTES :][: zl.PRIMER_BYTES] for i in range(zl.PRIMERS)]
        coders[lang] = zstandard.ZstdCompressor(level=5, dict_data=words, write_content_size=False), primers

    def size(lang, words):
        coder, primers = coders[lang]
        return max(sum(len(coder.compress(p + words)) - len(coder.compress(p)) for p in primers), 0)

    rows = [r for r in zl.identify_language(texts, content).collect()]
    raws = {r["request_id"]: r["raw"] for r in texts.collect()}
    for r in rows[:200]:
        words = zl.letters_only(raws[r["request_id"]])
        if not words:
            assert r["lang_pred"] == "und" and r["rejected"]
            continue
        (best, lang), (second, _) = sorted((size(lang, words), lang) for lang in coders)[:2]
        assert (r["lang_pred"], r["score"]) == (lang, (second - best) / (second + zl.LEAST_BYTES))


def test_unlearned_languages_and_tiny_texts_are_rejected(spark, learned):
    _, content = learned
    texts = [
        "xx", "olá", "ggg hhh jjj kkk lll",
        "Wszyscy ludzie rodzą się wolni i równi w swojej godności i swoich prawach, są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki ja omatunto.",
    ]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "request_id long, raw string")
    assert [r["rejected"] for r in zl.identify_language(table, content).orderBy("request_id").collect()] == [True] * len(texts)


def test_a_language_left_out_is_rejected(spark, learned):
    """Learned without German: most German texts go, hardly any other text does."""
    docs, _ = learned
    judged = zl.identify_language(docs, zl.learn_dictionaries(docs.filter("lang <> 'de'"))).filter("length(raw) BETWEEN 200 AND 6000")
    share = {r["de"]: r["share"] for r in judged.selectExpr("lang = 'de' AS de", "CAST(rejected AS INT) AS r").groupBy("de").agg({"r": "avg"}).toDF("de", "share").collect()}
    assert share[True] > 0.6 and share[False] < 0.01


def test_long_texts_are_cut_before_they_are_collected(spark):
    table = spark.createDataFrame([(i, "wort " * 200_000, "de") for i in range(3)], "request_id long, raw string, lang string")
    content = zl.learn_dictionaries(table, dictionary_bytes=4096)
    assert len(content["de"]) == 4096 + zl.PRIMERS * zl.PRIMER_BYTES and content.bounds == {}


def test_texts_longer_than_all_measured_have_the_last_bound():
    coders = zl.compressors({"a": b"xyz ", "b": b"uvw "}, 5)
    letters = [chr(97 + i * i * 7 % 26) for i in range(64)]
    text = " ".join("".join(letters[i : i + 5]) for i in range(60))
    assert zl.judge(text, coders, 0.0, {at: 0.1 for at in range(1, 4)})[2]
