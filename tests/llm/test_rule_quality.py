"""The rule ensemble: statistics and scores against plain Python, accuracy on held-out rows."""

import math
import re
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from assayline.llm.queries import QUERIES
from assayline.llm.rule_quality import STATISTICS, Ensemble, Rule, fit_rules, score_responses, with_statistics
from assayline.session import materialise

FOLDER = "/root/testdata/sf0.01"
RESPONSES = "request_id string, attempt int, raw string, score string, Statistics int, accepted int"
BLOCK = "\\begin{tikzpicture}\n\\fill[primary] (0,0) rectangle (21,29.7);\n% LOGO_PLACEMENT x=2 y=3\n\\end{tikzpicture}"


def plain(text):
    text = text or ""
    words, lines = re.findall(r"[^ \t\n\x0b\f\r]+", text), [x for x in text.split("\n") if x.strip(" ")]
    kind = [unicodedata.category(c) for c in text]
    over = lambda a, b: a / max(b, 1)
    letters = sum(k[0] == "L" for k in kind)
    symbols = sum(not (k[0] in "LN" or c in " \t\n\x0b\f\r.,;:!?'\"()-") for c, k in zip(text, kind))
    n = len(words)
    return [
        len(text),
        n,
        over(sum(map(len, words)), n),
        over(letters, len(text)),
        over(kind.count("Lu"), letters),
        over(sum(c in "0123456789" for c in text), len(text)),
        over(sum(c in " \t\n\x0b\f\r" for c in text), len(text)),
        over(sum(c in "!?" for c in text), len(text)),
        over(symbols, len(text)),
        over(sum(len(w) <= 3 for w in words), n),
        math.log(len(set(words))) / math.log(n) if n > 1 else n,
        over(sum(a == b for a, b in zip(words, words[1:])), n),
        over(n, len(lines)),
        over(len(set(lines)), len(lines)),
    ]


@pytest.fixture(scope="module")
def table(spark):
    rows = [("r1", 1, BLOCK, "a", 1, 1), ("r1", 1, BLOCK, "a", 1, 1), ("r2", 1, None, None, None, None), ("r3", 1, "", "b", 2, 0)]
    rows += [(None, 2, "Ärger ärger ärger!! 12 ½\n\n \nx", "c", 3, 0), ("r4", 1, "vazio " * 100_000, "d", 4, 7)]
    return spark.createDataFrame(rows, RESPONSES)


def test_statistics_equal_plain_python(table):
    out = with_statistics(table)
    assert out.columns == ["request_id", "attempt", "score", "accepted", "statistics"]
    texts = [r["raw"] for r in table.collect()]
    for text, row in zip(texts, out.collect()):
        assert tuple(row["statistics"].asDict()) == STATISTICS
        assert list(row["statistics"]) == pytest.approx(plain(text)), text


def test_compiled_rules_equal_plain_rules(table):
    rules = {
        Rule(()).within("n_chars", 0.0, None).within("digit_share", None, 0.2): 1.5,
        Rule(()).within("repeated_word_share", 0.1, None).within("repeated_word_share", 0.05, 0.9): -2.0,
        Rule(()).within("n_words", None, 0.0): 0.25,
    }
    ensemble = Ensemble(-0.5, rules)
    rows = score_responses(with_statistics(table), ensemble).collect()
    for text, row in zip([r["raw"] for r in table.collect()], rows):
        s = dict(zip(STATISTICS, plain(text)))
        z = -0.5 + 1.5 * (s["n_chars"] > 0 and s["digit_share"] <= 0.2) - 2.0 * (0.1 < s["repeated_word_share"] <= 0.9) + 0.25 * (s["n_words"] <= 0)
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-z)))
        assert row["predicted"] == (row["score"] >= 0.3)


def test_one_label_none_and_empty(table):
    judged = with_statistics(table)
    for rows, want in ((judged.filter("accepted = 1"), 3 / 4), (judged.limit(0), 0.5), (judged.filter("accepted IS NULL"), 0.5)):
        ensemble = fit_rules(rows)
        assert not ensemble.weights
        assert score_responses(judged, ensemble).first()["score"] == pytest.approx(want)
    assert score_responses(judged.limit(0), Ensemble()).count() == 0


def test_learns_conjunctions(spark):
    rows = spark.range(4000).select(
        F.col("id").cast("string").alias("request_id"),
        F.struct(*((F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000).alias(n) for i, n in enumerate(("a", "b", "c")))).alias("statistics"),
    )
    rows = materialise(rows.withColumn("accepted", F.expr("int(statistics.a > 0.4 AND statistics.b <= 0.7)")))
    for bound in (100_000, 2_000):
        ensemble = fit_rules(rows, fit_rows=bound)
        scored = score_responses(rows, ensemble, threshold=0.5)
        assert scored.filter("predicted = accepted").count() >= 0.97 * 4000
        assert 0 < len(ensemble.weights) < 60
        assert any({n for n, _, _ in rule.bounds} == {"a", "b"} for rule in ensemble.weights)


def test_query_on_held_out_rows(spark):
    df = QUERIES["op12_rule_quality"](spark, FOLDER)
    assert dict(df.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(held) >= 0.96 * len(held)
