import pytest
from pyspark.sql import functions as F

from assayline.operators.blocks import COVER_MARKER
from assayline.operators.quarantine import accepted, rejected
from assayline.plans.covers import conform_responses
from assayline.plans.incidents import incident_windows, log_reports
from assayline.sources.readers import read_brands, read_images, read_log_lines, read_texts
from assayline.sources.writers import append_responses, compose, write_artifacts, write_quarantine, write_texts

MACROS = r"\BookTitle \BookSubtitle \BookDescription \BookAuthor \BookDate \BookVersion"
BLOCK = (
    COVER_MARKER + "{%\n\\definecolor{light}{HTML}{FEFEFE}\n\\definecolor{own}{HTML}{123456}\n"
    "\\begin{tikzpicture}\n\\fill[light] (-1,-1) rectangle (22,31);\n"
    "% LOGO_PLACEMENT x=2.0 y=27.2 height=1.2 bg=light\n" + MACROS + "\n\\end{tikzpicture}%\n}"
)
ACME = """{"company": "Acme Works", "series": "Acme Books", "colors": {
  "bg_primary": "#4038FF", "accent_2": "#3B3CD0", "light": "#FFFFFF", "muted": "#757576"},
  "logos": {"dark": "d", "light": "l", "alt": "a"}, "logo_height_cm": 1.5, "logo_position": [1.5, 27.0]}"""


def test_brands_and_covers(spark, tmp_path):
    for name, text in {"acme": ACME, "broken": '{"colors": {"light": "#12"}}', "torn": '{"colors": '}.items():
        (tmp_path / "brands" / name).mkdir(parents=True)
        (tmp_path / "brands" / name / "brand.json").write_text(text, encoding="utf-8")
    brands = read_brands(spark, str(tmp_path / "brands"))
    assert {r.brand for r in brands.collect()} == {"acme", "broken", "torn"}
    assert [r.brand for r in brands.filter("_corrupt_record IS NOT NULL").collect()] == ["torn"]

    rows = [
        ("r1", "acme", 1, "m1", None, "503 UNAVAILABLE"),
        ("r1", "acme", 2, "m2", BLOCK[:-1], None),
        ("r1", "acme", 3, "m3", "```latex\n" + BLOCK + "\n```", None),
        ("r1", "acme", 4, "m4", "unused", None),
        ("r2", "acme", 1, "m1", None, "401 bad key"),
        ("r2", "acme", 2, "m2", BLOCK, None),
        ("r3", "acme", 1, "m1", "prose", None),
        ("r3", "acme", 2, "m2", "", None),
        ("r4", "broken", 1, "m1", BLOCK, None),
        ("r5", "nobody", 1, "m1", BLOCK, None),
        ("r6", None, 1, "m1", BLOCK, None),
        ("r7", "acme", 1, "m1", None, "boom"),
        ("r8", "", 1, "m1", BLOCK, None),
        ("r9", "empty", 1, "m1", BLOCK, None),
        ("r10", "flat", 1, "m1", BLOCK, None),
    ]
    responses = spark.createDataFrame(rows, "request_id string, brand string, attempt int, model string, raw string, error string")
    good = brands.filter("_corrupt_record IS NULL")
    empty = F.create_map().cast("map<string,string>")
    listed = good.unionByName(good.filter("brand = 'acme'").withColumn("brand", F.lit("empty")).withColumn("colors", empty)).unionByName(
        good.filter("brand = 'acme'").withColumn("brand", F.lit("flat")).withColumn("logo_height_cm", F.lit(0.0))
    )
    done = conform_responses(responses, listed).cache()
    got = {r.request_id: r for r in done.collect()}
    assert len(got) == 10 and accepted(done).count() + rejected(done).count() == 10
    assert {k: r.reject_reason for k, r in got.items()} == {
        "r1": None, "r2": "aborted: no complete block", "r3": "exhausted: no complete block",
        "r4": "invalid values: light=#12", "r5": "unknown brand", "r6": None, "r7": "aborted: no complete block",
        "r8": None, "r9": None, "r10": "no native height",
    }
    for name in ("r6", "r8", "r9"):  # no brand, or one without colours
        assert got[name].off_reference == [] and got[name].tone is None and got[name].artifact.endswith("\n" + BLOCK + "\n")
    first = got["r1"]
    assert (first.attempts, first.winner, first.off_reference, first.variant, first.background) == (3, "m3", ["own"], "light", "FFFFFF")
    assert abs(first.scale - 0.8) < 1e-9 and first.logo_at == [2.0, 27.2] and first.tone == "light" and first.warnings == []
    lines = first.artifact.splitlines()
    assert lines[0] == "% Auto-generated (brand: acme) - generated, edits will be lost"
    assert "\\definecolor{VSRed}{HTML}{757576}" in lines and "\\definecolor{VSCoverFg}{HTML}{1A1A1A}" in lines
    assert "\\definecolor{light}{HTML}{FFFFFF}" in lines and "\\definecolor{own}{HTML}{123456}" in lines
    assert first.artifact.endswith("\\end{tikzpicture}%\n}\n")
    assert got["r3"].rejected_payload == "prose"
    assert got["r6"].artifact == "% Auto-generated - generated, edits will be lost\n" + BLOCK + "\n" and got["r6"].variant is None

    write_artifacts(accepted(done).select("request_id", "brand", "artifact"), str(tmp_path / "out"))
    write_quarantine(done.select("request_id", "reject_reason", "rejected_payload"), str(tmp_path / "bad"))
    append_responses(responses, str(tmp_path / "raw"))
    append_responses(responses, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 6
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 30


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "x", None), ("r2", "y", "torn"), ("r3", "z", "torn")], "request_id string, raw string, reject_reason string")
    kept, bad = str(tmp_path / "raw"), str(tmp_path / "bad")
    for batch in ("2024-01-01", "b", "b"):
        append_responses(rows, kept, batch)
        write_quarantine(rows, bad, batch=batch)
    got = sorted((str(r.batch), r.request_id) for r in spark.read.parquet(kept).collect())
    assert got == [("2024-01-01", f"r{i}") for i in (1, 2, 3)] + [("b", f"r{i}") for i in (1, 2, 3)]
    assert spark.read.parquet(bad).count() == 4
    # Mended rows: the second run of the batch has no rejects, and none of the first run's stay.
    write_quarantine(rows.withColumn("reject_reason", F.lit(None).cast("string")), bad, batch="b")
    assert [r.batch for r in spark.read.schema(rows.schema.add("batch", "string")).parquet(bad).collect()] == ["2024-01-01"] * 2
    with pytest.raises(ValueError):
        append_responses(rows, kept, "a/b")


def test_artifacts_as_text_files(spark, tmp_path):
    texts = {"r1": "% a\n\\begin{x}\né\n\\end{x}\n\n", "r/2": "one line\n", "r3": "\n"}
    rows = spark.createDataFrame([*texts.items(), ("r4", None)], "request_id string, artifact string")
    out = tmp_path / "tex"
    for _ in range(2):  # written again, nothing doubles
        write_texts(rows.repartition(3), str(out))
    files = {p.parent.name.removeprefix("request_id="): p.read_bytes() for p in out.glob("*/part-*")}
    assert files == {k.replace("/", "%2F"): t.encode() for k, t in texts.items()}
    write_texts(spark.createDataFrame([("r3", "new\n")], "request_id string, artifact string"), str(out))
    assert len(list(out.glob("*/part-*"))) == 3
    made = rows.select(compose(F.lit("c"), F.col("request_id")).alias("t")).first().t
    assert made.endswith("\n")


def test_text_and_image_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("é", encoding="utf-8")
    got = {r.file.rsplit("/", 1)[1]: r.raw for r in read_texts(spark, str(tmp_path / "*.txt")).collect()}
    assert got == {"a.txt": "one\ntwo\n", "b.txt": "é"}
    (tmp_path / "c.png").write_bytes(b"\x89PNG")
    row = read_images(spark, str(tmp_path / "*.png")).first()
    assert bytes(row.content) == b"\x89PNG" and row.length == 4
    assert "content" not in read_images(spark, str(tmp_path / "*.png"), content=False).columns


def test_log_lines_number_like_the_origin(spark, tmp_path):
    texts = {
        "plain": "a\nb\nc", "ended": "a\nb\n", "blank": "\n\n", "crlf": "a\r\nb\r\n", "cr": "a\rb\r", "mixed": "a\x0bb\x0c\nc\x1cd",
        "open": "x\ny\x0b", "open_cr": "x\n\r", "closed": "x\ny\x0b\n", "both": "a\x0b\r", "wide": "é\u2028z\x85", "one": "a\x1e",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode("utf-8"))
    (tmp_path / "bytes").write_bytes(b"ok\nbad\xff\xfe\nend")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7")
    try:
        rows = read_log_lines(spark, str(tmp_path)).collect()
        sliced = read_log_lines(spark, str(tmp_path), rows_per_slice=3).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128MB")
    got = {}
    for r in rows:
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_no] = r.line
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sliced))
    want = {n: t.splitlines() for n, t in texts.items()}
    want["bytes"] = b"ok\nbad\xff\xfe\nend".decode("utf-8", "replace").splitlines()
    assert {n: [v[i] for i in sorted(v)] for n, v in got.items()} == want
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())


def test_incidents_with_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 40)).alias("k"),
        "id",
        (F.col("id") % 5 == 0).alias("bad"),
        (F.col("id") % 11).cast("string").alias("s"),
        F.lit(1.0).alias("v"),
    )
    plain = incident_windows(df, ["k"], ["id"], F.col("bad"), "s", "v")
    cut = incident_windows(df, ["k"], ["id"], F.col("bad"), "s", "v", rows_per_slice=25, fold_lines=16, fold_group=4)
    assert plain.count() == cut.count() > 40
    assert plain.exceptAll(cut).count() == 0
    hot = [i for i in range(0, 3000, 3)]
    starts, free = [], 0
    for n, i in enumerate(hot, 1):
        if i % 5 == 0 and n >= free:
            starts.append(n)
            free = n + 10
    every = incident_windows(df, ["k"], ["id"], F.col("bad"), "s", "v", dedup=False)
    assert sorted(r.start_line for r in every.filter("k = 'hot'").collect()) == starts


def test_log_reports(spark):
    lines = spark.createDataFrame(
        [("a", 1, "! x"), ("a", 2, "detail"), ("b", 1, "quiet")], "file string, line_no bigint, line string"
    )
    files = spark.createDataFrame([("a",), ("b",), ("empty",), (None,)], "file string")
    got = {r.file: r.text for r in log_reports(lines, ["file"], 10, files).collect()}
    assert got["a"] == "--- Error block 1 ---\n! x\ndetail"
    assert got["b"].startswith("--- Error block 1 ---\n[no structured error")
    assert got["empty"] == got[None] == got["b"] and len(got) == 4
    assert {r.file for r in log_reports(lines, ["file"], 10).collect()} == {"a", "b"}


def test_materialise_writes_below_the_folder_of_the_session(spark):
    from pathlib import Path

    from assayline.session import CHECKPOINT_CONF, checkpoint_dir, materialise

    folder = checkpoint_dir(spark)
    assert folder == (spark.conf.get(CHECKPOINT_CONF, None) or folder)
    before = set(Path(folder).iterdir()) if Path(folder).exists() else set()
    assert materialise(spark.range(5)).count() == 5
    assert len(set(Path(folder).iterdir()) - before) == 1


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    import pytest

    from assayline.session import checkpoint_dir

    def session(master, folder=None):
        context = SimpleNamespace(master=master, applicationId="app", getCheckpointDir=lambda: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: folder))

    assert checkpoint_dir(session("local[8]")).endswith("assayline-app") and checkpoint_dir(session("local"))
    assert checkpoint_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_dir(session(master))
