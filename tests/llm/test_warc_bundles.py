"""Round trips through bundles: whole files, single frames and single records."""

import io

import pytest
import zstandard

from assayline.llm import warc_bundles as wb


def table(spark, rows):
    return spark.createDataFrame([(k, u, t, "x") for k, u, t in rows], "request_id long, uri string, raw string, payload string")


ROWS = [
    (3, "http://a/x", "same"),
    (1, "http://a/y", "same"),
    (2, None, None),
    (7, "http://a/\r\nz", ""),
    (9, "http://b", "é" * 50_000 + "\r\n\r\nWARC/1.1\r\n"),
    (11, "http://b", "\x00\x01 odd"),
    (None, "http://c", "same"),
]


@pytest.fixture()
def archive(spark, tmp_path):
    folder = str(tmp_path / "archive")
    more = [(100 + i, f"http://n/{i}", f"page {i} " * 200) for i in range(200)]
    wb.write_bundles(table(spark, ROWS + more), folder, frame_bytes=4096, bundle_bytes=100_000)
    return folder, ROWS + more


def test_round_trip(spark, archive):
    folder, rows = archive
    got = {r["request_id"]: r for r in wb.read_bundles(spark, folder).collect()}
    assert len(got) == len(rows)
    for key, _, text in rows:
        payload, r = (text or "").encode(), got[key]
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == wb.digest(payload)
        if r["record_type"] == "response":
            assert r["payload"] == payload and r["refers_to"] is None
    assert [got[k]["record_type"] for k in (1, 3, None, 2, 7)] == ["response", "revisit", "revisit", "response", "revisit"]
    assert got[3]["refers_to"] == got[None]["refers_to"] == 1 and got[7]["refers_to"] == 2


def test_files_are_plain_zstandard_with_a_seek_table(spark, archive):
    folder, rows = archive
    files = [r["content"] for r in spark.read.format("binaryFile").load(folder).collect() if r["length"]]
    assert len(files) > 1 and sum(len(wb.seek_table(f)) for f in files) > len(files)
    text = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f), read_across_frames=True).read() for f in files)
    assert text.count(b"WARC-Record-ID") == len(rows)
    for f in files:
        for place in wb.seek_table(f):
            assert wb.read_frame(f, place).startswith(b"WARC/1.1\r\n")


def test_records_by_index(spark, archive):
    folder, _ = archive
    index = wb.read_bundles(spark, folder, payloads=False)
    assert index.filter("payload is not null").count() == 0
    got = wb.fetch_records(spark, folder, index, index["request_id"].isin(9, 150)).collect()
    assert {r["request_id"]: r["payload"] for r in got} == {9: ROWS[4][2].encode(), 150: ("page 50 " * 200).encode()}


def test_least_bytes_and_repeated_rows(spark, tmp_path):
    folder = str(tmp_path / "a")
    wb.write_bundles(table(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc"), (3, "u", "abc")]), folder, least_bytes=3)
    got = sorted((r["request_id"], r["record_type"]) for r in wb.read_bundles(spark, folder).collect())
    assert got == [(1, "response"), (2, "response"), (3, "response"), (3, "response"), (4, "revisit")]


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "a")
    wb.write_bundles(spark.createDataFrame([], "request_id long, uri string, raw string"), folder)
    assert wb.read_bundles(spark, folder).count() == 0


def test_text_ids(spark, tmp_path):
    """Ids of the table of responses are text: their order decides, and any text comes back."""
    folder = str(tmp_path / "a")
    ids = ["req-b", "req-a", "", "é> \r\n%41", "10", "9", None]
    rows = spark.createDataFrame([(k, f"u{n}", "same" if n < 3 else f"own {n}") for n, k in enumerate(ids)], "request_id string, uri string, raw string")
    wb.write_bundles(rows, folder)
    index = wb.read_bundles(spark, folder, key_type="string")
    got = {r["request_id"]: r for r in index.collect()}
    assert set(got) == set(ids)
    assert {k for k in ids if got[k]["record_type"] == "revisit"} == {"req-a", "req-b"} and got["req-a"]["refers_to"] == ""
    one = wb.fetch_records(spark, folder, index, index["request_id"] == "10").collect()
    assert [(r["request_id"], bytes(r["payload"])) for r in one] == [("10", b"own 4")]
