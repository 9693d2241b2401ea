import gzip
import uuid
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from juryframe.llm import common, warc
from juryframe.llm.queries import op10_warc

WRITE = uuid.UUID(int=7)
PAGES = "page_id long, url string, html string, id long, payload string, value string"


@pytest.fixture(scope="module")
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, None, None, None) for r in rows], PAGES)


@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunked_round_trip(payload, size):
    assert warc.dechunked(warc.chunked(payload, size)) == (payload, True)
    assert not payload or not warc.dechunked(warc.chunked(payload, size)[:-6])[1]


@given(st.binary(max_size=400), st.integers(80, 200))
def test_records_round_trip(payload, segment):
    records = list(warc.page_records(WRITE, 7, "0-1", "http://a/ü b", "response", None, payload, segment))
    data = b"".join(r + b"\r\n\r\n" for r in records)
    for archive in (data, gzip.compress(data)):
        parsed = list(warc.parse_records(archive))
        block = b"".join(b for _, b in parsed)
        assert warc.dechunked(block.partition(b"\r\n\r\n")[2]) == (payload, True)
        assert all(len(b) <= segment for _, b in parsed)
        assert [f.get("warc-segment-number") for f, _ in parsed] == ([None] if len(parsed) == 1 else [str(i) for i in range(1, len(parsed) + 1)])
        assert len(parsed) == 1 or parsed[-1][0]["warc-segment-total-length"] == str(len(block))


def expected(rows, least=0):
    payloads = [(r[2] or "").encode() for r in rows]
    firsts = defaultdict(list)
    for r, p in zip(rows, payloads, strict=True):
        if r[0] is not None and len(p) >= least:
            firsts[p].append(r[0])
    out = []
    for r, p in zip(rows, payloads, strict=True):
        first = min(firsts[p], default=None)
        revisit = first is not None and r[0] != first
        out.append((r[0], len(p), warc.payload_digest(p), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_archives(spark, pages, tmp_path):
    rows = [(1, "http://a/", "x"), (2, "http://b/", "x"), (3, None, None), (4, "http://c/\r\nX: y", ""), (5, "http://ü/", "é" * 40_000), (6, "", "é" * 40_000), (7, "http://d/", "\r\n\r\nWARC/1.1\r\n\r\n" * 9), (8, "http://e/", "z"), (8, "http://e/", "z"), (None, "http://f/", "z"), (None, "http://g/", "only here"), (9, "http://h/", "漢😀" * 30_000)]
    path = str(tmp_path / "warc")
    warc.write_warc(pages(rows).repartition(3), path, segment=1000)
    found = warc.read_warc(spark, path).collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found], key=str) == expected(rows)
    assert all(r["whole"] for r in found)
    by = {r["page_id"]: bytes(r["payload"]) for r in found if r["record_type"] == "response" and r["page_id"] is not None}
    assert by[5] == ("é" * 40_000).encode() and by[9] == ("漢😀" * 30_000).encode() and by[7] == rows[6][2].encode()
    files = list((tmp_path / "warc").glob("part-*"))
    assert any(files) and all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n") for f in files)
    # Each record is a member of its own, and each has its own id.
    ids = [next(f for f, _ in warc.parse_records(m))["warc-record-id"] for file in files for m in warc._members(file.read_bytes())]
    assert len(ids) == len(set(ids)) > len(rows) and all(i.startswith("<urn:uuid:") for i in ids)


def test_plain_archives(spark, pages, tmp_path):
    rows = [(1, "http://a/", "x" * 5000), (2, None, "y")]
    warc.write_warc(pages(rows), str(tmp_path / "warc"), segment=1000, compressed=False)
    assert {f.read_bytes()[:8] for f in (tmp_path / "warc").glob("part-*")} - {b""} == {b"WARC/1.1"}
    found = {r["page_id"]: r for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert all(r["whole"] for r in found.values()) and bytes(found[1]["payload"]) == b"x" * 5000 and found[2]["url"] is None


def test_two_archives_together(spark, pages, tmp_path):
    rows = [(1, "http://a/", "x" * 100_000), (2, "http://b/", "y")]
    paths = [str(tmp_path / c) for c in "ab"]
    for p in paths:
        warc.write_warc(pages(rows), p)
    for where in (paths, [str(tmp_path / "*")]):
        found = warc.read_warc(spark, where).collect()
        assert sorted((r["page_id"], len(r["payload"]), r["whole"]) for r in found) == [(1, 100_000, True)] * 2 + [(2, 1, True)] * 2


def test_files_are_bounded_by_bytes(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ROWS_A_FILE", 1)
    import random

    noise = [random.Random(i).randbytes(200_000).hex() for i in range(12)]
    warc.write_warc(pages([(i, None, x) for i, x in enumerate(noise)]).coalesce(1), str(tmp_path / "warc"))
    sizes = [f.stat().st_size for f in (tmp_path / "warc").glob("part-*")]
    assert len(sizes) > 1 and max(sizes) < warc.ROW_BYTES + 100_000
    assert sorted(r["payload_bytes"] for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()) == [400_000] * 12


def test_filter_decides_nothing(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 8)
    rows = [(i, None, f"text {i % 40}") for i in range(100)]
    warc.write_warc(pages(rows), str(tmp_path / "warc"))
    found = warc.read_warc(spark, str(tmp_path / "warc")).collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found], key=str) == expected(rows)


def test_malformed_records_are_told(spark, tmp_path):
    a, b, c = (next(warc.page_records(WRITE, i, str(i), None, "response", None, b"x" * 9, 10_000)) for i in (1, 2, 3))
    d = list(warc.page_records(WRITE, 4, "4", None, "response", None, b"x" * 900, 300))
    bad = [a.replace(b"Content-Length: ", b"Content-Length: many", 1), b, d[0], d[1].replace(b"Segment-Number: 2", b"Segment-Number: two"), *d[2:], c[:-4]]
    (tmp_path / "warc").mkdir()
    (tmp_path / "warc/a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in bad[:-1]) + bad[-1])
    packed = [gzip.compress(r + b"\r\n\r\n") for r in (b, c)]
    (tmp_path / "warc/b.warc.gz").write_bytes(packed[0][:40] + b"\0" * 20 + packed[0][60:] + packed[1])
    found = sorted((r["page_id"], r["whole"]) for r in warc.read_warc(spark, str(tmp_path / "warc")).collect())
    assert [x for x in found if x[1]] == [(2, True), (3, True)] and {1, 3, 4} <= {i for i, whole in found if not whole}


def test_least_bytes(spark, pages, tmp_path):
    rows = [(1, None, "ab"), (2, None, "ab"), (3, None, "abc"), (4, None, "abc")]
    path = str(tmp_path / "warc")
    warc.write_warc(pages(rows), path, least_bytes=3)
    found = warc.read_warc(spark, path, with_payload=False).collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found], key=str) == expected(rows, 3)


def test_missing_segment_is_told(spark, tmp_path):
    records = list(warc.page_records(WRITE, 1, "0-1", None, "response", None, b"x" * 900, 300))
    (tmp_path / "warc").mkdir()
    (tmp_path / "warc/a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in [*records[:1], *records[2:]]))
    found = warc.read_warc(spark, str(tmp_path / "warc")).collect()
    assert [(r["page_id"], r["whole"]) for r in found] == [(1, False)]


def test_empty(spark, pages, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_warc(pages([]), path)
    assert warc.read_warc(spark, path).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted([tuple(r) for r in op10_warc(spark, sf_dir).collect()], key=str) == expected(rows)


def test_all_longs_survive(spark, tmp_path):
    """Ids at both ends of the range, and the numbers around a power of ten, for pages and for what they refer to."""
    ids = [2**63 - 1, -(2**63), 9_100_000_000_000_000_000, -9_200_000_000_000_000_000, 8_999_999_999_999_999_999, 10**18, -(10**18), 0, -1]
    rows = [(i, f"http://a.b/{k}", f"page {k}") for k, i in enumerate(ids)] + [(i + (1 if i < 0 else -1), None, f"page {k}") for k, i in enumerate(ids[:4])]
    path = str(tmp_path / "archive")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    found = warc.read_warc(spark, path).collect()
    assert sorted(r["page_id"] for r in found) == sorted(r[0] for r in rows)
    firsts = {html: min(r[0] for r in rows if r[2] == html) for _, _, html in rows}
    assert all(r["refers_to"] == (None if r["page_id"] in firsts.values() else firsts[next(x[2] for x in rows if x[0] == r["page_id"])]) for r in found)


@pytest.mark.parametrize("text", ["9223372036854775808", "-9223372036854775809", "99999999999999999999", "+1", "1.0", " 1", "", "\u0661"])
def test_no_other_text_is_an_id(text):
    assert warc._long(text) is None
