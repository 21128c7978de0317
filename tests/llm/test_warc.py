import io

import pytest

from quireframe.llm import warc
from quireframe.llm.common import Cut, new_folder
from quireframe.llm.contract import op5_warc


def plain(rows):
    """By hand: page_id to (payload_bytes, payload_digest, record_type, refers_to)."""
    last = {}
    for d, h in rows:
        last[h or ""] = max(last.get(h or "", d), d)
    out = {}
    for d, h in rows:
        raw = (h or "").encode()
        own = last[h or ""] == d
        out[d] = (len(raw), warc.payload_digest(raw), "response" if own else "revisit", None if own else last[h or ""])
    return out


def test_query(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op5_warc(spark, sf).collect()}
    assert got == plain(rows)


def test_round_trip_of_hard_rows(spark):
    rows = [(1, "<p>a"), (2, "<p>a"), (3, None), (4, ""), (5, "x" * 3_000_000), (6, "é\r\n\r\n\0"), (7, "<p>a")]
    pages = spark.createDataFrame([(d, f"http://h/{d}\r\nX: y", h, "clash") for d, h in rows] + [(None, None, "only", "")], "page_id long, url string, html string, payload string")
    folder = new_folder(spark, "test")
    files = Cut(spark)(warc.write(warc.refer(pages, Cut(spark)), folder), "files")
    got = warc.read(files).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 8 and {d: tuple(by[d][k] for k in ("payload_bytes", "payload_digest", "record_type", "refers_to")) for d, _ in rows} == plain(rows)
    assert all(bytes(by[d].payload) == ((h or "").encode() if by[d].record_type == "response" else b"") for d, h in rows)
    assert by[None].record_type == "response" and by[5].url == "http://h/5X: y"
    assert warc.round_trip(pages.limit(0)).count() == 0
    small = {r.page_id: r.record_type for r in warc.round_trip(pages, least_bytes=5).collect()}
    assert small[1] == small[3] == "response"


def test_more_pages_than_the_dictionary_has_samples(spark):
    pages = spark.range(0, 700, 1, 2).selectExpr("id AS page_id", "'u' AS url", "concat('<p>some words and page ', id DIV 2) AS html")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    got = warc.round_trip(pages).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == plain(rows) and len(got) == 700


def archive(records, dictionary=b""):
    out = io.BytesIO()
    warc.write_archive(records, out, dictionary)
    return out.getvalue()


def test_dictionary_and_frames():
    records = [warc.record(i, f"http://h/{i}", f"<html><p>some common words {i}".encode() * 3, warc.payload_digest(f"<html><p>some common words {i}".encode() * 3), None) for i in range(300)]
    dictionary = warc.train_dictionary(records)
    data = archive(records, dictionary)
    assert dictionary and len(data) < len(archive(records)) and int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    for piece in (7, 100, 1 << 20):
        assert list(warc.read_archive(io.BytesIO(data), piece)) == records
    assert list(warc.read_archive(io.BytesIO(archive(records)))) == records and list(warc.read_archive(io.BytesIO(b""))) == []


def test_broken_archives():
    record = warc.record(1, "u", b"payload", warc.payload_digest(b"payload"), None)
    data = archive([record, record])
    for bad in (data[:-1], data[:10], b"junk" + data, data + b"junk of some length", data[:30] + bytes([data[30] ^ 1]) + data[31:]):
        with pytest.raises(warc.BrokenArchive):
            list(warc.read_archive(io.BytesIO(bad)))
    assert warc.parse(record)[1] == b"payload"
    for bad in (record.replace(b"payload\r", b"payloae\r"), record[:-1], record.replace(b"WARC/1.1", b"WARC/9.9"), record.replace(b"Content-Length: 6", b"Content-Length: 7"), record.replace(b"WARC-Type: response\r\n", b"")):
        with pytest.raises(warc.BrokenArchive):
            warc.parse(bad)


def test_records_have_a_date_and_an_id_of_their_own(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>same"), (1, "http://a/", "<p>same"), (9, "http://b/", "<p>same")], "page_id long, url string, html string")
    files = Cut(spark)(warc.write(warc.refer(pages.coalesce(1), Cut(spark)), new_folder(spark, "test")), "files").collect()
    found = []
    for f in files:
        system, at = warc.store_of(f.path)
        with system.open_input_stream(at) as source:
            found += [warc.parse(x)[0] for x in warc.read_archive(source)]
    assert len({h["warc-record-id"] for h in found}) == 3 and all(h["warc-date"].endswith("Z") for h in found)
    assert {h["warc-refers-to-target-uri"] for h in found if h["warc-type"] == "revisit"} == {"http://b/"}
    whole = warc.record(1, "u", b"x", warc.payload_digest(b"x"), None)
    with pytest.raises(warc.BrokenArchive):
        warc.parse(whole.replace(b"WARC-Date: 1970-01-01T00:00:00Z\r\n", b""))
