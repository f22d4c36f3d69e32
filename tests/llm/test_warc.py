import gzip
import hashlib

import pytest

from tessera.llm import warc


def test_round_trip(spark):
    body = "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/ b\r\nc", body, 1), (0, "u", body, 1), (0, "u", body, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", "short", 1), (5, "u", "short", 1), (None, "u", body, 1), (6, "u", "y" * 100, 1), (7, "v", "y" * 100, 1), (8, "v", "y" * 99, 1), (9, "v", "y" * 99, 1), (10, "u", "z" * 3_000_000, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = sorted(tuple(r) for r in warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").fillna(-1).collect())
    want = []
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        same = [i for i, _, h, _ in rows if i is not None and (h or "").encode() == data]
        first = min(same, default=None)
        revisit = len(data) >= 100 and page_id is not None and first < page_id
        want.append((-1 if page_id is None else page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else -1))
    assert got == sorted(want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_repeated_ids_with_several_payloads(spark):
    rows = [(1, "u", "a" * 200), (1, "u", "b" * 5000), (2, "u", "a" * 200), (3, "u", "b" * 5000)]
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(1, 200, "response", None), (1, 5000, "response", None), (2, 200, "revisit", 1), (3, 5000, "revisit", 1)}


def test_parse_rejoins_records_that_hold_separators():
    record = lambda payload: b"WARC/1.1\r\nA: b\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(payload), payload)
    payloads = [b"", b"\r\n\r\nWARC/1.1\r\n", b"x\r\n\r\nWARC/1.1\r\n\r\n\r\nWARC/1.1\r\ny", b"\r\n\r\n", b"WARC/1.1\r\n", b"plain"]
    files = [b"".join(map(record, x)) for x in (payloads, payloads[::-1], payloads[:1])]
    parts = [p for f in files for p in f.split(b"\r\n\r\nWARC/1.1\r\n")]
    assert [p for _, p in warc.parse(parts)] == [*payloads, *payloads[::-1], b""]
    with pytest.raises(ValueError):
        list(warc.parse([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"]))
    with pytest.raises(ValueError):
        list(warc.parse([b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc"]))


def test_record_ids(spark, tmp_path):
    body, path = "x" * 100, f"file://{tmp_path}/archives"
    rows = [(1, "u", body), (1, "u", "y" * 100), (1, "u", "short"), (2, "u", body), (None, "u", body), (None, "u", body)]
    warc.write(warc.resolve(spark.createDataFrame(rows, "page_id long, url string, html string")), path)
    names = sorted(str(p) for p in (tmp_path / "archives").glob("*.gz"))
    heads = [h for n in names for h, _ in warc.parse(gzip.open(n).read().split(b"\r\n\r\nWARC/1.1\r\n"))]
    assert len({h["WARC-Record-ID"] for h in heads}) == len(rows)  # no two records share an id
    (revisit,) = [h for h in heads if h["WARC-Type"] == "revisit"]
    (first,) = [h for h in heads if h["WARC-Record-ID"] == revisit["WARC-Refers-To"]]
    assert first["Page-ID"] == "1" and first["WARC-Payload-Digest"] == revisit["WARC-Payload-Digest"] and first["Content-Length"] == "100"


def test_session_keeps_its_settings(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    warc.round_trip(spark.createDataFrame([(1, "u", "x" * 5_000_000)] * 3, "page_id long, url string, html string")).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
