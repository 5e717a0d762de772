import gzip
import hashlib
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegraph.llm import warc


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 64))
def test_chunked_round_trip(payload, size):
    assert warc.unchunked(warc.chunked(payload, size)) == payload


def test_chunk_extensions_and_trailers():
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"3\r\nab", b"zz\r\n", b"2\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_reassembly_checks_numbers_and_total():
    assert warc.reassembled([(2, b"b"), (1, b"a")], 2) == b"ab"
    for parts, total in (([(1, b"a"), (3, b"c")], 2), ([(1, b"a"), (1, b"a")], 2), ([(1, b"a")], 2), ([(1, b"a")], None)):
        with pytest.raises(ValueError):
            warc.reassembled(parts, total)


def test_segments_are_records_of_one_origin():
    ids = iter(f"<id{k}>" for k in range(9))
    data = b"".join(warc.segments([], "response", "<first>", b"x" * 25, 10, lambda: next(ids)))
    found = list(warc.records(io.BytesIO(data)))
    assert [f["warc-type"] for f, _ in found] == ["response", "continuation", "continuation"]
    assert [f.get("warc-segment-number") for f, _ in found] == ["1", "2", "3"] and found[-1][0]["warc-segment-total-length"] == "25"
    assert {f["warc-segment-origin-id"] for f, _ in found[1:]} == {"<first>"}
    assert list(warc.records(io.BytesIO(gzip.decompress(data)))) == found
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.decompress(data)[:-20])))


def _expected(rows):
    first = {}
    for key, _, page in rows:
        payload = (page or "").encode()
        if len(payload) >= warc.LEAST_PAYLOAD and key is not None:
            first[payload] = min(key, first.get(payload, key))
    out = []
    for key, _, page in rows:
        payload = (page or "").encode()
        to = first.get(payload)
        again = to is not None and to != key
        out.append((key, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def test_round_trip_of_odd_pages(spark):
    same, long = "<p>" + "same " * 40 + "</p>", "<p>" + "lang ☃ " * 20_000
    rows = [(5, "http://a/1", same), (3, "http://a/2", same), (4, None, same), (None, "http://a/3", same), (6, "http://a b/4", long), (7, "", None), (8, "u", ""), (9, "u", "short"), (10, "u", "short"), (3, "http://a/2", same), (11, "u", long + "x"), (12, "u", "\r\n0\r\n\r\n" * 30)]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, digest string, path string").repartition(3)
    got = warc.archive_pages(spark, pages).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == _expected(rows)


def test_lost_segment_is_reported(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "y" * 50_000)], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/a").collect()
    main = [r for r in manifest if "-main" in r.path]
    got = warc.read_archives(spark.createDataFrame(main, "path string"), f"file://{tmp_path}/w").first()
    assert got.page_id == 1 and got.payload_digest is None and "record" in got.error


def test_empty_table(spark):
    assert warc.archive_pages(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
