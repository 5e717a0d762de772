import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegraph.llm import tiff


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_pages_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(compression)
    images = [rng.integers(0, high, shape).astype(kind) for shape, high in (((5, 7, 1), 256), ((40, 33, 3), 4), ((90, 70, 1), 256)) for kind in (np.uint8, np.uint16)]
    data = tiff.write(images, tiff.Layout(compression, predictor, 8, tile), [f"page {k}" for k in range(len(images))], order)
    found = list(tiff.pages(data))
    assert len(found) == len(images) and [p.description for p in found] == [f"page {k}" for k in range(len(images))]
    assert all((p.pixels == i).all() for p, i in zip(found, images, strict=True))


@settings(max_examples=80, deadline=None)
@given(st.one_of(st.binary(max_size=600), st.lists(st.integers(0, 2), max_size=9000).map(bytes)))
def test_codecs(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_long_lzw_restarts_its_table():
    data = np.random.default_rng(0).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_floating_point_predictor():
    x = np.random.default_rng(2).normal(size=(3, 5, 1)).astype("<f4")
    planes = x.astype(">f4").view(np.uint8).reshape(3, 5, 4).transpose(0, 2, 1).reshape(3, 20)
    coded = np.diff(planes, axis=1, prepend=np.zeros((3, 1), np.uint8)).astype(np.uint8)
    assert (tiff._unpredict(coded.view("<f4").reshape(3, 5, 1), 3) == x).all()


def test_broken_files_give_an_error_row(spark):
    good = tiff.write([np.zeros((2, 2, 1), np.uint8), np.ones((2, 2, 1), np.uint8)])
    ring = bytearray(good)
    rows = [(1, good), (2, b"II"), (3, b"not a tiff at all"), (4, good[: len(good) // 2]), (5, None), (None, bytes(ring))]
    out = tiff.read_pages(spark, spark.createDataFrame(rows, "key long, media binary")).collect()
    by = {}
    for r in out:
        by.setdefault(r.key, []).append(r)
    assert [r.page for r in by[1]] == [0, 1] and bytes(by[1][1].pixels) == b"\1" * 4 and by[1][0].width == 2
    assert by[2][0].error and by[3][0].error and by[4][-1].error and 5 not in by and len(by[None]) == 2


def test_texts_as_media(spark, odd_docs, odd_rows):
    got = tiff.media_features(spark, odd_docs).collect()
    want = []
    for key, text in odd_rows:
        raw = (text or "").encode()
        size = max(192, -(-len(raw) // 192) * 192)
        padded = raw.ljust(size, b" ")
        want.append((key, len(raw), size, hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == sorted(want, key=str)
    same = [r for r in got if r.doc_id in (5, 6)]
    assert len({(r.media_sha256, r.feature, r.media_bytes) for r in same}) == 1


def _with_tag(data, tag, count=None, kind=None, value=None):
    """data with fields of a tag of its first directory replaced."""
    import struct

    out = bytearray(data)
    (at,) = struct.unpack_from("<I", out, 4)
    for k in range(struct.unpack_from("<H", out, at)[0]):
        place = at + 2 + 12 * k
        if struct.unpack_from("<H", out, place)[0] == tag:
            for offset, form, x in ((2, "<H", kind), (4, "<I", count), (8, "<I", value)):
                if x is not None:
                    struct.pack_into(form, out, place + offset, x)
    return bytes(out)


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_corrupt_pages_give_an_error_row(spark, compression):
    """Strips cut or overwritten, tags without values, and a description that isn't text end no job."""
    image = np.random.default_rng(3).integers(0, 256, (40, 8, 3)).astype(np.uint8)
    good = tiff.write([image], tiff.Layout(compression, 2, 8), ["text"])
    bad = [good[:8] + b"\xff" * 40 + good[48:], good[:8] + b"\0" * 40 + good[48:]]
    bad += [_with_tag(good, t, count=0) for t in (tiff.WIDTH, tiff.BITS, tiff.COMPRESSION, tiff.STRIP_OFFSETS, tiff.STRIP_BYTES, tiff.PREDICTOR)]
    bad += [_with_tag(good, tiff.DESCRIPTION, kind=4, count=1), _with_tag(good, tiff.ROWS_PER_STRIP, value=0), _with_tag(good, tiff.WIDTH, value=1 << 31), _with_tag(good, tiff.STRIP_OFFSETS, value=1 << 30)]
    out = tiff.read_pages(spark, spark.createDataFrame(list(enumerate(bad)), "key long, media binary")).collect()
    assert {r.key for r in out} == set(range(len(bad)))
    failed = [r for r in out if r.error]
    assert all(r.pixels is None for r in failed) and len(failed) >= 8


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 3), st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 255)), max_size=6), st.integers(0, 400))
def test_no_broken_file_raises_anything_else(codec, edits, cut):
    image = np.arange(16 * 8 * 3).astype(np.uint8).reshape(16, 8, 3)
    data = bytearray(tiff.write([image, image], tiff.Layout([tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS][codec], 2, 8, 0), ["a", "b"]))
    for at, value in edits:
        data[at % len(data)] = value
    try:
        list(tiff.pages(bytes(data[: len(data) - cut])))
    except ValueError:
        pass


def test_texts_meet_every_codec_and_layout():
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, 7).astype(np.uint8)) for _ in range(500)]
    texts = [b"", b"short", b" ".join(words[:60]), b" ".join(words[:200]), b"a" * 5000, b" ".join(words * 40), bytes(rng.integers(0, 256, 30_000).astype(np.uint8)), bytes(rng.integers(0, 256, 500).astype(np.uint8))]
    seen = set()
    for t in texts:
        media = tiff.text_image(t)
        found = list(tiff.pages(media))
        payload = b"".join(p.pixels.tobytes() for p in found)
        assert payload == t.ljust(max(192, -(-len(t) // 192) * 192), b" ") and found[0].description == f"bytes={len(t)}"
        assert all(p.height <= tiff.PAGE_ROWS_OF_TEXT for p in found)
        seen |= {(p.compression, p.height >= tiff.TILE) for p in found} | {len(found) > 1}
    assert {c for c, *_ in (x for x in seen if isinstance(x, tuple))} == {tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS}
    assert {(tiff.DEFLATE, True), (tiff.DEFLATE, False), (tiff.NONE, True), True} <= seen


def test_empty_table(spark, no_docs):
    assert tiff.media_features(spark, no_docs).count() == 0
