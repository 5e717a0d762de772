import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegraph.llm import simple8b, token_output
from tidegraph.llm.tokens import default_tokenizer, encoder


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b_round_trip(ids):
    x = np.array(ids, dtype=np.uint64)
    words, offsets = simple8b.encode(x)
    assert (simple8b.decode(words, offsets, len(x)) == x).all()
    assert len(offsets) == -(-len(x) // simple8b.BLOCK)


def test_simple8b_blocks_decode_alone_and_pack_well():
    x = np.random.default_rng(1).integers(0, 50_257, 4000, dtype=np.uint64)
    words, offsets = simple8b.encode(x)
    a, b = int(offsets[3]), int(offsets[4])
    assert (simple8b.decode(words[a:b], np.array([0], np.uint32), simple8b.BLOCK) == x[3 * simple8b.BLOCK : 4 * simple8b.BLOCK]).all()
    zero_words, _ = simple8b.encode(np.zeros(1280, np.uint64))
    assert len(words) * 8 < 3 * len(x) and len(zero_words) <= 20


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_pieces_equal_whole_texts(text):
    e = encoder(default_tokenizer())
    assert e.encode(text) == e.whole(text)


@pytest.mark.parametrize("text", ["a  b\n\n c'll  ", "ça va'S 12345 !! <|endoftext|> x", "x\x1cy\x85 z\xa0\xa0w ² ½a ª_b", "I'm  \n\t you're", " \n \n x"])
def test_pieces_equal_whole_awkward_texts(text):
    e = encoder(default_tokenizer())
    assert e.encode(text) == e.whole(text)


def _expected(rows):
    e = encoder(default_tokenizer())
    out, at = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = e.whole(text or "") + b"\0\0\0\0"
        out.append((key, len(ids) // 4, zlib.crc32(ids)))
    return out


def test_odd_rows(spark, odd_docs, odd_rows):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_output.token_output(spark, odd_docs).collect())
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert [g[1] for g in got] == [e[0] for e in _expected(odd_rows)]
    assert sorted(map(str, (g[1:] for g in got))) == sorted(map(str, _expected(odd_rows)))


def test_ids_come_back(spark, tmp_path):
    docs = spark.createDataFrame([(2, "second text"), (1, "first")], "doc_id long, text string")
    manifest = token_output.write_token_shards(docs, f"file://{tmp_path}/s", end_id=7)
    manifest = spark.createDataFrame(manifest.collect(), token_output.MANIFEST)
    rows = {r.doc_id: list(r.ids) for r in token_output.read_token_shards(manifest, with_ids=True).collect()}
    e = encoder(default_tokenizer())
    assert rows == {i: [*np.frombuffer(e.whole(t), "<u4").tolist(), 7] for i, t in ((1, "first"), (2, "second text"))}


def test_empty_table_and_broken_shard(spark, no_docs):
    assert token_output.token_output(spark, no_docs).count() == 0
    with pytest.raises(ValueError):
        list(token_output.frames(io.BytesIO(b"nonsense")))
    whole = token_output.MAGIC + token_output.frame([1], [3], np.arange(3, dtype=np.uint64))
    with pytest.raises(ValueError):
        list(token_output.frames(io.BytesIO(whole[:-4])))


def test_equal_rows_are_spread(spark, tmp_path):
    """Rows that are all the same don't end in one shard."""
    docs = spark.createDataFrame([(7, "the same text")] * 4000, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        manifest = token_output.write_token_shards(docs, f"file://{tmp_path}/shards").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest) > 1 and sum(r.n_docs for r in manifest) == 4000 and max(r.n_docs for r in manifest) < 3000
