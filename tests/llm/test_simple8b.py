"""Round trips of the codec and of the token files."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from kinweave.llm import simple8b
from kinweave.llm.token_files import ChunkEncoder, read_tokens, token_digests, write_tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60).flatmap(lambda b: st.integers(0, (1 << b) - 1 if b else 0)) | st.integers(0, (1 << 64) - 1), max_size=3000))
def test_round_trip(values):
    (segment,) = simple8b.pack(np.array(values, np.uint64))
    assert simple8b.unpack(segment).tolist() == values


def test_blocks_decode_alone_and_segments_split():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) >> rng.integers(0, 64, 5000).astype(np.uint64)
    parts = simple8b.pack(values, [1, 0, 2500, 2499])
    assert [len(simple8b.unpack(p)) for p in parts] == [1, 0, 2500, 2499]
    assert (np.concatenate([simple8b.unpack(p) for p in parts]) == values).all()
    whole = simple8b.unpack(parts[2])
    for block in range(3):
        assert (simple8b.unpack_block(parts[2], block) == whole[block * 1024 : (block + 1) * 1024]).all()


def test_small_values_are_packed_and_wide_ones_escape():
    (small,), (wide,) = simple8b.pack(np.zeros(1200, np.uint64)), simple8b.pack(np.full(10, (1 << 64) - 1, np.uint64))
    assert len(small) < 200
    assert simple8b.unpack(wide).tolist() == [(1 << 64) - 1] * 10


def test_a_foreign_file_is_refused():
    with pytest.raises(ValueError):
        simple8b.unpack(b"nope" + bytes(40))


TEXTS = ["", "  ", "Hello, world!", "a<|endoftext|>b", "I'm sure can't\tOK\r\n\n'S", "é x́ ́e \x1c y\x85z", None, "word " * 3000]


def test_chunks_encode_as_whole_texts():
    import public_tokenizers
    import pyarrow as pa

    encoder = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    ids, counts = encoder(pa.array(TEXTS, pa.string()))
    whole = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in whole]
    assert ids.tolist() == [i for x in whole for i in x]


def test_files(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i * 3 % 8, t) for i, t in enumerate(TEXTS)] + [(None, "no key"), (5, "tie"), (5, "tie")]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, ids_crc32 string, start int")
    folder = write_tokens(docs, path, 1)
    got = sorted(token_digests(spark, folder).collect(), key=lambda r: r["start"])
    tokens = {r["start"]: r["ids"] for r in read_tokens(spark, folder).collect()}
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert [r["start"] for r in got] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in got])[:-1])).tolist()
    encoder = ChunkEncoder(path).tokenizer
    want = sorted(tuple(encoder.encode(t or "", add_special_tokens=False).ids) + (1,) for _, t in rows)
    assert sorted(tuple(tokens[r["start"]]) for r in got) == want
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(tokens[r["start"]], "<u4").tobytes())


def test_no_documents(spark):
    import public_tokenizers

    folder = write_tokens(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), 1)
    assert token_digests(spark, folder).count() == 0
