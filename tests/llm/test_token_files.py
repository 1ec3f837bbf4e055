import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from mailspark.llm import token_files as T
from mailspark.llm.common import text_blocks
from mailspark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("special_as_text", [False, True])
def test_pieces_like_the_library(special_as_text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = special_as_text
    pick = random.Random(1)
    parts = [*"  ''sstreavmld\n\t.!ab1éßñ日　٣ ½🎉​́", "\r\n", "'re", "don't", "I'll ", "  ", "<|endoftext|>", "'S"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 40))) for _ in range(1_500)]
    coder = T.PieceCoder(tokenizer_path(), special_as_text)
    for first, rows, data, bounds in text_blocks(pa.array(texts)):
        ids, sizes = coder.encode(data, bounds)
        for text, got in zip(texts[first : first + rows], np.split(ids, np.cumsum(sizes)[:-1])):
            assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def huffman_cost(counts, limit):
    """Least total length of prefix codes of at most ``limit`` bits, by trying all length lists that satisfy Kraft's inequality."""
    counts = sorted(counts, reverse=True)
    lists = itertools.combinations_with_replacement(range(1, limit + 1), len(counts))
    return min(sum(c * n for c, n in zip(counts, ls)) for ls in lists if sum(2.0**-n for n in ls) <= 1)


@pytest.mark.parametrize("limit", [3, 4, 6])
def test_lengths_are_optimal_and_limited(limit):
    pick = random.Random(limit)
    for _ in range(30):
        counts = np.array([pick.choice([1, 1, 2, 5, 40, 1000]) for _ in range(pick.randint(2, 6))])
        lengths = T.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0**-n for n in lengths) <= 1
        assert int((lengths * counts).sum()) == huffman_cost(counts, limit)


def test_skewed_counts_reach_the_limit():
    counts = np.array([2**k for k in range(40)])
    lengths = T.code_lengths(counts)
    assert lengths.max() == T.LIMIT and sum(2.0**-n for n in lengths) == 1
    with pytest.raises(ValueError):
        T.code_lengths(np.ones(9), 3)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5_000])
@pytest.mark.parametrize("kinds", [1, 2, 3_000])
def test_bits_come_back(n, kinds):
    rng = np.random.default_rng(n + kinds)
    ids = np.minimum(rng.geometric(0.01, n), kinds).astype(np.uint32) * 7 + 3
    found, counts = np.unique(ids if n else np.array([3], dtype=np.uint32), return_counts=True)
    code = T.Code(found, T.code_lengths(counts))
    bits, checkpoints = T.encode_bits(ids, *code.encoder())
    assert T.decode_bits(bits, checkpoints, n, code.decoder()).tolist() == ids.tolist()


def expected(tokenizer, texts):
    start, out = 0, []
    for doc, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, T.END_ID], dtype="<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_small_table_in_many_chunks(spark, tables, tokenizer, monkeypatch):
    monkeypatch.setattr(T, "CHUNK_IDS", 3_000)
    docs = [(d["doc_id"], d["text"]) for d in tables("documents")]
    random.Random(5).shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = sorted(tuple(r) for r in T.token_table(spark, frame, tokenizer_path()).collect())
    assert got == expected(tokenizer, sorted(docs))


def test_odd_rows(spark, odd, no_docs, tokenizer):
    got = sorted(T.token_table(spark, odd, tokenizer_path()).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 1, 2, 3, 4, 5, 6, 7]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    empty = zlib.crc32(np.array([T.END_ID], dtype="<u4").tobytes())
    assert [r["ids_crc32"] for r in got if r["doc_id"] in (2, 3)] == [empty, empty]
    assert T.token_table(spark, no_docs, tokenizer_path()).count() == 0
