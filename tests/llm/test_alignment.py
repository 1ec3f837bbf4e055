import hashlib
from collections import Counter

import numpy as np
import pytest

from mailspark.llm import alignment as A
from mailspark.llm.queries import op13_alignment, tokenizer_path

BYTE, PIECE = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


def byte_decoder():
    """Characters of byte-level tokens to bytes, by the rule of the vocabulary: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@pytest.fixture(scope="module")
def tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    byte = Tokenizer.from_file(BYTE)
    byte.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    table = byte_decoder()

    def cut(text):
        """(A ids, A bytes, B ids, B bytes), or nothing where they do not spell the text."""
        if not text:
            return [], [], [], []
        a = byte.encode(" " + text, add_special_tokens=False).ids
        raw_a = [bytes(table[c] for c in byte.id_to_token(k)) for k in a]
        b = model.encode(text)
        raw_b = []
        for k in b:
            piece = model.id_to_piece(k)
            raw_b.append(bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode())
        whole = (" " + text).encode()
        return (a, raw_a, b, raw_b) if b"".join(raw_a) == whole == b"".join(raw_b) else ([], [], [], [])

    return cut


def brute(texts, cut):
    """Rows without doc_id, in order of the texts."""
    docs, pairs = [], Counter()
    for text in texts:
        a, raw_a, b, raw_b = cut(text)
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        links = [(i, j) for i, e in enumerate(ends_a) if e in set(ends_b) for j in [ends_b.index(e)]]
        pairs.update((a[i], b[j]) for i, j in links)
        groups, was = [], (0, 0)
        for i, j in links:
            groups.append(",".join(map(str, a[was[0] : i + 1])) + "|" + ",".join(map(str, b[was[1] : j + 1])))
            was = i + 1, j + 1
        docs.append((a, b, links, ";".join(groups)))
    most = Counter()
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    out = []
    for a, b, links, groups in docs:
        found = [(a[i], b[j]) for i, j in links]
        out.append((
            len(a), len(b), len(links), len(links), sum(pairs[p] == most[p[1]] for p in found), sum(pairs[p] for p in found),
            hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        ))
    return out


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD_TEXTS = [
    None, "", " ", "  ", "a", " a", "a  b ", "a ▁b", "▁", "<|endoftext|> x", "<s> </s> <unk> <0x0A>", "naïve 日本語 🎉\t\n\r\n end  ", "\0 nul", "x" * 3_000,
    "don't  I'll 've 123456789 --- ***", " 　 thin", "é é ﬁ", "a\u0000b", "same text", "same text", " " * 40 + "far",
]


def test_odd_texts_equal_brute_force(spark, tokens):
    rows = [(k if k % 5 else None, t) for k, t in enumerate(ODD_TEXTS)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, pair string, number int").repartition(3)
    got = sorted(map(repr, (tuple(r[c] for c in COLUMNS) for r in A.alignments(spark, docs, BYTE, PIECE).collect())))
    want = sorted(repr((k, *row)) for (k, _), row in zip(rows, brute(ODD_TEXTS, tokens)))
    assert got == want


def test_small_batches_give_the_same(spark, tokens, monkeypatch):
    texts = [t for t in ODD_TEXTS if t] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    want = {k: row for k, row in enumerate(brute(texts, tokens))}
    batches = A.aligned_batches(spark, docs, BYTE, PIECE)
    assert sum(len(r.doc_ids) for r in batches.collect()) == len(texts)
    for row in A.alignments(spark, docs, BYTE, PIECE).collect():
        assert tuple(row[c] for c in COLUMNS[1:]) == want[row.doc_id]


def test_whole_table_equals_brute_force(spark, tables, tokens):
    docs = tables("documents")
    want = {d["doc_id"]: row for d, row in zip(docs, brute([d["text"] for d in docs], tokens))}
    got = op13_alignment(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for row in got:
        assert tuple(row[c] for c in COLUMNS[1:]) == want[row.doc_id]


def test_links_name_tokens_that_end_together(spark, tokens):
    texts = ["the quick  brown naïveté", "日本語", None]
    rows = A.links(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), BYTE, PIECE).collect()
    for k, text in enumerate(texts):
        a, raw_a, b, raw_b = tokens(text)
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]), np.cumsum([len(x) for x in raw_b])
        own = sorted((r.a_index, r.b_index, r.a_id, r.b_id, r.end) for r in rows if r.doc_id == k)
        assert own == [(i, j, a[i], b[j], int(x)) for i, x in enumerate(ends_a) for j, y in enumerate(ends_b) if x == y]


def test_lockstep_against_sets():
    pick = np.random.default_rng(5)
    ends = [[np.append(np.flatnonzero(pick.random(size) < 0.4), size) + base for base, size in ((0, 30), (31, 1), (33, 400))] for _ in range(2)]
    flat, first = [np.concatenate(e) for e in ends], [np.cumsum([0, *map(len, e)]) for e in ends]
    partner = A.lockstep(*flat, first[0][:-1], first[1][:-1], first[0][1:])
    where = {x: k for k, x in enumerate(flat[1].tolist())}
    assert partner.tolist() == [where.get(x, -1) for x in flat[0].tolist()]


def test_decimal_words():
    words, bits = A.decimal_words(12_345)
    assert [int(w).to_bytes(8, "little")[: int(n) // 8].decode() for w, n in zip(words, bits)] == [str(k) for k in range(12_345)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert A.alignments(spark, none, BYTE, PIECE).count() == 0
