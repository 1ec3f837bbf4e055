"""Language identification, LM scores and toxicity: brute force where there is one, held-out accuracy else."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mailspark.llm import language, lm, toxicity
from mailspark.llm.queries import tokenizer_path

PIECES = tokenizer_path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def small(spark, tables):
    rows = [(d["doc_id"], d["text"], d["lang"], d["source"]) for d in tables("documents")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


@pytest.fixture(scope="module")
def pieces():
    keys = language.piece_keys(PIECES)
    chance = np.random.default_rng(0).random((len(keys) + 1, 2)) * 0.01
    chance[-1] = 0
    return language.Lookup(keys), chance


def plain_log(word, lookup, chance):
    value = np.zeros((len(word) + 1, chance.shape[1]))
    value[0] = 1
    for end in range(1, len(word) + 1):
        for size in range(1, min(language.LONGEST, end) + 1):
            key = language.span_hash(np.frombuffer(word[end - size : end], dtype=np.uint8)[None, :])
            piece = lookup.of(key)[0]
            if piece >= 0:
                value[end] += value[end - size] * chance[piece]
    return np.log(value[-1])


WORDS = [b" the", b" schlichpfauenheitenkeitundsoweiter", b" x", " éa".encode(), b" " + b"abc" * 14, b" zz9", b" "]


def test_forward_sums_all_segmentations(pieces):
    lookup, chance = pieces
    want = np.array([plain_log(w, lookup, chance) for w in WORDS])
    assert np.allclose(language.word_scores(WORDS, lookup, chance), want, atol=1e-9)
    assert np.isfinite(language.word_scores([b" " + b"q7" * 5_000], lookup, chance)).all()


def test_expected_counts_are_the_slopes(pieces):
    lookup, chance = pieces
    words, counts = WORDS[1:2] + WORDS[:1], np.array([[2.0, 3.0], [1.0, 1.0]])
    total = np.zeros_like(chance)
    lengths, found = language.lattice(words, lookup)
    language._add_expected(total, lengths, found, chance, counts)
    base = np.array([plain_log(w, lookup, chance) for w in words])
    for piece in np.flatnonzero(total.sum(axis=1))[:20]:
        moved = chance.copy()
        moved[piece] *= 1 + 1e-6
        slope = (np.array([plain_log(w, lookup, moved) for w in words]) - base) / 1e-6
        assert np.allclose((slope * counts).sum(axis=0), total[piece], rtol=1e-3, atol=1e-5)


def test_languages_of_held_out_texts(spark, small):
    got = language.languages(spark, small, PIECES).join(small.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 200 and len(held) > 20 and (held.lang == held.lang_pred).mean() >= 0.95
    assert got.score.between(0, 1).all()
    assert set(held.doc_id) == {k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0}


def test_odd_languages(spark, odd, no_docs):
    got = language.languages(spark, odd, PIECES).collect()
    assert len(got) == odd.count()
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {2, 3, 4, 5, None}
    assert language.languages(spark, no_docs, PIECES).count() == 0
    unlabelled = odd.withColumn("lang", odd["lang"].substr(99, 0)).replace("", None, "lang")
    assert {r["lang_pred"] for r in language.languages(spark, unlabelled, PIECES).collect()} == {"und"}


@pytest.fixture
def small_model(monkeypatch):
    """Few symbols and listed words, so that all three kinds of words come up."""
    for name, value in (("SYMBOLS", 40), ("LISTED", 300), ("ROUNDS", 1), ("SWEEPS", 3), ("KEPT", 2)):
        monkeypatch.setattr(lm, name, value)


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def check_base(rows, texts):
    counts = Counter()
    for doc, text in texts:
        if not fold(doc):
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (repr(doc), fold(doc), len(tokens(text)), sum(counts[w] > 0 for w in tokens(text)), n,
         round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(text)), 5))
        for doc, text in texts
    )
    got = sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], atol=1e-4)


def test_lm_counts_and_perplexity(spark, small, small_model):
    scored = lm.scores(spark, small)
    rows = scored.collect()
    check_base(rows, [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()])
    assert all(r["score"] < 0 for r in rows)
    held = {r["held_out"]: r for r in lm.perplexity(spark.createDataFrame(rows, scored.schema)).collect()}[True]
    assert held["perplexity"] < held["base_perplexity"]


def test_lm_odd_rows(spark, odd, no_docs, odd_rows, small_model):
    check_base(lm.scores(spark, odd).collect(), [r[:2] for r in odd_rows])
    assert lm.scores(spark, no_docs).count() == 0


def test_chances_sum_to_one(spark, small_model):
    rows = [(c, s, (c * s) % 5 + 1) for c in range(6) for s in range(8) if (c + s) % 3]
    chance = lm.fitted(spark.createDataFrame(rows, "context bigint, symbol bigint, n bigint"), 12)
    assert chance.shape == (12, 12) and np.allclose(chance.sum(axis=1), 1, atol=1e-5) and (chance > 0).all()


def test_seating_matches_the_posterior():
    """One dish of three customers: the number of tables by sampling and by summing all seatings."""
    discount, strength, base = 0.4, 1.0, 0.3
    place = lm.Restaurant(np.array([3, 1]), np.array([base, 0.7]), discount, strength, np.random.default_rng(2))
    seen = Counter()
    for _ in range(20_000):
        place.sweep(3)
        assert place.size.sum() == 4 and (place.size > 0).all()
        seen[int(place.tables()[0])] += 1
    blocks = {1: (1 - discount) * (2 - discount), 2: 3 * (1 - discount), 3: 1.0}
    # the other dish holds one table
    weight = {t: blocks[t] * base**t * math.prod(strength + discount * k for k in range(1, t + 1)) for t in blocks}
    for t in weight:
        assert abs(seen[t] / 20_000 - weight[t] / sum(weight.values())) < 0.015


def labelled(spark):
    """Toxic where an insult and a group are named together; either alone is clean."""
    plain = "some more words of a text about nothing at all with numbers".split()
    rows = []
    for k in range(1_600):
        words = [plain[(k * 7 + j) % len(plain)] for j in range(8)]
        words += ["insulter"] * (k % 4 in (1, 3)) + ["grouping"] * (k % 4 in (2, 3))
        rows.append((k, " ".join(words), int(k % 4 == 3)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id bigint, quality int, toxic int")


def test_pairs_of_terms_count(spark):
    docs, labels = labelled(spark)
    got = toxicity.scores(docs, labels).toPandas()
    held = got[got.held_out]
    assert len(held) > 300 and (held.predicted == (held.doc_id % 4 == 3)).all()
    assert toxicity.without_toxic(docs, labels).count() == 1_200


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    machine = toxicity.Machine(np.arange(30), 0.3, rng.normal(size=30), rng.normal(size=(30, toxicity.FACTORS)))
    lists = [sorted(rng.choice(30, size, replace=False)) for size in (0, 1, 2, 9, 30)]
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    got = machine.margin(doc, np.array([t for x in lists for t in x], dtype=np.int64), len(lists))
    for value, terms in zip(got, lists):
        pairs = sum(float(machine.factors[i] @ machine.factors[j]) for k, i in enumerate(terms) for j in terms[k + 1 :])
        assert value == pytest.approx(machine.bias + sum(machine.linear[t] for t in terms) + pairs)


def test_exclusive_or_needs_pairs(spark, monkeypatch):
    """Toxic where one of two words stands without the other: no weights of single terms tell that apart."""
    docs, _ = labelled(spark)
    labels = spark.range(1_600).selectExpr("id as doc_id", "1 as quality", "cast(id % 4 in (1, 2) as int) as toxic")
    rows = toxicity.scores(docs, labels).toPandas()
    held = rows[rows.held_out]
    truth = held.doc_id % 4
    # held-out ids have all four kinds
    assert set(truth) == {0, 1, 2, 3} and ((held.score > 0.5) == truth.isin((1, 2))).all()
    monkeypatch.setattr(toxicity, "SPREAD", 0.0)
    linear = toxicity.scores(docs, labels).toPandas()
    linear = linear[linear.held_out]
    assert ((linear.score > 0.5) == (linear.doc_id % 4).isin((1, 2))).mean() < 0.8


def test_repeated_rows_are_learnt_from_once(spark):
    docs, labels = labelled(spark)
    hot = docs.filter("doc_id = 3").crossJoin(spark.range(3_000)).select("doc_id", "text")
    once = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, labels).collect()}
    again = {r["doc_id"]: r["score"] for r in toxicity.scores(docs.union(hot), labels).collect()}
    assert once.keys() == again.keys() and all(abs(once[k] - again[k]) < 1e-6 for k in once)


def test_toxicity_odd_rows(spark, odd, no_docs):
    _, labels = labelled(spark)
    strange = labels.limit(0).union(spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, None), (None, 1, 1), (7, 0, 0)], labels.schema))
    for given in (strange, strange.limit(0)):
        got = toxicity.scores(odd, given).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.scores(no_docs, strange).count() == 0
    assert toxicity.without_toxic(odd, strange.limit(0)).columns == odd.columns
