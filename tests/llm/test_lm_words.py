"""Every word has its own context in the LM: sums to one, brute force, and tables against exact numbers and long chains."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from mailspark.llm import lm, seating


@pytest.fixture
def scores_of(monkeypatch, spark):
    """Scores of learnt and of asked texts, with few listed words."""

    def run(learnt, asked, **values):
        for name, value in ({"SYMBOLS": 2, "LISTED": 4, "ROUNDS": 1, "SWEEPS": 3, "KEPT": 2} | values).items():
            monkeypatch.setattr(lm, name, value)
        held = [k for k in range(3_000) if zlib.crc32(str(k).encode()) % 10 == 0]
        training = sorted(set(range(3_000)).difference(held))
        rows = [*zip(training, learnt), *zip(held, asked)]
        assert len(rows) == len(learnt) + len(asked)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        by_id = {r["doc_id"]: r["score"] for r in lm.scores(spark, docs).collect()}
        return [by_id[k] for k, _ in rows]

    return run


@pytest.fixture
def model_of(monkeypatch, scores_of):
    """The same with several buckets, and the fitted model."""
    seen, fit = [], lm.fit
    monkeypatch.setattr(lm, "fit", lambda *args: seen.append(fit(*args)) or seen[-1])

    def run(learnt, asked, **values):
        return scores_of(learnt, asked, BUCKET=40, **values), seen[-1]

    return run


def texts(words, count, seed):
    """Some pairs come often, most words are rare."""
    rng = np.random.default_rng(seed)
    chance = 1 / np.arange(1, len(words) + 1)
    return [" ".join(words[k] for k in rng.choice(len(words), rng.integers(1, 12), p=chance / chance.sum())) for _ in range(count)]


WORDS = "a b c d e f g h i j k".split()


def test_chances_of_all_next_words_sum_to_one(model_of):
    learnt = texts(WORDS, 60, 1)
    asked = ["", *WORDS, *(f"new {w}" for w in WORDS), *(f"new {u} {w}" for u in WORDS for w in [*WORDS, "other"])]
    got, model = model_of(learnt, asked)
    chance = {text: 10**score for text, score in zip(asked, got[len(learnt) :])}
    counts = Counter(w for text in learnt for w in text.split())
    assert min(counts.values()) > 1 and sum(counts.values()) > 200
    unknown = model.parent.of(np.zeros(1, dtype=np.int64))[0]
    new, end = model.rest()[0] * unknown, model.parent.listed[0]
    # that the chances after u sum to one says, times the parent's chance of u: P(u) = sum over w of P(w) B(u, w) / A(w) + A(u) / new + O(u) / (new end)
    ends = np.array([chance[f"new {w}"] for w in WORDS])
    pairs = np.array([[chance[f"new {u} {w}"] for w in WORDS] for u in WORDS])
    others = np.array([chance[f"new {u} other"] for u in WORDS])
    parent = np.linalg.solve(np.eye(len(WORDS)) - pairs / ends, ends / new + others / (new * end))
    assert parent.sum() + end + unknown == pytest.approx(1, abs=1e-6)
    for listed in model.parent.listed[1:]:
        assert min(abs(parent - listed)) < 1e-6
    assert sum(chance[w] * new * p / a for w, p, a in zip(WORDS, parent, ends)) + chance[""] + new == pytest.approx(1, abs=1e-6)


def once_only(count):
    """Texts in which no pair of neighbours, ends included, comes twice."""
    rng, words, seen, out = np.random.default_rng(4), [f"w{k}" for k in range(60)], set(), []
    while len(out) < count:
        text = [words[k] for k in rng.integers(0, len(words), rng.integers(1, 25))]
        pairs = [*zip([None, *text], [*text, None])]
        if len({*pairs}) == len(pairs) and not seen & {*pairs}:
            seen.update(pairs)
            out.append(" ".join(text))
    return out


def test_scores_by_brute_force(model_of):
    """Where every pair comes once, tables are known, and scores follow from counts and the parent."""
    learnt = once_only(40)
    asked = ["", "w1", "w1 w2 w3", "nothing known", "w5 unknown w6", *(" ".join(text.split()[::-1]) for text in learnt[:10])]
    got, model = model_of(learnt, asked)
    firsts, pairs = Counter(), Counter()
    for text in learnt:
        for pair in zip([None, *text.split()], [*text.split(), None]):
            firsts[pair[0]] += 1
            pairs[pair] += 1
    assert max(pairs.values()) == 1 and max(firsts.values()) > 4
    discount, strength = lm.CONTEXT
    for text, score in zip([*learnt, *asked], got):
        want = 0
        for u, w in zip([None, *text.split()], [*text.split(), None]):
            chance = model.parent.of(np.array([firsts[w]]))[0]
            want += math.log10(((1 - discount) * pairs[u, w] + (strength + discount * firsts[u]) * chance) / (strength + firsts[u]))
        assert score == pytest.approx(want, abs=1e-6)


def test_rare_words_have_their_own_contexts(scores_of):
    """q always follows p, and r follows s; before, all words that weren't symbols shared a context by their last byte."""
    plain = texts([f"v{k}x" for k in range(30)], 60, 5)
    learnt = [*plain, *(f"{text} px qx" for text in plain[:15]), *(f"{text} sx rx" for text in plain[:15])]
    got = scores_of(learnt, ["px qx", "px rx", "sx rx", "sx qx"])
    right, wrong, right_too, wrong_too = got[len(learnt) :]
    assert right > wrong + 0.5 and right_too > wrong_too + 0.5


def test_symbols_change_nothing(scores_of):
    learnt, asked = texts(WORDS, 40, 2), ["a b c", "k j new", "b a a a"]
    few = scores_of(learnt, asked, LISTED=8)
    many = scores_of(learnt, asked, LISTED=8, SYMBOLS=500)
    assert np.allclose(few, many, atol=1e-6)


def test_tables_by_closed_form():
    """For a discount of a half, S(c, t) = (2c - t - 1)! / ((t - 1)! (c - t)! 4^(c - t)); beyond the table it comes from the integral."""
    for c, log_y in ((300, -2.0), (1_024, 1.0), (1_025, -9.0), (3_000, 0.0), (40_000, 3.0), (40_000, 9.0), (1_000_000, -1.0)):
        t = np.arange(1, c + 1)
        logs = np.array([math.lgamma(2 * c - k) - math.lgamma(k) - math.lgamma(c - k + 1) + k * (math.log(4) + log_y) for k in t[:300_000]])
        want = np.exp(logs - logs.max())
        want /= want.sum()
        u = (np.arange(400) + 0.5) / 400
        off = seating.drawn(np.full(400, c), np.full(400, log_y), 0.5, u) - 1 - np.searchsorted(np.cumsum(want), u)
        assert np.abs(off).max() <= 1 and (off != 0).sum() <= 2


def test_gammas_and_uniforms():
    keys = np.arange(200_000)
    u = seating.uniform(keys, 5)
    assert abs(u.mean() - 0.5) < 0.005 and abs(np.corrcoef(u, seating.uniform(keys, 6))[0, 1]) < 0.01
    x = seating.gammas(np.full(len(keys), 4.5), keys, 1)
    assert abs(x.mean() - 4.5) < 0.03 and abs(x.var() - 4.5) < 0.1


def test_tables_as_in_long_chains():
    """Mean tables of a restaurant with many dishes, some with many customers: sweeps against customers that move one by one."""
    customers = np.array([150] * 4 + [1] * 60)
    base, (discount, strength) = np.full(len(customers), 1 / len(customers)), lm.CONTEXT
    slow = lm.Restaurant(customers, base, discount, strength, np.random.default_rng(1))
    chain = []
    for _ in range(120):
        slow.sweep(150)
        chain.append(slow.tables()[:4].mean())
    tables, fast = np.ones(len(customers), dtype=np.int64), []
    for sweep in range(400):
        x = lm.variables(np.array([tables.sum()]), np.zeros(1), sweep)[0]
        tables = seating.drawn(customers, np.log(discount * x * base), discount, seating.uniform(np.arange(len(customers)), sweep))
        fast.append(tables[:4].mean())
    assert np.mean(fast[20:]) == pytest.approx(np.mean(chain[20:]), rel=0.05)
