import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailspark.llm import mixing as M
from mailspark.llm import spotsigs as S

HOUSE = "The old house on the hill was sold to a young family by its former owner"


def test_chains_skip_common_words():
    one, two, far = S.signature_sets([HOUSE, HOUSE.lower().replace(" ", "  "), "Completely different words stand here in a row"])
    assert one.tolist() == two.tolist() and S.likeness(one, two) == 1.0 and S.likeness(one, far) == 0.0
    assert len(S.signature_sets(["the of and"])[0]) >= 1


@pytest.mark.parametrize("least", [0.4, 0.8])
def test_search_loses_nothing(spark, tables, least):
    """Links and classes against all pairs: texts of the corpus, copies with words changed, equal texts, texts without words."""
    rng = np.random.default_rng(4)
    texts = [d["text"] for d in tables("documents")][:60]
    for text in texts[:25]:
        words = text.split(" ")
        for changes in (1, 1 + len(words) // 12):
            for at in rng.integers(0, len(words), changes):
                words[at] = f"new{at}"
            texts.append(" ".join(words))
    texts += texts[:5] + ["", "", None, "!!", "the of and"]
    rows = [(k + 1, t, "clash", "clash") for k, t in enumerate(texts)] + [(None, texts[0], "clash", "clash")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, part string, signature string")
    members, links = S.similar(spark, frame, F.col("doc_id") % 3 == 0, least)
    sets = [frozenset(x.tolist()) for x in S.signature_sets([t or "" for t in texts])]
    named, asked = {}, set()
    for k, found in enumerate(sets, 1):
        named.setdefault(found, k)
        asked |= {found} if k % 3 == 0 else set()
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == {k: named[found] for k, found in enumerate(sets, 1)}
    want = {(named[a], named[b]): len(a & b) / len(a | b) for a in asked for b in named if a != b and len(a & b) >= least * len(a | b) - 1e-9}
    got = links.collect()
    assert len(got) == len(want) > 10 and {(r["query_id"], r["class_id"]): r["likeness"] for r in got} == pytest.approx(want)


def test_next_document_and_edit(spark, tables):
    docs = sorted(((d["doc_id"], d["text"]) for d in tables("documents")), reverse=True)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r for r in S.fingerprints(spark, frame).collect()}
    assert len(got) == len(docs)
    for k, (doc, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, new, other = S.signature_sets([text, changed, following])
        row = got[doc]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (row["fingerprint"], row["edited_fingerprint"]) == (S.written(own), S.written(new))
        assert (row["near_edited"], row["near_next"]) == (S.likeness(own, new), S.likeness(own, other))


def test_spotsigs_odd_rows(spark, odd, no_docs):
    got = S.fingerprints(spark, odd).collect()
    assert len(got) == odd.count() and all(0 <= r["near_next"] <= 1 for r in got)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (2, 3)}) == 1
    assert S.fingerprints(spark, no_docs).count() == 0
    members, links = S.similar(spark, odd, F.lit(True))
    assert members.count() == odd.filter("doc_id is not null").count() and links.columns == ["query_id", "class_id", "likeness"]
    assert links.count() == 0 and S.similar(spark, no_docs, F.lit(True))[1].count() == 0
    alone = S.fingerprints(spark, odd.filter("doc_id = 6")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def plain_weights(rows, given, power):
    """(cell: weight) by raking in plain Python."""
    cells = {}
    for cell, n in rows:
        cells[cell] = cells.get(cell, 0) + n
    total = sum(cells.values())
    w = {c: n / total for c, n in cells.items()}
    targets = []
    for k, name in enumerate(M.MARGINS):
        sums = {}
        for c, n in cells.items():
            sums[c[k]] = sums.get(c[k], 0) + n
        fixed = {v: s for v, s in given.get(name, {}).items() if v in sums}
        free = {v: s ** power.get(name, 1.0) for v, s in sums.items() if v not in fixed}
        left = 1 - sum(fixed.values())
        targets.append(fixed | {v: s / sum(free.values()) * left for v, s in free.items()})
    for _ in range(500):
        for k in range(len(M.MARGINS)):
            sums = {}
            for c, x in w.items():
                sums[c[k]] = sums.get(c[k], 0) + x
            w = {c: x * targets[k][c[k]] / sums[c[k]] for c, x in w.items()}
    weights = {c: w[c] / (n / total) for c, n in cells.items() if n}
    return weights


def test_raking_like_plain_python(spark, tables):
    docs = [(d["doc_id"], d["text"], d["source"], d["lang"]) for d in tables("documents")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string")
    given, power = {"lang": {"en": 0.5}}, {"source": 0.5, "lang": 0.8}
    got = M.mix_table(spark, frame, given, power).collect()
    assert len(got) == len(docs)
    want = plain_weights([((r["source"], r["lang"], r["topic"]), r["n_tokens"]) for r in got], given, power)
    most = max(want.values())
    counts = {d[0]: len(d[1].split()) for d in docs}
    for r in got:
        cell = (r["source"], r["lang"], r["topic"])
        assert r["n_tokens"] == counts[r["doc_id"]]
        assert r["weight"] == pytest.approx(want[cell], rel=1e-4) and r["probability"] == pytest.approx(want[cell] / most, rel=1e-4)
    kept = M.sampled(spark, frame, given, power)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])


def test_draw_follows_the_probability(spark):
    frame = spark.createDataFrame([(k, f"text {k} " * (1 + k % 2), "ab"[k % 2], "en") for k in range(4_000)], "doc_id bigint, text string, source string, lang string")
    got = M.mix_table(spark, frame, {"source": {"a": 0.5, "b": 0.5}}).toPandas()
    share = got[got.kept].groupby("source").n_tokens.sum()
    assert abs(share["a"] / share.sum() - 0.5) < 0.03
    assert got[got.source == "a"].kept.all() and abs(got[got.source == "b"].kept.mean() - 0.5) < 0.04


def test_mixing_odd_rows(spark, odd, no_docs):
    got = M.mix_table(spark, odd, power={"source": 0.7}).collect()
    assert len(got) == odd.count() and {r["source"] for r in got} >= {"(none)", "src1"}
    assert all(0 <= r["probability"] <= 1 for r in got)
    assert M.sampled(spark, odd).columns == odd.columns and M.sampled(spark, odd).count() == odd.count()
    assert M.mix_table(spark, no_docs).count() == 0
