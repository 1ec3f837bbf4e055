import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mailspark.llm import simhash as S
from mailspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, distance):
    """Smallest member of each print's component, all pairs compared."""
    prints = sorted(set(prints))
    parent = {p: p for p in prints}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= distance:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {p: top(p) for p in prints}


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def groups(pairs):
    out = {}
    for member, name in pairs:
        out.setdefault(name, set()).add(member)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("distance,bucket", [(1, 64), (2, 64), (2, 2), (3, 3)])
def test_links_find_every_component(spark, monkeypatch, distance, bucket):
    """Clusters around few centres, and clusters where every bucket is full."""
    monkeypatch.setattr(S, "BUCKET", bucket)
    pick = random.Random(distance * 100 + bucket)
    prints = set()
    for _ in range(12):
        centre = pick.getrandbits(64)
        for _ in range(pick.randint(1, 40)):
            prints.add(centre ^ sum({1 << pick.randrange(64) for _ in range(pick.randint(0, 4))}))
    frame = spark.createDataFrame([(signed(p),) for p in prints], "print bigint")
    found = components(S.links(spark, frame, distance, bucket))
    got = groups((r["node"], r["component"]) for r in found.collect())
    want = {frozenset(map(signed, g)) for g in groups(plain_classes(prints, distance).items()) if len(g) > 1}
    assert got == want


def test_thresholds_sum_and_cost():
    costs = [[0.0, 5.0, 9.0, 9.5], [0.0, 1.0, 1.5, 30.0], [0.0, 2.0, 2.5, 2.6]]
    price, chosen = S.thresholds(costs, 0)
    best = min(sum(c[t + 1] for c, t in zip(costs, ts)) for ts in itertools.product(range(-1, 3), repeat=3) if sum(ts) == 0)
    assert sum(chosen) == 0 and price == pytest.approx(best)


def test_bits_are_grouped_once():
    both = np.random.default_rng(1).integers(0, 100, (64, 64)).astype(float)
    for parts in (2, 3, 4):
        layout = S.grouped_bits(both + both.T, 200, parts)
        assert sorted(itertools.chain(*layout)) == list(range(64)) and len(layout) == parts


def test_small_table(spark, tables):
    docs = tables("documents")
    frame = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id bigint, text string")
    prints = {d["doc_id"]: plain_print(d["text"]) for d in docs}
    classes = plain_classes(prints.values(), 2)
    least = {}
    for doc, p in prints.items():
        least[classes[p]] = min(doc, least.get(classes[p], doc))
    want = sorted((doc, f"{p:016x}", least[classes[p]]) for doc, p in prints.items())
    assert sorted(tuple(r) for r in S.near_duplicates(spark, frame).collect()) == want


def test_odd_rows(spark, odd, no_docs):
    got = S.near_duplicates(spark, odd).collect()
    assert len(got) == odd.count()
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in zero} == {2, 3, 4, None} and {r["component_id"] for r in zero} == {2}
    kept = S.deduplicated(spark, odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert [i for n, i in ids if not n] == [1, 1, 2, 5, 6, 7] and sum(n for n, _ in ids) == 1
    assert S.near_duplicates(spark, no_docs).count() == 0 and S.deduplicated(spark, no_docs).count() == 0


def test_components_of_paths_stars_and_nothing(spark):
    path = [(k, k + 1) for k in range(1, 70)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    frame = spark.createDataFrame(path + star + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)], "a bigint, b bigint")
    got = dict(tuple(r) for r in components(frame).collect())
    assert got == {k: 1 for k in range(1, 71)} | {k: 1000 for k in range(1000, 1300)} | {2000: 2000, 2001: 2000}
    assert components(frame.filter(F.lit(False))).count() == 0


def test_helper_names_and_maps_are_no_trouble(spark):
    rows = [(k, "one two three four five" if k < 6 else f"text number {k} is its own", {"a": k % 2}, k, "x", None) for k in [0, 1, 1, 5, 7, 8]]
    schema = "doc_id bigint, text string, tags map<string,int>, _id bigint, _row_key string, first struct<m:map<string,int>>"
    kept = S.deduplicated(spark, spark.createDataFrame(rows, schema).repartition(3))
    assert kept.columns == ["doc_id", "text", "tags", "_id", "_row_key", "first"]
    assert sorted(r.doc_id for r in kept.collect()) == [0, 7, 8]
