import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailspark.llm import hard_negatives as H
from mailspark.llm import neighbours as N
from mailspark.llm import vectors as V
from mailspark.llm.queries import op11_hard_negatives, op12_neighbours

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>, label int, score double, rank int, shard int, group_no int"


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def frame(spark, rows):
    """Rows (id, vector, label) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, y, 0.5, 1, 2, 3) for i, v, y in rows], SCHEMA).repartition(3)


# --- hard negatives


def padded(vector, size):
    return [int(math.floor(256 * x)) for x in vector] + [0] * (size - len(vector))


def brute_negatives(rows, is_anchor):
    rows = [r for r in rows if r[0] is not None and r[2] is not None and usable(r[1]) and all(math.isfinite(256 * x) for x in r[1])]
    size = max([len(r[1]) for r in rows], default=0)
    rows = [(i, padded(v, size), y) for i, v, y in rows]
    out = []
    for k, (i, a, y) in enumerate(rows):
        if not is_anchor(i):
            continue
        scored = [(-sum(p * q for p, q in zip(a, b)), j, z) for m, (j, b, z) in enumerate(rows) if m != k]
        for minus, positive, _ in sorted(s[:2] + (0,) for s in scored if s[2] == y)[:5]:
            fits = sorted((s, j) for s, j, z in scored if z != y and 30 * -minus <= 100 * -s <= 90 * -minus)[:10]
            out += [(i, positive, rank, j, clamp(-minus), clamp(-s)) for rank, (s, j) in enumerate(fits, 1)]
    return sorted(out)


def clamp(x):
    return max(-(1 << 63), min((1 << 63) - 1, x))


NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(table, **options):
    found = H.hard_negatives(table.sparkSession, table, F.col("vec_id") % 10 == 0, **options)
    return sorted(tuple(r[c] for c in NAMES) for r in found.collect())


def random_rows(n, size, scale, labels=4, seed=0):
    pick = random.Random(seed)
    return [(i, [pick.gauss(0.3, 1) * scale for _ in range(size)], pick.randrange(labels)) for i in range(n)]


ODD = [
    (None, [1.0, 2.0], 1), (900, None, 1), (901, [1.0, None], 1), (902, [float("nan"), 1.0], 1), (903, [float("inf")], 2), (904, [1e307], 2),
    (910, [], 1), (911, [0.5], 0), (920, [0.5, 0.5, 0.5, 0.5], None), (930, [0.5, 0.25, -0.5, 1.0], 0), (930, [0.5, 0.25, -0.5, 1.0], 0), (930, [0.25, 0.5], 1),
    (940, [0.0, 0.0, 0.0, 0.0], 2), (941, [0.5, 0.25, -0.5, 1.0], 3), (942, [0.5, 0.25, -0.5, 1.0], 3),
]


@pytest.mark.parametrize("scale", [0.3, 40.0, 1e7, 1e20])
def test_negatives_equal_brute_force(spark, scale):
    rows = random_rows(160, 4, scale) + ODD
    assert mined(frame(spark, rows)) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_hot_label_and_small_blocks(spark, monkeypatch):
    rows = [(i, v, 0 if i % 3 else y) for i, v, y in random_rows(300, 5, 0.4, labels=9, seed=2)]
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert mined(frame(spark, rows)) == want
    # groups that are too large to broadcast meet the blocks by salted keys
    monkeypatch.setattr(V, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(V, "GROUP_ROWS", 7)
    assert mined(frame(spark, rows)) == want


def test_no_rows_and_no_anchors(spark):
    assert mined(frame(spark, random_rows(5, 3, 1.0)).filter("false")) == []
    assert mined(frame(spark, [(1, [1.0], 0), (2, [1.0], 1)])) == []
    assert mined(frame(spark, [(10, [1.0], 0)])) == []


def test_whole_table_equals_brute_force(spark, tables):
    rows = [(r["vec_id"], r["embedding"], None if r["label"] is None else (r["label"] + (r["vec_id"] % 7 == 0)) % 10) for r in tables("embeddings")]
    got = sorted(tuple(r[c] for c in NAMES) for r in op11_hard_negatives(spark, SMALL).collect())
    assert got == brute_negatives(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("low, high, size", [(-159, 158, 64), (0, 1, 1), (-(1 << 20), 1 << 20, 300), (-(1 << 40), 1 << 40, 3), (0, 0, 4)])
def test_packed_products_are_exact(low, high, size):
    pick = random.Random(size)
    packing = H.Packing(min(0, low), max(0, high), size)
    assert packing.fields > 1 or packing.bits > 32
    rows, anchors = (np.array([[pick.choice([low, high, pick.randint(low, high)]) for _ in range(size)] for _ in range(n)], dtype=np.float64) for n in (9, 5))
    raised = packing.raised(rows)
    got = packing.scores(packing.packed(raised), raised, packing.raised(anchors))
    want = [[sum(int(x) * int(y) for x, y in zip(r, a)) for a in anchors] for r in rows]
    assert [[int(x) for x in line] for line in got] == want


def test_sortable_text_keeps_order():
    values = [0, 1, -1, 9, 10, -9, -10, 10**30, -(10**30), 10**30 + 1, -(10**29)]
    assert [H._number(t) for t in sorted(map(H._sortable, values))] == sorted(values)


# --- neighbours


def brute_nearest(rows, count=10):
    rows = [(i, v) for i, v in rows if i is not None and usable(v) and any(v)]
    size = max([len(v) for _, v in rows], default=0)
    rows = [(i, list(v) + [0.0] * (size - len(v))) for i, v in rows]
    out = {}
    for k, (i, q) in enumerate(rows):
        if i % 10 == 0:
            near = []
            for m, (j, v) in enumerate(rows):
                if m != k:
                    total = 0.0
                    for x, y in zip(v, q):
                        total += (x - y) * (x - y)
                    near.append((math.sqrt(total), j))
            out.setdefault(i, []).append(sorted(near)[:count])
    return out


def searched(table, count=10):
    found = {}
    for r in sorted(N.nearest(table.sparkSession, table, F.col("vec_id") % 10 == 0, count).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return found


def clustered(n, size, seed=1):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(12, size))
    return [(i, (centres[i % 12] + 0.2 * pick.normal(size=size)).tolist()) for i in range(n)]


def test_recall_and_exact_scores(spark):
    rows = clustered(1_500, 48)
    want = brute_nearest(rows)
    got = searched(frame(spark, [(*r, 0) for r in rows]))
    vectors = dict(rows)
    assert set(got) == set(want)
    hits = 0
    for i, found in got.items():
        assert len(found) == 10 and found == sorted(found)
        for score, j in found:
            total = 0.0
            for x, y in zip(vectors[j], vectors[i]):
                total += (x - y) * (x - y)
            assert score == math.sqrt(total)
        hits += len({j for _, j in found} & {j for _, j in want[i][0]})
    assert hits >= 0.95 * 10 * len(want)


def test_few_odd_rows_are_all_found(spark, monkeypatch):
    odd = [(i, v) for i, v, _ in ODD if i is None or i != 930] + [(930, [0.5, 0.25, -0.5, 1.0]), (931, [0.5, 0.25, -0.5, 1.0]), (933, [0.5, 0.25, -0.5, 1.0])]
    # fewer candidates than asked for: all of them, whatever the radius
    want = {i: lists[0] for i, lists in brute_nearest(odd, 50).items()}
    assert searched(frame(spark, [(*r, 0) for r in odd]), 50) == want


def test_short_radius_falls_back_to_all_rows(spark, monkeypatch):
    rows = clustered(200, 16, seed=4)
    monkeypatch.setattr(N, "RECALL", 0.0)
    got = searched(frame(spark, [(*r, 0) for r in rows]), 150)
    assert got == {i: lists[0] for i, lists in brute_nearest(rows, 150).items()}


def test_repeated_rows_are_candidates_of_each_other(spark):
    rows = [(10, [1.0, 2.0])] * 3 + [(11, [1.0, 2.5])]
    got = searched(frame(spark, [(*r, 0) for r in rows]), 2)
    assert got == {10: [(0.0, 10)] * 6}


def test_no_rows_and_no_queries(spark):
    assert searched(frame(spark, [(10, [1.0], 0)]).filter("false")) == {}
    assert searched(frame(spark, [(1, [1.0], 0), (2, [2.0], 0)])) == {}
    assert searched(frame(spark, [(10, [1.0], 0)])) == {}


@pytest.mark.parametrize("radius", [0, 3, 9, 20])
def test_pigeonhole_finds_every_code_in_the_radius(radius):
    pick = np.random.default_rng(radius)
    codes = pick.integers(0, 1 << 24, 800).astype(np.uint64)
    near = pick.integers(0, 2, (800, 24)).astype(np.uint64)
    parts = 3
    reach = [(radius + 1) // parts + (k < (radius + 1) % parts) - 1 for k in range(parts)]
    made = N.Codes(24, np.zeros(24), np.eye(24), radius, [(8 * k, 8, min(8, t)) for k, t in enumerate(reach)], 0)
    query = codes[0] ^ np.uint64(int(near[0].sum()))
    found = set()
    for k, (_, bits, t) in enumerate(made.substrings):
        directory, place = np.unique(made.part(codes, k), return_inverse=True)
        values = np.arange(1 << bits, dtype=np.uint64)
        masks = values[np.bitwise_count(values) <= t] if t >= 0 else values[:0]
        hit = set(N.probed(directory, int(made.part(np.array([query]), k)[0]), t, bits, masks).tolist())
        assert hit == set(np.flatnonzero(np.bitwise_count(directory ^ made.part(np.array([query]), k)[0]) <= t).tolist()) or t < 0
        found |= {int(i) for i in np.flatnonzero(np.isin(place, list(hit)))}
    assert found >= set(np.flatnonzero(np.bitwise_count(codes ^ query) <= radius).tolist())


def test_registered_query_reaches_its_recall(spark, tables):
    rows = [(r["vec_id"], r["embedding"]) for r in tables("embeddings")]
    want = {i: lists[0] for i, lists in brute_nearest([(i, v) for i, v in rows]).items() if i % 100 == 0}
    found = {}
    for r in op12_neighbours(spark, SMALL).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(found) == set(want)
    assert sum(len(found[i] & {j for _, j in near}) for i, near in want.items()) >= 0.9 * 10 * len(want)
