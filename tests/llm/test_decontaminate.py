import hashlib
import random
import re

import pytest

from mailspark.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, span=13):
    windows = {}
    for item, text in items:
        found = words(text)
        size = min(span, len(found))
        for k in range(len(found) - size + 1 if found else 0):
            windows.setdefault(tuple(found[k : k + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        found, hit, named = words(text), set(), set()
        for size in sizes:
            for k in range(len(found) - size + 1):
                items_here = windows.get(tuple(found[k : k + size]))
                if items_here:
                    hit.update(range(k, k + size))
                    named |= {str(i) for i in items_here if i is not None}
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((doc, len(found), len(hit), len(named), digest, len(hit) > 0 and 20 * len(hit) >= len(found)))
    return out


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def same(spark, docs, items, span=13):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows(D.contamination(spark, d, i, span)) == sorted(plain(docs, items, span), key=repr)


def test_few_words_repeat_a_lot(spark):
    """Three different words only: many equal k-grams, ties in every window, overlapping hits."""
    pick = random.Random(3)
    text = lambda n: " ".join(pick.choice(["ab", "Cd", "éf"]) for _ in range(n))
    same(spark, [(k, text(pick.randint(0, 60))) for k in range(60)], [(k, text(pick.randint(0, 9))) for k in range(12)], span=6)


def test_spans_over_borders_are_no_hits(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = [(1, " ".join(f"w{k}" for k in range(6))), (2, " ".join(f"w{k}" for k in range(6, 20))), (3, "x " + item.upper() + "!"), (4, item[:-1])]
    same(spark, docs, [(7, item), (8, item), (9, "short one"), (10, None), (11, ""), (12, "w1 w2")])


def test_odd_rows(spark, odd, odd_rows):
    items = [(1, "the rising sun"), (1, "the rising sun"), (None, "der die"), (2, "a b"), (3, None), (4, "other text")]
    i = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows(D.contamination(spark, odd, i)) == sorted(plain([r[:2] for r in odd_rows], items), key=repr)
    clean = D.decontaminated(spark, odd, i)
    assert clean.columns == odd.columns
    bad = [r for r in plain([r[:2] for r in odd_rows], items) if r[-1]]
    assert clean.count() == len(odd_rows) - len(bad) and bad


@pytest.mark.parametrize("side", ["docs", "items"])
def test_empty_tables(spark, odd, no_docs, side):
    items = spark.createDataFrame([] if side == "items" else [(1, "the rising sun")], "item_id bigint, text string")
    docs = no_docs if side == "docs" else odd
    got = D.contamination(spark, docs, items)
    assert got.count() == docs.count() and not got.filter("contaminated").count()
    assert D.decontaminated(spark, docs, items).count() == docs.count()
