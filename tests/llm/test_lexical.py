"""Ranked search against the definition."""

import random

import numpy as np
import pytest

from tessera.llm import lexical


def tables(n=400, m=30, seed=5):
    rnd = random.Random(seed)
    words = ["the", "The", "é", "x1", "a_b", "你好", *(f"w{i}" for i in range(60))]

    def text():
        return rnd.choice([" ", "-", "\n"]).join(rnd.choice(words[: rnd.choice([3, 20, 66])]) for _ in range(rnd.randrange(40)))

    docs = [(i, None if i % 17 == 0 else text()) for i in range(n)] + [(3, "w1 w2 w2"), (3, "w1 w2 w2"), (900, "w1 w2 w2")]
    items = [(i, None if i == 4 else "" if i == 5 else text()) for i in range(m)] + [(50, "nowhere else"), (51, "w1 W2")]
    return docs, items


@pytest.mark.parametrize(("k", "slice_terms", "cells"), [(50, 1 << 20, 1 << 21), (3, 250, 1 << 21), (7, 1 << 20, 64)])
def test_definition(spark, monkeypatch, k, slice_terms, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    docs, items = tables()
    df = spark.createDataFrame([(*d, "v", "v") for d in docs], "doc_id long, text string, rank string, item string").repartition(5)
    qs = spark.createDataFrame([(*i, "v") for i in items], "item_id long, text string, doc string")
    got = lexical.search(df, qs, k=k, slice_terms=slice_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(lexical.brute_force(docs, items, k))


def test_odd_rows(spark):
    docs = [(1, "a b"), (None, "a a c"), (2, None), (3, "a " * 200_000), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (2, None)], "item_id long, text string")
    got = sorted(map(tuple, lexical.search(df, items).collect()))
    # Rows without an id count in the statistics but aren't found; rows of one item are one item.
    assert got == sorted((i, r, d, s) for i, r, d, s in lexical.brute_force([(d if d is not None else -1, t) for d, t in docs], [(1, "a b")]) if d != -1) and len(got) == 2
    assert lexical.search(df.limit(0), items).count() == lexical.search(df, items.limit(0)).count() == 0
    twice = lexical.search(df, spark.createDataFrame([(1, "b b")], "item_id long, text string"), once_each=False).collect()
    once = lexical.search(df, spark.createDataFrame([(1, "b b")], "item_id long, text string")).collect()
    assert twice[0].doc_id == once[0].doc_id == 1 and twice[0].score == 2 * once[0].score


def test_impacts_beyond_64_bits():
    tf, n = np.array([1, 3]), np.array([10, 2_000_000_000])
    docs, length = 10**11, 10**14
    want = [1_000_000_000 * int(t) // (1000 * int(t) + 20 * (50 + 50 * int(x) * docs // length)) for t, x in zip(tf, n, strict=True)]
    assert lexical.impacts(tf, n, docs, length).tolist() == want
