import random

import numpy as np

from tessera.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, node string, bands int, comp string"


def corpus(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [r.choice(vocab) for _ in range(150)]

    def edited(k):
        w = list(base)
        for _ in range(k):
            w[r.randrange(150)] = r.choice(vocab)
        return " ".join(w)

    texts = [None, "", " \n", "One two", "one  TWO", "one two three"]
    texts += [edited(r.randrange(0, 8)) for _ in range(90)]
    texts += [" ".join(r.choice(vocab) for _ in range(r.randrange(5, 300))) for _ in range(20)]
    texts += [texts[10], texts[10].upper(), texts[100] + " x"]
    return texts


def test_equals_brute_force(spark):
    texts = corpus()
    rows = [(i * 3 + 1, t, "n", 1, "c") for i, t in enumerate(texts)]
    sizes, least = nd.brute_force(texts, 3, 85)
    old = nd.SMALL, nd.CHUNK
    try:
        for small, chunk in (old, (3, 10)):  # pairs within small buckets, several blocks in larger ones
            nd.SMALL, nd.CHUNK = small, chunk
            out = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), width=3, percent=85).collect()
            got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in out}
            assert got == {i * 3 + 1: (n, c * 3 + 1, i == c) for i, (n, c) in enumerate(zip(sizes, least, strict=True))}
    finally:
        nd.SMALL, nd.CHUNK = old
    assert sum(i != c for i, c in enumerate(least)) > 40


def test_empty_null_ids_and_repeats(spark):
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    t = "a b c d e f g"
    rows = [(None, t, "", 0, ""), (5, t, "", 0, ""), (5, t, "", 0, ""), (None, "other words here", "", 0, ""), (7, None, "", 0, "")]
    out = sorted(((x.doc_id, x.component_id, x.kept) for x in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert out == sorted([(None, 5, False), (5, 5, True), (5, 5, True), (None, None, True), (7, 7, True)], key=str)
    left = nd.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(left) == 3 and left[0].__fields__ == ["doc_id", "text", "node", "bands", "comp"]


def test_rows_without_an_id_or_of_one_id_are_told_apart_by_text(spark):
    t = "a b c d e f g"
    rows = [(None, t), (5, t), (5, t), (None, "other words here"), (7, None), (None, "a third text"), (None, "a third text"), (5, "quite another one"), (8, "quite another ONE")]
    left = nd.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(5, t), (None, "other words here"), (7, None), (None, "a third text"), (5, "quite another one")], key=str)


def test_signature_estimates():
    r = np.random.default_rng(1)
    e = r.integers(0, 1 << 63, 900, dtype=np.uint64)
    h = np.concatenate([e[:600], e[100:900]])
    owner = np.repeat([0, 1], [600, 800])
    sig = nd.signatures(h, owner, 2)
    assert abs((sig[0] == sig[1]).mean() - 500 / 900) < 0.12
    one = nd.signatures(e[:3], np.zeros(3, np.int64), 1)
    assert (one != np.uint64(2**64 - 1)).all()
    assert (nd.common_counts([e[:5], e[3:4]], [e[2:9]]) == [[3], [1]]).all()


def test_strings_made_to_cancel_modulo_powers_of_two_differ():
    import pyarrow as pa

    from tessera.llm.textblock import blocks

    bits = [0]
    for _ in range(12):
        bits += [1 - x for x in bits]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    block = next(blocks(pa.array([a, b, a])))
    h = block.hashes(block.offs[:-1], block.offs[1:])
    assert h[0] == h[2] != h[1]


def test_signature_threshold_is_the_exact_tail():
    from fractions import Fraction
    from math import comb

    for percent in (80, 85, 95):
        p = Fraction(percent, 100)
        below = lambda k: sum(comb(nd.SLOTS, i) * p**i * (1 - p) ** (nd.SLOTS - i) for i in range(k))  # noqa: E731, B023
        least = nd.least_matches(percent)
        assert below(least) <= nd.LOST < below(least + 1)


def test_full_sets_everywhere(spark):
    texts = corpus(9)
    rows = [(i, t, "n", 1, "c") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), width=3, percent=85, exact=True).collect()}
    sizes, label = nd.brute_force(texts, 3, 85)
    assert got == {i: (sizes[i], label[i]) for i in range(len(texts))}
