import random
import zlib

import numpy as np

from tessera.llm import packing

SCHEMA = "doc_id long, text string, rest int, bucket int, n string"


def texts(seed=1, n=150):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randrange(2, 9)))
    out = [None, "", "a", "<|endoftext|> x", "z" * 9000, "é 1234 " * 3000]
    return out + [" ".join(word() for _ in range(r.choice([5, 40, 40, 300, 1500]))) for _ in range(n)]


def check(rows, docs, window):
    """All ids lie in one piece each, pieces tile sequences, and nothing is padded."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for k, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        ids = docs[k]
        at = 0
        for p in pieces:
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at == window or (at < window and at & (at - 1) == 0)


def test_pieces_tile(spark):
    from tokenizers import Tokenizer

    t = texts()
    tok = Tokenizer.from_file(packing.default_paths()[0])
    docs = {i: [*(tok.encode(x, add_special_tokens=False).ids if x else []), 1] for i, x in enumerate(t)}
    df = spark.createDataFrame([(i, x, 0, 0, "") for i, x in enumerate(t)], SCHEMA).repartition(3)
    for window in (2048, 64):
        check(packing.pack(df, window=window).collect(), docs, window)
    again = packing.pack(df, window=64, with_ids=True).where("doc_id = 5").orderBy("start").collect()
    assert [i for r in again for i in r.ids] == docs[5]
    assert packing.pack(df.limit(0)).count() == 0


def test_copies_and_small_buckets(spark):
    old = packing.BUCKET_ROWS
    packing.BUCKET_ROWS = 7
    try:
        df = spark.createDataFrame([(i, "the same words again", 0, 0, "") for i in range(90)] + [(None, "x y", 0, 0, "")], SCHEMA)
        rows = packing.pack(df, window=16).collect()
    finally:
        packing.BUCKET_ROWS = old
    ids = packing.Encoder(*packing.default_paths())
    check([r for r in rows if r.doc_id is not None] + [r for r in rows if r.doc_id is None], {**{i: [*ids("the same words again"), 1] for i in range(90)}, None: [*ids("x y"), 1]}, 16)


def test_least_squares_uses_the_histogram():
    hist = np.zeros(64, np.int64)
    hist[[10, 54, 20, 24, 16]] = [100, 90, 50, 30, 40]
    combos = packing.combinations(hist, 64)
    counts = packing.solve_counts(hist, combos)
    used = np.zeros(64, np.int64)
    for c, k in zip(combos, counts, strict=True):
        assert sum(n * t for n, t in c.items()) == 64
        for n, t in c.items():
            used[n] += k * t
    assert (used <= hist).all() and (used * np.arange(64)).sum() > 0.8 * (hist * np.arange(64)).sum()
