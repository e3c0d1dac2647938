import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import ctw
from tessera.llm.textblock import blocks

SCHEMA = "doc_id long, text string, train int, _row string, score int"


def prose(r, n):
    return " ".join("".join(r.choice(["ka", "Lo", "mi", "nu", "é"]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def base(rows):
    train = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 != 1]
    tok = lambda t: [m.group() for m in re.finditer(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [0]
    c = {}
    for x in train:
        for w in tok(x[1]):
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    return {x[0]: (len(tok(x[1])), sum(w in c for w in tok(x[1])), n, sum(math.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tok(x[1]))) for x in rows}


def test_scores(spark):
    r = random.Random(2)
    rows = [(i, prose(r, r.randrange(1, 80)), 0, "", 0) for i in range(120)] + [(200, None, 0, "", 0), (201, "", 0, "", 0), (202, "Ω new ☂ " * 9000, 0, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = {x.doc_id: x for x in ctw.score_documents(df).collect()}
    want = base(rows)
    for k, (n, known, total, score) in want.items():
        x = out[k]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (n, known, total) and abs(x.base_score - score) < 1e-6 * max(1, abs(score))
        assert x.held_out == (zlib.crc32(str(k).encode()) % 5 == 1) and x.score < 0
    held = [out[i] for i in range(120) if out[i].held_out]
    assert np.mean([x.bits_per_byte for x in held]) < 2.2 and sum(x.score for x in held) > sum(x.base_score for x in held)
    assert out[200].score == out[201].score


def test_repeats_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", 0, "", 0), (1, "a b", 0, "", 0), (None, "a b", 0, "", 0), (None, None, 0, "", 0)], SCHEMA)
    out = ctw.score_documents(df).collect()
    assert len(out) == 4 and all(x.held_out for x in out if x.doc_id is None)
    assert ctw.score_documents(df.limit(0)).count() == 0


def test_probabilities_sum_to_one():
    r = random.Random(5)
    text = prose(r, 400)
    levels = []
    keys, _ = ctw.strings(next(blocks(pa.array([text]))))
    for d in range(ctw.DEPTH + 1):
        levels.append(ctw.count_sorted(keys & np.uint64((1 << 8 * (d + 1)) - 1)))
    for ctx in (0, 0x6B61206B61, 0x4142434445):
        p = np.exp(ctw.log_probabilities(levels, np.uint64(ctx << 8) + np.arange(256, dtype=np.uint64)))
        assert abs(p.sum() - 1) < 1e-4 and (p > 0).all()


def brute_weighted(bits, contexts, depth):
    """The tree's weighted probability of a bit sequence by its definition, for one bit position."""

    def weighted(rows, d):
        a, b = sum(1 for i in rows if not bits[i]), sum(1 for i in rows if bits[i])
        kt = math.exp(math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1))
        if d == depth:
            return kt
        split = {}
        for i in rows:
            split.setdefault(contexts[i][d], []).append(i)
        return 0.5 * kt + 0.5 * math.prod(weighted(v, d + 1) for v in split.values())

    return weighted(range(len(bits)), 0)


def test_first_bit_prediction_is_the_ratio_of_weighted_probabilities():
    data = b"abacabadabacab"
    keys = np.zeros(len(data), np.uint64)
    padded = bytes(5) + data
    for i in range(len(data)):
        keys[i] = int.from_bytes(padded[i : i + 6], "big")
    levels = [ctw.count_sorted(keys & np.uint64((1 << 8 * (d + 1)) - 1)) for d in range(6)]
    # P(next | last context) equals the product over the eight bits of ratios of weighted probabilities, for bytes seen in the context and for others.
    i = 11
    for byte in (*b"abcdz", 0, 255):
        want = 1.0
        for b in range(8):
            rows = [j for j in range(len(data)) if data[j] >> (8 - b) == byte >> (8 - b)]
            bits, ctxs = [data[j] >> (7 - b) & 1 for j in rows], [padded[j : j + 5][::-1] for j in rows]
            new = brute_weighted([*bits, byte >> (7 - b) & 1], [*ctxs, padded[i : i + 5][::-1]], 5)
            want *= new / (brute_weighted(bits, ctxs, 5) if rows else 1.0)
        key = (keys[i : i + 1] & ~np.uint64(255)) | np.uint64(byte)
        got = float(np.exp(ctw.log_probabilities(levels, key)[0]))
        assert abs(got / want - 1) < 1e-4, byte
    assert abs(ctw._lgamma(np.array([0.5, 1.0, 7.3, 1e6]))[2] - math.lgamma(7.3)) < 1e-10


def test_scores_are_those_of_the_whole_tree(spark):
    r = np.random.default_rng(6)
    texts = [bytes(r.integers(97, 123, 50_000, dtype=np.uint8)).decode() for _ in range(30)]
    texts += [t[:30_000] for t in texts[:8]] + ["", "unseen ÄÖ bytes"]
    rows = [(i, t, 0, "", 0) for i, t in enumerate(texts)]
    kept = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    keys = np.concatenate([ctw.strings(b)[0] for b in blocks(pa.array(kept))])
    levels = [ctw.count_sorted(keys & np.uint64((1 << 8 * (d + 1)) - 1)) for d in range(ctw.DEPTH + 1)]
    assert sum(len(k) for k, _ in levels[3:]) > 2_000_000
    out = {x.doc_id: x.score for x in ctw.score_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for i, t in enumerate(texts):
        own = np.sort(ctw.strings(next(blocks(pa.array([t]))))[0])
        want = ctw.log_probabilities(levels, own).sum() / math.log(10)
        assert abs(out[i] - want) < 1e-5 * max(1, abs(want)), i


def text_batches(n, size, seed=8):
    r = np.random.default_rng(seed)
    return [pa.record_batch({"_text": pa.array([bytes(r.integers(97, 123, size, dtype=np.uint8)).decode()])}) for _ in range(n)]


def test_counts_leave_a_task_once_they_are_many(monkeypatch):
    batches = text_batches(6, 3000)
    whole = {}
    for b in batches:
        for k in ctw.strings(next(blocks(b.column("_text"))))[0]:
            whole[int(k)] = whole.get(int(k), 0) + 1
    monkeypatch.setattr(ctw, "_HELD", 5000)
    got, most = {}, 0
    for out in ctw._count(8)(iter(batches)):
        made = [(ctw.from_gaps(k.as_py()), ctw.from_planes(n.as_py(), np.int64)) for k, n in zip(out.column("keys"), out.column("n"))]
        most = max(most, sum(len(k) for k, _ in made))
        for keys, n in made:
            for k, c in zip(keys.tolist(), n.tolist()):
                got[k] = got.get(k, 0) + c
    assert got == whole and most < 10_000 < len(whole)


def test_a_part_is_answered_in_portions(monkeypatch):
    import types

    keys = np.unique(ctw.strings(next(blocks(text_batches(1, 4000)[0].column("_text"))))[0])
    levels = [ctw.count_sorted(keys & np.uint64((1 << 8 * (d + 1)) - 1)) for d in range(ctw.DEPTH + 1)]
    top = types.SimpleNamespace(value=ctw._Top(levels[: ctw.SHARED + 1], None))
    schema = pa.schema([("p", pa.int32()), ("depth", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("kind", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])
    rows = [{"p": 3, "depth": d, "keys": ctw.gaps(levels[d][0]), "n": ctw.planes(levels[d][1]), "kind": 0} for d in range(ctw.SHARED + 1, ctw.DEPTH + 1)]
    rows += [{"p": 3, "kind": 1, "block": i, "data": ctw.gaps(keys[i : i + 500])} for i in range(40)]
    taken = []
    batches = (taken.append(i) or pa.RecordBatch.from_pylist([x], schema) for i, x in enumerate(rows))
    monkeypatch.setattr(ctw, "_ASKED", 1000)
    made = ctw._score_parts(top)(batches)
    first = next(made)
    assert len(taken) <= 6 and len(first) == 2
    out = {b.as_py(): ctw.from_planes(x.as_py(), np.float32) for batch in (first, *made) for b, x in zip(batch.column("block"), batch.column("data"))}
    want = ctw.log_probabilities(levels, keys)
    assert sorted(out) == list(range(40)) and all(np.allclose(x, want[i : i + 500], atol=1e-5) for i, x in out.items())


def test_parts_follow_the_size_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(ctw, "_PART_BYTES", 1000)
    df = spark.createDataFrame([("ab" * 1000,)] * 50 + [(None,)], "_text string").coalesce(1)
    assert ctw._parts(df) == 100 and ctw._parts(df.limit(0)) == 8


def test_stored_rows_are_small(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i, i, prose(r, 2000) * 8) for i in range(100)], "_id long, _row long, _text string").coalesce(1)
    whole = df.selectExpr("sum(length(_text))").first()[0]
    sizes = [len(x.data) for x in df.mapInArrow(ctw._string_blocks(8), "block bigint, kind int, p int, data binary").where("kind = 0").collect()]
    assert whole > 5 << 20 and max(sizes) < 1 << 19
