"""op6 and op10 against versions that loop over one document at a time."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import cotrain, langid
from tessera.llm.text_stats import block_counts, ratio_matrix
from tessera.llm.textblock import blocks


def plain_score(model, text, meta):
    """The two views of one document, weight by weight, and whether it stays."""
    block = next(blocks(pa.array([text])))
    ratios = ratio_matrix(block_counts(block))[0]
    words = {}
    for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode()):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        for _ in range(2):
            w = w[:-1] if len(w) > 1 and w[-1:] in b".,;:!?\"')(" else w
        words[w] = int(cotrain.word_buckets(next(blocks(pa.array([w.decode("latin-1")]))))[1][0]) if w.isascii() else None
    assert all(b is not None for b in words.values())

    def logit(of):
        beta, bias, a, b = of.text
        z = bias
        for f, edges in enumerate(model.edges):
            z += beta[f * cotrain._BINS + sum(e <= ratios[f] for e in edges)]
        for bucket in set(words.values()):
            if of.columns[bucket] >= 0:
                z += beta[len(model.edges) * cotrain._BINS + of.columns[bucket]]
        return a * z + b

    beta, bias, a, b = model.meta
    zt, zm = logit(model), a * (bias + sum(beta[i] for i in meta)) + b
    u, v, c = model.mix
    sig = lambda z: 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
    toxic = sig(logit(model.toxic)) if model.toxic else 0.0
    return sig(zt), sig(zm), sig(u * zt + v * zm + c), toxic


def test_cotraining_scores(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(240):
        w = [r.choice(vocab) for _ in range(r.randrange(20, 60))]
        kind = i % 6
        if kind == 0:
            w[3:5] = ["vile,", "NASTY!"]
        if kind == 1:
            w = ["#" * 5] * 4 + w[:9]
        rows.append((i, " ".join(w) + ".\n", "en", "spam" if kind < 2 and r.random() < 0.8 else "src1", 99))
        if i < 160:
            labels.append((i, int(kind != 1), int(kind == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = cotrain.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    meta = {x.doc_id: x.m for x in docs.select("doc_id", cotrain.meta_columns(docs).alias("m")).collect()}
    assert model.toxic is not None
    for x in cotrain.score(docs, model).collect():
        text, whole = rows[x.doc_id][1], plain_score(model, rows[x.doc_id][1], meta[x.doc_id])
        assert np.allclose([x.text_score, x.meta_score, x.score], whole[:3], atol=1e-4), text
        if abs(whole[2] - model.threshold) > 1e-4 and abs(whole[3] - model.toxic.cut) > 1e-4:
            assert x.kept == (whole[2] >= model.threshold and whole[3] < model.toxic.cut)


def plain_languages(model, text):
    """Expectation-maximisation over one document's trigrams, in plain loops."""
    raw = (text or "").encode()
    clean = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in raw)
    padded, counts = b" " + clean + b" ", {}
    for i in range(len(padded) - 2):
        k = padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]
        if k != 0x202020:
            h = (k * 0x9E3779B97F4A7C15 % 2**64) >> (64 - langid.GRAM_BITS)
            counts[h] = counts.get(h, 0) + 1
    if not counts:
        return [], 0.0
    langs, total = range(len(model.names)), sum(counts.values())

    def em(mix, steps):
        for _ in range(steps):
            new = [0.0] * len(mix)
            for g, n in counts.items():
                joint = [mix[j] * float(model.prob[g, j]) for j in langs]
                for j in langs:
                    new[j] += n * joint[j] / max(sum(joint), 1e-30)
            mix = [x / total for x in new]
        like = sum(n * math.log(max(sum(mix[j] * float(model.prob[g, j]) for j in langs), 1e-30)) for g, n in counts.items())
        return mix, like

    mix, _ = em([1 / len(langs)] * len(langs), 6)
    order = sorted(langs, key=lambda j: -mix[j])
    best, gain = None, -math.inf
    for k in range(1, len(langs) + 1):
        made, like = em([1 / k if j in order[:k] else 0.0 for j in langs], 0 if k == 1 else 5)
        if like - 3.0 * (k - 1) * math.log(total + 1) > gain + 1e-6:
            best, gain = made, like - 3.0 * (k - 1) * math.log(total + 1)
    chosen = sorted((j for j in langs if best[j] > 0), key=lambda j: -best[j])
    return [model.names[j] for j in chosen], best[chosen[0]]


def test_language_sets(spark):
    syllables = {"aa": "ka lo mi nu pe", "bb": "str ung sch eit ver", "cc": "ção ñe üm ée oix", "dd": "qua zed xor wyn jip"}
    r = random.Random(3)
    prose = lambda lang, n: " ".join("".join(r.choice(syllables[lang].split()) for _ in range(r.randrange(1, 4))) for _ in range(n))
    rows = [(i, prose(lang, 50), lang) for i in range(40) for lang in [sorted(syllables)[i % 4]]]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = [" ".join(prose(lang, n) for lang, n in parts) for parts in ([("aa", 40), ("bb", 30)], [("aa", 30), ("bb", 30), ("cc", 30)], [(x, 40) for x in syllables], [("dd", 9)], [("cc", 2), ("dd", 2)])]
    texts = [x[1] for x in rows[:8]] + mixed + ["A", "é", "!!"]
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, [F.col("doc_id")]).collect()
    for x in got:
        names, share = plain_languages(model, texts[x.doc_id])
        if not re.search(r"[^\W\d_]", texts[x.doc_id]):
            names, share = [], 0.0
        assert x.languages == names and abs(x.score - share) < 2e-3, texts[x.doc_id][:60]
        assert x.lang_pred == (names[0] if names else "und")
    assert len(next(x for x in got if x.doc_id == 10).languages) == 4
