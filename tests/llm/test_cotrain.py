import random

import pyarrow as pa

from tessera.llm import cotrain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def corpus(n=400, seed=2):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [r.choice(vocab) for _ in range(r.randrange(30, 90))]
        if bad:
            words[r.randrange(len(words))] = "vile,"
            words[r.randrange(len(words))] = "nasty"
        source = "spam" if bad and r.random() < 0.9 else f"src{r.randrange(3)}"
        rows.append((i, " ".join(words), "en", source, 100, "x"))
        if i < n // 2:
            labels.append((i, int(not bad), 0) if i % 8 else (i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_exchange(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    model = cotrain.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.exchanged > 0 and model.held_out > 0.9
    out = {r.doc_id: r for r in cotrain.score(docs, model).collect()}
    right = sum(out[i].kept == (i % 4 != 0) for i in range(200, 400))
    assert right >= 190 and all(0 <= r.score <= 1 for r in out.values())
    kept = cotrain.filter_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out.values())


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(None, None, None, None, None, ""), (1, "", "en", None, 0, ""), (1, "", "en", None, 0, ""), (2, "x " * 50_000, "en", "s", 9, "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert cotrain.fit(docs, none) is None
    assert cotrain.score(docs, None).where("kept").count() == 4
    rows, labels = corpus(80)
    model = cotrain.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert cotrain.score(docs, model).count() == 4
    assert cotrain.score(docs.limit(0), model).count() == 0
    assert cotrain.score(docs.select("doc_id", "text"), model).count() == 4


def test_label_noise_does_not_open_the_threshold(spark):
    rows, labels = corpus(2400, 7)
    r = random.Random(3)
    clean = {i: int(i % 4 != 0) for i in range(2400)}
    # one bad row in twenty is labelled good: held-out "good" rows with the lowest scores are bad ones
    noisy = [(i, 1, 0) if not clean[i] and r.random() < 0.05 else (i, q, t) for i, q, t in labels]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = cotrain.fit(docs, spark.createDataFrame(noisy, "doc_id long, quality int, toxic int"))
    out = {x.doc_id: x.kept for x in cotrain.score(docs, model).collect()}
    rest = range(1200, 2400)
    assert sum(out[i] for i in rest if not clean[i]) <= 0.02 * 300
    assert sum(not out[i] for i in rest if clean[i]) <= 0.05 * 900
    assert model.toxic is not None and model.toxic.recall > 0.5 and 0 < model.threshold < 1


def test_cut_weighs_both_errors():
    import numpy as np

    score = np.array([0.02, 0.05, 0.1, 0.2, 0.03, 0.8, 0.9, 0.7, 0.95, 0.99])
    good = np.array([0, 0, 0, 0, 1, 1, 1, 1, 1, 1], bool)
    assert 0.2 < cotrain._best_cut(score, good) < 0.7


def test_views_exchange_labels_over_all_rows(spark, monkeypatch):
    rows, labels = corpus(9000, 11)
    labels = [x for x in labels if x[0] < 400]
    asked = []
    sure = cotrain._sure
    monkeypatch.setattr(cotrain, "_sure", lambda *a: asked.append(a) or sure(*a))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = cotrain.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(asked) == 3 and model.exchanged > 0
    # every unlabelled row is seen, not a sample of 4,000
    one = docs.selectExpr("doc_id as _k", "xxhash64(doc_id, text) as key", "text as _text", "*").withColumn("meta", cotrain.meta_columns(docs)).select("_k", "key", "_text", "meta")
    fields = [pa.field("_k", pa.int64()), pa.field("key", pa.int64())]
    one = one.mapInArrow(cotrain._features(*fields), f"_k bigint, key bigint, {cotrain._FEATURES}")
    seen = one.mapInArrow(sure(asked[0][0], 0.0, asked[0][2]), "_k bigint, key bigint, view int, label int, sure double")
    assert seen.where("view = 0").select("key").distinct().count() == 9000
