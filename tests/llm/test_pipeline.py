"""The stages of the pipeline against plain versions, one after another, and the whole chain."""

import random
import re

import pytest
from test_plain_versions import plain_score

import corpus_pipeline
from tessera.llm import cotrain, near_dedup, quality_rules

VOCAB = ["".join(random.Random(i).choices("abcdefghijklmnop", k=3 + i % 7)) for i in range(900)]


def corpus():
    r = random.Random(11)
    prose = lambda n: " ".join(r.choice(VOCAB) for _ in range(n))
    shared, rows, labels = prose(55), [], []
    for i in range(180):
        text, bad, toxic = prose(r.randrange(60, 140)), False, False
        if i % 9 == 0:
            text, bad = "## $$ %% " * 20 + prose(12), True
        elif i % 9 == 1:
            text, toxic = text.replace(" ", " vilest ", 3), True
        elif i % 30 == 2:
            text = prose(20) + " " + shared + " " + prose(30)
        rows.append((i, text, "en", "src1", len(text)))
        if i < 120:
            labels.append((i, int(not bad), int(toxic)))
    for j, i in enumerate((5, 6, 7)):
        w = rows[i][1].split()
        w[len(w) // 2] = "changed"
        rows.append((200 + j, " ".join(w), "en", "src1", 1))
    rows += [(300, rows[8][1], "en", "src1", 1), (301, "too short", "en", "src1", 1), (302, None, None, None, None)]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus()
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def plain_counts(t):
    raw = (t or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    return len(words), len(again)


def plain_cut(texts):
    """Passages of more than 50 words, or 300 bytes, all of whose 101-byte strings stand elsewhere too."""
    length, seen = corpus_pipeline.LEAST_BYTES, {}
    raws = {k: (t or "").encode() for k, t in texts.items()}
    for raw in raws.values():
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = {}
    for k, raw in raws.items():
        keep, i = [True] * len(raw), 0
        while i <= len(raw) - length:
            if seen[raw[i : i + length]] < 2:
                i += 1
                continue
            j = i
            while j <= len(raw) - length and seen[raw[j : j + length]] > 1:
                j += 1
            a, z = i, j - 1 + length
            inner = len(raw[a:z].split()) - (a > 0 and raw[a - 1 : a].isalnum() and raw[a : a + 1].isalnum()) - (z < len(raw) and raw[z - 1 : z].isalnum() and raw[z : z + 1].isalnum())
            if inner > corpus_pipeline.REPEAT_WORDS or z - a >= corpus_pipeline.REPEAT_BYTES:
                keep[a:z] = [False] * (z - a)
            i = j
        out[k] = None if texts[k] is None else bytes(c for c, g in zip(raw, keep, strict=True) if g).decode("utf-8", "ignore")
    return out


def test_stages_equal_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rules = quality_rules.learn_rules(docs, labels)
    kept = texts_of(corpus_pipeline.rules(spark, docs, folder))
    ratios = {r.doc_id: r for r in docs.select("doc_id", "text").collect()}
    for i, row in ratios.items():
        n, again = plain_counts(row.text)
        if n < 10 or 100 * again > 20 * n:
            assert i not in kept
    verdicts = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs, rules).collect()}
    assert set(kept) == {i for i, ok in verdicts.items() if ok} and not any(i in kept for i in range(0, 180, 9))

    docs = docs.where(docs.doc_id.isin(list(kept)))
    model = cotrain.fit(docs, labels)
    meta = {r.doc_id: r.m for r in docs.select("doc_id", cotrain.meta_columns(docs).alias("m")).collect()} if model else {}
    good = texts_of(corpus_pipeline.classifier(spark, docs, folder))
    if model is not None:
        for i in kept:
            _, _, score, toxic = plain_score(model, kept[i], meta[i])
            assert (i in good) == (score >= model.threshold and toxic < (model.toxic.cut if model.toxic else 2)) or abs(score - model.threshold) < 1e-4
        assert sum(i % 9 == 1 for i in good if i < 180) <= 2 and len(good) > 120

    docs = docs.where(docs.doc_id.isin(list(good)))
    ids = sorted(good)
    _, least = near_dedup.brute_force([good[i] for i in ids], 5, 80)
    left = texts_of(corpus_pipeline.near_duplicates(spark, docs, folder))
    assert left == {i: good[i] for k, i in enumerate(ids) if least[k] == k} and not {200, 201, 202, 300} & set(left)

    docs = docs.where(docs.doc_id.isin(list(left)))
    cut = texts_of(corpus_pipeline.repeats(spark, docs, folder))
    assert cut == plain_cut(left) and sum(cut[i] != left[i] for i in cut) >= 4

    pieces = corpus_pipeline.packed(spark, spark.createDataFrame(list(cut.items()), "doc_id long, text string"), folder).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(cut)
    for own in by_doc.values():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == own[0].doc_tokens
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048


def test_the_chain_is_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
    want = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.packed(spark, docs, folder).collect()}
    got = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()}
    assert {(d, sum(x[2] for x in got if x[0] == d)) for d in {x[0] for x in got}} == {(d, sum(x[2] for x in want if x[0] == d)) for d in {x[0] for x in want}}
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "suffix_dedup", "packing"]


def test_filters_send_each_text_to_python_once(spark):
    r = random.Random(4)
    texts = [" ".join(f"word{r.randrange(10**9)}" for _ in range(300)) + (" vile nasty" if i % 4 == 0 else "") for i in range(200)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, Text string, lang string, source string").coalesce(1)
    model = cotrain.fit(docs, spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(200)], "doc_id long, quality int"))
    total = sum(map(len, texts))
    for kept in (cotrain.filter_good(docs, model), quality_rules.filter_by_rules(docs, [])):
        rows = kept.collect()
        assert kept.columns == docs.columns and 100 < len(rows) and all(x.Text == texts[x.doc_id] for x in rows)
        plan = kept._jdf.queryExecution().executedPlan()
        while plan.metrics().get("pythonDataSent").isEmpty():
            plan = plan.children().apply(0)
        assert total < plan.metrics().get("pythonDataSent").get().value() < 1.5 * total
