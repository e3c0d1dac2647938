"""Every operator on tables with extra columns of names that it uses itself, nulls, repeats and ties."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, cotrain, ctw, langid, lexical, merkle, near_dedup, packing, quality_rules, sentencepiece_codec, suffix_dedup, token_counts, warc

EXTRA = ("_k", "_text", "_rest", "_id", "_th", "_key", "_row", "_f", "_l", "_order", "key", "block", "part", "rows", "train", "score", "kept", "n_words", "meta", "node", "comp", "name", "bands", "runs", "spans", "start", "n", "at", "y", "toxic", "shard", "tie", "payload", "languages")


def odd(spark):
    long_text = "many words of a very long text " * 3000
    texts = [None, "", " \n ", "One two three four five six seven", "One two three four five six seven", "é" * 900, long_text, "x " * 60, "a quite normal line of plain text which says a few things about rain and then ends here.\n"]
    rows = [(i, t, ["en", None][i % 2], "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, "another text of id three", "de", None, 3), (3, texts[3], "de", "s", 3), (None, "no id at all", "fr", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit("v").alias(c) for c in EXTRA]), len(rows)


def labels(spark):
    return spark.createDataFrame([(i, int(i > 4), int(i == 1)) for i in range(9)] + [(3, 1, 0), (None, 1, 0), (77, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "suffix_dedup": lambda d, s: suffix_dedup.measure_repeats(d),
    "packing": lambda d, s: packing.pack(d, window=64),
    "sentencepiece": lambda d, s: sentencepiece_codec.encode(d),
    "near_dedup": lambda d, s: near_dedup.near_duplicates(d),
    "warc": lambda d, s: warc.round_trip(d, "doc_id", "source", "text"),
    "cotrain": lambda d, s: cotrain.score(d, cotrain.fit(d, labels(s))),
    "ctw": lambda d, s: ctw.score_documents(d),
    "rules": lambda d, s: quality_rules.apply_rules(d, quality_rules.learn_rules(d, labels(s))),
    "merkle": lambda d, s: merkle.manifest(d),
    "token_counts": lambda d, s: token_counts.count_tokens(d),
    "langid": lambda d, s: langid.identify(d, langid.learn(d), [F.col("doc_id")]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(spark, name):
    docs, n = odd(spark)
    rows = OPERATORS[name](docs, spark).collect()
    assert len(rows) >= n if name == "packing" else len(rows) == n
    assert OPERATORS[name](docs.limit(0), spark).count() == 0


def test_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.5, None]), (6, [0.2, 0.9]), (None, [1.0, 1.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *[F.lit("v").alias(c) for c in ("vec", "rb", "qb", "codes", "q", "rn", "query_id", "rank")])
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(df, df, k=5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 1.0), (1, 2, 6, 0.2), (2, 1, 1, 1.0), (2, 2, 6, 0.2), (6, 1, 1, 0.2), (6, 2, 2, 0.2)]


def test_search(spark):
    docs, _ = odd(spark)
    got = lexical.search(docs, docs, item_col="doc_id")
    assert got.columns == ["doc_id", "rank", "doc_id", "score"] and got.count() > 0
    assert lexical.search(docs.limit(0), docs, item_col="doc_id").count() == 0


def test_filters_keep_all_columns(spark):
    docs, _ = odd(spark)
    rules = quality_rules.learn_rules(docs, labels(spark))
    for out in (quality_rules.filter_by_rules(docs, rules), cotrain.filter_good(docs, cotrain.fit(docs, labels(spark))), near_dedup.drop_near_duplicates(docs), suffix_dedup.remove_repeats(docs, length=101)):
        assert out.columns == docs.columns and out.count() > 0
        assert out.where("bands <> 'v'").count() == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stage(spark, stage, tmp_path):
    docs, _ = odd(spark)
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, str(tmp_path))
    assert out.count() > 0 and run(spark, docs.limit(0), str(tmp_path)).count() == 0
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
