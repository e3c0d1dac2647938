"""The stored term index: what it finds, what it reads, and what it refuses."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval
from tessera.operators.postings import Postings, PostingsFault

ROWS = [(1, "red ink on paper", "en tag-a"), (2, "Red red 光影动画", "fr"), (3, None, "ink"), (None, "paper", None), (4, "", ""), (5, "inks", "en")]


def build(spark, path, rows=ROWS, revision="r1", buckets=16):
    docs = spark.createDataFrame(rows, "id long, body string, tags string")
    fields = {"body": retrieval.search_tokens(F.lower("body")), "tags": retrieval.search_tokens(F.lower("tags"))}
    return docs, Postings.build(docs, path, "id", fields, revision, buckets)


def test_terms_fields_and_frequencies(spark, tmp_path):
    _, index = build(spark, f"file://{tmp_path}/ix")
    got = {(r.term, r.field, r.id): r.n for r in index.lookup(["red", "ink", "paper", "光影", "none"]).collect()}
    assert got == {("red", "body", 1): 1, ("red", "body", 2): 2, ("ink", "body", 1): 1, ("ink", "tags", 3): 1, ("paper", "body", 1): 1, ("paper", "body", None): 1, ("光影", "body", 2): 1}
    assert index.lookup([]).count() == 0 and index.lookup(["nothing"]).count() == 0


def test_scores_are_those_of_the_scan(spark, tmp_path):
    docs, index = build(spark, f"file://{tmp_path}/ix")
    query, weights = ("ink", "red", "en", "动画"), {"body": 1, "tags": 8}
    fields = {"body": (retrieval.search_tokens(F.lower("body")), 1), "tags": (retrieval.search_tokens(F.lower("tags")), 8)}
    want = {(r.id, r.score, tuple(r.matched)) for r in retrieval.lexical_matches(docs.na.fill(""), ["id"], fields, F.array(*map(F.lit, query))).where("score > 0").collect()}
    assert {(r.id, r.score, tuple(r.matched)) for r in index.lexical(query, weights).collect()} == want and len(want) == 4


def test_only_the_terms_buckets_are_read(spark, tmp_path):
    _, index = build(spark, f"file://{tmp_path}/ix", [(i, f"word{i} common", "") for i in range(300)])
    found = index.lookup(["word7"])
    assert len(found.inputFiles()) == 16  # before the filter on buckets
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(term" in plan or "EqualTo(term" in plan
    assert found.count() == 1 and index.lookup(["common"]).count() == 300


def test_whole_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    with pytest.raises(PostingsFault):
        Postings(spark, path)
    docs, index = build(spark, path)
    index.verify("r1")
    with pytest.raises(PostingsFault):
        index.verify("r2")
    with pytest.raises(FileExistsError):
        build(spark, path)
    os.remove(sorted(glob.glob(f"{tmp_path}/ix/rows/*/*.parquet"))[0])
    with pytest.raises(PostingsFault):
        Postings(spark, path).verify()
    _, none = build(spark, f"file://{tmp_path}/none", [(1, None, None)])
    none.verify()
    assert none.lexical(["a"], {"body": 1}).count() == 0


def test_tokens_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def words(text):
        made.add(1)
        return text.split()

    docs = spark.createDataFrame([(i % 90, f"red ink {i}") for i in range(100)], "id long, body string")
    index = Postings.build(docs, f"file://{tmp_path}/once", "id", {"body": F.udf(words, "array<string>")("body")}, "r1", 8)
    assert made.value == 100
    index.verify("r1")
    assert sorted(r.n for r in index.lookup(["ink"]).collect()) == [1] * 80 + [2] * 10
    assert sorted(os.listdir(f"{tmp_path}/once")) == ["RECEIPT", "rows"]


def test_a_terms_documents_are_stored_as_lists(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", ["common", "common", None, f"own{i}"]) for i in range(300)] + [(None, ["common"]), ("e", None)], "id string, words array<string>").coalesce(2)
    index = Postings.build(docs, f"file://{tmp_path}/lists", "id", {"w": F.col("words")}, "r1", 4)
    index.verify("r1")
    assert index.receipt["rows"] == 601 and not index.receipt["repeated"]
    assert spark.read.parquet(f"{tmp_path}/lists/rows").where("term = 'common'").count() == 2
    assert {(r.id, r.n) for r in index.lookup(["common"]).collect()} == {(f"d{i}", 2) for i in range(300)} | {(None, 1)}
    assert [(r.field, r.id, r.n) for r in index.lookup(["own7"]).collect()] == [("w", "d7", 1)]


def test_texts_stay_where_they_are(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * 200) for i in range(50)], "id long, body string")
    written = []
    build = type(docs.write).parquet
    try:
        type(docs.write).parquet = lambda self, path, *a, **b: (written.append(path), build(self, path, *a, **b))[1]
        index = Postings.build(docs, f"file://{tmp_path}/once", "id", {"body": F.split("body", " ")}, "r1", 4)
    finally:
        type(docs.write).parquet = build
    assert [p.rsplit("/", 1)[-1] for p in written] == ["rows"]
    assert {r.n for r in index.lookup(["word"]).collect()} == {200}


def test_the_seed_index_stores_words_by_lists(spark, sf_dir):
    from tessera.plans import analytics, knowledge

    index = knowledge._index(analytics.Tables(spark, sf_dir))
    stored = spark.read.parquet(f"{index.path}/rows")
    assert index.receipt["rows"] == index.rows().count() > 2 * stored.count()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = docs.where(F.array_contains(F.split(F.lower("text"), r"\s+"), "and")).select("doc_id").collect()
    assert {r.id for r in index.lookup(["and"]).where("field = 'fts'").collect()} == {r.doc_id for r in want} and want
