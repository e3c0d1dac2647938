"""Versioned tables: what writes touch, what they refuse, and what readers of old versions see."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.versioned import VersionConflict, VersionedTable

SCHEMA = StructType().add("id", "long").add("body", "string").add("rev", "integer")


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable.open(spark, f"file://{tmp_path}/t", SCHEMA, ["id"], 8)


def rows(spark, *values):
    return spark.createDataFrame(values, SCHEMA)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(tmp_path):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{tmp_path}/t/data") for f in fs if f.endswith(".parquet")}


def test_upsert_touches_only_its_buckets(spark, table, tmp_path):
    assert table.version() == 0 and table.read().count() == 0
    table.upsert(rows(spark, *[(i, f"b{i}", 1) for i in range(200)], (None, "none", 1)))
    before = table._manifest()["folders"]
    was = files(tmp_path)
    assert table.upsert(rows(spark, (7, "new", 2), (7, "older", 1), (None, "null", 2)), version="rev") == 2
    after = table._manifest()["folders"]
    changed = {b for b in after if before.get(b) != after[b]}
    assert 1 <= len(changed) <= 2 and was < files(tmp_path) and len(files(tmp_path) - was) == len(changed)
    assert got(table.read()) == sorted([*[(i, f"b{i}", 1) for i in range(200) if i != 7], (7, "new", 2), (None, "null", 2)], key=str)
    assert table.read(1).where("id = 7").first().body == "b7"  # an old version is what it was
    assert got(table.read(keys=spark.createDataFrame([(7,), (900,)], "id long"))) == [(7, "new", 2)]
    assert table.upsert(rows(spark, (7, "late", 1)), version="rev") == 3 and table.read().where("id = 7").first().body == "new"
    assert table.upsert(rows(spark).limit(0)) == 3


def test_of_two_writers_one_is_refused(spark, table):
    other = VersionedTable.open(spark, table.path, SCHEMA, ["id"], 99)
    assert other.buckets == 8
    head = table._manifest()
    table.upsert(rows(spark, (1, "a", 1)))
    with pytest.raises(VersionConflict):
        other.upsert(rows(spark, (1, "b", 1)), expected=0)
    with pytest.raises(VersionConflict):  # even if it hadn't looked: the place is taken
        other._commit({**head, "version": 1})
    assert got(table.read()) == [(1, "a", 1)]
    assert other.upsert(rows(spark, (2, "b", 1)), expected=1) == 2
    with pytest.raises(ValueError):
        VersionedTable.open(spark, table.path, SCHEMA, ["body"])


def test_insert_delete_append_compact_vacuum(spark, table, tmp_path):
    table.insert(rows(spark, (1, "a", 1), (1, "a", 1), (2, "b", 1)))
    table.insert(rows(spark, (2, "other", 9), (3, "c", 1)))
    assert got(table.read()) == [(1, "a", 1), (2, "b", 1), (3, "c", 1)]
    table.append(rows(spark, (1, "a2", 2), (4, "d", 1)))
    table.append(rows(spark, (1, "a3", 3)))
    want = [(1, "a", 1), (1, "a2", 2), (1, "a3", 3), (2, "b", 1), (3, "c", 1), (4, "d", 1)]
    assert got(table.read()) == want and max(map(len, table._manifest()["folders"].values())) == 3
    before = table._manifest()["folders"]
    table.compact()
    after = table._manifest()["folders"]
    assert got(table.read()) == want and set(map(len, after.values())) == {1}
    assert all(after[b] == f for b, f in before.items() if len(f) == 1)
    assert table.compact() == table.version()
    table.delete(spark.createDataFrame([(1,), (4,)], "id long"))
    assert got(table.read()) == want[3:5]
    assert table.vacuum() > 0 and got(table.read()) == want[3:5] and len(table._names()) == 1


def test_swap_only_what_is_as_expected(spark, table):
    table.upsert(rows(spark, (1, "a", 1), (2, "b", 5)))
    new = spark.createDataFrame([(1, "a+", 2, 1), (2, "b+", 3, 2), (3, "c", 1, None), (4, "d", 1, 7), (5, "e", 1, None), (5, "f", 1, None)], "id long, body string, rev int, was int")
    assert got(table.swap(new, "rev", "was")) == [(1, True), (2, False), (3, True), (4, False), (5, False), (5, False)]
    assert got(table.read()) == [(1, "a+", 2), (2, "b", 5), (3, "c", 1)]


def test_a_batch_counts_once(spark, table):
    table.upsert(rows(spark, (1, "a", 1)), batch=0)
    assert table.upsert(rows(spark, (1, "again", 1)), batch=0) == 1 and got(table.read()) == [(1, "a", 1)]
    assert table.upsert(rows(spark).limit(0), batch=1) == 2 and table.upsert(rows(spark, (2, "b", 1)), batch=2) == 3


def test_names(spark, tmp_path):
    with pytest.raises(ValueError):
        VersionedTable.open(spark, f"file://{tmp_path}/u", StructType.fromDDL("id long, _bucket int"), ["id"])
    wide = VersionedTable.open(spark, f"file://{tmp_path}/w", StructType.fromDDL("`a b` string, x long, d date"), ["a b", "x"], 4)
    wide.upsert(spark.createDataFrame([("k", 1), (None, 2)], "`a b` string, x long").withColumn("d", F.lit("2024-01-01").cast("date")))
    assert wide.read().count() == 2
