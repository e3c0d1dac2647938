"""The Merkle manifest against the definition, over groups within a run, over many runs and over range borders."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle

COLS = ("doc_id", "source", "n_chars", "text")


def table(n=700, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = None if i % 11 == 0 else "hot" if i % 2 else ["a", "é", "b", "", f"s{i}", "hot"][rnd.randrange(6)]
        rows.append((rnd.randrange(n) if i % 50 else None, source, rnd.choice(["x\ny", "", "z", None, "\n"]), rnd.choice([None, 3])))
    return rows


def leaf(row, strip=False):
    out = ""
    for c, v in row.items():
        if v is not None and strip and c == "text":
            v = v.replace("\n", "")
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return hashlib.sha256(out.encode()).hexdigest()


def expected(rows, fanout):
    made = []
    for doc_id, source, text, n_chars in rows:
        row = {"doc_id": doc_id, "source": source, "n_chars": n_chars, "text": text}
        other = leaf(row, True) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else None
        made.append((source is not None, (source or "").encode(), doc_id is not None, doc_id or 0, leaf(row), other or "", source, doc_id))
    made.sort(key=lambda x: x[:6])
    out = merkle.brute_force([x[6] for x in made], [x[4] for x in made], [x[5] or None for x in made], fanout)
    return sorted(((x[7], x[4], *y) for x, y in zip(made, out, strict=True)), key=str)


def got(df, fanout, run):
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 2 == 0
    other = F.when(even, merkle.digest(F.col("doc_id"), F.col("source"), F.col("n_chars"), F.translate("text", "\n", "")))
    return sorted(map(tuple, merkle.manifest(df, value_cols=COLS, other=other, fanout=fanout, run=run).collect()), key=str)


@pytest.mark.parametrize(("fanout", "run"), [(3, 4), (3, 4096), (2, 7)])
def test_definition(spark, fanout, run):
    rows = table()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long").repartition(5)
    assert got(df, fanout, run) == expected(rows, fanout)


def test_groups_of_every_small_size(spark):
    rows = [(i, f"s{n}", "t\n", 1) for n in (1, 2, 3, 4, 9, 10, 28) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long")
    assert got(df, 3, 2) == expected(rows, 3)


def test_only_row(spark):
    row = merkle.manifest(spark.createDataFrame([(1, "s", None, None, "")], "doc_id long, source string, lang string, n_chars long, text string")).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified
    assert row.leaf == hashlib.sha256(b"1:11:s--0:").hexdigest() and row.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_copies_stand_in_any_range(spark):
    rows = [(7, "s", "same", 4)] * 900 + [(8, "s", "x\n", 4)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long").repartition(6)
    assert got(df, 3, 16) == expected(rows, 3)
