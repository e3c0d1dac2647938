"""Statements of a writer about themselves, kind by kind."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.statements import explicit_statements

CASES = [
    ("原来声音不是先有的，我现在知道其实是后配的。", ["MISCONCEPTION_CORRECTED"]),
    ("我之前以为噪声不应该太大，现在懂了。", ["MISCONCEPTION_CORRECTED"]),
    ("我做交互时总是在端口设置上卡住。", ["RECURRING_STRUGGLE"]),
    ("我的同学总是卡住。", []),
    ("我朋友已经学会了遮罩。", []),
    ("今天下课后，我学会了遮罩", ["LEARNED_CONCEPT"]),
    ("我更喜欢冷色！然后我学会了遮罩。我又在导出时失败。", ["RECURRING_STRUGGLE", "PREFERENCE"]),
    ("我更喜欢冷色吗？", []),
    ("如果我喜欢冷色，就用蓝。", []),
    ("用蓝；比如老师说，我喜欢冷色", []),
    ("我正在设计一个装置。", ["PROJECT_FACT"]),
    ("我想说，这次项目面向小学生。", ["PROJECT_FACT"]),
    ("这次项目面向小学生。", []),
    ("我每次都出错。我学会了遮罩。我不喜欢红。我正在做海报。", ["RECURRING_STRUGGLE", "LEARNED_CONCEPT", "PREFERENCE"]),
    ("他说我喜欢红", []),
    ("", []),
    (None, []),
]


@pytest.fixture(scope="module")
def made(spark):
    rows = spark.createDataFrame(list(enumerate(t for t, _ in CASES)), "i int, t string")
    return {r.i: r.s for r in rows.select("i", explicit_statements(F.col("t")).alias("s")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_kinds(made, i):
    assert [s.kind for s in made[i]] == CASES[i][1], CASES[i][0]


def test_quotes_and_weights(made):
    assert [(s.quote, s.weight) for s in made[13]] == [("我每次都出错。", 2), ("我学会了遮罩。", 2), ("我不喜欢红。", 1)]
    assert made[5][0].quote == "今天下课后，我学会了遮罩"
