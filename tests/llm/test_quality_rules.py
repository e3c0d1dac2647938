import re

import numpy as np

from tessera.llm import quality_rules as qr

SCHEMA = "doc_id long, text string, quality string, n_words int, _rest string"


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    rep = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(5)}
    failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), failed


def texts():
    prose = " ".join(f"mot{i}é" for i in range(60))
    return [None, "", " \t\n", "a b", prose, prose + "\n" + prose, "x\nx\n\n\nx \ny\r\nx\n", "| # <a>\n" * 9, "AB!! CD!! " * 30, "w " * 5000 + "é" * 40_000, prose[:200] + "\x85 z q", prose]


def test_counts_equal_brute_force(spark):
    t = texts()
    rows = [(i, x, "q", 1, "r") for i, x in enumerate(t)]
    out = qr.apply_rules(spark.createDataFrame(rows, SCHEMA).repartition(3), []).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out}
    assert got == {i: brute(x) for i, x in enumerate(t)}
    assert all(r.kept != r.base_failed for r in out)
    assert qr.apply_rules(spark.createDataFrame([], SCHEMA), []).count() == 0


def test_learns_and_filters(spark):
    good = [" ".join(f"wort{(i * 7 + k) % 211}" for k in range(40 + i % 30)) for i in range(90)]
    bad = [" ".join(f"WORT{(i * 5 + k) % 197}!!" for k in range(40 + i % 30)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "q", 1, "r") for i, t in enumerate(good + bad)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 90)) for i in range(150)], "doc_id long, quality int")
    rules = qr.learn_rules(docs, labels)
    assert 1 <= len(rules) <= 3 and all(r.precision >= 0.97 for r in rules) and str(rules[0])
    kept = qr.filter_by_rules(docs, rules)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(90))
    assert qr.learn_rules(docs, labels.where("quality = 1")) == []
    assert qr.learn_rules(docs, labels.limit(0)) == []


def test_rules_need_precision():
    r = np.random.default_rng(0)
    assert qr.learn(r.random((300, 3)), r.random(300) < 0.3, ["a", "b", "c"]) == []
