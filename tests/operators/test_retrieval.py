import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.functions import text, vector
from tessera.operators import graph, records, relational, retrieval


@pytest.mark.parametrize("n", [0, 1, 2, 5001, 9000])
def test_median_of(spark, n):
    values = [float((i * 7919) % 1000) + (i % 3) / 7 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    assert retrieval.median_of(df, "x", slices=16) == pytest.approx(statistics.median(values) if n else 0.0)


def test_median_of_a_frequent_value(spark):
    df = spark.range(9001).select(F.when(F.col("id") < 6000, 5.0).otherwise(F.col("id").cast("double")).alias("x"))
    assert retrieval.median_of(df, "x") == 5.0


def test_lexical_ranking_with_han_and_fields(spark):
    rows = [("osc", "OSC 通信", ["OSC"], "打通收发", "收不到 数据"), ("mid", "色彩", ["色彩"], "", "OSC"), ("none", "版式", [], "", "grid")]
    df = spark.createDataFrame(rows, "id string, title string, tags array<string>, facts string, content string")
    tok = lambda c: retrieval.search_tokens(text.canonical(c))
    fields = {"title": (tok(F.col("title")), 5), "tags": (tok(F.array_join("tags", " ")), 8), "facts": (tok(F.col("facts")), 4), "content": (tok(F.col("content")), 1)}
    scored = retrieval.lexical_matches(df, ["id"], fields, tok(F.lit("DigiShow OSC 收不到")))
    got = {r.id: (r.score, r.matched) for r in scored.collect()}
    assert got == {"osc": (3 * 5 + 3 * 8 + 2 + 2 + 3, ["osc", "不到", "收不", "收不到"]), "mid": (3, ["osc"]), "none": (0, [])}
    assert [(r.id, r.confidence) for r in retrieval.ranked(scored, "id").collect()] == [("osc", 0.958)]


def test_memory_scores(spark):
    one = lambda q, c: spark.range(1).select(retrieval.memory_overlap(F.lit(q), F.lit(c)).alias("x")).first().x
    assert one("osc port 8000", "port 80 osc") == 6
    assert one("光影", "城市光影") == 2
    assert one("port 8000", "set port 8000 now") == 3 + 3 + 8
    sim = lambda c, b, k: spark.range(1).select(retrieval.memory_similarity(F.lit(c).cast("double"), F.lit(b), F.lit(k)).alias("x")).first().x
    assert sim(0.8, 0.8, 1) == pytest.approx(0.45 / 0.65) and sim(0.3, 0.3, 1) == 0
    assert sim(0.9, 0.5, 3) == pytest.approx(0.8) and sim(0.29, 0.0, 3) == 0 and sim(None, 0.1, 3) == 0


def test_near_duplicate_classes_keep_copies_together(spark):
    t = "红色墨水流过旧纸张而行人看着"
    rows = [(i, "k", t) for i in range(40)] + [(50, "k", t + " 呢"), (51, "k", t.replace("而", "不想")), (52, "j", t), (53, "k", "完全另一段文字内容")]
    got = {r.id: (r.class_id, r.links) for r in retrieval.near_duplicate_classes(spark.createDataFrame(rows, "id long, key string, note string"), ["key"], "id", "note").collect()}
    assert {got[i] for i in range(40)} == {(0, 1)} and got[50] == (50, 1) and got[52] == (52, 0) and got[53] == (53, 0)


def test_near_duplicate_classes_over_hot_units(spark, monkeypatch):
    """Units that all classes have meet in blocks; no pair is lost."""
    from tessera.functions import text

    monkeypatch.setattr(retrieval, "UNIT_BLOCK", 3)
    r = random.Random(9)
    common, rare = "甲乙丙丁戊己庚辛壬癸", "子丑寅卯辰巳午未申酉"
    notes = ["".join(common[: r.choice([8, 9, 10])]) + "".join(r.sample(rare, r.choice([0, 1, 1]))) for _ in range(70)]
    rows = [(i, "k", n) for i, n in enumerate(notes)]
    got = {x.id: (x.class_id, x.links) for x in retrieval.near_duplicate_classes(spark.createDataFrame(rows, "id long, key string, note string"), ["key"], "id", "note").collect()}
    first = {n: notes.index(n) for n in notes}
    pairs = spark.createDataFrame([(a, b) for a in first for b in first if first[a] < first[b]], "a string, b string")
    same = pairs.where(text.near_duplicate(text.note_signature(F.col("a")), text.note_signature(F.col("b")))).collect()
    links = {n: 0 for n in first}
    for p in same:
        links[p.a] += 1
        links[p.b] += 1
    assert got == {i: (first[n], links[n]) for i, n in enumerate(notes)} and sum(links.values()) > 40


def test_near_duplicates_of_frequent_units_are_never_rows(spark, monkeypatch):
    """Classes that share frequent units meet block by block, over steps of sizes; the largest step of the job makes far fewer rows than there are pairs."""
    from tessera.functions import text

    monkeypatch.setattr(retrieval, "BLOCK_CLASSES", 40)
    r = random.Random(4)
    letters = "甲乙丙丁戊己庚辛壬癸子丑"
    base = ["".join(r.choices(letters[: r.choice([8, 9, 11, 12])], k=40)) for _ in range(12)]
    notes = [t[: r.randrange(30, 41)] + "".join(r.sample(letters, 2)) for t in base for _ in range(25)] + ["x1 é y1", "甲乙", "甲乙丙"]
    rows = [(i, r.choice("kj"), n) for i, n in enumerate(notes)]
    handed = []
    met = retrieval._links_by_rare_units
    monkeypatch.setattr(retrieval, "_links_by_rare_units", lambda *a: handed.append(a[1].count()) or met(*a))
    got = {x.id: (x.class_id, x.links) for x in retrieval.near_duplicate_classes(spark.createDataFrame(rows, "id long, key string, note string"), ["key"], "id", "note").collect()}
    first = {}
    for i, k, n in rows:
        first.setdefault((k, n), i)
    sig = spark.createDataFrame([(i, k, n) for (k, n), i in first.items()], "id long, k string, n string").select("id", "k", text.note_signature(F.col("n")).alias("s"))
    same = sig.alias("a").join(sig.alias("b"), "k").where("a.id < b.id").where(text.near_duplicate(F.col("a.s"), F.col("b.s"))).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).collect()
    links = dict.fromkeys(first.values(), 0)
    for p in same:
        links[p.x] += 1
        links[p.y] += 1
    assert got == {i: (first[k, n], links[first[k, n]]) for i, k, n in rows}
    assert sum(links.values()) > 1000 and handed[0] < len(rows)


def test_found_tokens_are_those_of_the_whole_list(spark):
    words = ("ab", "a.b", "ab-", "b1", "光影", "光", "影动画", "x+y", "光影动画城", "b")
    texts = ["ab a.b", "-ab .ab-", "..ab", "xab ab1 b1", "光影动画城市 b1", "x+y x+y+", "a.b.", "ab\nab", "", "é-ab é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    made = df.select("t", F.array_sort(retrieval.found_tokens(F.col("t"), words)).alias("a"), F.array_sort(F.array_intersect(F.array(*map(F.lit, words)), retrieval.search_tokens(F.col("t")))).alias("b")).collect()
    assert all(r.a == r.b for r in made) and sum(bool(r.a) for r in made) > 6


def test_newest_and_medians(spark):
    r = random.Random(1)
    rows = [(i, r.choice([5, 5, 5, r.randrange(10**12), -3, None])) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    ordered = sorted((x for x in rows if x[1] is not None), key=lambda x: (-x[1], x[0]))
    for k in (1, 40, 333, 700, 5000):
        assert {x.id for x in retrieval.newest(df, "v", "id", k, slices=7).collect()} == {i for i, _ in ordered[:k]}, k
    keyed = spark.createDataFrame([(k, float(r.randrange(50))) for k in (1, 2, 2, 3, 3, 3, 4) for _ in range(5)] + [(9, None)], "k long, v double")
    want = {x.k: x.m for x in keyed.groupBy("k").agg(F.median("v").alias("m")).collect() if x.m is not None}
    assert {x.k: x.median for x in retrieval.medians(keyed, ["k"], "v").collect()} == want



def test_paths_do_not_cross_hidden_pages(spark):
    pages = spark.createDataFrame([(x,) for x in "abcde"], "page string")
    links = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "a", "c"), (4, "c", "d"), (5, "a", "h"), (6, "h", "e"), (7, "a", "a")], "link long, a string, b string")
    seeds = spark.createDataFrame([("a",)], "page string")
    got = {(r.page, r.origin, tuple(r.links)) for r in graph.paths_within(seeds, pages, links, 2).collect()}
    assert got == {("b", "a", (1,)), ("c", "a", (3,)), ("c", "a", (1, 2)), ("b", "a", (3, 2)), ("d", "a", (3, 4))}
    found = graph.found_pages(seeds, graph.paths_within(seeds, pages, links, 2), 3, paths=1).collect()
    assert [(r.page, r.seed, r.ways, r.paths) for r in found] == [("a", True, 0, None), ("b", False, 1, [[1]]), ("c", False, 1, [[3]])]


def test_link_times_and_repeats(spark):
    links = spark.createDataFrame([("a", "b", "x", 1, 5), ("b", "a", "x", 3, None), ("a", "b", "y", 6, 9)], "a string, b string, kind string, valid_from int, valid_until int")
    assert graph.current_links(links, F.lit(5)).count() == 2 and graph.current_links(links, F.lit(6)).count() == 2
    assert [tuple(r) for r in graph.repeated_links(links).collect()] == [("a", "b", "x", 2)]


def test_forest_and_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 5)], "a long, b long")
    assert [tuple(r) for r in graph.cyclic_components(e).collect()] == [(1, 3, 3)]


def test_chain_faults(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, 1, 4), (3, 1, 6), (4, 9, 7), (5, 6, 8), (6, 5, 8), (7, 6, 9)], "id long, prior long, at int")
    got = {(r.id, r.fault) for r in graph.chain_faults(rows, "id", "prior", "at").collect()}
    assert got == {(4, "UNKNOWN_PRIOR"), (1, "FORK"), (6, "FORK"), (5, "CYCLE"), (6, "CYCLE"), (7, "CYCLE"), (2, "TIME_ORDER")}


def test_vectors(spark):
    v = [[3.0, 4.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], None, [1.0, None]]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v array<double>").select("i", vector.is_valid(F.col("v")).alias("ok"), vector.unit(F.col("v")).alias("u")).orderBy("i").collect()
    assert [r.ok for r in got] == [True, False, False, False, False, False] and got[0].u == [0.6, 0.8] and got[1].u is None


def test_paging_and_sets(spark):
    rows = spark.range(30)
    got = relational.offset_page(rows, [F.asc("id")], 5000, 5, most=10).collect()
    assert [r.id for r in got] == list(range(5, 15)) and got[0].total == 30 and got[0].truncated
    assert relational.offset_page(rows, [F.asc("id")], 0, 29).collect()[0].truncated is False
    df = spark.createDataFrame([("demo-1", 1), ("x", 2)], "n string, v int")
    assert records.matching(df, n="x", v=None).count() == 1 and records.matching(df).count() == 2
    assert [r.g for r in df.select(records.glob(F.col("n"), "demo-*").alias("g")).collect()] == [True, False]
    assert [r.g for r in df.select(records.glob(F.col("n"), "?").alias("g")).collect()] == [False, True]


def test_hashed_vectors_equal_a_plain_version(spark, sf_dir):
    import math

    from tessera.plans.catalog import QUERIES

    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 % (1 << 32)
        return h

    want = {}
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w, sums = r.text.lower().split(), {}
        for n in (1, 2):
            for i in range(len(w) - n + 1):
                h = fnv(" ".join(w[i : i + n]))
                sums[h % 512] = sums.get(h % 512, 0) + (-1 if h >= 1 << 31 else 1)
        norm = math.sqrt(sum(v * v for v in sums.values()))
        want |= {(r.item_id, b): round(v / norm, 6) for b, v in sums.items() if v}
    got = {(r.item_id, r.bucket): round(r.v, 6) for r in QUERIES["text_hash_vector"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_ways_through_a_hub_are_bounded_while_walking(spark):
    n = 60
    pages = spark.range(n).select(F.col("id").alias("page"))
    edges = [(0, i) for i in range(1, n)] + [(i, 59) for i in range(1, 59)] + [(i, i + 1) for i in range(1, 40)]
    links = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "link long, a long, b long")
    seeds = spark.createDataFrame([(1,), (2,), (5,)], "page long")
    whole, held = graph.paths_within(seeds, pages, links, 3), graph.paths_within(seeds, pages, links, 3, most=8)
    want, got = (sorted(map(str, graph.found_pages(seeds, w, 100).collect())) for w in (whole, held))
    assert got == want and held.count() <= 3 * 8 * n < whole.count() * 9
    assert held.groupBy("page", F.size("links")).count().agg(F.max("count")).first()[0] <= 8
