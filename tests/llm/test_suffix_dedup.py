import random

from tessera.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, start int, whole string"


def corpus(seed=5):
    r = random.Random(seed)

    def prose(n):
        return "".join(r.choice("abcdé \n") for _ in range(n))

    shared = prose(700)
    run = "x" * 900
    texts = [None, "", "short", shared, prose(300) + shared[:399] + prose(90), prose(40) + shared[:400] + prose(3)]
    texts += [prose(200) + shared[100:620] + prose(50) + shared[150:600], run, prose(100) + run[:450], shared, shared]
    texts += [prose(1500)] + [prose(120) + shared[200:650] + prose(77) for _ in range(20)]
    edited = list(prose(3000))
    for _ in range(3):
        texts.append("".join(edited))
        edited[r.randrange(3000)] = "#"
    return texts


def test_equals_brute_force(spark):
    texts = corpus()
    rows = [(i, t, 1, "w") for i, t in enumerate(texts)]
    got = {x[0]: tuple(x)[1:] for x in sd.measure_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = sd.brute_force(texts)
    assert got == dict(enumerate(want))
    assert sum(w[1] for w in want) > 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "q" * 10 + "z" * 450, 0, ""), (7, "abc" * 200, 0, ""), (7, "abc" * 200, 0, "")]
    out = sd.measure_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sd.brute_force([r[1] for r in rows])
    assert sorted((tuple(x)[1:] for x in out)) == sorted(want)
    assert sd.measure_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_remove_keeps_other_columns(spark):
    texts = corpus(9)
    rows = [(i, t, i, "w") for i, t in enumerate(texts)]
    out = sd.remove_repeats(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "start", "whole"]
    got = {x.doc_id: x for x in out.collect()}
    assert len(got) == len(texts) and got[0].text is None and got[2].text == "short" and got[11].text == texts[11]
    assert got[3].text == "" and all(got[i].start == i for i in got)


def test_hash_intervals_follow_bytes():
    import numpy as np
    import pyarrow as pa

    from tessera.llm.textblock import blocks

    b = next(blocks(pa.array(["abcabc", None, "xabc"])))
    h = b.hashes(np.array([0, 3, 7, 1]), np.array([3, 6, 10, 4]))
    assert h[0] == h[1] == h[2] != h[3]
    assert list(b.null) == [False, True, False]


def test_pipeline_cuts_passages_of_51_short_words_and_spares_shorter_ones(spark):
    import corpus_pipeline

    r = random.Random(4)
    own = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(n))
    tiny, short, few, long = (" ".join(r.choice(letters) * k for _ in range(n)) for letters, k, n in (("xyz", 1, 51), ("uvwxyz", 3, 51), ("pqrst", 4, 50), ("klmno", 12, 30)))
    texts = []
    for p in (tiny, short, few, long):
        texts += [f"{own(20)}A {p} B{own(20)}", f"{own(9)}C {p} D{own(9)}"]
    out = corpus_pipeline.repeats(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    got = {x.doc_id: x.text for x in out.collect()}
    for i, p in enumerate((tiny, short, few, long)):
        for k in (2 * i, 2 * i + 1):
            assert (p in got[k]) == (p is few), (i, got[k])
            assert len(got[k]) >= len(texts[k]) - len(p) - 2


def test_one_passage_in_a_third_of_all_rows(spark):
    r = random.Random(21)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    hot = prose(450)
    texts = [prose(120) + (hot[r.randrange(40) :] if i % 3 == 0 else prose(330)) + prose(60) for i in range(240)]
    rows = [(i, t, 0, "") for i, t in enumerate(texts)]
    got = {x[0]: tuple(x)[1:] for x in sd.measure_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    want = sd.brute_force(texts)
    assert got == dict(enumerate(want)) and sum(w[1] > 400 for w in want) == 80


def test_blocks_beyond_the_usual_size(spark):
    base = "".join(random.Random(2).choice("abcdef") for _ in range(3000))
    texts = ["x" + base * 400, base[:700], "y" * 1000]
    got = {x[0]: tuple(x)[1:] for x in sd.measure_repeats(spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert got[0][:3] == (1_200_001, 1_200_000, 1) and got[1][1] == 700 and got[2][1] == 1000


def test_text_without_passages_beside_the_measures(spark):
    r = random.Random(31)
    own = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared, short = " ".join(r.choice(("red", "ink", "oak", "sun")) for _ in range(55)), " ".join(r.choice(("moss", "fern")) for _ in range(44))
    texts = [None, "", f"{own(30)} A {shared} B {own(30)}", f"{own(9)} C {shared} D {own(20)}", f"{own(9)} E {short} F", f"{own(5)} G {short} H", own(80)]
    out = {x.doc_id: x for x in sd.measure_repeats(spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], SCHEMA), passages=(200, 50, 300)).collect()}
    assert [tuple(out[i])[1:5] for i in range(7)] == sd.brute_force(texts) and out[2].n_removed == 0
    assert all(shared not in out[i].text and texts[i].startswith(out[i].text[:20]) for i in (2, 3))
    assert [out[i].text for i in (0, 1, 4, 5, 6)] == ["", "", *texts[4:]]


def test_one_search_for_both_lengths(spark):
    """Strings of 400 bytes found within stretches of repeated strings of 200 are those that a search of all texts finds."""
    r = random.Random(8)
    prose = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    hot, mid = prose(700), prose(300)
    texts = [prose(90) + hot[r.randrange(300) :][: r.randrange(150, 600)] + prose(r.randrange(80)) + mid + hot[:120] for _ in range(60)]
    texts += ["z" * 399, "z" * 450, "ab" * 300, texts[0], texts[0], "", None, mid + "!" + mid, hot + hot]
    rows = [(i, t, 0, "") for i, t in enumerate(texts)] + [(3, texts[3], 0, "")]
    got = sorted(tuple(x)[:5] for x in sd.measure_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), passages=(200, 50, 300)).collect())
    want = sd.brute_force([x[1] for x in rows])
    assert got == sorted((x[0], *w) for x, w in zip(rows, want, strict=True)) and sum(w[1] > 0 for w in want) > 20


def test_passages_of_a_whole_block_at_once():
    """Stretches of many texts are found together and leave in one batch, as a plain walk over each text's runs gives them."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(12)
    texts, runs = [], []
    for _ in range(200):
        texts.append("".join(r.choice("abcdé ") for _ in range(900)))
        runs.append(sorted({(r.randrange(500) << 32) + r.randrange(1, 60) for _ in range(r.choice((0, 1, 4, 25)))}, key=lambda _: r.random()) or None)

    def plain(own, length):
        out = []
        for s, n in sorted((x >> 32, x & 0xFFFFFFFF) for x in own or ()):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], s + n)
            else:
                out.append([s, s + n])
        return [(s, e - 1 + length) for s, e in out]

    want = [(i, a, z) for i, own in enumerate(runs) for a, z in plain(own, 200)]
    offs, start, n = sd._unpacked(pa.array(runs, pa.list_(pa.int64())))
    assert list(zip(*(x.tolist() for x in sd._passages(np.repeat(np.arange(200), np.diff(offs)), start, n, 200)), strict=True)) == want
    ids, ths = pa.array([None if i == 3 else i for i in range(200)], pa.int64()), pa.array(range(200), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ths, pa.array(texts), pa.array(runs, pa.list_(pa.int64()))], names=["_id", "_th", "_text", "passages"])
    made = list(sd._stretches(200, 260, pa.int64())(iter([batch])))
    assert len(made) == 1
    assert [tuple(x.values()) for x in made[0].to_pylist()] == [(ids[i].as_py(), i, a, texts[i].encode()[a:z]) for i, a, z in want if z - a >= 260]


def test_least_of_neighbours_over_pieces():
    import numpy as np

    x = np.random.default_rng(3).integers(0, 1 << 63, 40_000).astype(np.uint64)
    for w in (1, 2, 3, 153, 353):
        for n in (w - 1, w, w + 1, 16_384, 16_383 + w, 40_000):
            want = np.lib.stride_tricks.sliding_window_view(x[:n], w).min(axis=1) if n >= w else x[:0]
            assert np.array_equal(sd._slide_min(x[:n], w), want)


def test_block_without_a_repeated_string():
    import numpy as np
    import pyarrow as pa

    none = np.zeros(0, np.int64)
    assert list(sd._by_text(none, none, none)) == [] and [len(x) for x in sd._passages(none, none, none, 200)] == [0, 0, 0]
    assert list(sd._by_text(np.array([0, 0, 4]), np.array([1, 9, 2]), np.array([5, 12, 6]))) == [(0, [(1, 5), (9, 12)]), (4, [(2, 6)])]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([3, 4]), pa.array(["ab", ""]), *[pa.array([None, None], pa.list_(pa.int64()))] * 2], names=["_id", "_th", "_text", "spans", "passages"])
    assert [x["text"] for x in next(sd._cut(400, pa.int64(), (200, 50, 300))(iter([batch]))).to_pylist()] == ["ab", ""]
    assert list(sd._stretches(200, 400, pa.int64())(iter([batch]))) == []
