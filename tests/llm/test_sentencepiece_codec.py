import random

from tessera.llm import sentencepiece_codec as sc

SCHEMA = "doc_id long, text string, ids string, n_ids int"


def brute(p, text):
    """Best score of any path, by trying all cuts."""
    n, score = len(text), [0.0] + [-1e18] * len(text)
    for j in range(1, n + 1):
        score[j] = score[j - 1] + p.unknown * len(text[j - 1].encode()) if p.table.get(text[j - 1]) is None else -1e18
        for i in range(max(0, j - p.longest), j):
            hit = p.table.get(text[i:j])
            if hit is not None:
                score[j] = max(score[j], score[i] + hit[1])
    return score[n]


def test_paths_are_best():
    p = sc.Pieces.load(sc.default_path())
    r = random.Random(1)
    for _ in range(60):
        t = "".join(r.choice("the antion  é日\n▁ß") for _ in range(r.randrange(1, 120)))
        ids = p.encode(t)
        want = sum(brute(p, x) for k, y in enumerate(t.split("▁")) for x in [("▁" if not k else "") + y.replace(" ", "▁")]) + t.count("▁") * 3 * p.unknown
        assert abs(p.total(ids) - want) < 1e-3 and p.decode(ids) == t


def test_stream_commits_and_agrees():
    p = sc.Pieces.load(sc.default_path())
    t = "internä" * 400 + "tionalisation" * 50
    parts = list(p.stream(t))
    assert len(parts) > 20
    ids = [i for x in parts for i in x]
    assert abs(p.total(ids) - brute(p, t)) < 1e-2
    small = sc.Pieces([("a", -1.0), ("b", -1.5), ("ab", -2.0), ("a b", -1.0), ("ba", -1.1)], list(range(100, 356)), [b"a", b"b", b"ab", b"a b", b"ba"] + [b""] * 95 + [bytes([i]) for i in range(256)])
    assert abs(small.total([i for x in small.stream("abababba" * 30, check=8) for i in x]) - brute(small, "abababba" * 30)) < 1e-6


def test_round_trip(spark):
    texts = [None, "", " ", "  two  blanks ", "tab\tline\r\n\n", "▁ mark ▁", "z" * 30_000, "é" * 500 + "𝄞\x00", "word " * 20_000, "word"]
    df = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA)
    out = sc.encode(df)
    back = {r.doc_id: r for r in sc.decode(out).collect()}
    assert all(r.round_trip and r.text == (texts[i] or "") for i, r in back.items()) and back[0].n_ids == back[1].n_ids == 0
    assert sc.encode(df.limit(0)).count() == 0


def test_commits_do_not_change_the_path():
    p = sc.Pieces.load(sc.default_path())
    r = random.Random(8)
    for n in (1, 39, 40, 41, 200, 1500):
        t = "".join(r.choice("the antionéß") for _ in range(n)).replace(" ", "▁")
        whole = [i for x in p.stream(t, check=10_000) for i in x]
        for check in (1, 7, 64):
            assert [i for x in p.stream(iter(t), check=check) for i in x] == whole
    assert list(p.stream("")) == []
