import random

from pyspark.sql import functions as F

from tessera.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string, languages int"
SYLLABLES = {"aa": "ka lo mi nu pe".split(), "bb": "str ung sch eit ver".split(), "cc": "ção ñe üm ée oix".split()}


def prose(r, lang, n=60):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_held_out_and_mixtures(spark):
    r = random.Random(4)
    rows = [(i, prose(r, lang), lang, "s", 0) for i in range(60) for lang in [sorted(SYLLABLES)[i % 3]]]
    model = langid.learn(spark.createDataFrame(rows[:30], SCHEMA))
    assert model.names == ["aa", "bb", "cc"]
    test = rows[30:] + [(100, prose(r, "aa", 60) + " " + prose(r, "bb", 40), None, "", 0), (101, None, "aa", "", 0), (102, "123 !?", "aa", "", 0), (103, "", "aa", "", 0), (104, "ß", "aa", "", 0), (105, "ka " * 50_000, None, "", 0)]
    out = {x.doc_id: x for x in langid.identify(spark.createDataFrame(test, SCHEMA), model, [F.col("doc_id")]).collect()}
    assert len(out) == len(test) and all(out[i].lang_pred == rows[i][2] and out[i].languages == [rows[i][2]] for i in range(30, 60))
    assert out[100].languages == ["aa", "bb"] and 0.4 < out[100].score < 0.8
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (101, 102, 103))
    assert out[104].lang_pred in model.names and out[105].lang_pred == "aa"


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.learn(empty) is None
    out = langid.identify(spark.createDataFrame([(1, "text", None, "", 0)], SCHEMA), None, [F.col("doc_id")]).collect()
    assert out[0].lang_pred == "und" and langid.identify(empty, None, [F.col("doc_id")]).count() == 0


def test_company_does_not_matter():
    """Two near twins among four languages: a text's set is the same alone and beside texts that need larger sets."""
    import numpy as np
    import pyarrow as pa

    from tessera.llm.textblock import blocks

    r = random.Random(7)
    twins = {"aa": SYLLABLES["aa"], "ab": [*SYLLABLES["aa"][:4], "ve"], "bb": SYLLABLES["bb"], "cc": SYLLABLES["cc"]}
    say = lambda lang, n: " ".join("".join(r.choice(twins[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))
    counts = np.zeros((4, 1 << langid.GRAM_BITS))
    for i, lang in enumerate(twins):
        _, gram, n = langid.grams(next(blocks(pa.array([say(lang, 4000)]))))
        counts[i] = np.bincount(gram, weights=n, minlength=1 << langid.GRAM_BITS)
    model = langid.LanguageModel.from_counts(list(twins), counts)
    texts = [" ".join(say(lang, n) for lang, n in parts) for parts in ([("ab", 30)], [("aa", 25), ("ab", 25)], [("ab", 60), ("bb", 50), ("cc", 40)], [("aa", 20), ("ab", 20), ("bb", 20)], [("cc", 3)]) for _ in range(6)]
    block = next(blocks(pa.array(texts)))
    together = langid.infer(model, *langid.grams(block), block.n)
    assert len({int((m > 0).sum()) for m in together}) > 2
    for i, t in enumerate(texts):
        one = next(blocks(pa.array([t])))
        alone = langid.infer(model, *langid.grams(one), 1)[0]
        assert np.array_equal(alone, together[i]), i


def test_more_values_than_languages(spark):
    rows = [(i, "ka lo mi", "aa") for i in range(6)] + [(9, "str ung", "bb"), (10, "str sch", "bb")] + [(20 + i, "xx", f"junk{i}") for i in range(9)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=2)
    assert model.names == ["aa", "bb"]
