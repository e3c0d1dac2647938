"""Token counts against the library's own encoding."""

import sys

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import token_counts

PATH = P.path("byte_bpe_50k.json")
LIBRARY, COUNTER = Tokenizer.from_file(PATH), token_counts.Counter(PATH)
TEXTS = [
    "", " ", "\n\n", "a", "I'll we've they're 's 'S it's'", "one  two   three \t\n four\n\n five ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "naïve café 你好世界 привет ١٢٣ Ⅷ ½", "  x　y\u0085z\x1c\x1d",
    "😀👩‍👩‍👧 á", "՘࢏\U000323b0 x\U0003fc3f1", "9" * 500 + " " + "ab" * 3000, "!?" * 700, " " * 5000 + "x" + "\n" * 400, "\x00\x01\x7f", "'" * 9 + "'re're",
]


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_counts(text):
    assert COUNTER.count(text) == library(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'setrvlmdxA1!<|>ofnd é你😀"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    assert COUNTER.count(text) == library(text)


def test_every_character():
    """Code points between letters, digits and signs: all up to 0x2FFF, then one in 61."""
    points = [c for c in [*range(0x3000), *range(0x3000, sys.maxunicode + 1, 61)] if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 4096):
        text = "".join(f"a{c}a1{c}1!{c}! {c}" for c in map(chr, points[lo : lo + 4096]))
        assert COUNTER.count(text) == library(text), hex(points[lo])


def test_proof_covers_the_vocabulary():
    """Every string that counts one by look-up is one token for the library, and few of the vocabulary aren't."""
    fresh = token_counts.Counter(PATH)
    assert all(library(s) == 1 for s in fresh)
    assert len(fresh) > 0.95 * sum(1 for i in range(LIBRARY.get_vocab_size()) if LIBRARY.decode([i]) and "�" not in LIBRARY.decode([i]))


def test_stretches_and_memory(monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 50)
    monkeypatch.setattr(token_counts, "MEMO", 3)
    fresh = token_counts.Counter(PATH, COUNTER.proven)
    for text in TEXTS + ["word  and\n\n more é " * 80, "zqxjkvbp " * 50 + "zzxqj" * 300]:
        assert fresh.count(text) == library(text)
    assert len(fresh) <= fresh.whole + 3


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(P.path("word_bpe_49k.json"))


def test_rows(spark):
    rows = [(i, t, "v") for i, t in enumerate(TEXTS)] + [(None, None, "v"), (0, "again", "v"), (0, "again", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    made = sorted(map(tuple, token_counts.count_tokens(df, limit=4).collect()), key=str)
    assert made == sorted(((i, len((t or "").encode()), library(t), library(t) > 4) for i, t, _ in rows), key=str)
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    from tessera.llm.queries import QUERIES

    made = {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in QUERIES["op12_token_counts"](spark, sf_dir).collect()}
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert made == {d: (n := library(t), len((t or "").encode()), n > 512) for d, t in texts}
