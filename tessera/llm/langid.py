"""Language identification as mixture inference.

Every language is a distribution over hashed byte trigrams.  A document is a
mixture of languages; expectation-maximisation estimates its proportions from
the likelihoods of its trigrams, and the set of languages is the one whose
likelihood, less a penalty for each language, is greatest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_type, one_array
from .textblock import LOWER, TextBlock, blocks

GRAM_BITS = 16
UNDETERMINED = "und"
_CLEAN = LOWER.copy()
_CLEAN[[b for b in range(128) if not chr(b).isalpha()]] = 32
_BATCH = 1 << 19


def grams(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed trigrams of each document with their counts: document (ascending), trigram, count.

    Words are set apart by blanks; a trigram that is all blank isn't one.
    """
    size = np.diff(block.offs)
    at = np.arange(len(block.data)) + 2 * np.repeat(np.arange(block.n), size) + 1
    data = np.full(len(block.data) + 2 * block.n, 32, np.uint8)
    data[at] = _CLEAN[block.data]
    if len(data) < 3:
        return (np.zeros(0, np.int64),) * 3
    doc = np.repeat(np.arange(block.n, dtype=np.uint64), size + 2)
    x = data.astype(np.uint64)
    k = (x[:-2] << np.uint64(16)) | (x[1:-1] << np.uint64(8)) | x[2:]
    use = (doc[:-2] == doc[2:]) & (k != np.uint64(0x202020))
    h = (k[use] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)
    key, n = np.unique((doc[:-2][use] << np.uint64(GRAM_BITS)) | h, return_counts=True)
    return (key >> np.uint64(GRAM_BITS)).astype(np.int64), (key & np.uint64((1 << GRAM_BITS) - 1)).astype(np.int64), n


@dataclass
class LanguageModel:
    names: list[str]
    prob: np.ndarray  # float32, trigram x language

    @staticmethod
    def from_counts(names: list[str], counts: np.ndarray, smoothing: float = 0.5) -> LanguageModel:
        """``counts``: language x trigram."""
        c = counts + smoothing
        return LanguageModel(names, np.ascontiguousarray((c / c.sum(1, keepdims=True)).T.astype(np.float32)))


def _em(p: np.ndarray, n: np.ndarray, lo: np.ndarray, owner: np.ndarray, total: np.ndarray, mix: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by document, and their log likelihoods, after some steps from ``mix`` (zeros stay)."""
    for _ in range(steps):
        joint = mix[owner] * p
        joint *= (n / np.maximum(joint.sum(1), 1e-30))[:, None]
        mix = (np.add.reduceat(joint, lo, axis=0) / total[:, None]).astype(np.float32)
    like = np.add.reduceat(n * np.log(np.maximum((mix[owner] * p).sum(1), 1e-30)), lo)
    return mix, like


def _most_likely(p: np.ndarray, n: np.ndarray, lo: np.ndarray, owner: np.ndarray, total: np.ndarray, mix: np.ndarray, like: np.ndarray) -> np.ndarray:
    """A bound on the log likelihood of every mixture: by Jensen's inequality none exceeds that of ``mix`` by more than ``total`` times the log of the greatest factor of its next step."""
    factor = np.add.reduceat(p * (n / np.maximum((mix[owner] * p).sum(1), 1e-30))[:, None], lo, axis=0) / total[:, None]
    return like + total * np.log(np.maximum(factor.max(1), 1))


def infer(model: LanguageModel, doc: np.ndarray, gram: np.ndarray, count: np.ndarray, n_docs: int, penalty: float = 3.0) -> np.ndarray:
    """Proportions (document x language) within the chosen set of languages; zeros for documents without trigrams.

    Sets of every size are tried, by the largest shares of a mixture of all
    languages; the one of the greatest penalised likelihood is chosen, the
    smaller one if equal.  A document leaves once no larger set can better what
    it has, by the bound of :func:`_most_likely`; what stands beside it in a
    batch never matters.
    """
    out = np.zeros((n_docs, len(model.names)), np.float32)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    bounds = np.append(starts, len(doc))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + _BATCH, side="right")) - 1)
        a, b = bounds[i], bounds[j]
        rows = doc[starts[i:j]]
        size = np.diff(bounds[i : j + 1])
        owner = np.repeat(np.arange(j - i), size)
        p, n, lo = model.prob[gram[a:b]], count[a:b].astype(np.float32), starts[i:j] - a
        total = np.add.reduceat(n, lo)
        langs = p.shape[1]
        mix, like = _em(p, n, lo, owner, total, np.full((j - i, langs), 1 / langs, np.float32), 6)
        most = _most_likely(p, n, lo, owner, total, mix, like) + 1e-3 * (1 + np.abs(like)) ** 0.5
        order = np.argsort(-mix, axis=1, kind="stable")
        best, gain = np.zeros_like(mix), np.full(j - i, -np.inf)
        live = np.arange(j - i)
        for k in range(1, langs + 1):
            start = np.zeros((len(live), langs), np.float32)
            np.put_along_axis(start, order[live, :k], 1 / k, axis=1)
            made, like = _em(p, n, lo, owner, total[live], start, 0 if k == 1 else 5)
            worth = like - penalty * (k - 1) * np.log(total[live] + 1)
            better = worth > gain[live] + 1e-6
            best[live[better]], gain[live[better]] = made[better], worth[better]
            stay = most[live] - penalty * k * np.log(total[live] + 1) > gain[live]
            if not stay.any():
                break
            if not stay.all():
                keep = stay[owner]
                p, n, size, live = p[keep], n[keep], size[stay], live[stay]
                owner, lo = np.repeat(np.arange(len(live)), size), np.cumsum(size) - size
        out[rows] = best
        i = j
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("grams", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for b in blocks(batch.column("_text")):
            doc, gram, n = grams(b)
            own = langs[b.rows]
            for lang in dict.fromkeys(own):
                use = (own == lang)[doc]
                sums[lang] = sums.get(lang, 0) + np.bincount(gram[use], weights=n[use], minlength=1 << GRAM_BITS)
    for lang, v in sums.items():
        some = np.flatnonzero(v)
        yield arrow_batch(schema, [lang], pa.array([some.astype(np.int32)], pa.list_(pa.int32())), pa.array([v[some].astype(np.int64)], pa.list_(pa.int64())))


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most_languages: int = 256) -> LanguageModel | None:
    """Trigram counts of every language over all rows with a language; None without any.

    The model holds 65,536 numbers a language, however many rows there are.  Of
    more than ``most_languages`` values of ``lang_col`` those of the most rows
    are learned, by name if equal; the others are no languages then.  Null and
    empty texts add nothing; repeated rows count as often as they stand; other
    columns are ignored.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("_text"))
    known = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages + 1).collect()
    if len(known) > most_languages:
        rows = rows.where(F.col("lang").isin([r["lang"] for r in known[:most_languages]]))
    parts = rows.mapInArrow(_count, "lang string, grams array<int>, n array<bigint>")
    flat = parts.select("lang", F.explode(F.arrays_zip("grams", "n")).alias("x")).groupBy("lang", F.col("x.grams").alias("gram")).agg(F.sum("x.n").alias("n"))
    names, counts = [], []
    for r in flat.groupBy("lang").agg(F.collect_list("gram").alias("grams"), F.collect_list("n").alias("n")).toLocalIterator():  # at most 65,536 pairs a language
        names.append(r["lang"])
        counts.append(np.bincount(r["grams"], weights=r["n"], minlength=1 << GRAM_BITS))
    if not names:
        return None
    order = sorted(range(len(names)), key=names.__getitem__)
    return LanguageModel.from_counts([names[i] for i in order], np.stack([counts[i] for i in order]))


def _predict(shared, key_types: list[tuple[str, pa.DataType]]):
    schema = pa.schema([*key_types, ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            letter = np.asarray(batch.column("_letter").fill_null(False))
            for b in blocks(batch.column("_text")):
                mix = infer(model, *grams(b), b.n)
                top = mix.argmax(1)
                some = letter[b.rows] & (mix.sum(1) > 0)
                names = [[model.names[i] for i in np.argsort(-m, kind="stable") if m[i] > 0] if ok else [] for m, ok in zip(mix, some, strict=True)]
                pred = [model.names[i] if ok else UNDETERMINED for i, ok in zip(top, some, strict=True)]
                value = np.where(some, np.minimum(mix[np.arange(b.n), top], 1), 0).astype(np.float64)
                yield arrow_batch(schema, *[one_array(batch.column(k)).slice(b.first, b.n) for k, _ in key_types], pred, value, pa.array(names, pa.list_(pa.string())))

    return apply


def identify(docs: DataFrame, model: LanguageModel | None, keys: list[Column], text_col: str = "text") -> DataFrame:
    """``keys`` with ``lang_pred`` (largest share), ``score`` (that share) and ``languages`` (the chosen set, by share).

    Only the text is looked at.  Texts that are null or have no letter, and all
    texts if no language was learned, are ``und`` with score 0.  Repeated rows
    come back as often as they stand; an empty table stays empty.
    """
    rows = docs.select(*keys, F.col(text_col).alias("_text"), F.col(text_col).rlike(r"\p{L}").alias("_letter"))
    names = [c for c in rows.columns if c not in ("_text", "_letter")]
    if model is None:
        return rows.select(*names, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("languages"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``most_languages`` columns of 256 KB
    return rows.mapInArrow(_predict(shared, [(c, arrow_type(rows, c)) for c in names]), f"{kinds}, lang_pred string, score double, languages array<string>")
