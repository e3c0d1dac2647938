"""Quality classifier by co-training: a text view and a metadata view teach one another.

Both views are logistic models.  Each predicts all unlabelled rows of the corpus,
hands its most confident predictions to the other as labels, and both are fitted
again, for some rounds.  Held-out labelled rows calibrate the two views and
weigh them against each other; every document is then scored by both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_batch, arrow_type, list_parts, one_array, whole_rows
from .quality_rules import labelled_rows
from .text_stats import COUNT_BYTES, RATIOS, block_counts, ratio_matrix
from .textblock import TextBlock, blocks

WORD_BITS = 18
MAX_WORDS = 1024
MAX_LABELLED = 8000
META_BUCKETS = 512
_BINS = 12


def word_buckets(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed words of every document: document (ascending) and bucket."""
    low = block.lowered()
    start, end, doc = low.words()
    # Marks at a word's end don't make it another word.
    mark = np.zeros(256, bool)
    mark[list(b".,;:!?\"')(")] = True
    for _ in range(2):
        last = (end - start > 1) & mark[low.data[np.maximum(end - 1, 0)]] if len(end) else np.zeros(0, bool)
        end = end - last
    key = np.sort((doc.astype(np.uint64) << np.uint64(WORD_BITS)) | (low.hashes(start, end) >> np.uint64(64 - WORD_BITS)))
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    return (key >> np.uint64(WORD_BITS)).astype(np.int64), (key & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)


def _one_hot(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Column of each value's bin, by ratio; bins of one ratio are neighbours."""
    return np.stack([f * _BINS + np.searchsorted(e, values[:, f], side="right") for f, e in enumerate(edges)], axis=1)


def meta_columns(docs: DataFrame) -> Column:
    """Hashed metadata features of a row: source, language, length class and their pairs; absent columns count as null."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("?")) if name in docs.columns else F.lit("?")

    size = F.floor(F.log2(F.greatest(F.expr("try_cast(n_chars as double)") if "n_chars" in docs.columns else F.lit(1.0), F.lit(1.0)))).cast("string")
    size = F.coalesce(size, F.lit("?"))
    parts = [("s", text("source")), ("l", text("lang")), ("n", size), ("sl", F.concat_ws("|", text("source"), text("lang"))), ("ln", F.concat_ws("|", text("lang"), size))]
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), v), F.lit(META_BUCKETS)).cast("int") for k, v in parts])


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 1.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by accelerated gradient steps."""
    beta, bias = np.zeros(x.shape[1], np.float32), 0.0
    prev, pbias = beta.copy(), bias
    rate = 4.0 / (float((x * x).sum(1).mean()) + 1.0)
    total = max(float(w.sum()), 1.0)
    for t in range(steps):
        m = t / (t + 3)
        vb, vc = beta + m * (beta - prev), bias + m * (bias - pbias)
        g = (w * (1 / (1 + np.exp(-np.clip(x @ vb + vc, -30, 30))) - y)).astype(np.float32)
        prev, pbias = beta, bias
        beta = vb - rate * ((x.T @ g) / total + l2 / total * vb)
        bias = vc - rate * float(g.sum()) / total
    return beta, float(bias)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset that calibrate logits."""
    a, b = 1.0, 0.0
    for _ in range(300):
        d = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - y
        ga, gb = float((d * z).mean()) + 1e-3 * a, float(d.mean())
        a, b = max(0.0, a - ga / (0.25 * float((z * z).mean()) + 0.1)), b - gb * 2
    return a, b


def _best_cut(score: np.ndarray, high: np.ndarray) -> float:
    """The cut with the least sum of both error rates between scores that should be high and the others; of equal ones, that nearest to a half."""
    at = np.unique(score)
    cuts = np.concatenate([(at[1:] + at[:-1]) / 2, [0.5]])
    hi, lo = np.sort(score[high]), np.sort(score[~high])
    lost = np.searchsorted(hi, cuts) / len(hi) + 1 - np.searchsorted(lo, cuts) / len(lo)
    return float(cuts[np.lexsort((np.abs(cuts - 0.5), np.round(lost, 9)))[0]])


def _telling_words(flat: np.ndarray, row: np.ndarray, rows: np.ndarray, label: np.ndarray) -> np.ndarray:
    """By word bucket, the column of the words that tell the two labels apart best, or -1."""
    size = 1 << WORD_BITS
    sets = {c: np.bincount(flat[np.isin(row, rows[label[rows] == c])], minlength=size) for c in (0, 1)}
    n0, n1 = (label[rows] == 0).sum(), (label[rows] == 1).sum()
    p = (sets[0] + sets[1] + 1) / (n0 + n1 + 2)
    z = np.abs(sets[1] / n1 - sets[0] / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    chosen = np.lexsort((np.arange(size), -z))[:MAX_WORDS]
    columns = np.full(size, -1, np.int16)
    columns[chosen] = np.arange(len(chosen))
    return columns


def _text_matrix(flat: np.ndarray, row: np.ndarray, ratios: np.ndarray, edges: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    wide = len(edges) * _BINS
    xt = np.zeros((len(ratios), wide + MAX_WORDS), np.float32)
    xt[np.arange(len(ratios))[:, None], _one_hot(ratios, edges)] = 1
    col = columns[flat]
    xt[row[col >= 0], wide + col[col >= 0]] = 1
    return xt


def _meta_matrix(meta: np.ndarray) -> np.ndarray:
    xm = np.zeros((len(meta), META_BUCKETS), np.float32)
    np.put_along_axis(xm, meta, 1, axis=1)
    return xm


@dataclass
class ToxicModel:
    columns: np.ndarray
    text: tuple[np.ndarray, float, float, float]
    cut: float  # rows of at least this score are dropped
    recall: float  # share of held-out toxic rows that the cut drops
    loss: float  # share of the other held-out rows that it drops


@dataclass
class CoModel:
    columns: np.ndarray  # int16 by word bucket: column of the text view or -1
    edges: list[np.ndarray]
    text: tuple[np.ndarray, float, float, float]  # weights, bias, calibration slope and offset
    meta: tuple[np.ndarray, float, float, float]
    mix: tuple[float, float, float]  # weights of the calibrated logits, offset
    threshold: float
    exchanged: int  # pseudo-labels given in all rounds
    held_out: float  # accuracy on the calibration rows
    recall: float  # share of held-out bad rows that the threshold drops
    loss: float  # share of held-out good rows that it drops
    toxic: ToxicModel | None = None

    def toxic_score(self, words: tuple[np.ndarray, np.ndarray], ratios: np.ndarray) -> np.ndarray:
        if self.toxic is None:
            return np.zeros(len(ratios))
        return 1 / (1 + np.exp(-np.clip(self.text_logit(words, ratios, self.toxic), -500, 500)))

    def text_logit(self, words: tuple[np.ndarray, np.ndarray], ratios: np.ndarray, of: ToxicModel | None = None) -> np.ndarray:
        beta, bias, a, b = (of or self).text
        doc, bucket = words
        col = (of or self).columns[bucket]
        hit = col >= 0
        z = np.bincount(doc[hit], weights=beta[len(self.edges) * _BINS + col[hit]], minlength=len(ratios)).astype(np.float64)
        return a * (z + beta[_one_hot(ratios, self.edges)].sum(1) + bias) + b

    def meta_logit(self, buckets: np.ndarray) -> np.ndarray:
        beta, bias, a, b = self.meta
        return a * (beta[buckets].astype(np.float64).sum(1) + bias) + b

    def scores(self, zt: np.ndarray, zm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, v, c = self.mix
        return tuple(1 / (1 + np.exp(-np.clip(z, -500, 500))) for z in (zt, zm, u * zt + v * zm + c))


def _toxic_model(flat: np.ndarray, row: np.ndarray, ratios: np.ndarray, edges: list[np.ndarray], toxic: np.ndarray, fit: np.ndarray, held: np.ndarray) -> ToxicModel | None:
    """A calibrated text model of toxicity with a cut of its own; None if rows to fit on or to judge by lack one of the labels."""
    fit, held = fit[toxic[fit] >= 0], held[toxic[held] >= 0]
    if len(np.unique(toxic[fit])) < 2 or len(np.unique(toxic[held])) < 2:
        return None
    columns = _telling_words(flat, row, fit, toxic)
    x = _text_matrix(flat, row, ratios, edges, columns)
    y = toxic[fit].astype(np.float32)
    beta, bias = _fit(x[fit], y, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32))
    z = x[held] @ beta + bias
    a, b = _platt(z, toxic[held])
    score, bad = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500))), toxic[held] == 1
    cut = _best_cut(score, bad)
    return ToxicModel(columns, (beta, bias, a, b), cut, float((score[bad] >= cut).mean()), float((score[~bad] >= cut).mean()))


#: Model, confidence and most rows of each label; returns choices (row, view, label), and the words, ratios and metadata of the rows.
Ask = Callable[["CoModel", float, dict[int, int]], tuple[list[tuple[int, int, int]], dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]]


def co_train(words: list[np.ndarray], ratios: np.ndarray, meta: np.ndarray, y: np.ndarray, rounds: int = 3, confident: float = 0.95, per_round: float = 0.25, toxic: np.ndarray | None = None, ask: Ask | None = None) -> CoModel | None:
    """Fits both views.  ``y`` is 1 (good) or 0 (bad), ``toxic`` 1, 0 or -1 (unknown); None without both kinds of labels.

    ``ask`` finds the unlabelled rows of which a model is surest, at most so many of each label.

    The threshold, and that of toxicity, has the least sum of both error rates on the held-out rows.
    """
    if not (y == 1).any() or not (y == 0).any():
        return None
    known = np.flatnonzero(y >= 0)
    held = known[::4] if len(known) >= 16 else known
    fit = np.setdiff1d(known, held) if len(known) >= 16 else known
    if len(np.unique(y[held])) < 2 or len(np.unique(y[fit])) < 2:
        held = fit = known
    flat, row = np.concatenate(words) if words else np.zeros(0, np.int64), np.repeat(np.arange(len(words)), [len(w) for w in words])
    columns = _telling_words(flat, row, fit, y)
    edges = [np.unique(np.quantile(ratios[fit, f], np.linspace(0, 1, _BINS + 1)[1:-1])) for f in range(ratios.shape[1])]
    xt = _text_matrix(flat, row, ratios, edges, columns)
    views = [xt, _meta_matrix(meta)]
    place: dict[int, int] = {}  # where the rows found by ``ask`` stand
    given: list[dict[int, int]] = [{}, {}]  # pseudo-labels that each view has received
    models: list[tuple[np.ndarray, float, float, float]] = []
    for turn in range(rounds + 1):
        models = []
        for x, own in zip(views, given, strict=True):
            extra = np.fromiter(own, np.int64, len(own))
            rows = np.concatenate([fit, extra])
            target = np.concatenate([y[fit], np.fromiter(own.values(), np.int64, len(own))]).astype(np.float32)
            weight = np.concatenate([np.ones(len(fit)), np.full(len(own), 0.5)]).astype(np.float32)
            share = float((weight * target).sum() / weight.sum())
            weight *= np.where(target == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)).astype(np.float32)
            beta, bias = _fit(x[rows], target, weight)
            a, b = _platt(x[held] @ beta + bias, y[held])
            models.append((beta, bias, a, b))
        if turn == rounds or ask is None:
            break
        most = {label: max(1, int(per_round * len(fit) * (y[fit] == label).mean())) for label in (0, 1)}
        choices, found = ask(CoModel(columns, edges, models[0], models[1], (0.0, 0.0, 0.0), 0.5, 0, 0.0, 0.0, 0.0), confident, most)
        new = [k for k in sorted(found) if k not in place]
        if new:
            more, own, m = ([found[k][i] for k in new] for i in range(3))
            at = np.repeat(np.arange(len(new)), [len(w) for w in more])
            place.update({k: len(views[0]) + i for i, k in enumerate(new)})
            views[0] = np.concatenate([views[0], _text_matrix(np.concatenate(more), at, np.stack(own), edges, columns)])
            views[1] = np.concatenate([views[1], _meta_matrix(np.stack(m))])
        for k, view, label in choices:
            given[1 - view][place[k]] = label
    zt, zm = ((x[held] @ beta + bias) * a + b for x, (beta, bias, a, b) in zip(views, models, strict=True))
    both = np.stack([zt, zm], axis=1).astype(np.float64)
    weights, bias = _fit(both.astype(np.float32) / 4, y[held].astype(np.float32), np.ones(len(held), np.float32), 0.01, 400)
    u, v, c = max(float(weights[0]) / 4, 0.05), max(float(weights[1]) / 4, 0.0), bias
    score = 1 / (1 + np.exp(-np.clip(u * zt + v * zm + c, -500, 500)))
    good = y[held] == 1
    threshold = _best_cut(score, good)
    kept = score >= threshold
    out = CoModel(columns, edges, models[0], models[1], (u, v, c), threshold, len(given[0]) + len(given[1]), float((kept == good).mean()), float((~kept[~good]).mean()), float((~kept[good]).mean()))
    if toxic is not None:
        del views, xt
        out.toxic = _toxic_model(flat, row, ratios, edges, toxic, fit, held)
    return out


def _features(*more: pa.Field):
    """Words, ratios and metadata of texts, with the columns ``more`` as they are."""
    schema = pa.schema([*more, ("meta", pa.list_(pa.int32())), ("words", pa.list_(pa.int32())), ("ratios", pa.list_(pa.float64()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("_text"), COUNT_BYTES):
                doc, bucket = word_buckets(b)
                offs = np.searchsorted(doc, np.arange(b.n + 1)).astype(np.int32)
                r = ratio_matrix(block_counts(b))
                ratios = pa.ListArray.from_arrays(np.arange(0, r.size + 1, r.shape[1], dtype=np.int32), pa.array(r.ravel()))
                cut = [one_array(batch.column(f.name)).slice(b.first, b.n) for f in (*more, schema.field("meta"))]
                yield arrow_batch(schema, *cut, pa.ListArray.from_arrays(offs, pa.array(bucket.astype(np.int32))), ratios)

    return apply


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, rounds: int = 3) -> CoModel | None:
    """Co-trains on at most ``max_labelled`` labelled rows, chosen by hashes of the id, and the most confident of all others.

    A row is good if its quality is 1 and it isn't toxic; rows without a quality
    label, and those without an id, are unlabelled.  Null texts are empty ones.
    Of rows that share a labelled id one is fitted on, that of the least hash of
    its text.  The text view knows the ``MAX_WORDS`` words that tell most of the
    labels.  Other columns than text and metadata are ignored whatever their names.
    """
    if not {id_col, "quality"} <= set(labels.columns):
        return None
    known = F.coalesce(F.col("toxic"), F.lit(-1)) if "toxic" in labels.columns else F.lit(-1)
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    target = labels.where("quality is not null").select(F.col(id_col), ((F.col("quality") == 1) & (toxic == 0)).cast("int").alias("good"), known.cast("int").alias("toxic"))
    fields = [F.col(f"`{text_col}`").alias("_text"), meta_columns(docs).alias("meta")]
    some = labelled_rows(docs, target, ["good", "toxic"], fields, id_col, text_col, max_labelled).select(F.xxhash64("_k").alias("key"), F.col("_l_good").alias("y"), F.col("_l_toxic").alias("toxic"), "_text", "meta")
    label = [pa.field("key", pa.int64()), pa.field("y", pa.int32()), pa.field("toxic", pa.int32())]
    made = some.mapInArrow(_features(*label), f"key bigint, y int, toxic int, {_FEATURES}").toArrow()
    if not made.num_rows:
        return None
    made = made.sort_by([("key", "ascending"), ("y", "ascending")]).combine_chunks()
    words, ratios, meta = _arrays(made)
    known_ids = target.select(F.col(id_col).alias("_k"))
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    texts = docs.select(F.col(f"`{id_col}`").alias("_k"), key.alias("key"), *fields)
    kind, id_type = texts.schema["_k"].dataType.simpleString(), arrow_type(texts, "_k")
    # What both views look at is worked out once for all rounds.
    scratch = Scratch()
    rows = scratch.stored(texts.mapInArrow(_features(pa.field("_k", id_type), pa.field("key", pa.int64())), f"_k {kind}, key bigint, {_FEATURES}"))

    def ask(model: CoModel, confident: float, most: dict[int, int]) -> tuple[list[tuple[int, int, int]], dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        sure = rows.mapInArrow(_sure(model, confident, id_type), f"_k {kind}, key bigint, view int, label int, sure double")
        sure = scratch.stored(sure.join(known_ids, "_k", "left_anti").groupBy("view", "label", "key").agg(F.first("sure").alias("sure")))
        best = [sure.where((F.col("view") == v) & (F.col("label") == c)).orderBy(F.desc("sure"), "key").limit(most[c]).collect() for v in (0, 1) for c in (0, 1)]
        choices = [(r["key"], r["view"], r["label"]) for part in best for r in part]
        if not choices:
            return [], {}
        picked = docs.sparkSession.createDataFrame([(k,) for k in sorted({k for k, _, _ in choices})], "key bigint")
        got = rows.join(F.broadcast(picked), "key").dropDuplicates(["key"]).select("key", "meta", "words", "ratios").toArrow().combine_chunks()
        w, r, m = _arrays(got)
        return choices, {int(k): (w[i], r[i], m[i]) for i, k in enumerate(got["key"].to_pylist())}

    model = co_train(words, ratios, meta, np.asarray(made["y"]).astype(np.int64), rounds, toxic=np.asarray(made["toxic"]).astype(np.int64), ask=ask)
    scratch.drop_rest()
    return model


_FEATURES = "meta array<int>, words array<int>, ratios array<double>"


def _arrays(made: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The words, ratios and metadata of rows of features."""
    offs, flat = list_parts(made["words"])
    flat = np.asarray(flat)
    grid = lambda c: np.asarray(list_parts(made[c])[1]).reshape(made.num_rows, -1)
    return [flat[a:b] for a, b in zip(offs, offs[1:], strict=False)], grid("ratios"), grid("meta").astype(np.int64)


def _sure(model: CoModel, confident: float, id_type: pa.DataType):
    """What each view is sure of: a row for each row and view with at least that confidence."""
    schema = pa.schema([("_k", id_type), ("key", pa.int64()), ("view", pa.int32()), ("label", pa.int32()), ("sure", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids, keys = (one_array(batch.column(c)) for c in ("_k", "key"))
            offs, flat = list_parts(batch.column("words"))
            meta, ratios = (np.asarray(list_parts(batch.column(c))[1]).reshape(len(batch), -1) for c in ("meta", "ratios"))
            words = np.repeat(np.arange(len(batch)), np.diff(offs)), np.asarray(flat)
            for view, z in enumerate((model.text_logit(words, ratios), model.meta_logit(meta))):
                prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                for label, sure in ((1, prob), (0, 1 - prob)):
                    at = np.flatnonzero(sure >= confident)
                    if len(at):
                        row = pa.array(at)
                        yield arrow_batch(schema, ids.take(row), keys.take(row), np.full(len(at), view), np.full(len(at), label), sure[at])

    return apply


def _score(model: CoModel, key_type: pa.DataType, texts: Callable[[pa.RecordBatch], pa.Array]):
    schema = pa.schema([("_key", key_type), ("text_score", pa.float64()), ("meta_score", pa.float64()), ("score", pa.float64()), ("toxic_score", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, flat = list_parts(batch.column("meta"))
            meta = np.asarray(flat).reshape(len(batch), -1)
            for b in blocks(texts(batch), COUNT_BYTES):
                words, ratios = word_buckets(b), ratio_matrix(block_counts(b))
                zt = model.text_logit(words, ratios)
                yield arrow_batch(schema, one_array(batch.column("_key")).slice(b.first, b.n), *model.scores(zt, model.meta_logit(meta[b.rows])), model.toxic_score(words, ratios))

    return apply


def _scored(rows: DataFrame, model: CoModel, texts: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """``_key``, scores and verdict of rows of ``_key`` and ``meta``, whose texts ``texts`` takes out of a batch."""
    schema = f"_key {rows.schema['_key'].dataType.simpleString()}, text_score double, meta_score double, score double, toxic_score double"
    return rows.mapInArrow(_score(model, arrow_type(rows, "_key"), texts), schema).withColumn("kept", (F.col("score") >= model.threshold) & (F.col("toxic_score") < (model.toxic.cut if model.toxic else 2.0))).drop("toxic_score")


def score(docs: DataFrame, model: CoModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id_col, text_score, meta_score, score`` (0 to 1, calibrated) and ``kept``.

    Null texts are empty ones and null metadata is a value of its own; repeated
    rows come back as often as they stand; an empty table stays empty.  Without
    a model (no labels of both kinds) all scores are null and all rows kept.
    """
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(F.col(f"`{id_col}`").alias(id_col), none.alias("text_score"), none.alias("meta_score"), none.alias("score"), F.lit(True).alias("kept"))
    rows = docs.select(F.col(f"`{id_col}`").alias("_key"), F.col(f"`{text_col}`").alias("_text"), meta_columns(docs).alias("meta"))
    return _scored(rows, model, lambda batch: batch.column("_text")).withColumnRenamed("_key", id_col)


def filter_good(docs: DataFrame, model: CoModel | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`score` keeps, with their columns."""
    if model is None:
        return docs
    packed, at = whole_rows(docs, text_col)
    rows = docs.select(packed.alias("_key"), meta_columns(docs).alias("meta"))
    return _scored(rows, model, lambda batch: one_array(batch.column("_key")).field(at)).where("kept").select(*[F.col("_key").getField(c).alias(c) for c in docs.columns])
