"""Ranked lexical search as a blocked sparse matrix product.

One factor is item x term, with a term's multiplicity in an item (or one, for
items that count a term once); the other is term x document, with the int64
impact of the term on the document.  Documents come in blocks: one pass over the
texts stores, for each block, its postings by term for all terms that some item
has.  Document frequencies are sums over these blocks; then each block is
multiplied with the items by Gustavson's method, which merges the term rows of
every item into one row of scores, and only the ``k`` best documents of each
item leave the block and then the task.  A last top-k over these is the result.

Items are taken in slices whose terms fit a stated bound, so what tasks are
sent does not grow with the number of items; each slice is a pass of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batch, list_parts, one_array, ranges
from .textblock import LOWER, TextBlock, blocks

#: Pairs of item and term in a slice: 16 bytes each in every task.
SLICE_TERMS = 1 << 20
#: Text of a block of documents.
BLOCK = 4 << 20
#: Cells of the dense rows into which items are merged at a time.
CELLS = 1 << 21

TERM = np.zeros(256, bool)
TERM[0x80:] = TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = True


def terms(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """The document and the 64-bit hash of every term, A-Z lower-cased: runs of ASCII letters, digits and all characters beyond ASCII."""
    low = TextBlock(LOWER[block.data], block.offs, block.first, block.null)
    start, end = low.runs(TERM[low.data])
    return low.owner(start), low.hashes(start, end).view(np.int64)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("item", pa.int64()), ("term", pa.int64())])
    for batch in batches:
        ids = one_array(batch.column("_id"))
        for b in blocks(batch.column("_text")):
            item, term = terms(b)
            yield arrow_batch(schema, ids.take(pa.array(item + b.first)), term)


@dataclass
class Slice:
    """Some items: their ids, their terms' places in ``vocabulary`` (sorted) as compressed rows, and the multiplicities."""

    ids: np.ndarray
    offs: np.ndarray
    term: np.ndarray
    times: np.ndarray
    vocabulary: np.ndarray


def _gather(rows: DataFrame) -> Slice:
    got = rows.toArrow()
    item, term, times = (np.asarray(got.column(c).combine_chunks()).astype(np.int64) for c in ("item", "term", "times"))
    vocabulary, place = np.unique(term, return_inverse=True)
    order = np.lexsort((place, item))
    ids, count = np.unique(item[order], return_counts=True)
    return Slice(ids, np.append(0, np.cumsum(count)), place[order], times[order], vocabulary)


_BLOCK_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("term", pa.list_(pa.int32())), ("df", pa.list_(pa.int32())), ("rows", pa.list_(pa.int32())), ("doc", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32())), ("docs", pa.int64()), ("length", pa.int64())])
_BLOCK_TYPE = "ids array<bigint>, n array<int>, term array<int>, df array<int>, rows array<int>, doc array<int>, tf array<int>, docs bigint, length bigint"


def _lists(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a)) for a in arrays]


def _postings(vocabulary):
    """Blocks of documents, and their postings for the terms of ``vocabulary``, by term."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            ids = one_array(batch.column("_id"))
            named, ids = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0))
            for b in blocks(batch.column("_text"), BLOCK):
                doc, term = terms(b)
                n = np.bincount(doc, minlength=b.n)
                at = np.searchsorted(known, term)
                at[at == len(known)] = 0
                met = known[at] == term if len(known) else np.zeros(len(term), bool)
                key, tf = np.unique(at[met] * b.n + doc[met], return_counts=True)
                row, first, count = np.unique(key // b.n, return_index=True, return_counts=True)
                use = named[b.rows][key % b.n]  # rows without an id count, but can't be found
                rows = np.add.reduceat(use, first, dtype=np.int32) if len(key) else count
                found = [x.astype(np.int32) for x in (n, row, count, rows, (key % b.n)[use], tf[use])]
                yield arrow_batch(_BLOCK_SCHEMA, *_lists(ids[b.rows].astype(np.int64), *found), [int((n > 0).sum())], [int(n.sum())])

    return apply


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """The weight of ``tf`` occurrences in a document of ``n`` terms, in whole numbers rounded down."""
    if 50 * int(n.max(initial=0)) * docs < 1 << 62:
        part = (50 * n.astype(np.int64) * docs) // length
    else:  # beyond 64 bits
        part = np.array([50 * int(x) * docs // length for x in n], np.int64)
    m = 100 - 50 + part
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class _Best:
    """The ``k`` best documents of every item so far; equal scores by ascending id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * items
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * items

    def add(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        have = self.scores[item]
        if len(have) == self.k:  # documents below the worst that is kept can't come in
            use = scores >= have[-1]
            ids, scores = ids[use], scores[use]
        if len(scores):
            ids, scores = np.concatenate([self.ids[item], ids]), np.concatenate([have, scores])
            order = np.lexsort((ids, -scores))[: self.k]
            self.ids[item], self.scores[item] = ids[order], scores[order]


def merge_rows(own: Slice, weights: np.ndarray, ids: np.ndarray, term: np.ndarray, count: np.ndarray, doc: np.ndarray, value: np.ndarray, best: _Best) -> None:
    """One block of the product: the rows of each item's terms, weighted, are merged into a row of scores."""
    start = np.zeros(len(own.vocabulary) + 1, np.int64)
    start[term + 1] = count
    np.cumsum(start, out=start)
    width = len(ids)
    step = max(1, CELLS // max(width, 1))
    for lo in range(0, len(own.ids), step):
        hi = min(lo + step, len(own.ids))
        a, z = own.offs[lo], own.offs[hi]
        t = own.term[a:z]
        item = np.repeat(np.arange(hi - lo), np.diff(own.offs[lo : hi + 1]))
        sums = np.zeros((hi - lo) * width, np.int64)
        # Rows in groups of about as many postings as there are cells.
        size = start[t + 1] - start[t]
        cuts = np.searchsorted(np.cumsum(size), np.arange(CELLS, int(size.sum()) + CELLS, CELLS), side="left") + 1
        for x, y in zip(np.append(0, cuts), np.append(cuts, len(t)), strict=True):
            if x < y:
                at, owner = ranges(start[t[x:y]], size[x:y])
                np.add.at(sums, item[x:y][owner] * width + doc[at], value[at] * (own.times[a:z][x:y] * weights[t[x:y]])[owner])
        for i, row in enumerate(sums.reshape(hi - lo, width), lo):
            some = np.flatnonzero(row > 0)
            if len(some) > best.k:
                least = np.partition(row[some], len(some) - best.k)[len(some) - best.k]
                some = some[row[some] >= least]  # ties with the last stay, to be told apart by id
            best.add(i, ids[some], row[some])


def _product(own, weights, docs: int, length: int, k: int):
    schema = pa.schema([("item", pa.int64()), ("doc", pa.int64()), ("score", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Slice = own.value
        best = _Best(len(items.ids), k)
        for batch in batches:
            parts = {c: list_parts(batch.column(c)) for c in ("ids", "n", "term", "rows", "doc", "tf")}
            for r in range(len(batch)):
                ids, n, term, rows, doc, tf = (np.asarray(v)[o[r] : o[r + 1]] for o, v in parts.values())
                if len(term):
                    merge_rows(items, weights.value, ids, term.astype(np.int64), rows, doc, impacts(tf, n[doc], docs, length), best)
        for i, (ids, scores) in enumerate(zip(best.ids, best.scores, strict=True)):
            if len(ids):
                yield arrow_batch(schema, np.full(len(ids), items.ids[i]), ids, scores)

    return apply


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 50, once_each: bool = True, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """Each item's ``k`` highest-scoring documents with a score above 0: ``item_col, rank, id_col, score``.

    Ids of both tables are whole numbers.  Equal scores stand by ascending id.
    Rows of one ``item_col`` are one item with the terms of all; with
    ``once_each`` a term counts once in an item, else as often as it stands.
    Null texts have no terms, documents and items without terms never meet, and
    rows without an id take no part in the ranking (documents count for the
    statistics all the same).  Repeated documents are ranked as rows of their
    own.  Empty tables give an empty result, texts of any length are read whole,
    and other columns are ignored whatever their names.
    """
    spark, scratch = docs.sparkSession, Scratch()
    asked = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("_id"), F.col(item_text_col).alias("_text"))
    per_item = scratch.stored(asked.mapInArrow(_item_terms, "item bigint, term bigint").groupBy("item", "term").agg((F.lit(1) if once_each else F.count(F.lit(1))).cast("long").alias("times")))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    made, total = None, per_item.count()
    slices = max(1, -(-total // slice_terms))
    while True:  # until every slice keeps to the bound, or is one item
        dealt = per_item.withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(slices)))
        worst = dealt.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("a"), F.max("item").alias("z")).where((F.col("n") > slice_terms) & (F.col("a") != F.col("z"))).limit(1).count()
        if not worst or slices > total:
            break
        slices *= 2
    for s in range(slices):
        own = _gather(dealt.where(F.col("slice") == s).drop("slice"))
        if not len(own.ids):
            continue
        words = spark.sparkContext.broadcast(own.vocabulary)
        stored = scratch.stored(texts.mapInArrow(_postings(words), _BLOCK_TYPE))
        docs_n, length = stored.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
        found = stored.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.sum("x.df").alias("df")).toArrow()  # a number for each term of the slice
        weights = np.zeros(len(own.vocabulary), np.int64)
        weights[np.asarray(found.column("term"))] = [weight(docs_n, d) for d in found.column("df").to_pylist()]
        part = stored.mapInArrow(_product(spark.sparkContext.broadcast(own), spark.sparkContext.broadcast(weights), docs_n, length, k), "item bigint, doc bigint, score bigint")
        made = part if made is None else made.unionByName(part)
    if made is None:
        made = spark.createDataFrame([], "item bigint, doc bigint, score bigint")
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    ranked = made.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], k: int = 50) -> list[tuple[int, int, int, int]]:
    """The definition, for tests: (item, rank, document, score)."""
    import re
    from collections import Counter

    def cut(text: str | None) -> list[str]:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    held = [(i, Counter(cut(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    docs_n, length, df = sum(s > 0 for s in sizes), sum(sizes), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        rows = []
        for (i, c), n in zip(held, sizes, strict=True):
            score = 0
            for t in set(cut(text)):
                if t in c:
                    m = 50 + 50 * n * docs_n // length
                    score += math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                rows.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return out
