"""Nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of several codebooks of full
dimension.  Codebooks are fitted to residuals, codes are found by beam search,
and the codebooks are refitted to the codes.  A query scores a code by adding
entries of its table of inner products, scaled by the stored norm ratio of the
vector and its code; the best codes are then ranked by exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import arrow_batch, stored

BOOKS = 12
WORDS = 256
BEAM = 4
SAMPLE = 12_000
ROW_BLOCK = 8192
QUERY_BLOCK = 8192
SHORTLIST = 384


class AdditiveQuantizer:
    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)  # book x word x dimension

    @staticmethod
    def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 6, seed: int = 5) -> AdditiveQuantizer:
        """Residual codebooks by k-means, then a least-squares fit of all of them to beam-search codes."""
        rng, rest, made = np.random.default_rng(seed), x.astype(np.float32).copy(), []
        words = max(1, min(words, len(x)))
        for _ in range(books):
            c = rest[rng.choice(len(rest), words, replace=False)].copy()
            for _ in range(rounds):
                own = np.argmin((c * c).sum(1)[None, :] - 2 * rest @ c.T, axis=1)
                n = np.bincount(own, minlength=words)
                sums = np.stack([np.bincount(own, weights=rest[:, d], minlength=words) for d in range(x.shape[1])], axis=1)
                c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], rest[rng.choice(len(rest), words)]).astype(np.float32)
            own = np.argmin((c * c).sum(1)[None, :] - 2 * rest @ c.T, axis=1)
            rest -= c[own]
            made.append(c)
        q = AdditiveQuantizer(np.stack(made))
        codes = q.encode(x)
        flat = codes.astype(np.int64) + np.arange(books) * words
        gram, cross = np.zeros((books * words, books * words), np.float32), np.zeros((books * words, x.shape[1]), np.float32)
        for i in range(books):
            np.add.at(cross, flat[:, i], x.astype(np.float32))
            for j in range(books):
                pair = np.bincount(flat[:, i] * (books * words) + flat[:, j], minlength=0)
                at = np.flatnonzero(pair)
                gram.ravel()[at] += pair[at]
        gram[np.diag_indices(len(gram))] += 0.1
        fitted = np.linalg.solve(gram, cross + 0.1 * q.books.reshape(-1, x.shape[1])).reshape(q.books.shape)
        return AdditiveQuantizer(fitted)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (row x book): the best sum of codewords that a beam of partial sums finds."""
        m, k, dim = self.books.shape
        flat = self.books.reshape(m * k, dim)
        gram, norms = flat @ flat.T, (flat * flat).sum(1)
        out = np.zeros((len(x), m), np.uint8)
        for lo in range(0, len(x), 2048):
            dots = x[lo : lo + 2048].astype(np.float32) @ flat.T
            n = len(dots)
            cost, code = np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.int64)
            for b in range(m):
                step = (norms[b * k : b * k + k] - 2 * dots[:, b * k : b * k + k])[:, None, :] + cost[:, :, None]
                for prev in range(b):
                    step += 2 * gram[code[:, :, prev] + prev * k, b * k : b * k + k]
                step = step.reshape(n, -1)
                width = min(beam, step.shape[1])
                best = np.argpartition(step, width - 1, axis=1)[:, :width]
                cost = np.take_along_axis(step, best, axis=1)
                code = np.concatenate([np.take_along_axis(code, (best // k)[:, :, None], axis=1), (best % k)[:, :, None]], axis=2)
            out[lo : lo + n] = code[np.arange(n), cost.argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[b][codes[:, b]] for b in range(len(self.books)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries with all codewords: book x word x query."""
        return np.matmul(self.books, queries.T.astype(np.float32))


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    """The rows whose vectors are of the table's most common length, not zero and without null or non-finite components."""
    v = F.col(vec_col)
    fine = df.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    size = fine.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return fine.where(F.size(v) == (size[0]["d"] if size else 0))


def _encode(q: AdditiveQuantizer, number: pa.DataType):
    schema = pa.schema([("rb", pa.int32()), ("vec_id", pa.int64()), ("vec", pa.list_(number)), ("codes", pa.binary()), ("ratio", pa.float32())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.asarray(batch.column("vec").flatten(), np.float64).reshape(len(batch), -1)
            codes = q.encode(x)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.linalg.norm(x, axis=1) / np.linalg.norm(q.decode(codes), axis=1)
            ratio = np.where(np.isfinite(ratio), ratio, 1)
            raw, m = codes.tobytes(), codes.shape[1]
            yield arrow_batch(schema, batch.column("rb"), batch.column("vec_id"), batch.column("vec"), pa.array([raw[i : i + m] for i in range(0, len(raw), m)], pa.binary()), ratio.astype(np.float32))

    return apply


FOUND = "query_id long, vec_id long, score double"


def _search(q: AdditiveQuantizer, k: int, shortlist: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def apply(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        rows = rows.combine_chunks()
        ids, qids = np.asarray(rows["vec_id"]), np.asarray(queries["query_id"])
        vecs = np.asarray(rows["vec"].combine_chunks().flatten()).reshape(len(ids), -1)  # as wide as they came; products are in double precision
        asked = np.asarray(queries["q"].combine_chunks().flatten()).astype(np.float64).reshape(len(qids), -1)
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
        ratio = np.asarray(rows["ratio"])
        most = min(len(ids), shortlist)
        out: list[list[np.ndarray]] = [[], [], []]
        for lo in range(0, len(qids), 128):
            table, own = q.tables(asked[lo : lo + 128]), qids[lo : lo + 128]
            near = table[0][codes[:, 0]]
            for b in range(1, codes.shape[1]):
                near += table[b][codes[:, b]]
            near = np.ascontiguousarray((near * ratio[:, None]).T)
            best = np.argpartition(-near, most - 1, axis=1)[:, :most]
            exact = np.einsum("qrd,qd->qr", vecs[best].astype(np.float64), asked[lo : lo + 128])
            exact[ids[best] == own[:, None]] = -np.inf
            order = np.lexsort((ids[best], -exact), axis=1)[:, :k]
            score, hit = np.take_along_axis(exact, order, 1), ids[np.take_along_axis(best, order, 1)]
            real = np.isfinite(score)
            for c, v in zip(out, (np.broadcast_to(own[:, None], hit.shape), hit, score), strict=True):
                c.append(v[real])
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=schema)

    return apply


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, shortlist: int = SHORTLIST) -> DataFrame:
    """The ``k`` rows of ``vectors`` of largest inner product with each row of ``queries``: ``query_id, rank, vec_id, score``.

    The codebooks are fitted to at most ``sample`` vectors chosen by a hash;
    every vector is encoded and scored.  Rows go by blocks, so a task holds one
    block of rows and one of queries; a block of rows is read once for all
    ``QUERY_BLOCK`` queries.  In every block of ``ROW_BLOCK`` rows, ``shortlist``
    rows are ranked exactly for each query.  Of equal vectors only the ``k + 1``
    smallest ids can be among the nearest, so only these go on.  A query's own
    id is never a result.  Ties go to the smaller id; vectors or ids that are
    null and vectors that are zero, not finite or of another length take no
    part; a repeated id counts once for each different vector; other columns
    are ignored; no vectors or no queries give an empty result.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vec_col].dataType == ArrayType(FloatType(), vectors.schema[vec_col].dataType.containsNull)
    kind = "array<float>" if single else "array<double>"
    rows = usable(vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec")), "vec")
    first = Window.partitionBy("vec").orderBy("vec_id")
    rows = stored(rows.dropDuplicates(["vec_id", "vec"]).withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1).drop("rn"))
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, sample / total) * (1 << 30))).orderBy("vec_id").limit(2 * sample)
    x = np.array([r["vec"] for r in picked.collect()] or [rows.first()["vec"]], np.float64)
    dim = x.shape[1]
    q = AdditiveQuantizer.fit(x)
    n_rows = -(-total // ROW_BLOCK)
    placed = rows.withColumn("rb", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(n_rows)).cast("int"))
    coded = placed.select("rb", "vec_id", "vec").mapInArrow(_encode(q, pa.float32() if single else pa.float64()), f"rb int, vec_id long, vec {kind}, codes binary, ratio float")
    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast(kind).alias("q"))
    asked = usable(asked, "q").where(F.size("q") == dim)
    n_queries = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64(F.lit("block"), "query_id"), F.lit(n_queries)).cast("int"))
    left = coded.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    right = asked.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(_search(q, k, shortlist), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute_force(ids: np.ndarray, vecs: np.ndarray, queries: np.ndarray, k: int) -> dict[int, list[int]]:
    """Exact nearest ids by query position, for tests."""
    out = {}
    for i in queries:
        s = vecs @ vecs[i]
        s[ids == ids[i]] = -np.inf
        out[int(ids[i])] = [int(ids[j]) for j in np.lexsort((ids, -s))[:k]]
    return out
