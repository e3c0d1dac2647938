"""A stored term index: which documents hold a term, in which field and how often, by buckets of terms.

A query reads the buckets of its own terms and nothing else, neither texts nor
other terms.  An index is there whole or not at all, bound to a digest of its
rows and to a name for the version of what was indexed.  A term's documents are
moved and stored as lists, some thousands to a row.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .stages import filesystem

#: Documents of which a bucket has a file of its own, about.
_SPREAD = 1 << 18
#: Tasks that write the files of so many documents, at most.
_WRITERS = 64


class PostingsFault(Exception):
    """An index that is missing, incomplete or not the one that its receipt seals."""


class Postings:
    """The index at ``path``: rows ``term, field, id, n`` and a receipt."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        fs, where = filesystem(spark, f"{self.path}/RECEIPT")
        if not fs.exists(where):
            raise PostingsFault(f"no receipt at {path}")
        self.receipt = json.loads(spark.read.text(f"{self.path}/RECEIPT").first()["value"])

    @classmethod
    def build(cls, docs: DataFrame, path: str, id_col: str, fields: Mapping[str, Column], revision: str, buckets: int = 256) -> Postings:
        """Indexes arrays of tokens, one for each of ``fields``; a token counts as often as it stands in a field.

        A task counts the tokens of its documents and lists the documents of each
        token, and only these lists move, once and compressed.  Batches of
        documents share a bucket's files, as many as there are documents for, so
        a frequent term isn't one task's.  Null arrays and tokens are none;
        documents of one id are one document: where ids repeat, counts are added
        up by those who read.  A ``path`` that exists is refused.
        """
        spark = docs.sparkSession
        fs, target = filesystem(spark, path.rstrip("/"))
        if fs.exists(target):
            raise FileExistsError(path)

        docs_n, most = docs.groupBy(id_col).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).first()
        spread = max(1, -(-docs_n // _SPREAD))
        kind, tokens = docs.schema[id_col].dataType, [c.alias(f"_{i}") for i, c in enumerate(fields.values())]
        packed = docs.select(F.col(id_col).alias("id"), *tokens).mapInArrow(_lists(list(fields), to_arrow_type(kind), buckets, spread), "bucket int, part int, lists binary")
        dealt = packed.repartition(min(_WRITERS, buckets) * spread, "bucket", "part").mapInArrow(_unpacked, f"{_schema(kind.simpleString())}, bucket int").sortWithinPartitions("bucket", "term", "field")
        staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
        dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{staging}/rows")
        made = spark.read.schema(_schema(kind.simpleString())).parquet(f"{staging}/rows")
        rows, digest = made.agg(*_sums()).first()
        receipt = {"buckets": buckets, "fields": list(fields), "rows": rows, "digest": str(digest), "revision": revision, "id": kind.simpleString(), "repeated": (most or 0) > 1}
        spark.createDataFrame([(json.dumps(receipt),)], "value string").coalesce(1).write.text(f"{staging}/RECEIPT")
        if not fs.rename(filesystem(spark, staging)[1], target):
            raise OSError(f"could not rename {staging}")
        return cls(spark, path)

    def _stored(self) -> DataFrame:
        schema = f"{_schema(self.receipt['id'])}, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows") if self.receipt["rows"] else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        each = self._stored().select("term", "field", F.explode(F.arrays_zip("ids", "ns")).alias("x"), "bucket")
        out = each.select("term", "field", F.col("x.ids").alias("id"), F.col("x.ns").cast("long").alias("n"), "bucket")
        if not self.receipt["repeated"]:
            return out
        return out.groupBy("term", "field", "id", "bucket").agg(F.sum("n").alias("n")).select("term", "field", "id", "n", "bucket")

    def verify(self, revision: str | None = None) -> None:
        """Reads all that is stored once: it must be what the receipt says, made from ``revision``."""
        rows, digest = self._stored().agg(*_sums()).first()
        if (rows, str(digest)) != (self.receipt["rows"], self.receipt["digest"]):
            raise PostingsFault(f"the rows of {self.path} are not those of its receipt")
        if revision is not None and revision != self.receipt["revision"]:
            raise PostingsFault(f"{self.path} was made from {self.receipt['revision']}")

    def lookup(self, terms: Sequence[str]) -> DataFrame:
        """``term, field, id, n`` of some terms; only their buckets are read, and of these the row groups that can hold them."""
        if not terms:
            return self.rows().drop("bucket").limit(0)
        own = sorted({_bucket(t.encode(), self.receipt["buckets"]) for t in terms})
        return self.rows().where(F.col("bucket").isin(own) & F.col("term").isin(list(terms))).drop("bucket")

    def lexical(self, terms: Sequence[str], weights: Mapping[str, int]) -> DataFrame:
        """``id, score, matched``: for each field and distinct term that it holds, min(length, 4) times the field's weight; ``matched`` in order."""
        weight = F.create_map(*[F.lit(x) for item in weights.items() for x in item])
        points = F.least(F.length("term"), F.lit(4)) * F.element_at(weight, F.col("field"))
        hits = self.lookup(sorted(set(terms))).where(F.col("field").isin(list(weights)))
        return hits.groupBy("id").agg(F.sum(points).cast("long").alias("score"), F.array_sort(F.collect_set("term")).alias("matched"))


def _schema(id_type: str) -> str:
    return f"term string, field string, ids array<{id_type}>, ns array<int>"


def _bucket(term: bytes, buckets: int) -> int:
    return zlib.crc32(term) % buckets


def _lists(fields: Sequence[str], id_type: pa.DataType, buckets: int, spread: int):
    """For each token of a field the documents of a batch that hold it, and how often each does; the lists of a bucket are one compressed row."""
    schema = pa.schema([("term", pa.string()), ("field", pa.string()), ("ids", pa.list_(id_type)), ("ns", pa.list_(pa.int32()))])
    out = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("lists", pa.binary())])

    def lists(ids: pa.Array, field: str, tokens: pa.Array) -> tuple[pa.RecordBatch, np.ndarray]:
        """In the order of their buckets, and the buckets."""
        doc = np.repeat(np.arange(len(ids)), np.asarray(tokens.value_lengths().fill_null(0)))
        flat = tokens.flatten()
        doc, coded = doc[np.asarray(flat.is_valid())], flat.drop_null().dictionary_encode()
        terms = coded.dictionary.cast(pa.string())
        bucket = np.array([_bucket(t, buckets) for t in terms.cast(pa.binary()).to_pylist()], np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        pairs, n = np.unique(place[np.asarray(coded.indices)] * len(ids) + doc, return_counts=True)
        term, doc = np.divmod(pairs, max(1, len(ids)))  # every place has some
        offs = pa.array(np.searchsorted(term, np.arange(len(order) + 1)), pa.int32())
        made = [pa.ListArray.from_arrays(offs, x) for x in (ids.take(pa.array(doc)), pa.array(n, pa.int32()))]
        return pa.RecordBatch.from_arrays([terms.take(pa.array(order)), pa.array([field] * len(order), pa.string()), *made], schema=schema), bucket[order]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, batch in enumerate(batches, TaskContext.get().partitionId()):
            for i, field in enumerate(fields):
                made, bucket = lists(batch.column("id"), field, batch.column(f"_{i}"))
                own, at = np.unique(bucket, return_index=True)
                rows = [_packed(made.slice(a, z - a)) for a, z in zip(at, np.append(at, len(bucket))[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([part % spread] * len(own), pa.int32()), pa.array(rows, pa.binary())], schema=out)

    return apply


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, lists in zip(batch.column("bucket"), batch.column("lists"), strict=True):
            for rows in pa.ipc.open_stream(lists.as_py()):
                yield rows.append_column("bucket", pa.array([bucket.as_py()] * len(rows), pa.int32()))


def _sums() -> tuple[Column, Column]:
    """Of stored lists in any order: how many documents they hold, and the sum of their hashes as a decimal, which can't overflow."""
    digest = F.sum(F.xxhash64("term", "field", "ids", "ns").cast("decimal(38,0)"))
    return F.coalesce(F.sum(F.size("ids").cast("long")), F.lit(0)), F.coalesce(digest, F.lit(0).cast("decimal(38,0)"))
