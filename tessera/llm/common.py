"""What the operators of this subpackage share: stored intermediates, row keys and Arrow helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.stages import filesystem
from tessera.operators.stages import shared_folder as shared_dir


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back, so that lost executors cost no recomputation of what led to it."""
    path = path or shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are stored for a while: what they led to is stored too before they go, so nothing ever has to be made again from them."""

    def __init__(self) -> None:
        self.kept: list[tuple[DataFrame, str]] = []

    def stored(self, df: DataFrame) -> DataFrame:
        path = shared_dir(df.sparkSession)
        out = stored(df, path)
        self.kept.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables."""
        for df, path in [x for x in self.kept if any(x[0] is t for t in tables)]:
            fs, where = filesystem(df.sparkSession, path)
            fs.delete(where, True)
        self.kept = [x for x in self.kept if not any(x[0] is t for t in tables)]

    def drop_rest(self) -> None:
        self.drop(*[df for df, _ in self.kept])


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two columns that tell rows apart for joins back to their texts: rows that share both are copies of one another."""
    return F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th")


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Null-safe equality of :func:`row_key` columns."""
    return a["_id"].eqNullSafe(b["_id"]) & (a["_th"] == b["_th"])


def arrow_batch(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    arrays = [a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def one_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def whole_rows(docs: DataFrame, text_col: str) -> tuple[Column, int]:
    """All columns as one struct, and the place of the text in it: a text that goes to Python with its row needs no column of its own beside it."""
    at = docs.columns.index(text_col) if text_col in docs.columns else [c.lower() for c in docs.columns].index(text_col.lower())
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]), at


def list_parts(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets (from 0) and flattened values of a list column; null lists are empty."""
    column = one_array(column)
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    offs = np.zeros(len(column) + 1, np.int64)
    np.cumsum(lengths, out=offs[1:])
    return offs, column.flatten()


def ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [start, start + count), and the index of the range of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts[owner] + inner, owner


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)
