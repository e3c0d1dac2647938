"""Blocks of signatures, and how many members of other ones each member of a block is linked with."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The item lists of a signature.
PARTS = ("units", "bigrams")
_COLUMNS = 512  # of a product of matrices
_PAIRS = 1 << 22  # counted one by one at a time


def fields(kind: str) -> str:
    """A packed block: its members' ids, the lengths of their lists, and by item, in order, the members that have it."""
    return f"ids array<{kind}>, " + ", ".join(f"{c}_n array<int>, {c}_vocab array<bigint>, {c}_ends array<int>, {c}_rows binary" for c in PARTS)


def pack(keys: tuple[str, ...], id_type: pa.DataType):
    """Packs the members of a group into one row; at most 65,536."""
    ints = pa.list_(pa.int32())
    more = [f for c in PARTS for f in ((f"{c}_n", ints), (f"{c}_vocab", pa.list_(pa.int64())), (f"{c}_ends", ints), (f"{c}_rows", pa.binary()))]

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows > 1 << 16:
            raise ValueError("a block of too many members")
        made = []
        for c in PARTS:
            lists = pa.concat_arrays(table.column(c).chunks)
            n = np.asarray(lists.value_lengths()).astype(np.int32)
            items, row = np.asarray(lists.flatten()), np.repeat(np.arange(len(n)), n)
            order = np.argsort(items, kind="stable")
            items, row = items[order], row[order]
            first = np.flatnonzero(np.append(True, items[1:] != items[:-1])) if len(items) else np.zeros(0, int)
            made += [[n], [items[first]], [np.append(first[1:], len(items))[: len(first)]], [row.astype(np.uint16).tobytes()]]
        head = [(k, table.schema.field(k).type) for k in keys]
        values = [[table.column(k)[0].as_py()] for k in keys] + [[table.column("class_id").to_pylist()], *made]
        types = [*head, ("ids", pa.list_(id_type)), *more]
        return pa.Table.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, types, strict=True)], schema=pa.schema(types))

    return run


def _shared(a: pa.StructScalar, b: pa.StructScalar, c: str) -> np.ndarray:
    """How many items of list ``c`` each member of one block shares with each of another: exact, as these counts are small.

    What many members have is counted by products of 0-1 matrices, the rest pair by pair.
    """
    sides = []
    for x in (a, b):
        ends = np.asarray(x[f"{c}_ends"].values).astype(np.int64)
        sides.append((np.asarray(x[f"{c}_vocab"].values), np.append(0, ends[:-1])[: len(ends)], ends, np.frombuffer(x[f"{c}_rows"].as_py(), np.uint16).astype(np.int64), len(x["ids"])))
    (va, fa, ea, ra, na), (vb, fb, eb, rb, nb) = sides
    out = np.zeros((na, nb), np.float32)
    _, i, j = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    da, db = ea[i] - fa[i], eb[j] - fb[j]
    many = da * db * 256 > na * nb
    for lo in range(0, np.count_nonzero(many), _COLUMNS):
        made = []
        for at, first, size, rows, n in ((i, fa, da, ra, na), (j, fb, db, rb, nb)):
            start, d = first[at][many][lo : lo + _COLUMNS], size[many][lo : lo + _COLUMNS]
            m = np.zeros((n, len(d)), np.float32)
            m[rows[_spread(start, d)], np.repeat(np.arange(len(d)), d)] = 1
            made.append(m)
        out += made[0] @ made[1].T
    i, j, da, db = i[~many], j[~many], da[~many], db[~many]
    upto, flat, lo = np.cumsum(da * db), out.ravel(), 0
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _PAIRS, side="right")))
        k = np.repeat(np.arange(lo, hi), (da * db)[lo:hi])
        within = np.arange(len(k)) - np.repeat(upto[lo:hi] - (da * db)[lo:hi] - (upto[lo - 1] if lo else 0), (da * db)[lo:hi])
        np.add.at(flat, ra[fa[i[k]] + within // db[k]] * nb + rb[fb[j[k]] + within % db[k]], 1)
        lo = hi
    return out


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of ``start .. start + size - 1``, one range after another."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def linked(units: np.ndarray, bigrams: np.ndarray, a: tuple, b: tuple) -> np.ndarray:
    """Which pairs overlap enough, from counts of shared items and sizes: as ``tessera.functions.text.overlapping`` says."""
    (n, p), (m, q) = a, b
    n, p, m, q = n[:, None].astype(np.float64), p[:, None], m[None].astype(np.float64), q[None]
    least, few = np.minimum(n, m), np.minimum(p, q)
    good = (least >= 3) & (least >= 0.8 * np.maximum(n, m)) & (units / least >= 0.9) & (units / (n + m - units) >= 0.8)
    return good & ((few < 2) | (bigrams / np.maximum(few, 1) >= 0.8))


def count_links(id_type: pa.DataType, rows: int = 256):
    """For pairs of blocks ``a, b``: ids with a link, and how many; a block that meets itself (``same``) is told once."""
    schema = pa.schema([("class_id", id_type), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, a, b in zip(batch.column("same").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                units, bigrams = (_shared(a, b, c).astype(np.float32, copy=False) for c in PARTS)
                size = [tuple(np.asarray(x[f"{c}_n"].values) for c in PARTS) for x in (a, b)]
                of_a, of_b = np.zeros(len(units), np.int64), np.zeros(units.shape[1], np.int64)
                for lo in range(0, len(units), rows):
                    part = slice(lo, lo + rows)
                    good = linked(units[part].astype(np.float64), bigrams[part].astype(np.float64), tuple(s[part] for s in size[0]), size[1])
                    if same:
                        k = np.arange(len(good))
                        good[k, lo + k] = False
                    of_a[part] += good.sum(axis=1)
                    of_b += good.sum(axis=0)
                for x, links in ((a, of_a),) if same else ((a, of_a), (b, of_b)):
                    has = np.flatnonzero(links)
                    if len(has):
                        yield pa.RecordBatch.from_arrays([x["ids"].values.take(pa.array(has)).cast(id_type), pa.array(links[has])], schema=schema)

    return run
