"""Packing of tokenised documents into fixed windows by non-negative least squares.

Whole windows of a document are sequences of their own; what is left of each
document, its residual, is shorter than a window.  The histogram of residual
lengths has at most ``window - 1`` bins, whatever the input, so the driver can
plan on it: shallow combinations of lengths that fill a window exactly are
enumerated, non-negative least squares finds how often each is to be used, the
counts are rounded, and residuals that no combination takes are packed greedily
one after another, cut where a window ends.  The last, partial window is cut
into powers of two.  So no sequence needs padding.

Documents find their places by arithmetic on their rank among the residuals of
their length; ranks come from windows over small hash buckets.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_type, one_array, stored

WINDOW = 2048
END_ID = 1
BUCKET_ROWS = 50_000
_LONG_RUN = re.compile(r"\S{3000}|\s{3000}")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Byte-level BPE ids.

    ``ranks_path`` is the same vocabulary as ``json_path`` in the form that the
    faster library reads; texts for which the two could differ (special tokens
    written out) or which it is slow on (very long runs without a break) go
    through the first.
    """

    def __init__(self, json_path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.fast is None or _LONG_RUN.search(text) or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _tokenize(paths: tuple[str, str | None], end_id: int, id_type: pa.DataType):
    schema = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("_id", id_type), ("n", pa.int64()), ("ids", pa.binary())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, row = Encoder(*paths), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = one_array(batch.column("_id"))
            for lo in range(0, len(batch), 256):
                texts = batch.column("_text").slice(lo, 256).to_pylist()
                made = [np.array([*encode(t), end_id], dtype="<u4") for t in texts]
                packed = [m.astype("<u2").tobytes() if int(m.max()) < 1 << 16 else b"\0" + m.tobytes() for m in made]
                yield arrow_batch(schema, np.full(len(made), part, np.int32), np.arange(row, row + len(made)), ids.slice(lo, 256), [len(m) for m in made], pa.array(packed, pa.binary()))
                row += len(made)

    return apply


def _unpack(raw: bytes) -> np.ndarray:
    """Two bytes an id, or a zero byte (which makes the length odd) and four bytes an id."""
    return np.frombuffer(raw, "<u2").astype("<u4") if len(raw) % 2 == 0 else np.frombuffer(raw[1:], "<u4")


def combinations(hist: np.ndarray, window: int, frequent: int = 48) -> list[dict[int, int]]:
    """Shallow multisets of residual lengths, as {length: times}, that sum to ``window``."""
    there = np.flatnonzero(hist[:window])
    have, top = set(there.tolist()), [int(x) for x in there[np.lexsort((there, -hist[there]))][:frequent]]
    found: dict[tuple, dict[int, int]] = {}

    def add(*lengths: int) -> None:
        if all(x in have for x in lengths):
            key = tuple(sorted(lengths))
            found.setdefault(key, {x: key.count(x) for x in key})

    for a in there[there <= window // 2]:
        add(int(a), window - int(a))
    for i, a in enumerate(top):
        for b in top[i:]:
            if a + b < window:
                add(a, b, window - a - b)
        for times in range(2, window // a + 1):
            rest = window - a * times
            if rest == 0:
                found.setdefault((a,) * times, {a: times})
            elif rest != a and rest in have:
                found.setdefault((*[a] * times, rest), {a: times, rest: 1})
    return list(found.values())


def solve_counts(hist: np.ndarray, combos: list[dict[int, int]], sweeps: int = 40) -> np.ndarray:
    """Non-negative least squares of combination counts against the histogram, by coordinate descent, rounded to whole counts that the histogram covers."""
    x, left = np.zeros(len(combos)), hist.astype(float).copy()
    cols = [(np.array(list(c)), np.array(list(c.values()), float)) for c in combos]
    norms = [float(m @ m) for _, m in cols]
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, m) in enumerate(cols):
            new = max(0.0, x[j] + float(m @ left[at]) / norms[j])
            if (d := new - x[j]) != 0:
                left[at] -= d * m
                x[j], moved = new, max(moved, abs(d))
        if moved < 0.01:
            break
    out, free = np.zeros(len(combos), np.int64), hist.astype(np.int64).copy()
    for up in (0.5, np.inf):  # rounded first, then as often as what is left allows
        for j in np.argsort(-x, kind="stable"):
            at, m = cols[j]
            most = int((free[at] // m.astype(np.int64)).min())
            k = min(most, int(x[j] + up) if np.isfinite(up) else most)
            out[j] += k
            free[at] -= k * m.astype(np.int64)
    return out


class Plan:
    """Where the residual of each length and rank goes."""

    def __init__(self, hist: np.ndarray, wholes: int, window: int):
        self.window = window
        combos = combinations(hist, window)
        counts = solve_counts(hist, combos) if combos else np.zeros(0, np.int64)
        slots: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: first rank, count, first sequence, offset
        used, seq = np.zeros(window, np.int64), wholes
        self.combined = int(counts.sum())
        for combo, k in zip(combos, counts, strict=True):
            if k:
                offset = 0
                for length, times in sorted(combo.items(), reverse=True):
                    for _ in range(times):
                        slots.setdefault(length, []).append((int(used[length]), int(k), seq, offset))
                        used[length] += k
                        offset += length
                seq += int(k)
        self.slots = {n: np.array(v, np.int64) for n, v in slots.items()}
        self.used = used
        rest = (hist[:window] - used) * np.arange(window)
        self.base = np.concatenate([[0], np.cumsum(rest)])[:window]
        total = int(rest.sum())
        whole, tail = divmod(total, window)
        bits = [1 << b for b in range(window.bit_length(), -1, -1) if tail >> b & 1]
        self.ends = whole * window + np.cumsum(bits).astype(np.int64)
        self.whole, self.first, self.total = whole, seq, total

    def places(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of the pieces of a residual, in order."""
        own = self.slots.get(length)
        if rank < self.used[length]:
            first, _, seq, offset = own[np.searchsorted(own[:, 0], rank, side="right") - 1]
            return [(int(seq + rank - first), int(offset), length)]
        pos, out = int(self.base[length] + (rank - self.used[length]) * length), []
        while length:
            if pos < self.whole * self.window:
                seq, offset = divmod(pos, self.window)
                room = self.window - offset
            else:
                i = int(np.searchsorted(self.ends, pos, side="right"))
                start = int(self.ends[i - 1]) if i else self.whole * self.window
                seq, offset, room = self.whole + i, pos - start, int(self.ends[i]) - pos
            take = min(room, length)
            out.append((self.first + seq, offset, take))
            pos, length = pos + take, length - take
        return out


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(plan: Plan, id_type: pa.DataType, with_ids: bool):
    fields = [("_id", id_type), *((c.split()[0], pa.int64()) for c in PIECES.split(", "))]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if with_ids else fields)
    window = plan.window

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, owner = batch.column("ids"), [], []
            n, rank, whole = (np.asarray(batch.column(c)) for c in ("n", "rank", "whole_id"))
            parts = []
            for i in range(len(batch)):
                tokens, size = _unpack(ids[i].as_py()), int(n[i])
                full, rest = divmod(size, window)
                places = [(int(whole[i]) + k, 0, window) for k in range(full)] + (plan.places(rest, int(rank[i])) if rest else [])
                at = 0
                for seq, offset, length in places:
                    piece = tokens[at : at + length]
                    rows.append((at, length, zlib.crc32(piece.tobytes()), size, seq, offset))
                    owner.append(i)
                    if with_ids:
                        parts.append(piece.astype(np.int32))
                    at += length
            if rows:
                more = [pa.array(parts, pa.list_(pa.int32()))] if with_ids else []
                yield arrow_batch(schema, one_array(batch.column("_id")).take(pa.array(owner)), *[list(c) for c in zip(*rows, strict=True)], *more)

    return apply


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, paths: tuple[str, str | None] | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents and their places in sequences of ``window`` ids.

    Returns ``id_col, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``, and the ids themselves if ``with_ids``.  A document is its ids and
    ``end_id``; a null or empty text is that id alone.  Repeated rows are packed
    as often as they stand, null ids are kept, other columns are ignored, and an
    empty table gives no piece.  Sequences are full or a power of two long.
    """
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind, id_type = docs.schema[id_col].dataType.simpleString(), arrow_type(docs, id_col)
    tokens = stored(keyed.mapInArrow(_tokenize(paths or default_paths(), end_id, id_type), f"part int, row bigint, _id {kind}, n bigint, ids binary"))
    total = tokens.count()
    slim = tokens.select("part", "row", F.pmod(F.xxhash64("part", "row"), F.lit(max(1, -(-total // BUCKET_ROWS)))).alias("bucket"), (F.col("n") % window).alias("rest"), F.floor(F.col("n") / window).alias("full"))
    cells = stored(slim.groupBy("rest", "bucket").agg(F.count(F.lit(1)).alias("c"), F.sum("full").alias("f")))
    sums = {r["rest"]: (r["c"], r["f"]) for r in cells.groupBy("rest").agg(F.sum("c").alias("c"), F.sum("f").alias("f")).collect()}
    hist, base, wholes = np.zeros(window, np.int64), [0] * window, 0
    for rest in sorted(sums):
        hist[rest], base[rest] = sums[rest][0], wholes
        wholes += sums[rest][1]
    hist[0] = 0
    plan = Plan(hist, wholes, window)
    before = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("rest", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f0"))
    inside = Window.partitionBy("rest", "bucket").orderBy("part", "row")
    ranked = slim.select("part", "row", "rest", "bucket", (F.row_number().over(inside) - 1).alias("k"), (F.sum("full").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full")).alias("g"))
    bases = F.element_at(F.array(*[F.lit(b).cast("bigint") for b in base]), (F.col("rest") + 1).cast("int"))
    placed = ranked.join(starts, ["rest", "bucket"]).select("part", "row", (F.col("k") + F.col("c0")).alias("rank"), (F.col("g") + F.col("f0") + bases).alias("whole_id"))
    joined = tokens.join(placed, ["part", "row"]).select("_id", "n", "ids", "rank", "whole_id")
    out = joined.mapInArrow(_cut(plan, id_type, with_ids), f"_id {kind}, {PIECES}" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("_id", id_col)
