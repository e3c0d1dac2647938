"""Exact removal of repeated byte strings, by interleave refinement of anchored suffix intervals.

Every shard (an Arrow block of whole documents) keeps its suffixes in intervals
of equal beginnings and the shards are merged by adding the sizes of the
intervals that they share.  As in the merge of Burrows-Wheeler transforms by
iterative interleaving, one pass lengthens the common beginning of all
surviving intervals, an interval of size one is settled and leaves, and no
suffix is ever sorted against another shard's.  Two things differ from the
textbook merge, which would pass over every byte of the corpus once per byte of
common prefix, some 400 times:

* Only suffixes that can matter take part.  Of the ``ANCHOR``-byte strings of a
  window, that of least hash is its anchor; equal windows have their anchors
  at the same place, so it is enough to refine the intervals around anchors.
* The common prefix grows in four steps instead of byte by byte: the anchor, the
  bytes of all windows of one anchor, blocks of ``BLOCK`` windows, one window.

Interval names are 64-bit hashes of their strings.  All merges are sums by
interval name with partial sums on the map side, so a passage that a third of
the corpus shares costs one row a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_batch, arrow_type, list_parts, one_array, ranges, row_key, same_row, stored
from .textblock import TextBlock, blocks, combine

ANCHOR = 48
BLOCK = 32
_POS_BITS = 31  # an Arrow string has fewer bytes than this can count


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every ``w`` neighbours, in pieces that stay in the cache."""
    m, piece = max(0, len(x) - w + 1), 1 << 14
    out = np.empty(m, x.dtype)
    for lo in range(0, m, piece):
        y, have, k = x[lo : lo + piece + w - 1], 1, min(piece, m - lo)
        while 2 * have <= w:
            y, have = np.minimum(y[:-have], y[have:]), 2 * have
        np.minimum(y[:k], y[w - have : w - have + k], out=out[lo : lo + k])
    return out


def anchored_runs(block: TextBlock, length: int, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """The windows of ``length`` bytes of a block, in runs that share an anchor.

    Returns, by run: document, start of the first window, number of windows,
    anchor position (all positions within the block), anchor hash, and the hash
    of all bytes that the run's windows cover.
    """
    n = len(block.data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    h = block.window_hashes(anchor)
    low = np.uint64((1 << _POS_BITS) - 1)
    key = (h & ~low) | np.arange(len(h)).astype(np.uint64)
    pos = (_slide_min(key, length - anchor + 1) & low).astype(np.int64)
    start = np.arange(len(pos))
    doc = np.repeat(np.arange(block.n), np.diff(block.offs))[: len(pos)]
    inside = start + length <= block.offs[doc + 1]
    new = np.ones(len(pos), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (doc[1:] != doc[:-1])
    edge = np.flatnonzero(np.append(new | ~inside, True))
    first = np.flatnonzero(new & inside)
    count = edge[np.searchsorted(edge, first, side="right")] - first
    p = pos[first]
    return doc[first], first, count, p, h[p], block.hashes(first, first + count - 1 + length)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _run_rows(id_type: pa.DataType, length: int, anchor: int):
    schema = pa.schema([("_id", id_type), ("_th", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("at", pa.int32()), ("part", pa.int64()), ("whole", pa.int64()), ("weight", pa.int32())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column("_id"), batch.column("_th")
            for b in blocks(batch.column("_text")):
                doc, start, n, p, part, whole = anchored_runs(b, length, anchor)
                if len(doc):
                    row = pa.array(doc + b.first)
                    yield arrow_batch(schema, ids.take(row), ths.take(row), start - b.offs[doc], n, p - b.offs[doc], _signed(part), _signed(whole), np.ones(len(doc), np.int32))

    return apply


def _finer_rows(id_type: pa.DataType, length: int, step: int):
    """Cuts runs of windows into blocks of ``step``, aligned to the distance from the anchor.

    ``part`` names the bytes common to all windows of a full block and
    ``whole`` those of the windows that are there; at a step of one they are
    equal, and only what tells single windows apart is given.
    """
    fields = [("_id", id_type), ("_th", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("at", pa.int32()), ("part", pa.int64()), ("whole", pa.int64()), ("weight", pa.int32())]
    schema = pa.schema([f for f in fields if step > 1 or f[0] not in ("n", "at", "whole")])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column("_id"), batch.column("_th")
            list_offs, runs = list_parts(batch.column("runs"))
            runs_s, runs_n, runs_p, weight = (np.asarray(runs.field(k)).astype(np.int64) for k in ("start", "n", "at", "weight"))
            for b in blocks(batch.column("_text")):
                lo, hi = list_offs[b.first], list_offs[b.first + b.n]
                if lo == hi:
                    continue
                doc = np.repeat(np.arange(b.n), np.diff(list_offs[b.first : b.first + b.n + 1]))
                base = b.offs[doc]
                s, n, p = runs_s[lo:hi] + base, runs_n[lo:hi], runs_p[lo:hi] + base
                near, far = p - (s + n - 1), p - s  # least and greatest distance of a window's start from the anchor
                which, run = ranges(near // step, far // step - near // step + 1)
                x, y = np.maximum(near[run], which * step), np.minimum(far[run], which * step + step - 1)
                start, count, q = p[run] - y, y - x + 1, p[run]
                core = b.hashes(q - which * step, q - which * step - (step - 1) + length)
                part = combine(core, which.astype(np.uint64))
                row = pa.array(doc[run] + b.first)
                own = b.offs[doc[run]]
                if step == 1:
                    yield arrow_batch(schema, ids.take(row), ths.take(row), start - own, _signed(part), weight[lo:hi][run])
                    continue
                whole = combine(combine(b.hashes(start, start + count - 1 + length), which.astype(np.uint64)), (x * 65536 + y).astype(np.uint64))
                yield arrow_batch(schema, ids.take(row), ths.take(row), start - own, count, q - own, _signed(part), _signed(whole), weight[lo:hi][run])

    return apply


def _merged(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Merges the shards' intervals and tells which are settled.

    Returns the rows whose ``whole`` interval holds several suffixes: all their
    windows are repeated.  And, for the next refinement, one row for each
    ``whole`` of every ``part`` that has more than one, weighing two if it
    stands for several: rows that are settled still count for others.
    """
    # Any row of an interval may stand for it.  These five are one row's, and unlike the least struct they need no sorted input.
    kept = [F.first(c).alias(c) for c in ("_id", "_th", "start", "n", "at")]
    sizes = scratch.stored(rows.groupBy("part", "whole").agg(F.sum("weight").alias("size"), *kept))
    several = sizes.where("size > 1").select("part", "whole")
    settled = scratch.stored(rows.join(several, ["part", "whole"], "left_semi").select("_id", "_th", "start", "n"))
    scratch.drop(rows)
    parts = sizes.groupBy("part").agg(F.count(F.lit(1)).alias("wholes")).where("wholes > 1").select("part")
    ahead = scratch.stored(sizes.join(parts, "part", "left_semi").select("_id", "_th", "start", "n", "at", F.least("size", F.lit(2)).cast("int").alias("weight")))
    scratch.drop(sizes)
    return settled, ahead


def _settled(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The single windows of which several stand in the texts: the last merge, which leaves nothing to refine."""
    several = scratch.stored(rows.groupBy("part").agg(F.sum("weight").alias("size")).where("size > 1").select("part"))
    settled = scratch.stored(rows.join(several, "part", "left_semi").select("_id", "_th", "start", F.lit(1).alias("n")))
    scratch.drop(rows, several)
    return settled


def _schema(df: DataFrame, id_col: str) -> str:
    kind = df.schema[id_col].dataType.simpleString()
    return f"_id {kind}, _th bigint, start int, n int, at int, part bigint, whole bigint, weight int"


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, scratch: Scratch | None = None) -> DataFrame:
    """Runs of window starts whose ``length``-byte strings stand in several places.

    Returns ``_id, _th`` (the row key), ``start`` and ``n``: the windows that
    start at ``start .. start + n - 1`` of that text all occur elsewhere too.
    Rows with one id and one text are copies and share their runs.  With
    ``scratch``, they lie in its tables until it drops them.
    """
    if length <= ANCHOR + 16:
        raise ValueError(f"length must exceed {ANCHOR + 16}")
    keyed = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("_text"))
    id_type = arrow_type(docs, id_col)
    schema = _schema(docs, id_col)
    own = scratch is None
    scratch = Scratch() if scratch is None else scratch
    runs = scratch.stored(keyed.where(F.octet_length("_text") >= length).mapInArrow(_run_rows(id_type, length, ANCHOR), schema))
    # Most anchors stand in one place only; their runs are settled as unique before anything else is moved.
    # Stored by itself, so that the join deals out the runs of a frequent anchor anew instead of giving them to the task that counted them.
    again = scratch.stored(runs.groupBy("part").agg(F.sum("weight").alias("places")).where("places > 1").select("part"))
    rows = scratch.stored(runs.join(again, "part", "left_semi"))
    scratch.drop(runs, again)
    first, ahead = _merged(rows, scratch)

    def with_runs(texts: DataFrame, level: DataFrame) -> DataFrame:
        own = level.groupBy("_id", "_th").agg(F.collect_list(F.struct("start", "n", "at", "weight")).alias("runs"))
        return texts.join(own, same_row(texts, own)).select(texts["_id"], texts["_th"], "_text", "runs")

    # Copies of a row come back as often as they stand in the table; their runs are settled, so weights above two change nothing.
    texts = scratch.stored(with_runs(keyed, ahead))
    scratch.drop(ahead)
    second, ahead = _merged(scratch.stored(texts.mapInArrow(_finer_rows(id_type, length, BLOCK), schema)), scratch)
    single = f"_id {docs.schema[id_col].dataType.simpleString()}, _th bigint, start int, part bigint, weight int"
    rows = scratch.stored(with_runs(texts.drop("runs"), ahead).mapInArrow(_finer_rows(id_type, length, 1), single))
    scratch.drop(texts, ahead)
    out = first.unionByName(second).unionByName(_settled(rows, scratch))
    if own:
        out = stored(out)
        scratch.drop_rest()
    return out


def _packed(start: Column, n: Column) -> Column:
    """A run of windows as one number: sets of numbers are made and moved in less than half the time of sets of structs."""
    return F.shiftleft(start.cast("long"), 32) + n


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of lists of :func:`_packed` runs, and all starts and numbers of windows."""
    offs, runs = list_parts(column)
    runs = np.asarray(runs).astype(np.int64)
    return offs, runs >> 32, runs & 0xFFFFFFFF


def covered_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, scratch: Scratch | None = None) -> DataFrame:
    """By row key, the windows of :func:`repeated_windows` as one list of :func:`_packed` runs, and how many they are at most (``reach``)."""
    windows = repeated_windows(docs, id_col, text_col, length, scratch)
    return windows.groupBy("_id", "_th").agg(F.collect_set(_packed(F.col("start"), F.col("n"))).alias("spans"), F.sum("n").alias("reach"))


def _keep_mask(b: TextBlock, list_offs: np.ndarray, s: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    lo, hi = list_offs[b.first], list_offs[b.first + b.n]
    doc = np.repeat(np.arange(b.n), np.diff(list_offs[b.first : b.first + b.n + 1]))
    edge = np.zeros(len(b.data) + 1, np.int32)
    np.add.at(edge, s[lo:hi] + b.offs[doc], 1)
    np.add.at(edge, s[lo:hi] + n[lo:hi] - 1 + length + b.offs[doc], -1)
    return np.cumsum(edge[:-1]) == 0


def _cut(length: int, id_type: pa.DataType, passages: tuple[int, int, int] | None):
    fields = [("_id", id_type), ("_th", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema([*fields, ("text", pa.string())] if passages else fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            list_offs, s, n = _unpacked(batch.column("spans"))
            found = _unpacked(batch.column("passages")) if passages else None
            for b in blocks(batch.column("_text")):
                keep = _keep_mask(b, list_offs, s, n, length)
                starts, _ = b.runs(~keep)
                n_spans = np.bincount(b.owner(starts), minlength=b.n)
                total = np.zeros(len(keep) + 1, np.int64)
                np.cumsum(keep, out=total[1:])
                size = np.diff(b.offs)
                removed = size - (total[b.offs[1:]] - total[b.offs[:-1]])
                kept = [b.text(i) if not removed[i] else b.data[b.offs[i] : b.offs[i + 1]][keep[b.offs[i] : b.offs[i + 1]]].tobytes() for i in range(b.n)]
                sha = [hashlib.sha256(k).hexdigest() for k in kept]
                more = []
                if found:
                    left = [b.text(i) for i in range(b.n)]
                    doc, a, z = _passages(*_of_block(b, *found), passages[0])
                    for i, places in _by_text(doc, a, z):
                        left[i] = _without(b.data[b.offs[i] : b.offs[i + 1]], places, *passages[1:])
                    more = [pa.array(left, pa.string())]
                yield arrow_batch(schema, one_array(batch.column("_id")).slice(b.first, b.n), one_array(batch.column("_th")).slice(b.first, b.n), size, removed, n_spans, sha, *more)

    return apply


_LETTER = np.array([x >= 0x80 or chr(x).isalnum() for x in range(256)])


def _words_within(raw: np.ndarray, a: int, z: int) -> int:
    """The words of ``raw[a:z]``, without those that an edge cuts between two letters."""
    cut = int(0 < a < len(raw) and _LETTER[raw[a - 1]] and _LETTER[raw[a]]) + int(z < len(raw) and _LETTER[raw[z - 1]] and _LETTER[raw[z]])
    return len(raw[a:z].tobytes().split()) - cut


def _passages(text: np.ndarray, start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of the byte ranges whose ``length``-byte windows are all repeated: runs of window starts without a gap, in order."""
    if not len(text):
        return text, start, n
    order = np.lexsort((start, text))
    # Texts are laid out one behind the other, with room between them, so that one pass of greatest ends serves them all.
    text, room = text[order], int((start + n).max()) + 1
    begin, end = start[order] + text * room, np.maximum.accumulate((start + n)[order] + text * room)
    first = np.append(True, begin[1:] > end[:-1])
    text, last = text[first], np.append(first[1:], True)
    return text, begin[first] - text * room, end[last] - text * room - 1 + length


def _of_block(b: TextBlock, offs: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text within the block, start and number of the runs that a block's texts have."""
    lo, hi = offs[b.first], offs[b.first + b.n]
    return np.repeat(np.arange(b.n), np.diff(offs[b.first : b.first + b.n + 1])), start[lo:hi], n[lo:hi]


def _by_text(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Each text that has ranges, with its ranges; ``text`` ascends."""
    edges = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield int(text[lo]), list(zip(start[lo:hi].tolist(), end[lo:hi].tolist(), strict=True))


def _without(raw: np.ndarray, places: list[tuple[int, int]], over_words: int, or_bytes: int) -> str:
    """A text without those of its repeated passages that have enough words or bytes."""
    keep = np.ones(len(raw), bool)
    for a, z in places:
        if z - a >= or_bytes or _words_within(raw, a, z) > over_words:
            keep[a:z] = False
    return raw[keep].tobytes().decode("utf-8", "ignore")


def _stretches(short: int, length: int, id_type: pa.DataType):
    """The parts of texts that are long enough for ``length`` and have all their ``short``-byte strings repeated, with their places."""
    schema = pa.schema([("_id", id_type), ("_th", pa.int64()), ("_from", pa.int64()), ("_text", pa.binary())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths, found = one_array(batch.column("_id")), one_array(batch.column("_th")), _unpacked(batch.column("passages"))
            for b in blocks(batch.column("_text")):
                doc, a, z = _passages(*_of_block(b, *found), short)
                enough = z - a >= length
                doc, a, z = doc[enough], a[enough], z[enough]
                if len(doc):
                    row, base = pa.array(doc + b.first), b.offs[doc]
                    yield arrow_batch(schema, ids.take(row), ths.take(row), a, [b.data[x:y].tobytes() for x, y in zip(base + a, base + z, strict=True)])

    return apply


def _longer_spans(keyed: DataFrame, found: DataFrame, short: int, length: int, scratch: Scratch) -> DataFrame:
    """As :func:`covered_spans` for ``length``, given all repeated strings of ``short`` bytes.

    A string that is repeated has only repeated strings inside, next to one
    another, so all places of a longer one lie in stretches whose shorter
    strings are all repeated; the search goes over these alone.
    """
    likely = found.where(F.col("reach") > length - short).select("_id", "_th", "passages")
    kind = found.schema["_id"].dataType.simpleString()
    near = keyed.join(likely, same_row(keyed, likely)).select(keyed["_id"], keyed["_th"], "_text", "passages")
    made = near.mapInArrow(_stretches(short, length, arrow_type(found, "_id")), f"_id {kind}, _th bigint, _from bigint, _text binary")
    parts = scratch.stored(made.withColumn("_part", F.monotonically_increasing_id()))
    windows = repeated_windows(parts.select("_part", "_text"), "_part", "_text", length, scratch).select(F.col("_id").alias("_part"), "start", "n")
    placed = windows.join(parts.select("_part", "_id", "_th", "_from"), "_part")
    return placed.groupBy("_id", "_th").agg(F.collect_set(_packed(F.col("start") + F.col("_from"), F.col("n"))).alias("spans"))


def measure_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, passages: tuple[int, int, int] | None = None) -> DataFrame:
    """What removing repeated strings leaves of every row.

    Each byte covered by a ``length``-byte string that also starts anywhere
    else (same text included, overlaps count, judged on the input) is removed.
    Returns ``id_col, n_bytes, n_removed, n_spans, kept_sha256``: one row per
    input row.  A null text counts as empty, texts shorter than ``length`` stay
    whole, repeated rows remove one another's long strings, an empty table gives
    an empty result, and other columns are ignored whatever their names.

    With ``passages`` (length, over_words, or_bytes), ``text`` follows: the text
    as :func:`remove_repeats` leaves it with these.  If these strings are the
    shorter ones, all texts are searched once, for them; the longer ones are
    then searched for within what they cover.
    """
    keyed = docs.select(*row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, _th bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    scratch = Scratch()
    if passages:
        inner = Scratch()
        found = scratch.stored(covered_spans(docs, id_col, text_col, passages[0], inner).withColumnRenamed("spans", "passages"))
        inner.drop_rest()
        spans = _longer_spans(keyed, found, passages[0], length, scratch) if passages[0] < length else covered_spans(docs, id_col, text_col, length)
        spans = found.join(spans, same_row(found, spans), "left").select(found["_id"], found["_th"], "spans", "passages")
        schema += ", text string"
    else:
        spans = covered_spans(docs, id_col, text_col, length)
    both = keyed.join(spans, same_row(keyed, spans), "left").select(keyed["_id"], keyed["_th"], "_text", *[c for c in ("spans", "passages") if c in spans.columns])
    return both.mapInArrow(_cut(length, arrow_type(docs, id_col), passages), schema).drop("_th").withColumnRenamed("_id", id_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, over_words: int = 0, or_bytes: int = 0) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text_col``, all other columns as they are.

    With ``over_words``, a run of repeated ``length``-byte strings is cut only
    if it has more words than that, or ``or_bytes`` bytes or more.
    Cuts fall between bytes; a character that a cut leaves in part is dropped.
    Texts without a repeated string, null ones included, come back unchanged.
    """
    spans = covered_spans(docs, id_col, text_col, length)
    rest = [c for c in docs.columns if c != text_col]
    packed = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest"))
    both = packed.join(spans, same_row(packed, spans), "left").select("_text", "_rest", "spans")

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd

        made = []
        for t, own in zip(text, spans, strict=True):
            if t is None or own is None or not len(own):
                made.append(t)
                continue
            _, a, z = _passages(np.zeros(len(own), np.int64), own >> 32, own & 0xFFFFFFFF, length)
            made.append(_without(np.frombuffer(t.encode(), np.uint8), list(zip(a.tolist(), z.tolist(), strict=True)), over_words, or_bytes))
        return pd.Series(made, dtype=object)

    cleaned = both.withColumn("_text", cut("_text", "spans"))
    return cleaned.select(*[F.col("_text").alias(text_col) if c == text_col else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def brute_force(texts: list[str | None], length: int = 400) -> list[tuple[int, int, int, str]]:
    """The definition, for tests: (n_bytes, n_removed, n_spans, kept_sha256) by text."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
