"""Code lengths of texts by context-tree weighting over bytes.

A byte is eight binary decisions.  Each decision has a context tree whose
branches are the bytes before it, nearest first; every node holds a
Krichevsky-Trofimov estimate, and a node's weighted probability is the mean of
its own estimate and the product of its children's.  The ratio of the two is
the weight that a node's own estimate gets when depths are mixed, so a byte's
probability mixes all depths from none to ``DEPTH`` bytes.

Counts of strings of ``DEPTH + 1`` bytes are summed over the whole training
part, by task, then by the last ``SHARED + 1`` context bytes, where all longer contexts
are complete, and all of them are kept: each part weighs and scores the strings
whose contexts it has.  Shorter contexts are shared by all parts.  A context that was never seen has an estimate of a half
for every bit, so probabilities of all 256 bytes sum to one.  A text ends with
a byte that no text holds.

Tasks read what they need in order and piece by piece: counts leave a task once
they are many, a part's strings are asked for in portions, and what is stored
or moved is compressed before it leaves Python, so rows are small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_type, list_parts, one_array, stored
from .textblock import TextBlock, blocks

DEPTH = 5
#: Contexts of so many bytes and fewer are known to all parts; longer ones lie in the part of their first ``SHARED + 1`` bytes.
SHARED = 2
END = 0xFF
_MERGE_AT = 1_200_000
_HELD = 4_000_000  # strings with counts that a task holds before it hands them on
_ASKED = 1 << 21  # strings that are scored together
_ROW = 1 << 14  # strings of a stored row
_PIECE = 1 << 19  # bytes of text of a stored row
_PART_BYTES = 16 << 20  # bytes of text for each part, at most
_BLOCK = 1 << 19  # bytes of text worked on at once
_STRING_BLOCK = 5 << 20  # bytes of text whose distinct strings are asked for together
_U = np.uint64
_Counts = tuple[np.ndarray, np.ndarray]  # sorted strings, and the count of each
_Levels = list[_Counts]


def planes(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, as equal high bytes compress to nothing, and compressed, so that they are small wherever they go."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def from_planes(raw: bytes, dtype: type) -> np.ndarray:
    flat = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def gaps(keys: np.ndarray) -> bytes:
    """Mostly ascending unsigned numbers as the planes of their differences."""
    return planes(np.diff(keys, prepend=keys.dtype.type(0)))


def from_gaps(raw: bytes, dtype: type = _U) -> np.ndarray:
    return np.cumsum(from_planes(raw, dtype), dtype=dtype)


def strings(block: TextBlock, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text and its end: the byte with the ``depth`` bytes before it as one number; and the document offsets."""
    size = np.diff(block.offs)
    wide = depth + 1
    data = np.zeros(len(block.data) + wide * block.n, np.uint8)
    shift = wide * np.arange(block.n) + depth
    data[np.arange(len(block.data)) + np.repeat(shift, size)] = block.data
    starts = block.offs[:-1] + wide * np.arange(block.n)
    data[starts + depth + size] = END
    key = np.zeros(len(data), _U)
    for j in range(wide):
        key[j:] |= data[: len(data) - j].astype(_U) << _U(8 * j)
    use = np.ones(len(data), bool)
    for j in range(depth):
        use[starts + j] = False
    offs = np.zeros(block.n + 1, np.int64)
    np.cumsum(size + 1, out=offs[1:])
    return key[use], offs


def count_sorted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``n`` (or the number) of each."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(at, len(keys))) if n is None else np.add.reduceat(n, at) if len(at) else n
    return keys[at], sums.astype(np.int64)


def _bucket(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of a string: by the ``SHARED + 1`` bytes before its last."""
    ctx = (keys >> _U(8)) & _U((1 << 8 * (SHARED + 1)) - 1)
    return ((ctx * _U(0x9E3779B97F4A7C15)) >> _U(40)).astype(np.int64) % parts


class _Tally:
    """Sums of counts of strings, in order once they are asked for."""

    def __init__(self) -> None:
        self.held: list[_Counts] = []

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.held.append((keys, n))
        if sum(len(k) for k, _ in self.held[1:]) > _MERGE_AT:
            self.held = [self.sums()]

    def size(self) -> int:
        return sum(len(k) for k, _ in self.held)

    def sums(self) -> _Counts:
        return count_sorted(*(np.concatenate(x) for x in zip(*self.held, strict=True))) if self.held else (np.zeros(0, _U), np.zeros(0, np.int64))


def _count(parts: int):
    schema = pa.schema([("p", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])

    def by_part(tally: _Tally) -> pa.RecordBatch:
        keys, n = tally.sums()
        order, own = _by_part(keys, parts)
        n, ends = n[order], np.cumsum([0, *[len(k) for _, k in own]])
        return arrow_batch(schema, [p for p, _ in own], pa.array([gaps(k) for _, k in own], pa.binary()), pa.array([planes(n[a:z]) for a, z in zip(ends, ends[1:])], pa.binary()))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            for b in blocks(batch.column("_text"), _BLOCK):
                tally.add(*count_sorted(strings(b)[0]))
                if tally.size() > _HELD:
                    yield by_part(tally)
                    tally = _Tally()
        yield by_part(tally)

    return apply


def _runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """The rows of sorted batches, cut where one of some columns changes, and what these hold."""
    for batch in batches:
        keys = [np.asarray(batch.column(c)) for c in names]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if lo < hi:
                yield tuple(int(k[lo]) for k in keys), batch.slice(lo, hi - lo)


def _context_sums(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    ctx = keys >> _U(8)
    new = np.append(True, ctx[1:] != ctx[:-1]) if len(ctx) else np.zeros(0, bool)
    sums = np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n
    return sums[np.cumsum(new) - 1]


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_rising(a) + _log_rising(b) - _log_gamma_ratio(a + b)


def _log_rising(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) - log Gamma(1/2)."""
    return _lgamma(n + 0.5) - 0.5723649429247001


def _log_gamma_ratio(n: np.ndarray) -> np.ndarray:
    return _lgamma(n + 1.0)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight; exact to about 1e-13 for x > 0."""
    shift = np.zeros_like(x, dtype=np.float64)
    y = np.asarray(x, np.float64)
    prod = y * (y + 1) * (y + 2) * (y + 3)
    shift = np.log(prod) + np.log((y + 4) * (y + 5) * (y + 6) * (y + 7))
    y = y + 8
    i = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + i * (1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i / 1680))) - shift


def _nodes(levels: list[tuple[np.ndarray, np.ndarray]], b: int) -> tuple[list, list, list]:
    """By depth: zeros and ones of the nodes of bit ``b`` and the node of each string; the node at one depth less; the nodes' names."""
    nodes, up, names = [], [], []
    short = np.zeros(0, _U)
    for d, (keys, n) in enumerate(levels):
        prefix = (keys >> _U(8) << _U(8)) | (_U(1 << b) | ((keys & _U(255)) >> _U(8 - b)))
        new = np.append(True, prefix[1:] != prefix[:-1]) if len(prefix) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        one = (keys >> _U(7 - b)) & _U(1)
        zeros, ones = (np.add.reduceat(np.where(one == v, n, 0), at).astype(float) for v in (0, 1))
        nodes.append((zeros, ones, (np.cumsum(new) - 1).astype(np.int32)))
        prefix = prefix[at]
        shorter = ((prefix >> _U(8)) & _U((1 << 8 * max(d - 1, 0)) - 1)) << _U(8) | (prefix & _U(255))
        up.append(np.searchsorted(short, shorter).astype(np.int32) if d else None)
        short = prefix
        names.append(prefix)
    return nodes, up, names


def _weigh(nodes: list, up: list, names: list, outer: tuple[np.ndarray, np.ndarray] | None = None, least: int = 0) -> tuple[list[np.ndarray], tuple]:
    """Weights of the nodes' own estimates, by depth from ``least``, and what the nodes of that depth hand to their parents."""
    weights: list[np.ndarray] = []
    below = None
    for d in range(len(nodes) - 1, least - 1, -1):
        zeros, ones, _ = nodes[d]
        mine = _log_kt(zeros, ones)
        if below is None:
            weighted, w = mine, np.ones(len(mine))
        else:
            parent, child_log = below
            if outer is not None and d == SHARED:
                split = outer[1][np.searchsorted(outer[0], names[d])]
            else:
                split = np.bincount(parent, weights=child_log, minlength=len(mine))
            weighted = np.logaddexp(mine, split) - np.log(2)
            w = np.exp(np.log(0.5) + mine - weighted)
        weights.insert(0, w)
        below = (up[d], weighted)
    return weights, below


def log_probabilities(levels: list[_Counts], keys: np.ndarray, outer: _Counts | None = None) -> np.ndarray:
    """Natural log probabilities of the last bytes of ``keys``, strings of the full depth, under the tree of all strings.

    ``levels``: by depth, sorted strings and their counts; each context's shorter
    one is there too.  If the strings beyond the shared depths are those
    of one part only, ``outer`` has for every node of the last shared depth the log
    probability of its children in all parts; the result then holds for strings of that part.

    A bit's probability at a node is the mean of the node's own estimate and
    that of the deeper context, weighed by what each has earned; a context
    without a node has seen nothing, so its estimate is a half.
    """
    out = np.zeros(len(keys))
    for b in range(8):
        nodes, up, names = _nodes(levels, b)
        weights, _ = _weigh(nodes, up, names, outer)
        one = ((keys >> _U(7 - b)) & _U(1)) == 1
        prefix = _U(1 << b) | ((keys & _U(255)) >> _U(8 - b))
        p = np.full(len(keys), 0.5)
        for d in range(len(levels) - 1, -1, -1):
            if not len(names[d]):
                continue
            name = ((keys >> _U(8)) & _U((1 << 8 * d) - 1)) << _U(8) | prefix
            at = np.minimum(np.searchsorted(names[d], name), len(names[d]) - 1)
            zeros, ones = nodes[d][0][at], nodes[d][1][at]
            mine = (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1)
            w = weights[d][at]
            p = np.where(names[d][at] == name, w * mine + (1 - w) * p, p)
        out += np.log(p)
    return out


def _parts(docs: DataFrame) -> int:
    """Twice the number of tasks that read the input, so that a part holds less than a task has counted; and as many as the size of the texts asks for, as tasks can be large."""
    size = docs.agg(F.sum(F.octet_length("_text").cast("long")).alias("size")).first()["size"] or 0
    return max(8, 2 * docs.rdd.getNumPartitions(), -(-size // _PART_BYTES))


@dataclass
class _Top:
    """What all parts share: the strings of up to ``SHARED + 1`` bytes, and what the children of contexts of ``SHARED`` bytes add up to."""

    levels: _Levels
    outer: tuple[np.ndarray, np.ndarray]  # names of the nodes of the last shared depth, over all bits, sorted; log probability of their children


def _sums(keys: list[np.ndarray], values: list[np.ndarray], dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their values."""
    k, v = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, _U), (values, dtype)))
    return (count_sorted(k, v) if dtype is np.int64 else _float_sums(k, v)) if len(k) else (k, v)


def _float_sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(keys, return_inverse=True)
    return names, np.bincount(at, weights=values)


def _read_levels(rows: list[pa.RecordBatch]) -> _Levels:
    """The strings of one part and their counts, by depth beyond the shared ones."""
    kept: dict[int, tuple[list, list]] = {d: ([], []) for d in range(SHARED + 1, DEPTH + 1)}
    for r in rows:
        for d, k, n in zip(*(r.column(c).to_pylist() for c in ("depth", "keys", "n")), strict=True):
            kept[d][0].append(from_gaps(k))
            kept[d][1].append(from_planes(n, np.int64))
    return [_sums(*kept[d], np.int64) for d in sorted(kept)]


_PART = pa.schema([("p", pa.int32()), ("depth", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])


def _part_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Part by part, its strings by depth; as depth 1 its strings of the last shared depth, as depth 0 what it adds to the nodes of that depth."""
    now, tally = None, _Tally()
    for (p,), rows in _runs(batches, "p"):
        if p != now:
            if now is not None:
                yield from _levels_of(now, *tally.sums())
            now, tally = p, _Tally()
        for keys, n in zip(rows.column("keys"), rows.column("n"), strict=True):
            tally.add(from_gaps(keys.as_py()), from_planes(n.as_py(), np.int64))
    if now is not None:
        yield from _levels_of(now, *tally.sums())


def _levels_of(part: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    levels = [(keys, n)]
    for d in range(DEPTH - 1, -1, -1):
        keys, n = levels[0]
        levels.insert(0, count_sorted(keys & _U((1 << 8 * (d + 1)) - 1), n))
    names, sums = [], []
    for b in range(8):
        nodes, up, name = _nodes(levels, b)
        _, (parent, weighted) = _weigh(nodes, up, name, least=SHARED + 1)
        names.append(name[SHARED])
        sums.append(np.bincount(parent, weights=weighted, minlength=len(name[SHARED])))
    deeper = [(d, *levels[d]) for d in range(DEPTH, SHARED, -1)]
    for depth, keys, n in [*deeper, (1, *levels[SHARED]), (0, np.concatenate(names), np.concatenate(sums))]:
        for lo in range(0, len(keys), _ROW):
            yield arrow_batch(_PART, [part], [depth], pa.array([gaps(keys[lo : lo + _ROW])], pa.binary()), pa.array([planes(n[lo : lo + _ROW])], pa.binary()))


def _top(levels: DataFrame) -> _Top:
    """Adds up what the parts say of the shared depths; its size is bound by the number of strings of ``SHARED + 1`` bytes."""
    got: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], [])}
    for r in levels.where("depth < 2").select("depth", "keys", "n").toLocalIterator():
        keys, values = got[r["depth"]]
        keys.append(from_gaps(r["keys"]))
        values.append(from_planes(r["n"], np.int64 if r["depth"] else np.float64))
        if len(keys) > 64:
            got[r["depth"]] = tuple([x] for x in _sums(keys, values, np.int64 if r["depth"] else np.float64))
    keys, n = _sums(*got[1], np.int64)
    return _Top([count_sorted(keys & _U((1 << 8 * (d + 1)) - 1), n) for d in range(SHARED)] + [(keys, n)], _sums(*got[0], np.float64))


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


_BLOCKS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("p", pa.int32()), ("data", pa.binary())])


def _string_blocks(parts: int):
    """Of each block of documents the documents themselves, as rows of kind 0, and their distinct strings by part, as rows of kind 1."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            for b in blocks(batch.column("_text"), _STRING_BLOCK):
                asked = _by_part(np.unique(strings(b)[0]), parts)[1]
                own = batch.slice(b.first, b.n)
                docs = [_packed(own.slice(x.first, x.n)) for x in blocks(own.column("_text"), _PIECE)]
                kinds, p = [0] * len(docs) + [1] * len(asked), [None] * len(docs) + [p for p, _ in asked]
                yield arrow_batch(_BLOCKS, [block] * len(p), kinds, p, pa.array(docs + [gaps(k) for _, k in asked], pa.binary()))
                block += 1

    return apply


def _by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The order that puts sorted strings part by part, and the strings of each part that has some."""
    p = _bucket(keys, parts)
    order = np.argsort(p, kind="stable")
    bounds = np.searchsorted(p[order], np.arange(parts + 1))
    return order, [(i, keys[order[bounds[i] : bounds[i + 1]]]) for i in range(parts) if bounds[i] < bounds[i + 1]]


_LOGS = pa.schema([("block", pa.int64()), ("p", pa.int32()), ("data", pa.binary())])


def _score_parts(top):
    """The log probabilities of the blocks' strings, part by part: its levels come first (kind 0), then what is asked (kind 1), which is answered in portions."""

    def answers(part: int, levels: _Levels, asked: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        distinct = np.unique(np.concatenate([k for _, k in asked]))
        logp = log_probabilities([*top.value.levels, *levels], distinct, top.value.outer).astype(np.float32)
        out = [planes(logp[np.searchsorted(distinct, k)]) for _, k in asked]
        return arrow_batch(_LOGS, [block for block, _ in asked], [part] * len(asked), pa.array(out, pa.binary()))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stored_levels, levels, asked, size = None, [], [], [], 0
        for (p, kind), rows in _runs(batches, "p", "kind"):
            if p != now:
                if asked:
                    yield answers(now, levels, asked)
                now, stored_levels, levels, asked, size = p, [], [], [], 0
            if not kind:
                stored_levels.append(rows)
                continue
            levels, stored_levels = levels or _read_levels(stored_levels), []
            for block, keys in zip(rows.column("block"), rows.column("data"), strict=True):
                asked.append((block.as_py(), from_gaps(keys.as_py())))
                size += len(asked[-1][1])
                if size >= _ASKED:
                    yield answers(p, levels, asked)
                    asked, size = [], 0
        if asked:
            yield answers(now, levels, asked)

    return apply


def _sum_up(parts: int, id_type: pa.DataType):
    """Block by block, the sums of its documents (kind 0) from the log probabilities of its strings, which come first (kind 1)."""
    schema = pa.schema([("_id", id_type), ("_row", pa.int64()), ("n_bytes", pa.int64()), ("score", pa.float64())])

    def sums(docs: pa.Table, logs: list[tuple[int, bytes]]) -> pa.RecordBatch:
        b = next(blocks(docs["_text"], 1 << 40))
        key, offs = strings(b)
        order = np.argsort(key)
        s = key[order]
        new = np.append(True, s[1:] != s[:-1])
        found = np.empty(int(new.sum()))
        found[_by_part(s[new], parts)[0]] = np.concatenate([from_planes(x, np.float32) for _, x in sorted(logs)])
        p = np.empty(len(key))
        p[order] = found[np.cumsum(new) - 1]
        return arrow_batch(schema, one_array(docs["_id"]), one_array(docs["_row"]), np.diff(b.offs), np.add.reduceat(p, offs[:-1]) / np.log(10))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, logs = None, [], []
        for (block, kind), rows in _runs(batches, "block", "kind"):
            if block != now:
                if docs:
                    yield sums(pa.concat_tables(docs), logs)
                now, docs, logs = block, [], []
            data = rows.column("data").to_pylist()
            if kind:
                logs += zip(rows.column("p").to_pylist(), data, strict=True)
            else:
                docs += [pa.ipc.open_stream(x).read_all() for x in data]
        if docs:
            yield sums(pa.concat_tables(docs), logs)

    return apply


def whole_code_lengths(docs: DataFrame, train_col: str, id_col: str = "doc_id", text_col: str = "text", row_col: str = "_row") -> DataFrame:
    """As :func:`code_lengths`, under the tree of all strings of the rows where ``train_col`` holds.

    All contexts that have their first ``SHARED + 1`` bytes in common lie in one
    part.  Every part weighs its own nodes, the sums for shorter contexts are
    added up, and a block's distinct strings meet the counts part by part, so
    nothing is pruned.  The largest part is that of the commonest three bytes.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(row_col).alias("_row"), F.col(train_col).alias("train"), F.col(text_col).alias("_text"))
    id_type, kind = arrow_type(rows, "_id"), rows.schema["_id"].dataType.simpleString()
    parts = _parts(rows)
    counted = rows.where("train").select("_text").mapInArrow(_count(parts), "p int, keys binary, n binary")
    levels = stored(counted.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(_part_levels, "p int, depth int, keys binary, n binary"))
    top = docs.sparkSession.sparkContext.broadcast(_top(levels))
    made = stored(rows.select("_id", "_row", "_text").mapInArrow(_string_blocks(parts), "block bigint, kind int, p int, data binary"))
    known = levels.where(f"depth > {SHARED}").withColumn("kind", F.lit(0))
    met = known.unionByName(made.where("kind = 1"), allowMissingColumns=True)
    logs = met.repartition(parts, "p").sortWithinPartitions("p", "kind").mapInArrow(_score_parts(top), "block bigint, p int, data binary")
    back = made.where("kind = 0").unionByName(logs.withColumn("kind", F.lit(1)))
    out = back.repartition(3 * parts, "block").sortWithinPartitions("block", F.desc("kind")).mapInArrow(_sum_up(parts, id_type), f"_id {kind}, _row bigint, n_bytes bigint, score double")
    bits = -F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)
    return out.select(F.col("_id").alias(id_col), F.col("_row").alias(row_col), "n_bytes", "score", bits.alias("bits_per_byte"))


# Word counts: the base score that code lengths are compared with.

_WORD_BLOCK = 8 << 20


def _hash_words(b: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    low = b.lowered()
    start, end, doc = low.words()
    return low.hashes(start, end), np.bincount(doc, minlength=b.n)


def _word_blocks(bits: int, id_type: pa.DataType):
    """Rows of kind 0 hold the documents of a block, their words as numbers into the block's word list; rows of kind 1 hold that list by part."""
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("p", pa.int32()), ("ids", pa.list_(id_type)), ("rows", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("n", pa.binary())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, seq, size
            if not held:
                return
            block = (part << 24) + seq
            h, sizes = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            train = np.concatenate([x[4] for x in held])
            ids, rows = pa.concat_arrays([x[2] for x in held]), pa.concat_arrays([x[3] for x in held])
            words, inverse = np.unique(h, return_inverse=True)
            n = np.bincount(inverse, weights=np.repeat(train, sizes), minlength=len(words)).astype(np.int64)
            doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
            local = np.sort((doc << 32) | inverse) & 0xFFFFFFFF  # in a text, order doesn't matter to a sum
            one = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a if isinstance(a, pa.Array) else pa.array(a, t))
            none = lambda t: pa.nulls(1, pa.list_(t))
            yield arrow_batch(schema, [block], [0], [0], one(ids, id_type), one(rows, pa.int64()), one(train, pa.bool_()), one(sizes.astype(np.int32), pa.int32()), pa.array([gaps(local.astype(np.uint32))], pa.binary()), pa.nulls(1, pa.binary()))
            p = (words >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
            bounds = np.searchsorted(p, np.arange((1 << bits) + 1))
            for i in range(1 << bits):
                a, z = bounds[i], bounds[i + 1]
                if a < z:
                    yield arrow_batch(schema, [block], [1], [i], none(id_type), none(pa.int64()), none(pa.bool_()), none(pa.int32()), pa.array([gaps(words[a:z])], pa.binary()), pa.array([planes(n[a:z])], pa.binary()))
            held, size, seq = [], 0, seq + 1

        for batch in batches:
            train = np.asarray(batch.column("train"))
            for b in blocks(batch.column("_text"), _BLOCK):
                h, sizes = _hash_words(b)
                held.append((h, sizes, one_array(batch.column("_id")).slice(b.first, b.n), one_array(batch.column("_row")).slice(b.first, b.n), train[b.rows]))
                size += len(b.data) + 64 * b.n
                if size >= _WORD_BLOCK:
                    yield from flush()
        yield from flush()

    return apply


_COUNTED = pa.schema([("block", pa.int64()), ("p", pa.int32()), ("c", pa.binary()), ("distinct", pa.int64())])


def _total_words(table: pa.Table) -> pa.Table:
    """Of one part of the words, their counts over all blocks, by block; and how many of them were seen in training."""
    words = [from_gaps(w) for w in table["words"].to_pylist()]
    flat, n = np.concatenate(words), np.concatenate([from_planes(x, np.int64) for x in table["n"].to_pylist()])
    keys, sums = count_sorted(flat, n)
    c = [planes(sums[np.searchsorted(keys, w)]) for w in words]
    distinct = [int((sums > 0).sum())] + [0] * (len(words) - 1)
    return pa.Table.from_arrays([table["block"].combine_chunks(), table["p"].combine_chunks(), pa.array(c, pa.binary()), pa.array(distinct, pa.int64())], schema=_COUNTED)


def _base(id_type: pa.DataType):
    schema = pa.schema([("_id", id_type), ("_row", pa.int64()), ("n_words", pa.int64()), ("n_known", pa.int64()), ("log_sum", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                counts = sorted(one.column("parts").to_pylist()[0] or [], key=lambda x: x["p"])
                c = np.concatenate([np.zeros(0, np.int64), *[from_planes(x["c"], np.int64) for x in counts]])
                sizes = np.asarray(one.column("sizes").flatten()).astype(np.int64)
                own = c[from_gaps(one.column("words")[0].as_py(), np.uint32)]
                offs = np.zeros(len(sizes) + 1, np.int64)
                np.cumsum(sizes, out=offs[1:])
                known = np.zeros(len(own) + 1, np.int64)
                np.cumsum(own > 0, out=known[1:])
                logs = np.log10(own + 0.5)
                sums = np.zeros(len(sizes))
                some = np.flatnonzero(sizes)
                if len(some):
                    sums[some] = np.add.reduceat(logs, offs[some])
                yield arrow_batch(schema, list_parts(one.column("ids"))[1], list_parts(one.column("rows"))[1], sizes, known[offs[1:]] - known[offs[:-1]], sums)

    return apply


def base_scores(docs: DataFrame, train_col: str, id_col: str = "doc_id", text_col: str = "text", row_col: str = "_row") -> DataFrame:
    """Per row ``id_col, row_col, n_tokens, n_known, train_tokens, base_score`` under smoothed counts of lower-cased words and text ends.

    Words and counts go by blocks of documents: a block's list of distinct words
    is counted over all blocks part by part, and the counts come back to the
    block, so no list of all words is ever held whole.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(row_col).alias("_row"), F.col(train_col).alias("train"), F.col(text_col).alias("_text"))
    id_type, kind = arrow_type(rows, "_id"), rows.schema["_id"].dataType.simpleString()
    bits = max(3, (_parts(rows) // 2 - 1).bit_length())
    made = stored(rows.mapInArrow(_word_blocks(bits, id_type), f"block bigint, kind int, p int, ids array<{kind}>, rows array<bigint>, train array<boolean>, sizes array<int>, words binary, n binary"))
    counted = stored(made.where("kind = 1").select("block", "p", "words", "n").groupBy("p").applyInArrow(_total_words, "block bigint, p int, c binary, distinct bigint"))
    vocabulary = counted.agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()["v"]
    sums = made.where("kind = 0").select(F.explode(F.arrays_zip("train", "sizes")).alias("x")).where("x.train").agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("x.sizes"), F.lit(0)).alias("words")).first()
    n, ends = int(sums["words"]) + int(sums["texts"]), int(sums["texts"])
    v = int(vocabulary) + (1 if ends else 0)
    back = counted.groupBy("block").agg(F.collect_list(F.struct("p", "c")).alias("parts"))
    joined = made.where("kind = 0").select("block", "ids", "rows", "sizes", "words").join(back, "block", "left")
    scored = joined.mapInArrow(_base(id_type), f"_id {kind}, _row bigint, n_words bigint, n_known bigint, log_sum double")
    whole = float(np.log10(n + 0.5 * (v + 1)))
    score = F.col("log_sum") + float(np.log10(ends + 0.5)) - (F.col("n_words") + 1) * whole
    return scored.select(F.col("_id").alias(id_col), F.col("_row").alias(row_col), (F.col("n_words") + 1).alias("n_tokens"), (F.col("n_known") + (1 if ends else 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), score.alias("base_score"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1) -> DataFrame:
    """Learns from all rows whose id's crc32, as text, isn't ``held_fold`` mod ``folds`` and scores every row.

    Returns ``id_col, held_out, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte``.  Null texts are empty ones; rows with a null id are
    held out; repeated rows come back as often as they stand, each with the same
    scores; other columns are ignored; without training rows every byte is
    equally likely; an empty table gives an empty result.
    """
    crc = F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8"))
    rows = docs.select(F.col(id_col).alias("_k"), F.coalesce(~(F.pmod(crc, F.lit(folds)) == held_fold), F.lit(False)).alias("train"), F.xxhash64(F.col(text_col)).alias("_row"), F.col(text_col).alias("_text"))
    lengths = whole_code_lengths(rows, "train", "_k", "_text").dropDuplicates(["_k", "_row"])
    base = base_scores(rows, "train", "_k", "_text")
    known = F.coalesce(F.pmod(crc, F.lit(folds)) == held_fold, F.lit(True))
    out = base.withColumnRenamed("_k", id_col).withColumn("held_out", known)
    both = out.join(lengths, out[id_col].eqNullSafe(lengths["_k"]) & (out["_row"] == lengths["_row"]))
    return both.select(out[id_col], "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
