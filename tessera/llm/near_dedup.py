"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union by label spreading.

Signatures.  An element visits every one of the ``m`` slots exactly once, in
the order of its own permutation, and offers the value (step, random fraction)
to the slot it visits.  A slot keeps its least offer.  Ranks of one element are
correlated (they are a permutation), which lowers the variance below that of
independent hashes, and a document needs no further step once all its slots are
filled by earlier ones: long documents stop after one or two steps.

Candidates.  Documents of equal shingle sets are one node, however many they
are.  Nodes that agree on a band share a bucket.  No bucket is expanded into
all its pairs:

1. every node of a bucket is verified against the bucket's pivot only;
2. what is left in different components in a small bucket is verified pairwise
   (at most ``SMALL`` partners a row);
3. in larger buckets, the nodes outside of the bucket's main component are
   compared with all members, in blocks of bounded size: first by signatures of
   one byte a slot, whose likeliest pairs are verified, then, for the members
   that are still similar to one of another component, by counting common
   shingles with matrix products; only links that join components come out.

All links are confirmed on full sets, so a result never rests on estimates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_batch, arrow_type, one_array, row_key, same_row, stored
from .textblock import TextBlock, blocks, combine, mix, shingle_sets

SLOTS = 353  # a prime, so that every step of an affine walk visits each slot once
MISS = 1e-6
SMALL = 24
LOST = 1e-9
CHUNK = 384  # members of a block on average, or fewer if they have more shingles than this
CHUNK_SHINGLES = 1 << 16
_SHARE = 512


def signatures(h: np.ndarray, owner: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of ``n`` sets of hashes; ``owner`` is the set of each hash, ascending."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * slots, empty, np.uint64)
    a = mix(h ^ np.uint64(0x1F83D9ABFB41BD6B))
    start, step = a % np.uint64(slots), (a >> np.uint64(32)) % np.uint64(slots - 1) + np.uint64(1)
    for level in range(slots):
        slot = (start + np.uint64(level) * step) % np.uint64(slots)
        offer = (combine(h, level) >> np.uint64(10)) | (np.uint64(level) << np.uint64(54))
        np.minimum.at(sig, owner * slots + slot.astype(np.int64), offer)
        open_ = (sig.reshape(n, slots) == empty).any(axis=1)
        go = open_[owner]
        if not go.any():
            break
        if not go.all():
            h, owner, start, step = h[go], owner[go], start[go], step[go]
    return sig.reshape(n, slots)


def band_rows(percent: int, slots: int = SLOTS) -> int:
    """The most slots a band can have if a pair of the least similarity is to miss all bands with a probability below ``MISS``."""
    return max((r for r in range(2, slots // 2) if (1 - (percent / 100) ** r) ** (slots // r) < MISS), default=1)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each band of a signature."""
    bands = sig.shape[1] // rows
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        key = combine(key, parts[:, :, k])
    return key


def _sums(x: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _set_keys(h: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """16 bytes that name a set of hashes."""
    size = np.diff(offs).astype(np.uint64)
    two = np.stack([combine(_sums(mix(h), offs), size), combine(_sums(mix(h ^ np.uint64(0x5BE0CD19137E2179)), offs), size)], axis=1)
    raw = np.ascontiguousarray(two).tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def _sketch(width: int, rows: int, b: TextBlock, ids: pa.Array, ths: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    h, owner, offs = shingle_sets(b.lowered(), width)
    sizes = np.diff(offs)
    some = np.flatnonzero(sizes)
    bands = SLOTS // rows
    keys = np.zeros((b.n, bands), np.uint64)
    if len(some):
        keys[some] = band_keys(signatures(h, owner, b.n), rows)[some]
    lists = pa.ListArray.from_arrays(np.arange(0, b.n * bands + 1, bands, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
    return arrow_batch(schema, ids, ths, sizes.astype(np.int64), pa.array(_set_keys(h, offs), pa.binary()), lists)


def _sketches(width: int, rows: int, id_type: pa.DataType):
    schema = pa.schema([("_id", id_type), ("_th", pa.int64()), ("n_shingles", pa.int64()), ("name", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = one_array(batch.column("_id")), one_array(batch.column("_th"))
            for b in blocks(batch.column("_text")):
                yield _sketch(width, rows, b, ids.slice(b.first, b.n), ths.slice(b.first, b.n), schema)

    return apply


def pack_set(h: np.ndarray) -> bytes:
    """A sorted set of hashes as their low 48 bits, six bytes each."""
    return np.sort(h & np.uint64((1 << 48) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_set(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def _full_sets(width: int):
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = one_array(batch.column("node"))
            for b in blocks(batch.column("_text")):
                h, _, offs = shingle_sets(b.lowered(), width)
                yield arrow_batch(schema, nodes.slice(b.first, b.n), pa.array([pack_set(h[offs[i] : offs[i + 1]]) for i in range(b.n)], pa.binary()))

    return apply


def linked_sizes(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * common >= percent * (a + b - common)


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                x, y = unpack_set(x.as_py()), unpack_set(y.as_py())
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                if linked_sizes(int((y[at] == x).sum()), len(x), len(y), percent):
                    good.append(i)
            yield arrow_batch(schema, *[one_array(batch.column(c)).take(pa.array(good, pa.int64())) for c in ("a", "b")])

    return apply


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of nodes that are linked, by their full sets.

    A node's set goes once to each group of ``_SHARE`` pairs in which it is
    ``a``, so a node of many pairs is shared among tasks.
    """
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.floor(F.col("c") / _SHARE) + 1).alias("salt"))
    right = salted.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    left = many.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("c") / _SHARE))).alias("salt")).join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    return right.join(left, ["a", "salt"]).select("a", "b", "sa", "sb").mapInArrow(_verify(percent), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for all nodes of undirected edges ``a, b``; comp is the least node that can be reached.

    Labels spread over edges and then jump to the label of the label, so that
    the number of rounds follows the logarithm of a component's diameter.
    """
    scratch = Scratch()
    both = scratch.stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        offered = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        spread = labels.join(offered, "node").select("node", F.least("comp", "m").alias("comp"), F.col("comp").alias("was"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("m"))
        after = scratch.stored(spread.join(up, "comp").select("node", F.least("comp", "m").alias("comp"), "was"))
        changed = after.where("comp <> was").limit(1).count()
        labels = after.select("node", "comp")
        if not changed:
            labels = stored(labels)
            scratch.drop_rest()
            return labels


def _with_comp(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


class _Forest:
    """Union-find over a few labels."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def common_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of all intersections between two lists of sets of distinct hashes, by matrix products over slices of the shared elements."""
    lx, rx = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(lx, rx)
    out = np.zeros((len(left), len(right)), np.float64)
    made = []
    for sets, flat in ((left, lx), (right, rx)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, flat), max(len(shared) - 1, 0))
        hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        made.append((row[hit][order], at[hit][order]))
    for lo in range(0, len(shared), width):
        grid = []
        for (row, at), n in zip(made, out.shape, strict=True):
            i, j = np.searchsorted(at, [lo, lo + width])
            m = np.zeros((n, min(width, len(shared) - lo)), np.float32)
            m[row[i:j], at[i:j] - lo] = 1
            grid.append(m)
        out += grid[0] @ grid[1].T
    return out


def _compare(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in range(len(batch)):
                ls, rs = (batch.column(c)[row].as_py() for c in ("lefts", "rights"))
                lsets, rsets = ([unpack_set(x["set"]) for x in s] for s in (ls, rs))
                common = common_counts(lsets, rsets)
                ln, rn = np.array([len(s) for s in lsets])[:, None], np.array([len(s) for s in rsets])[None, :]
                forest = _Forest()
                for i, j in zip(*np.nonzero(linked_sizes(common, ln, rn, percent)), strict=True):
                    if forest.union(ls[i]["comp"], rs[j]["comp"]):
                        a.append(ls[i]["node"])
                        b.append(rs[j]["node"])
            yield arrow_batch(schema, pa.array(a, pa.int64()), pa.array(b, pa.int64()))

    return apply


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets to signatures of one byte a slot."""
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            sets = [unpack_set(x.as_py()) for x in part.column("set")]
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            sig = (mix(signatures(np.concatenate(sets), owner, len(sets))) & np.uint64(255)).astype(np.uint8)
            yield arrow_batch(schema, part.column("node"), pa.array([x.tobytes() for x in sig], pa.binary()))


def least_matches(percent: int, slots: int = SLOTS, lost: float = LOST) -> int:
    """The most slots such that a pair of the least similarity has fewer equal ones with a probability of at most ``lost``, from the binomial distribution."""
    p, below = percent / 100, 0.0
    for k in range(slots + 1):
        below += math.comb(slots, k) * p**k * (1 - p) ** (slots - k)
        if below > lost:
            return k
    return slots


def _likely(percent: int, forest: bool):
    """Of two blocks of members, pairs of unlike components that signatures take for similar: as many as join components, likeliest first, or else the members of all of them."""
    fields = [("a", pa.int64()), ("b", pa.int64())] if forest else [("bucket", pa.int64()), ("node", pa.int64())]
    schema = pa.schema(fields)
    least = least_matches(percent)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [], []
            for row in range(len(batch)):
                ls, rs = (batch.column(c)[row].as_py() for c in ("lefts", "rights"))
                node, comp, n = ([np.array([m[k] for m in side]) for side in (ls, rs)] for k in ("node", "comp", "n"))
                left, right = (np.frombuffer(b"".join(m["set"] for m in side), np.uint8).reshape(len(side), -1) for side in (ls, rs))
                match = np.stack([(right == one).sum(1) for one in left])
                near = (match >= least) & (comp[0][:, None] != comp[1][None, :])
                small, large = np.minimum(n[0][:, None], n[1][None, :]), np.maximum(n[0][:, None], n[1][None, :])
                i, j = np.nonzero(near & (100 * small >= percent * large))
                if not forest:
                    some = np.unique(np.concatenate([node[0][i], node[1][j]]))
                    x += [batch.column("bucket")[row].as_py()] * len(some)
                    y += some.tolist()
                    continue
                joined = _Forest()
                for k in np.argsort(-match[i, j], kind="stable"):
                    if joined.union(int(comp[0][i[k]]), int(comp[1][j[k]])):
                        x.append(int(node[0][i[k]]))
                        y.append(int(node[1][j[k]]))
            yield arrow_batch(schema, pa.array(x, pa.int64()), pa.array(y, pa.int64()))

    return apply


def _block_pairs(members: DataFrame, payload: DataFrame, by_shingles: bool) -> DataFrame:
    """``bucket, lefts, rights``: the members outside of a bucket's main component against all its members, in blocks; ``members``: bucket, node, comp, n.

    A pair of blocks is dealt out by itself, so a frequent bucket is shared among tasks.
    """
    sizes = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    main = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.sum("size").alias("size"), F.sum("shingles").alias("shingles"), F.max(F.struct("size", "comp", "shingles")).alias("top"))
    rows = members.join(main, "bucket").withColumn("stray", F.col("comp") != F.col("main"))

    def blocks_of(size: str, shingles: str) -> Column:
        n = F.expr(size) / CHUNK
        return F.greatest(F.ceil(F.greatest(n, F.expr(shingles) / CHUNK_SHINGLES) if by_shingles else n).cast("int"), F.lit(1))

    h = F.xxhash64("node")
    placed = rows.withColumn("chunks", blocks_of("size", "shingles")).withColumn("owns", blocks_of("size - top.size", "shingles - top.shingles"))
    placed = placed.select("bucket", "node", "stray", "comp", "n", "chunks", F.pmod(h, F.col("chunks")).cast("int").alias("chunk"), F.pmod(h, F.col("owns")).cast("int").alias("own"))
    packed = placed.join(payload, "node").select("bucket", "chunk", "own", "stray", "chunks", F.struct("node", "comp", "n", "set").alias("m"))
    against = packed.where("stray").select("bucket", "own", "m", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    lefts = against.groupBy("bucket", "chunk", "own").agg(F.collect_list("m").alias("lefts"))
    rights = packed.groupBy("bucket", "chunk").agg(F.collect_list("m").alias("rights"))
    return lefts.join(rights, ["bucket", "chunk"]).select("bucket", "lefts", "rights")


def _live(members: DataFrame) -> DataFrame:
    """The members of buckets that still hold several components."""
    live = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    return members.join(live, "bucket", "left_semi")


def _hot_links(members: DataFrame, known: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links that join components within large buckets; ``members``: bucket, node, comp, n; ``known``: links found before.

    Signatures of one byte a slot propose pairs, likeliest first, and as few as
    join components.  Once these are verified, full sets go only to members
    that are still similar, by their signatures, to one of another component:
    these are compared without fail.
    """
    sketch = scratch.stored(sets.join(members.select("node").distinct(), "node", "left_semi").mapInArrow(_slots, "node bigint, set binary"))
    likely = _block_pairs(members, sketch, False).select("lefts", "rights").mapInArrow(_likely(percent, True), "a bigint, b bigint").distinct()
    found = scratch.stored(verified(scratch.stored(likely), sets, percent))
    now = scratch.stored(_live(_with_comp(members.drop("comp"), components(known.unionByName(found)))))
    open_ = _block_pairs(now, sketch, False).mapInArrow(_likely(percent, False), "bucket bigint, node bigint").distinct()
    rest = scratch.stored(now.join(open_, ["bucket", "node"], "left_semi"))
    return found.unionByName(_block_pairs(rest, sets, True).select("lefts", "rights").mapInArrow(_compare(percent), "a bigint, b bigint"))


def _close(a: str, b: str, percent: int) -> str:
    """SQL: two set sizes that leave room for a link."""
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _links(nodes: DataFrame, keyed: DataFrame, width: int, percent: int, scratch: Scratch, exact: bool = False) -> DataFrame:
    """Verified links between nodes; enough of them to join all nodes that are connected."""
    rows = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("pivot")).where("members > 1")
    inside = scratch.stored(rows.join(shared, "bucket").where("pivot <> node").select("bucket", "node", "n", "members", "pivot"))
    sized = nodes.select(F.col("node").alias("pivot"), F.col("n").alias("pn"))
    star = inside.groupBy("pivot", "node", "n").agg(F.lit(1)).join(sized, "pivot").where(_close("n", "pn", percent))
    star = scratch.stored(star.select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    wanted = star.select(F.col("a").alias("node")).union(star.select("b")).union(inside.where("members > 2").select("node")).distinct()
    reps = nodes.join(wanted, "node", "left_semi").select("node", "_kh", "_th")
    texts = keyed.groupBy("_kh", "_th").agg(F.first("_text").alias("_text"))
    sets = scratch.stored(texts.join(reps, ["_kh", "_th"]).select("node", "_text").mapInArrow(_full_sets(width), "node bigint, set binary"))
    first = scratch.stored(verified(star, sets, percent))
    members = scratch.stored(_live(_with_comp(inside.where("members > 2").select("bucket", "node", "n", "members"), components(first))))
    few = members.where(F.col("members") <= SMALL)
    ahead = few.groupBy("bucket").agg(F.collect_list(F.struct("node", "comp", "n")).alias("all"))
    partners = F.expr(f"filter(all, o -> node < o.node and comp <> o.comp and {_close('n', 'o.n', percent)})")
    pairs = few.join(ahead, "bucket").select(F.col("node").alias("a"), F.explode(partners).alias("o")).select("a", F.col("o.node").alias("b")).distinct()
    known = first.unionByName(scratch.stored(verified(scratch.stored(pairs), sets, percent)))
    many = members.where(F.col("members") > SMALL).select("bucket", "node", "comp", "n")
    if exact:
        large = _block_pairs(many, sets, True).select("lefts", "rights").mapInArrow(_compare(percent), "a bigint, b bigint")
    else:
        large = _hot_links(many, known, sets, percent, scratch)
    return known.unionByName(large)


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per row ``_id, _th, n_shingles, name, bands``, and per set of shingles ``node, name, comp`` and the row ``_id, _th`` that stands for it."""
    keyed = docs.select(*row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, _th bigint, n_shingles bigint, name binary, bands array<bigint>"
    sketched = stored(keyed.mapInArrow(_sketches(width, band_rows(percent), arrow_type(docs, id_col)), schema))
    named = sketched.where("n_shingles > 0").groupBy("name").agg(_least_row().alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    scratch = Scratch()
    nodes = scratch.stored(named.select(F.monotonically_increasing_id().alias("node"), "name", "n", F.col("rep._id").alias("_id"), F.xxhash64("rep._id").alias("_kh"), F.col("rep._th").alias("_th"), "bands"))
    hashed = keyed.select(F.xxhash64("_id").alias("_kh"), "_th", "_text")
    comp = components(_links(nodes, hashed, width, percent, scratch, exact))
    known = stored(_with_comp(nodes.select("node", "name", "_id", "_th"), comp))
    scratch.drop_rest()
    return sketched, known


def _least_row() -> Column:
    """The row of the least id, known ones first."""
    return F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_th"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """Groups of texts whose word-shingle sets overlap by ``percent`` of their union or more.

    Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lowered; a text
    with fewer than ``width`` words is one shingle.  Returns, per input row,
    ``id_col, n_shingles, component_id`` (the least id that can be reached) and
    ``kept`` (the row has that id).  Null and empty texts and those without
    words are linked with nothing and keep themselves; repeated rows are copies;
    a null id counts only if no id of its group is known; other columns are
    ignored whatever their names; an empty table gives an empty result.

    Two sets of at least ``percent`` agree in one band or more with a
    probability above 1 - ``MISS``, whatever the threshold.  In a band's bucket
    of more than ``SMALL`` sets, one-byte signatures choose the pairs whose full
    sets are compared, and miss a pair of just ``percent`` with a probability of
    at most ``LOST``; with ``exact``, full sets are compared there too.
    """
    sketched, known = _grouped(docs, id_col, text_col, width, percent, exact)
    ids = known.groupBy("comp").agg(F.min("_id").alias("component_id"))
    out = sketched.select("_id", "n_shingles", "name").join(known.join(ids, "comp").select("name", "component_id"), "name", "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(id_col), "n_shingles", alone.alias("component_id"), F.col("_id").eqNullSafe(alone).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the least id; copies of that row, equal in id and text, go too.

    Rows are told apart by id and text: rows without an id, or of one id, stay if their texts are in different groups.
    """
    _, known = _grouped(docs, id_col, text_col, width, percent)
    reps = known.groupBy("comp").agg(_least_row().alias("rep")).select("rep._id", "rep._th")
    blank = F.col(f"`{text_col}`").isNull() | ~F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]")
    texts = docs.where(~blank).select(*row_key(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_rest"))
    stay = texts.join(reps, same_row(texts, reps), "left_semi").dropDuplicates(["_id", "_th"])
    return stay.select(*[F.col("_rest").getField(c).alias(c) for c in docs.columns]).unionByName(docs.where(blank))


def brute_force(texts: list[str | None], width: int, percent: int) -> tuple[list[int], list[int]]:
    """The definition, for tests: set sizes, and for each text the least index that it reaches."""
    import re

    sets = []
    for t in texts:
        raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0d]+", raw)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    label = list(range(len(texts)))

    def find(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]

