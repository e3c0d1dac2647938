"""Merkle manifest of a table: a tree of digests for every group of rows, a tree over the groups, and a proof for every row.

Rows are range-sorted by group and order, and each range keeps its leaves in
runs of at most ``RUN`` leaves of one group.  The leaves of each group in each
range are counted, and sums of these counts over the ranges before give every
run its place in its group.  Then

* each run builds the complete aligned subtrees above its own leaves;
* nodes whose siblings stand in other runs, a few at each level, are shuffled by
  their coordinate (group, level, index) in blocks of ``SPAN`` levels, each of
  which is finished by one task, until one node of each group is left;
* these subroots are the leaves of the upper tree, which is built by the same steps;
* each run asks for the nodes beside its own way to the root, and makes the proofs of its rows.

A digest is the lowercase hex SHA-256 of its inputs, one after another; digests
enter others as hex text.  No task holds more than a run or a block, however
large a group is, and however many groups there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batch, arrow_type, list_parts, one_array

#: Leaves of a run at most.
RUN = 4096
#: Levels that one round of the upper part finishes.
SPAN = 7

_STEPS = "array<struct<left:string,right:string>>"


def digest(*values: Column) -> Column:
    """The leaf of a row: ``-`` for a null, else the value's UTF-8 byte count, a colon and the value."""
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _parent(children: list[bytes]) -> bytes:
    return sha256(b"".join(children)).hexdigest().encode()


def _climb(at: int, leaves: list[bytes], size: int, fanout: int) -> list[tuple[int, int, list[bytes]]]:
    """Levels above a run of leaves, as far as their children all stand in it: (nodes of the whole level, first index, nodes)."""
    levels = [(size, at, leaves)]
    while size > 1:
        upper = -(-size // fanout)
        first = -(-at // fanout)
        end = upper if at + len(leaves) == size else (at + len(leaves)) // fanout
        if first >= end:
            break
        leaves = [_parent(leaves[k * fanout - at : (k + 1) * fanout - at]) for k in range(first, end)]
        at, size = first, upper
        levels.append((size, at, leaves))
    return levels


def _height(size: int, fanout: int) -> int:
    h = 0
    while size > 1:
        size, h = -(-size // fanout), h + 1
    return h


@dataclass
class Tree:
    """Stored runs of a tree's leaves, with what stands beside and above them.

    runs: ``part, no`` (key of the run), ``keys, leaves, others``;
    places: ``part, no``, its group ``_g``, the number ``n`` of its leaves, where they stand (``at``) among the ``size`` of the group;
    beside: ``part, no, beside``, the nodes next to a run's way up that it can't build itself;
    tops: ``_g, top``, one row a group.
    """

    runs: DataFrame
    places: DataFrame
    beside: DataFrame
    tops: DataFrame


def _packed(key_type: pa.DataType, group_type: pa.DataType, run: int):
    """Sorted rows to runs of one group: range number, run number, group, leaves of the group before it in this range."""
    schema = pa.schema([("part", pa.int32()), ("no", pa.int64()), ("_g", group_type), ("before", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(key_type)), ("leaves", pa.list_(pa.binary())), ("others", pa.list_(pa.binary()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, before = TaskContext.get().partitionId(), 0, 0
        last: list = []  # the group of the row before, once there is one
        for batch in batches:
            groups = one_array(batch.column("_g")).to_pylist()
            edges = {i for i, g in enumerate(groups) if (groups[i - 1] != g if i else last != [g])}
            bounds = sorted({0, *edges, len(groups)})
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if lo in edges:
                    before = 0
                for a in range(lo, hi, run):
                    z = min(a + run, hi)
                    lists = [pa.ListArray.from_arrays(pa.array([0, z - a], pa.int32()), one_array(batch.column(c)).slice(a, z - a)) for c in ("_key", "_leaf", "_other")]
                    yield arrow_batch(schema, [part], [no], pa.array([groups[a]], group_type), [before], [z - a], *lists)
                    no, before = no + 1, before + z - a
            if groups:
                last = [groups[-1]]

    return apply


def _node_schema(group_type: pa.DataType) -> pa.Schema:
    return pa.schema([("_g", group_type), ("size", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.binary()), ("lone", pa.bool_())])


def _edge_nodes(group_type: pa.DataType, fanout: int):
    """Of every run: the group's top if the run has the whole group, else the nodes that no parent within the run takes."""
    schema = _node_schema(group_type)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes = batch.column("at").to_pylist(), batch.column("size").to_pylist()
            for i in range(len(batch)):
                leaves = [x.hex().encode() for x in batch.column("leaves")[i].as_py()]
                levels = _climb(at[i], leaves, sizes[i], fanout)
                out = []
                for k, (_, first, nodes) in enumerate(levels):
                    lo, hi = (levels[k + 1][1] * fanout, (levels[k + 1][1] + len(levels[k + 1][2])) * fanout) if k + 1 < len(levels) else (0, 0)
                    out += [(k, first + j, x) for j, x in enumerate(nodes) if not lo <= first + j < hi]
                level, idx, made = zip(*out, strict=True)
                yield arrow_batch(schema, one_array(batch.column("_g")).take(pa.array([i] * len(out))), [sizes[i]] * len(out), level, idx, [bytes.fromhex(x.decode()) for x in made], [len(leaves) == sizes[i]] * len(out))

    return apply


def _finish_block(fanout: int, top: int, schema: pa.Schema):
    """Builds every parent of the nodes of one block, up to level ``top``; a parent that isn't local to a run has all its children here."""

    def apply(block: pa.Table) -> pa.Table:
        whole = size = block["size"][0].as_py()
        have: dict[int, dict[int, bytes]] = {}
        for k, i, d in zip(*(block[c].to_pylist() for c in ("level", "idx", "digest")), strict=True):
            have.setdefault(k, {})[i] = d.hex().encode()
        level, made = min(have), []
        for _ in range(level):
            size = -(-size // fanout)
        while level < top and size > 1:
            nodes, upper = have.get(level, {}), have.setdefault(level + 1, {})
            for p in sorted({i // fanout for i in nodes}):
                upper[p] = _parent([nodes[c] for c in range(p * fanout, min((p + 1) * fanout, size))])
                made.append((level + 1, p, bytes.fromhex(upper[p].decode())))
            level, size = level + 1, -(-size // fanout)
        group = one_array(block["_g"]).take(pa.array([0] * len(made), pa.int64()))
        columns = [group, [whole] * len(made), *([m[j] for m in made] for j in range(3)), [False] * len(made)]
        return pa.Table.from_batches([arrow_batch(schema, *columns)])

    return apply


def _wanted(group_type: pa.DataType, fanout: int):
    """The coordinates beside each run's way up that the run can't build itself."""
    schema = pa.schema([("part", pa.int32()), ("no", pa.int64()), ("_g", group_type), ("level", pa.int32()), ("idx", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, level, idx = [], [], []
            for i, (at, n, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "n", "size")), strict=True)):
                own, own_end, lo, hi, k = at, at + n, at, at + n - 1, 0  # built here: own..own_end; on the way: lo..hi
                while size > 1:
                    for c in range(lo // fanout * fanout, min((hi // fanout + 1) * fanout, size)):
                        if not own <= c < own_end:
                            rows.append(i)
                            level.append(k)
                            idx.append(c)
                    upper = -(-size // fanout)
                    own, own_end = -(-own // fanout), upper if own_end == size else own_end // fanout
                    lo, hi, size, k = lo // fanout, hi // fanout, upper, k + 1
                    if own >= own_end:
                        own, own_end = size, -1  # nothing further up is built here
            take = pa.array(rows, pa.int64())
            yield arrow_batch(schema, *[one_array(batch.column(c)).take(take) for c in ("part", "no", "_g")], level, idx)

    return apply


def build_tree(rows: DataFrame, order: list[str], scratch: Scratch, fanout: int = 3, run: int = RUN) -> Tree:
    """The tree of every group over stored ``rows`` of ``_g, _key, _leaf, _other`` and the columns of ``order``."""
    key, group = rows.schema["_key"].dataType.simpleString(), rows.schema["_g"].dataType.simpleString()
    group_type = arrow_type(rows, "_g")
    ranged = rows.repartitionByRange("_g", *order).sortWithinPartitions("_g", *order).select("_g", "_key", "_leaf", "_other")
    runs = scratch.stored(ranged.mapInArrow(_packed(arrow_type(rows, "_key"), group_type, run), f"part int, no bigint, _g {group}, before bigint, n bigint, keys array<{key}>, leaves array<binary>, others array<binary>"))
    # One row for each range that a group has leaves in; all but the first row of a range's groups begin there.
    counted = runs.groupBy("_g", "part").agg(F.sum("n").alias("c"))
    over = Window.partitionBy("_g")
    placed = scratch.stored(counted.select("_g", "part", F.coalesce(F.sum("c").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("c").over(over).alias("size")))
    small = runs.select("part", "no", "_g", "before", "n")
    near = small.join(placed, (small["part"] == placed["part"]) & small["_g"].eqNullSafe(placed["_g"]))
    places = scratch.stored(near.select(small["part"], small["no"], small["_g"], (F.col("before") + F.col("offset")).alias("at"), "n", "size"))
    level_of = f"_g {group}, size bigint, level int, idx bigint, digest binary, lone boolean"
    joined = runs.select("part", "no", "_g", "leaves").join(places.drop("_g", "n"), ["part", "no"])
    edge = scratch.stored(joined.mapInArrow(_edge_nodes(group_type, fanout), level_of))
    # Groups of several runs go on; a group of one run is its own top already.
    high = places.where("n < size").agg(F.max("size")).first()[0]
    nodes, floor = edge, None
    for low in range(0, _height(high, fanout) if high else 0, SPAN):
        part = edge.where((F.col("level") >= low) & (F.col("level") < low + SPAN))
        part = part if floor is None else part.unionByName(floor)
        width = F.pow(F.lit(float(fanout)), low + SPAN - F.col("level"))
        blocks = part.where("not lone").withColumn("block", F.floor(F.col("idx") / width))
        floor = scratch.stored(blocks.groupBy("_g", "block").applyInArrow(_finish_block(fanout, low + SPAN, _node_schema(group_type)), level_of))
        nodes = nodes.unionByName(floor)
        floor = floor.where(F.col("level") == low + SPAN)
    heights = F.lit(0)
    for h in range(1, 64):
        if fanout**h >= 1 << 62:
            break
        heights = heights + (F.col("size") > fanout ** (h - 1)).cast("int")
    tops = scratch.stored(nodes.where(F.col("level") == heights).select("_g", F.col("digest").alias("top")))
    asked = places.where("n < size").select("part", "no", "_g", "at", "n", "size").mapInArrow(_wanted(group_type, fanout), f"part int, no bigint, _g {group}, level int, idx bigint")
    met = asked.join(nodes, asked["_g"].eqNullSafe(nodes["_g"]) & (asked["level"] == nodes["level"]) & (asked["idx"] == nodes["idx"]))
    beside = scratch.stored(met.groupBy(asked["part"], asked["no"]).agg(F.collect_list(F.struct(asked["level"], asked["idx"], nodes["digest"])).alias("beside")))
    return Tree(runs.select("part", "no", "keys", "leaves", "others"), places, beside, tops)


def _steps(at: int, leaves: list[bytes], size: int, beside: list[tuple[int, int, bytes]], fanout: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """For every leaf of a run, level by level, the siblings left and right of its way to the group's top."""
    known: list[dict[int, bytes]] = [{} for _ in range(_height(size, fanout) + 1)]
    for k, (_, first, nodes) in enumerate(_climb(at, leaves, size, fanout)):
        known[k].update(enumerate(nodes, first))
    for k, i, d in beside:
        known[k][i] = d
    sizes = [size]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // fanout))
    # Top down, so that what leaves have in common is made once.
    above: dict[int, list[tuple[bytes, bytes]]] = {0: []}
    for k in range(len(sizes) - 2, 0, -1):
        lo, hi = at // fanout**k, (at + len(leaves) - 1) // fanout**k
        above = {i: [_beside(known[k], i, sizes[k], fanout), *above[i // fanout]] for i in range(lo, hi + 1)}
    for i in range(at, at + len(leaves)):
        yield [_beside(known[0], i, size, fanout), *above[i // fanout]] if size > 1 else []


def _beside(nodes: dict[int, bytes], i: int, size: int, fanout: int) -> tuple[bytes, bytes]:
    first = i // fanout * fanout
    return b"".join(nodes[c] for c in range(first, i)), b"".join(nodes[c] for c in range(i + 1, min(first + fanout, size)))


def _fold(node: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in steps:
        node = sha256(left + node + right).hexdigest().encode()
    return node


def _entries(column: pa.Array) -> list[list[tuple[int, int, bytes]]]:
    offs, items = list_parts(column)
    level, idx, made = (items.field(c).to_pylist() for c in ("level", "idx", "digest"))
    rows = [(k, i, d.hex().encode()) for k, i, d in zip(level, idx, made, strict=True)]
    return [rows[a:z] for a, z in zip(offs, offs[1:], strict=False)]


def _leaf_steps(key_type: pa.DataType, fanout: int):
    """Runs to one row a leaf: its key and its steps (of the upper tree, where they are few)."""
    schema = pa.schema([("_key", key_type), ("steps", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beside = _entries(batch.column("beside"))
            for i in range(len(batch)):
                leaves = [x.hex().encode() for x in batch.column("leaves")[i].as_py()]
                made = [[{"left": a.decode(), "right": z.decode()} for a, z in s] for s in _steps(batch.column("at")[i].as_py(), leaves, batch.column("size")[i].as_py(), beside[i], fanout)]
                yield arrow_batch(schema, one_array(batch.column("keys").slice(i, 1)).flatten(), pa.array(made, schema.field("steps").type))

    return apply


def _proofs(key_type: pa.DataType, fanout: int, root: bytes):
    schema = pa.schema([("_key", key_type), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beside = _entries(batch.column("beside"))
            for i in range(len(batch)):
                leaves = [x.hex().encode() for x in batch.column("leaves")[i].as_py()]
                others = batch.column("others")[i].as_py()
                last = [(s["left"].encode(), s["right"].encode()) for s in batch.column("steps")[i].as_py()]
                rest = b"".join(a + z for a, z in last)
                proof, folded = [], []
                for leaf, other, steps in zip(leaves, others, _steps(batch.column("at")[i].as_py(), leaves, batch.column("size")[i].as_py(), beside[i], fanout), strict=True):
                    proof.append(sha256(b"".join([x for step in steps for x in step]) + rest).hexdigest())
                    folded.append(_fold(_fold(other.hex().encode() if other is not None else leaf, steps), last))
                n, top = len(leaves), batch.column("top")[i].as_py().hex()
                yield arrow_batch(schema, one_array(batch.column("keys").slice(i, 1)).flatten(), [x.decode() for x in leaves], [top] * n, [root.decode()] * n, proof, [x.decode() for x in folded], np.array([x == root for x in folded]))

    return apply


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", value_cols: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), other: Column | None = None, fanout: int = 3, run: int = RUN) -> DataFrame:
    """One row per input row: ``id_col, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Leaves are :func:`digest` of ``value_cols``; within a group they ascend by
    ``id_col``, null first, rows of one id by their digest.  Every ``fanout``
    consecutive nodes make one, the last run of a level with what it has, until
    one is left; the groups' tops, null group first and then by bytes, likewise
    make the root.  ``proof_sha256`` is the digest of all siblings on the way
    from leaf to root, of nothing at all for the only row of the only group.
    ``folded_root`` follows that way from ``other`` (a hex leaf; null: the row's
    own), and ``verified`` says whether it ends in the root.

    Nulls and empty values make different leaves, repeated rows are leaves of
    their own, values of any length are digested whole, an empty table gives an
    empty result, and further columns are ignored whatever their names.
    """
    scratch = Scratch()
    kind = docs.schema[id_col].dataType.simpleString()
    one = {c: F.col(f"`{c}`") for c in {id_col, group_col, *value_cols}}
    leaf = digest(*[one[c] for c in value_cols])
    rows = docs.select(one[group_col].alias("_g"), one[id_col].alias("_key"), F.unhex(leaf).alias("_leaf"), F.unhex(other if other is not None else F.lit(None).cast("string")).alias("_other"), F.monotonically_increasing_id().alias("_row"))
    rows = scratch.stored(rows)  # texts are read and digested once, and rows keep their number
    lower = build_tree(rows, ["_key", "_leaf", "_row"], scratch, fanout, run)
    tops = lower.tops.select(F.lit(0).alias("_g"), F.col("_g").alias("_key"), F.col("top").alias("_leaf"), F.lit(None).cast("binary").alias("_other"))
    upper = build_tree(tops, ["_key"], scratch, fanout, run)
    scratch.drop(rows)
    first = upper.tops.first()
    group = rows.schema["_g"].dataType.simpleString()
    around = upper.places.select("part", "no", "at", "size").join(upper.beside, ["part", "no"], "left")
    near = upper.runs.select("part", "no", "keys", "leaves").join(around, ["part", "no"])
    steps = scratch.stored(near.mapInArrow(_leaf_steps(arrow_type(rows, "_g"), fanout), f"_key {group}, steps {_STEPS}"))
    where = lower.places.select("part", "no", "_g", "at", "size")
    high = where.join(steps, where["_g"].eqNullSafe(steps["_key"])).join(lower.tops, where["_g"].eqNullSafe(lower.tops["_g"])).select("part", "no", "at", "size", "steps", "top")
    full = lower.runs.join(high.join(lower.beside, ["part", "no"], "left"), ["part", "no"])
    root = bytes(first["top"]).hex().encode() if first else b""
    schema = f"_key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return full.mapInArrow(_proofs(arrow_type(rows, "_key"), fanout, root), schema).withColumnRenamed("_key", id_col)


def brute_force(groups: list, leaves: list[str], others: list[str | None], fanout: int = 3) -> list[tuple[str, str, str, str, bool]]:
    """The definition, for tests, over rows already in order: (subroot, root, proof_sha256, folded_root, verified) by row."""

    def h(*parts: str) -> str:
        return sha256("".join(parts).encode()).hexdigest()

    def rise(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
        """The top, and the siblings of every node level by level."""
        ways: list[list[tuple[str, str]]] = [[] for _ in nodes]
        below = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            cut = [(nodes[i : i + fanout], below[i : i + fanout]) for i in range(0, len(nodes), fanout)]
            for part, own in cut:
                for k, members in enumerate(own):
                    for m in members:
                        ways[m].append(("".join(part[:k]), "".join(part[k + 1 :])))
            nodes, below = [h(*part) for part, _ in cut], [sum(own, []) for _, own in cut]
        return nodes[0], ways

    names = list(dict.fromkeys(groups))
    lower = {g: rise([x for x, y in zip(leaves, groups, strict=True) if y == g]) for g in names}
    root, upper = rise([lower[g][0] for g in names]) if names else ("", [])
    seen: dict = {}
    out = []
    for g, leaf, other in zip(groups, leaves, others, strict=True):
        i = seen[g] = seen.get(g, -1) + 1
        way = lower[g][1][i] + upper[names.index(g)]
        node = other if other is not None else leaf
        for left, right in way:
            node = h(left, node, right)
        out.append((lower[g][0], root, h(*[x for step in way for x in step]), node, node == root))
    return out
