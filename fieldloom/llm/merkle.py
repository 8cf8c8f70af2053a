"""Merkle manifest of a table: a hash tree of eight children per node for each group, and one over the
groups' roots, stored in van Emde Boas layout.

A leaf is the SHA-256 of a row's fields.  Within a group leaves ascend by key; every eight
neighbours (fewer at the end) are hashed into their parent until one node is left, the subroot.
The subroots, ordered by group, form a last tree of the same kind.  Digests are hashed as lower-case
hexadecimal text.

A tree is cut into blocks: aligned subtrees of ``HEIGHT`` steps, ``8 ** HEIGHT`` leaves at most.  A block is
one row whose nodes lie in one binary value in van Emde Boas order: the upper half of its levels
first, then each of the subtrees below, each laid out the same way.  ``addresses`` is the only
place that knows this order; construction writes through it and sibling retrieval reads through it.
Block roots are the leaves of the next blocks, so a tree of any size takes a few rounds, each over
a 4096th of the rows before.  Going down again, every block passes the sibling runs above it to
the blocks below, so that a proof needs one block and one path of runs, never the tree.

Leaves get their places from a range partitioning by (group, key, leaf) and counts per partition,
so that a group of a third of all rows is spread over many partitions and no window spans a group.

Null groups come first, null keys come first in their group, rows of equal keys are ordered by
leaf.  Null fields are told apart from empty ones.  Repeated rows are leaves of their own.  An empty
table has no rows and no root; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.shared import Batches, stored
from fieldloom.session import sized_broadcast

FAN_BITS = 3
FAN = 1 << FAN_BITS
HEIGHT = 4
HEX = 64
RAW = 32
PATH = "array<struct<place:int,run:binary>>"
_PATH = pa.list_(pa.struct([("place", pa.int32()), ("run", pa.binary())]))


def hashed(hexes: str) -> str:
    return sha256(hexes.encode()).hexdigest()


def size(levels: int) -> int:
    """Nodes of a complete tree of that many levels."""
    return ((1 << FAN_BITS * levels) - 1) // (FAN - 1)


@lru_cache(64)
def addresses(levels: int, depth: int) -> np.ndarray:
    """Slots of all nodes at ``depth`` of a tree of ``levels`` levels in van Emde Boas order."""
    if levels == 1:
        return np.zeros(1, np.int64)
    top = levels // 2
    if depth < top:
        return addresses(top, depth)
    below = addresses(levels - top, depth - top)
    bases = size(top) + size(levels - top) * np.arange(1 << FAN_BITS * top)
    return (bases[:, None] + below[None, :]).reshape(-1)


class Block:
    """An aligned subtree: hexadecimal digests by slot."""

    def __init__(self, levels: int, n: int, slots: list[str]):
        self.levels, self.n, self.slots = levels, n, slots

    @classmethod
    def build(cls, leaves: list[str], levels: int) -> "Block":
        block = cls(levels, len(leaves), [""] * size(levels))
        for a, leaf in zip(addresses(levels, levels - 1).tolist(), leaves):
            block.slots[a] = leaf
        for depth in range(levels - 2, -1, -1):
            for a, run in zip(addresses(levels, depth).tolist(), block.runs(depth + 1)):
                block.slots[a] = hashed(run)
        return block

    @classmethod
    def load(cls, levels: int, n: int, data: bytes) -> "Block":
        text = data.hex()
        return cls(levels, n, [text[i : i + HEX] for i in range(0, len(text), HEX)])

    def dump(self) -> bytes:
        return bytes.fromhex("".join(s or "0" * HEX for s in self.slots))

    def width(self, depth: int) -> int:
        """Nodes present at ``depth``."""
        return -(-self.n >> FAN_BITS * (self.levels - 1 - depth)) if self.n else 0

    def row(self, depth: int) -> list[str]:
        return [self.slots[a] for a in addresses(self.levels, depth)[: self.width(depth)].tolist()]

    def runs(self, depth: int) -> list[str]:
        """Concatenated digests of every eight neighbours at ``depth``."""
        row = self.row(depth)
        return ["".join(row[i : i + FAN]) for i in range(0, len(row), FAN)]


def siblings(place: int, run: str) -> str:
    return run[: HEX * place] + run[HEX * (place + 1) :]


def fold(digest: str, path: list[tuple[int, str]]) -> str:
    """The root that follows from a node's digest and the sibling runs above it."""
    for place, run in path:
        digest = hashed(run[: HEX * place] + digest + run[HEX * (place + 1) :])
    return digest


class Manifest(NamedTuple):
    """``base``: blocks of leaves (tree, block, levels, n, data, keys, found); ``upper``: blocks above them,
    level by level; ``subroots``: (tree, digest, n) per group; ``top``: blocks over the subroots, level by
    level; ``places``: (tree, idx) of the subroots; ``root``: None for an empty table."""

    base: DataFrame
    upper: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    places: DataFrame
    root: str | None


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def ranked(rows: DataFrame, group: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``idx``, (group, n)): places from 0 in each group, by ``order``.

    The last key tells equal rows apart, which may then lie in different partitions.
    """
    at = "monotonically_increasing_id() & 8589934591"  # the row's place in its partition
    keyed = rows.withColumn("_at", F.monotonically_increasing_id())
    cut = keyed.repartitionByRange(group, *order, "_at").sortWithinPartitions(group, *order, "_at").drop("_at")
    cut = stored(cut.withColumns({"_part": F.spark_partition_id(), "_seq": F.expr(at)}))
    parts = cut.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")
    parts = stored(parts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_n", (before - F.col("_first")).alias("_shift")))
    few = sized_broadcast(parts.select("_g", "_p", "_shift"), parts.count(), 64)
    joined = cut.join(few, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    counts = parts.groupBy("_g").agg(F.sum("_n").alias("n")).withColumnRenamed("_g", group)
    return joined.withColumn("idx", F.col("_seq") + F.col("_shift")).select(*rows.columns, "idx"), counts


def _height(n: str) -> Column:
    """Steps from ``n`` leaves to one root."""
    return F.expr(f"size(filter(sequence(0, 20), k -> shiftleft(1L, {FAN_BITS} * k) < {n}))")


def _blocks(nodes: DataFrame, tree_type: str, extra: dict[str, str]) -> DataFrame:
    """Blocks of (tree, idx, height, digest): ``height`` steps are left to the root.

    ``extra`` columns become arrays beside the leaves.
    """
    span = 1 << FAN_BITS * HEIGHT
    names = ["tree", "block", "levels", "n", "root", "data", *extra]
    ddl = f"tree {tree_type}, block bigint, levels int, n int, root string, data binary" + "".join(
        f", {c} array<{t}>" for c, t in extra.items())

    def build(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("idx").combine_chunks()
        leaves = [d.hex() for d in group.column("digest").to_pylist()]
        block = Block.build(leaves, min(HEIGHT, group.column("height")[0].as_py()) + 1)
        arrays = [group.column("tree").slice(0, 1).combine_chunks(), pa.array([key[1].as_py()], pa.int64()),
                  pa.array([block.levels], pa.int32()), pa.array([block.n], pa.int32()), pa.array([block.slots[0]]),
                  pa.array([block.dump()], pa.binary())]
        for c in extra:
            values = group.column(c).combine_chunks()
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        return pa.Table.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], names)

    cut = nodes.withColumn("block", F.expr(f"idx DIV {span}"))
    return stored(cut.groupBy("tree", "block").applyInArrow(build, ddl))


def _rise(base: DataFrame, tree_type: str) -> tuple[list[DataFrame], DataFrame]:
    """(blocks above ``base`` level by level, (tree, digest) roots)."""
    levels, roots, now, height = [], [], base, HEIGHT
    while True:
        # Blocks that hold the root of their tree have no neighbour.
        counted = now.groupBy("tree").agg(F.max("block").alias("most"))
        several = stored(counted.where("most > 0").select(F.col("tree").alias("t"), "most"))
        few = sized_broadcast(several, several.count(), 64)
        match = F.col("tree").eqNullSafe(F.col("t"))
        roots.append(now.join(few, match, "left_anti").select("tree", F.col("root").alias("digest")))
        if several.isEmpty():
            break
        rest = now.join(few, match)
        nodes = rest.select("tree", F.col("block").alias("idx"), _height("(most + 1)").alias("height"), F.unhex("root").alias("digest"))
        now = _blocks(nodes, tree_type, {})
        levels.append(now)
    out = roots[0]
    for more in roots[1:]:
        out = out.union(more)
    return levels, stored(out)


def build(docs: DataFrame, fields: list[str], group_col: str, key_col: str, found: list[Column] | None = None,
          changed: Column | None = None) -> Manifest:
    """Manifest of ``docs`` over ``fields``.

    Where ``changed`` holds, the leaf of the fields as ``found`` now is kept beside the manifest's, for
    ``verified``; elsewhere a row is found as it was.
    """
    leaf = F.unhex(leaf_digest(*map(F.col, fields)))
    other = F.when(changed, F.unhex(leaf_digest(*found))) if found else F.lit(None).cast("binary")
    rows = docs.select(F.col(group_col).alias("tree"), F.col(key_col).cast("long").alias("key"), leaf.alias("digest"), other.alias("found"))
    placed, counts = ranked(rows, "tree", "key", "digest")
    counts = stored(counts.select(F.col("tree").alias("t"), _height("n").alias("height"), "n"))
    few = sized_broadcast(counts, counts.count(), 64)
    nodes = placed.join(few, F.col("tree").eqNullSafe(F.col("t"))).select("tree", "idx", "height", "digest", "key", "found")
    kind = rows.schema["tree"].dataType.simpleString()
    base = _blocks(nodes, kind, {"key": "bigint", "found": "binary"})
    upper, subroots = _rise(base, kind)

    leaves, _ = ranked(subroots.select(F.lit(0).alias("one"), "tree", F.unhex("digest").alias("digest")), "one", "tree", "digest")
    total = subroots.count()
    places = stored(leaves.select(F.lit(0).alias("one"), "tree", "idx", "digest"))
    first = _blocks(places.select(F.col("one").alias("tree"), "idx", _height(f"{total}L").alias("height"), "digest"), "int", {})
    more, root = _rise(first, "int")
    last = root.first()
    return Manifest(base, upper, subroots, [first, *more], places.select("tree", "idx"), last and last["digest"])


def _descend(blocks: DataFrame, above: DataFrame | None, tree_type: str) -> DataFrame:
    """(tree, idx, path): the sibling runs from every leaf of ``blocks`` to the last root.

    ``above`` has (tree, idx, path) of the blocks themselves; without it they are the last.
    """
    if above is None:
        rows = blocks.withColumn("path", F.array().cast(PATH))
    else:
        up = above.select(F.col("tree").alias("t"), F.col("idx").alias("i"), "path")
        rows = blocks.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("i")))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                levels, n, data, number, path = (row.column(c)[0].as_py() for c in ("levels", "n", "data", "block", "path"))
                block = Block.load(levels, n, data)
                rest = [(x["place"], x["run"]) for x in path]
                runs = {depth: [bytes.fromhex(r) for r in block.runs(depth)] for depth in range(1, levels)}
                for low in range(0, n, 256):
                    paths = []
                    for leaf in range(low, min(n, low + 256)):
                        own, at = [], leaf
                        for depth in range(levels - 1, 0, -1):
                            own.append((at % FAN, runs[depth][at // FAN]))
                            at //= FAN
                        paths.append([{"place": p, "run": r} for p, r in own + rest])
                    first = number * (1 << FAN_BITS * HEIGHT) + low
                    tree = pa.concat_arrays([row.column("tree")] * len(paths))
                    yield pa.RecordBatch.from_arrays(
                        [tree, pa.array(range(first, first + len(paths)), pa.int64()), pa.array(paths, _PATH)], ["tree", "idx", "path"])

    return rows.select("tree", "block", "levels", "n", "data", "path").mapInArrow(run, f"tree {tree_type}, idx bigint, path {PATH}")


def paths_above(manifest: Manifest) -> DataFrame:
    """(tree, idx, path) of every block of leaves: the sibling runs above the block."""
    above = None
    for blocks in reversed(manifest.top):
        above = stored(_descend(blocks, above, "int"))
    kind = manifest.places.schema["tree"].dataType.simpleString()
    at = above.select(F.col("idx").alias("i"), "path")
    few = sized_broadcast(at, manifest.places.count(), 4096)
    last = stored(manifest.places.join(few, F.col("idx") == F.col("i")).select("tree", F.lit(0).cast("long").alias("idx"), "path"))
    # Trees end at different levels: a block without neighbours starts from its subroot.
    above = last
    for blocks in reversed(manifest.upper):
        below = _descend(blocks, above, kind)
        inner = stored(below)
        done = inner.select(F.col("tree").alias("t")).distinct()
        above = inner.union(last.join(done, F.col("tree").eqNullSafe(F.col("t")), "left_anti"))
    return above


def verified(manifest: Manifest, with_siblings: bool = False) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``folded_root`` is recomputed from the leaf found now and the manifest's sibling runs;
    ``proof_sha256`` is the digest of all siblings.  ``with_siblings`` adds them as hexadecimal text.
    """
    up = paths_above(manifest).select(F.col("tree").alias("t"), F.col("idx").alias("i"), "path")
    subs = manifest.subroots.select(F.col("tree").alias("s"), F.col("digest").alias("subroot"))
    subs = sized_broadcast(subs, manifest.places.count(), 256)
    rows = manifest.base.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("i")))
    rows = rows.join(subs, F.col("tree").eqNullSafe(F.col("s")))
    names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    names += ["siblings"] if with_siblings else []
    root = manifest.root

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block = Block.load(*(row.column(c)[0].as_py() for c in ("levels", "n", "data")))
                path = [(x["place"], x["run"].hex()) for x in row.column("path")[0].as_py()]
                tail = "".join(siblings(*x) for x in path)
                keys = row.column("key")[0].values
                found = row.column("found")[0].as_py()
                subroot = row.column("subroot")[0].as_py()
                runs = {depth: block.runs(depth) for depth in range(1, block.levels)}
                # What follows the leaf's own siblings in a proof, from the block's root down.
                behind = [tail]
                for depth in range(1, block.levels - 1):
                    behind = [siblings(k % FAN, runs[depth][k // FAN]) + behind[k // FAN] for k in range(block.width(depth))]
                leaves = block.row(block.levels - 1)
                proofs, folded, last = [], [], block.levels - 1
                for k, leaf in enumerate(leaves):
                    own, at = [], k
                    for depth in range(last, 0, -1):
                        own.append((at % FAN, runs[depth][at // FAN]))
                        at //= FAN
                    proofs.append((siblings(*own[0]) + behind[k // FAN]) if own else tail)
                    folded.append(fold(found[k].hex() if found[k] is not None else leaf, own + path))
                columns = [keys, pa.array(leaves), pa.repeat(subroot, len(leaves)), pa.repeat(root, len(leaves)),
                           pa.array([hashed(p) for p in proofs]), pa.array(folded), pa.array([f == root for f in folded])]
                columns += [pa.array(proofs)] if with_siblings else []
                yield pa.RecordBatch.from_arrays(columns, names)

    ddl = "key bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    picked = rows.select("levels", "n", "data", "path", "key", "found", "subroot")
    return picked.mapInArrow(run, ddl + (", siblings string" if with_siblings else ""))
