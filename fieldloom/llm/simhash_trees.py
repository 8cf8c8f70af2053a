"""SimHash near-duplicates with Burkhard-Keller trees over shards of fingerprints.

A text is lower-cased (A-Z), cut into words at white space and into shingles of ``WIDTH`` words,
repeats included, joined by one space; a shorter text is one shingle.  Bit i of the fingerprint is set
where it is set in more than half of the shingles' XXH64 digests (seed 42).  A text without words has
fingerprint zero.  Fingerprints that differ in at most ``RADIUS`` bits are linked, and
``component_id`` is the least id reachable over links.

Equal fingerprints are one class, and only classes are compared.  The 64 bits are cut into
``RADIUS + k`` blocks: two fingerprints within the radius agree on k of them at least.  For every choice
of k blocks, the classes that agree on these bits are a *group*; k grows with the counted number of
classes, so that chance groups stay near ``GROUP`` classes at any size.  A group is a shard with a
tree of its own, and a group beyond ``SHARD`` classes is dealt over several shards.

In a tree, the children of a node are keyed by their Hamming distance to it.  An insertion measures
the distance to every ancestor, so pairs within the radius that meet on the way are links already.
A class outside its group's main component then searches the group's trees, following only
edges whose key is within the radius of its distance to the node; members of the main component
are linked and need no search, so a family of near copies is not compared pair by pair.  Shard
trees are broadcast to the searches where their counted size allows, and joined by group beyond.

Null and empty texts have fingerprint zero and link like any other.  Rows with a null id keep their
fingerprint, have a null component and link nothing.  Repeated ids keep one row per input row.  An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.shared import Batches, arrow_map, components, signed, stored
from fieldloom.llm.text import Block, blocks, gather_spans
from fieldloom.session import sized_broadcast

WIDTH = 4
RADIUS = 4
BITS = 64
SEED = 42
GROUP = 128
SHARD = 4096
SLICE = 1 << 16
FRONTIER = 1 << 21


def _shingle_spans(block: Block, width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(words of the block, one space between, starts, ends, text) of all shingles, text by text."""
    block.find_words()
    lengths, data = gather_spans(block.data, block.starts, block.ends)
    joined = np.full(data.size + lengths.size, 32, np.uint8)
    joined[np.arange(data.size) + np.repeat(np.arange(lengths.size), lengths)] = data
    end = np.cumsum(lengths + 1) - 1
    begin = end - lengths
    count = np.diff(block.first)
    full = block.windows(width)
    short = np.flatnonzero((count > 0) & (count < width))
    first = np.concatenate([full, block.first[short]])
    last = np.concatenate([full + width, block.first[short + 1]]) - 1
    text = np.concatenate([np.repeat(np.arange(block.n), np.maximum(count - width + 1, 0)), short])
    order = np.argsort(text, kind="stable")
    return joined.tobytes(), begin[first[order]], end[last[order]], text[order]


def block_fingerprints(block: Block, width: int = WIDTH) -> np.ndarray:
    """Fingerprints of a block of lower-cased texts."""
    words, starts, ends, text = _shingle_spans(block, width)
    ones = np.zeros((block.n, BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, starts.size, SLICE):
        of = text[low : low + SLICE]
        spans = zip(starts[low : low + SLICE].tolist(), ends[low : low + SLICE].tolist())
        h = np.fromiter((digest(words[a:b], SEED) for a, b in spans), np.uint64, of.size)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        ones[of[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    majority = 2 * ones > np.bincount(text, minlength=block.n)[:, None]
    return np.packbits(majority, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batch):
        at = 0
        for block in blocks(batch.column("text"), lower=True):
            yield {"doc_id": batch.column("doc_id").slice(at, block.n), "fp": signed(block_fingerprints(block, width))}
            at += block.n

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, {"doc_id": "long", "fp": "long"})


class Forest:
    """Trees side by side: ``fp`` and ``tree`` of every node; ``parent`` is -1 for roots; ``edge`` is the
    distance to the parent."""

    def __init__(self, fp: np.ndarray, tree: np.ndarray, parent: np.ndarray, edge: np.ndarray):
        self.fp, self.tree, self.parent, self.edge = fp, tree, parent, edge

    @classmethod
    def grow(cls, fp: np.ndarray, tree: np.ndarray, radius: int) -> tuple["Forest", np.ndarray, np.ndarray]:
        """(forest, a, b): trees of the nodes in the order given, and the near pairs met on the way.

        All nodes descend together, a level at a time: of those that reach the same free
        place, the first takes it, and the others go on below it.
        """
        new = np.append(True, tree[1:] != tree[:-1])
        parent, edge = np.full(fp.size, -1, np.int32), np.zeros(fp.size, np.int8)
        left = np.flatnonzero(~new)
        at = np.flatnonzero(new)[np.cumsum(new) - 1][left]
        near = []
        while left.size:
            d = np.bitwise_count(fp[left] ^ fp[at])
            hit = d <= radius
            near.append((left[hit], at[hit]))
            place = at.astype(np.int64) * (BITS + 1) + d
            order = np.argsort(place, kind="stable")
            first = np.append(True, place[order][1:] != place[order][:-1])
            head = order[first]
            parent[left[head]], edge[left[head]] = at[head], d[head]
            child = left[head][np.cumsum(first) - 1]
            stay = order[~first]
            left, at = left[stay], child[~first]
        a, b = (np.concatenate(x) for x in zip(*near)) if near else (np.zeros(0, np.int64),) * 2
        return cls(fp, tree, parent, edge), a, b

    def search(self, query: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, node) of all pairs within the radius; ``root`` is where each query starts."""
        wide = BITS + 1 + 2 * radius
        child = np.full((self.fp.size, wide), -1, np.int32)
        inner = np.flatnonzero(self.parent >= 0)
        child[self.parent[inner], self.edge[inner] + radius] = inner
        largest = int(np.bincount(self.tree).max()) if self.tree.size else 1
        step, out = max(64, FRONTIER // (largest * 8)), []
        reach = np.arange(2 * radius + 1)
        for low in range(0, query.size, step):
            q = np.arange(low, min(low + step, query.size))
            node = root[q]
            while q.size:
                d = np.bitwise_count(query[q] ^ self.fp[node]).astype(np.int64)
                hit = d <= radius
                out.append((q[hit], node[hit]))
                below = child[node[:, None], d[:, None] + reach]
                row, _ = np.nonzero(below >= 0)
                node = below[below >= 0]
                q = q[row]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component under the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _outside(tree: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Nodes outside the largest component of their tree."""
    size = np.bincount(label, minlength=label.size)
    order = np.lexsort((label, -size[label], tree))
    first = order[np.append(True, tree[order][1:] != tree[order][:-1])]
    main = label[first]
    return np.flatnonzero(label != main[np.searchsorted(tree[first], tree)])


SHARDS = {"choice": "int", "bits": "long", "salt": "int", "fps": "array<long>", "parents": "array<int>", "edges": "array<tinyint>",
          "labels": "array<int>", "outside": "array<long>", "a": "array<long>", "b": "array<long>"}


def _lists(values: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    """``values`` as one list for each of ``n`` owners; ``of`` ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), pa.array(values))


def _plant(choice: np.ndarray, bits: np.ndarray, salt: np.ndarray, fp: np.ndarray, radius: int) -> dict:
    """Shard rows of sorted (choice, bits, salt, fp); a class alone in an undivided group is left out."""
    new = np.append(True, (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1]) | (salt[1:] != salt[:-1]))
    tree = np.cumsum(new) - 1
    keep = (np.bincount(tree)[tree] > 1) | (salt >= 0)
    choice, bits, salt, fp, new = choice[keep], bits[keep], salt[keep], fp[keep], new[keep]
    tree = np.cumsum(new) - 1
    n = int(new.sum())
    forest, a, b = Forest.grow(fp.view(np.uint64), tree, radius)
    label = labels(fp.size, a, b)
    begin = np.flatnonzero(new)
    shift = begin[tree] if n else tree
    outside = _outside(tree, label) if n else tree
    order = np.argsort(tree[a], kind="stable")
    a, b = a[order], b[order]
    return {"choice": choice[begin], "bits": bits[begin], "salt": salt[begin], "fps": _lists(fp, tree, n),
            "parents": _lists(np.where(forest.parent < 0, -1, forest.parent - shift).astype(np.int32), tree, n),
            "edges": _lists(forest.edge, tree, n), "labels": _lists((label - shift).astype(np.int32), tree, n),
            "outside": _lists(fp[outside], tree[outside], n), "a": _lists(fp[a], tree[a], n), "b": _lists(fp[b], tree[a], n)}


def _block_masks(count: int, radius: int, group: int) -> list[int]:
    """Masks of all choices of k among ``radius + k`` blocks, for the least k with small chance groups."""
    k = 1
    while count >> (BITS * k // (radius + k)) > group and k < 4:
        k += 1
    border = [BITS * i // (radius + k) for i in range(radius + k + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(border, border[1:])]
    return [sum(chosen) for chosen in combinations(block, k)]


def shard_trees(classes: DataFrame, count: int, radius: int = RADIUS, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """One row per shard: its tree, local components, classes outside the main one, and links found."""
    masks = _block_masks(count, radius, group)
    whole = lambda m: F.lit(m - (1 << BITS) if m >> (BITS - 1) else m)
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(whole(m)).alias("bits")) for i, m in enumerate(masks)])
    keyed = classes.select("fp", F.inline(choices))
    heavy = stored(keyed.groupBy("choice", "bits").agg(F.count("*").alias("m")).where(F.col("m") > shard))
    several = heavy.count()
    if several:
        keyed = keyed.join(sized_broadcast(heavy, several, 32), ["choice", "bits"], "left")
        parts = F.ceil(F.col("m") / shard).cast("int")
        keyed = keyed.withColumn("salt", F.when(F.col("m").isNull(), -1).otherwise(F.pmod(F.hash("fp"), parts)))
    else:
        keyed = keyed.withColumn("salt", F.lit(-1))
    rows = keyed.select("choice", "bits", "salt", "fp").repartition("choice", "bits", "salt").sortWithinPartitions("choice", "bits", "salt", "fp")

    def run(batches: Batches) -> Batches:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("choice", "bits", "salt", "fp")]))
            size += batch.num_rows
            if size >= SLICE:
                rows = np.concatenate(held, axis=1)
                same = (rows[:3] == rows[:3, -1:]).all(axis=0)
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:
                    yield told(rows[:, :cut])
                held, size = [rows[:, cut:]], rows.shape[1] - cut
        if size:
            yield told(np.concatenate(held, axis=1))

    def told(rows: np.ndarray) -> pa.RecordBatch:
        out = _plant(rows[0].astype(np.int32), rows[1], rows[2].astype(np.int32), rows[3], radius)
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in SHARDS)], names=list(SHARDS))

    return stored(rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in SHARDS.items())))


def _searches(trees: DataFrame, found: DataFrame, shard: int) -> DataFrame:
    """(choice, bits, queries): classes that have to search the trees of their group.

    In an undivided group these are the classes outside its main component; in a divided one,
    those outside the main component under the links found in all shards.
    """
    own = trees.where("salt < 0 AND size(outside) > 0").select("choice", "bits", F.col("outside").alias("queries"))
    divided = trees.where("salt >= 0").select("choice", "bits", F.explode("fps").alias("fp"))
    if divided.isEmpty():
        return own
    root = components(found, "a", "b").withColumnRenamed("node", "fp")
    divided = stored(divided.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    per = divided.groupBy("choice", "bits", "root").agg(F.count("*").alias("m"))
    main = per.groupBy("choice", "bits").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("m"))
    rest = divided.join(main, ["choice", "bits"]).where("root <> main")
    part = F.pmod(F.hash("fp"), F.ceil(F.col("m") / shard).cast("int"))
    rest = rest.groupBy("choice", "bits", part.alias("part")).agg(F.collect_list("fp").alias("queries"))
    return own.union(rest.select("choice", "bits", "queries"))


def _search_links(pairs: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of rows that hold a tree and queries: one per query and local component met."""

    def run(batch):
        size = pa.compute.list_value_length(batch.column("fps")).to_numpy()
        at = 0
        while at < batch.num_rows:
            until = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), SLICE, side="right")) + at)
            part = batch.slice(at, until - at)
            flat = {c: part.column(c).flatten().to_numpy() for c in ("fps", "parents", "edges", "labels", "queries")}
            n = size[at:until]
            begin = np.cumsum(n) - n
            tree = np.repeat(np.arange(n.size), n)
            shift = np.repeat(begin, n)
            parent = np.where(flat["parents"] < 0, -1, flat["parents"] + shift)
            forest = Forest(flat["fps"].view(np.uint64), tree, parent, flat["edges"])
            root = np.repeat(begin, pa.compute.list_value_length(part.column("queries")).to_numpy())
            q, node = forest.search(flat["queries"].view(np.uint64), root, radius)
            _, first = np.unique(q * np.int64(forest.fp.size) + (flat["labels"] + shift)[node], return_index=True)
            a, b = flat["queries"][q[first]], flat["fps"][node[first]]
            some = a != b
            yield {"a": np.minimum(a, b)[some], "b": np.maximum(a, b)[some]}
            at = until

    return arrow_map(pairs, run, {"a": "long", "b": "long"})


def links(classes: DataFrame, radius: int = RADIUS, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """Links (a, b) within the radius that connect exactly the classes that all such links connect."""
    classes = classes.select("fp")
    trees = shard_trees(classes, classes.count(), radius, group, shard)
    found = trees.select(F.inline(F.arrays_zip("a", "b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = stored(found.distinct())
    queries = _searches(trees, found, shard)
    nodes = trees.agg(F.sum(F.size("fps"))).first()[0] or 0
    shipped = sized_broadcast(trees.select("choice", "bits", "fps", "parents", "edges", "labels"), nodes, 24)
    met = _search_links(queries.join(shipped, ["choice", "bits"]), radius)
    return stored(found.union(met).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS,
                    group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    rows = stored(fingerprints(docs, id_col, text_col, width))
    classes = rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("m"))
    classes = stored(classes)
    root = components(links(classes, radius, group, shard), "a", "b").withColumnRenamed("node", "fp")
    classes = classes.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = classes.groupBy("root").agg(F.min("least").alias("least_id"), F.sum("m").alias("m")).where("m > 1")
    known = stored(classes.select("fp", "root").join(groups.select("root", "least_id"), "root").select("fp", "least_id"))
    out = rows.join(sized_broadcast(known, known.count(), 16), "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.coalesce("least_id", "doc_id")).alias("component_id"))
