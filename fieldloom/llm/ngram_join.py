"""N-gram Jaccard join with prefix filters under several global token orders.

Two documents whose shingle sets x and y have Jaccard similarity of at least t share a token
within the first ``|x| - ceil(t|x|) + 1`` (and ``|y| - ...``) tokens under *every* global token
order.  The join therefore intersects filters, cheapest first, before it compares sets:

1. order by ascending token digest, over all documents, with prefixes a little longer than
   needed: a document survives when as many of its prefix tokens occur in prefixes of other sets
   as a partner implies.  Tokens met more than once within a block are
   reduced to one row before the shuffle, so a frequent token costs a row per block.
2. order by document frequency (rarest first) among the survivors: prefix tokens make candidate
   pairs, with length and position bounds.  Tokens of one document only come first, so members
   of a large family of copies that differ too much drop out here without any comparison.
3. order by descending digest, and order 1 again, on each candidate pair.

What is left is verified by exact set intersection.

Equal sets form one class beforehand and only classes are joined.  Inside a bucket (one prefix
token) all classes are compared with one pivot, the class of fewest unshared tokens; connected
members need no further comparison, since the result is the component.  Pairs of a bucket that
are still in different components are then compared exhaustively, minority against all, so no
link between components is lost and no family is expanded into all of its pairs.

Null or empty texts have no shingles and link with nothing.  Rows with a null id are returned
with a null component and link nothing.  Repeated ids keep one result row per input row.
An empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldloom.llm.shared import arrow_map, components, signed, stored
from fieldloom.llm.text import ROW_BITS, blocks, mix, shingle_sets
from fieldloom.session import sized_broadcast

WIDTH = 5
PERCENT = 80
SLACK = 5  # percent of a set that the digest prefixes have beyond the least length


def _prefix(n, percent: int):
    """Prefix length of a set of ``n`` tokens, for integers and arrays."""
    return n - (percent * n + 99) // 100 + 1


def _sets(texts, width: int):
    """(block, hashes, bounds, sizes, class of every text) of a batch."""
    for block in blocks(texts, lower=True):
        h, bounds = shingle_sets(block.find_words(), width)
        run = np.append(np.uint64(0), np.cumsum(mix(h + np.uint64(1)), dtype=np.uint64))
        size = np.diff(bounds)
        yield block, h, bounds, size, mix((run[bounds[1:]] - run[bounds[:-1]]) ^ mix(size.astype(np.uint64)))


def shingle_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, node): ``node`` is equal for equal sets, null for the empty set."""

    def run(batch):
        at = 0
        for _, _, _, size, node in _sets(batch.column("text"), width):
            some = size > 0
            yield {"doc_id": batch.column("doc_id").slice(at, size.size), "n_shingles": size.astype(np.int64),
                   "node": pa.array(signed(node), mask=~some)}
            at += size.size

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, {"doc_id": "long", "n_shingles": "long", "node": "long"})


def _digest_prefixes(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Prefix tokens under the digest order, longer by ``SLACK`` percent than the least prefix.

    Rows with ``need = 0`` are tokens, one per block and token, with ``k = -1`` where several
    sets of the block have the token.  A row with ``need > 0`` stands for a set: ``k`` of its
    prefix tokens were met within the block, ``need`` is the least number a partner implies.
    """

    def run(batch):
        for _, h, bounds, size, node in _sets(batch.column("text"), width):
            keep = np.zeros(size.size, bool)
            keep[np.unique(node, return_index=True)[1]] = True
            keep &= size > 0
            least = _prefix(size, percent)
            take = np.where(keep, np.minimum(least + (SLACK * size + 99) // 100, size), 0)
            of = np.repeat(np.arange(size.size), take)
            token = h[bounds[of] + np.arange(of.size) - np.repeat(np.cumsum(take) - take, take)]
            order = np.argsort(token, kind="stable")
            same = token[order][1:] == token[order][:-1]
            met = np.zeros(token.size, bool)
            met[order[1:]] |= same
            met[order[:-1]] |= same
            first = np.ones(token.size, bool)
            first[order[1:]] = ~same
            one = np.flatnonzero(keep)
            k = np.bincount(of[met], minlength=size.size)[one]
            yield {"token": signed(np.concatenate([token[first], mix(node[one]) >> np.uint64(ROW_BITS)])),
                   "node": signed(node[np.concatenate([of[first], one])]),
                   "k": np.concatenate([-met[first].astype(np.int32), k.astype(np.int32)]),
                   "need": np.append(np.zeros(first.sum(), np.int32), (take - least + 1)[one].astype(np.int32))}

    return arrow_map(texts.select("text"), run, {"token": "long", "node": "long", "k": "int", "need": "int"})


def _survivors(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Nodes that share enough prefix tokens under the digest order with other nodes.

    A partner of similarity t lacks at most ``|x| - ceil(t|x|)`` tokens of x, so among any q
    tokens of x at least ``q - (|x| - ceil(t|x|))`` are met elsewhere.
    """
    ring = Window.partitionBy("token").orderBy("node")
    met = (F.lag("node").over(ring) != F.col("node")) | (F.lead("node").over(ring) != F.col("node"))
    rows = _digest_prefixes(texts, width, percent).withColumn("met", F.coalesce(met, F.lit(False)))
    credit = F.when(F.col("need") > 0, F.col("k")).when(F.col("met") & (F.col("k") == 0), 1).otherwise(0)
    counted = rows.select("node", credit.alias("credit"), "need").where("credit > 0 OR need > 0")
    total = counted.groupBy("node").agg(F.sum("credit").alias("credit"), F.max("need").alias("need"))
    return total.where("credit >= need").select("node")


def _own_texts(texts: DataFrame, width: int) -> DataFrame:
    """One text per node: rows whose text is of another node (under a repeated id) or repeats go."""

    def run(batch):
        wanted, at = batch.column("node").to_numpy(), 0
        for _, _, _, size, node in _sets(batch.column("text"), width):
            mine = signed(node) == wanted[at : at + size.size]
            part = batch.slice(at, size.size).filter(_pa(mine))
            yield {"node": part.column("node"), "text": part.column("text")}
            at += size.size

    return arrow_map(texts, run, {"node": "long", "text": "string"}).dropDuplicates(["node"])


def _tokens(texts: DataFrame, width: int) -> DataFrame:
    """(node, token): all tokens of every text."""

    def run(batch):
        for _, h, _, size, node in _sets(batch.column("text"), width):
            yield {"node": signed(np.repeat(node, size)), "token": signed(h)}

    return arrow_map(texts.select("text"), run, {"node": "long", "token": "long"})


def _frequency_prefixes(tokens: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(token, node, pos, n, own) under the order by document frequency, unshared tokens left out.

    ``own`` counts the tokens no other survivor has; they hold the first positions.
    """
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    listed = tokens.join(shared, "token").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("df", "token"))).alias("list")
    ).join(sizes, "node")
    own = F.col("n") - F.size("list")
    take = F.expr(f"n - (({percent} * n + 99) DIV 100) + 1") - own
    cut = listed.select("node", "n", own.alias("own"), take.cast("int").alias("take"), "list").where("take > 0")
    return cut.select("node", "n", "own", F.posexplode(F.slice("list", 1, F.col("take"))).alias("at", "e")).select(
        F.col("e.token").alias("token"), "node", (F.col("own") + F.col("at")).alias("pos"), "n", "own"
    )


def _bounds(percent: int) -> str:
    """Length and position bounds of a pair (x, y) that meets in one prefix token."""
    return (f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND "
            f"{100 + percent} * least(x.n - x.pos, y.n - y.pos) >= {percent} * (x.n + y.n)")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that pass the digest orders and reach the similarity."""

    def run(batch):
        side = []
        for which in ("a", "b"):
            node = batch.column(which).to_numpy()
            _, first, back = np.unique(node, return_index=True, return_inverse=True)
            sets = [h[b[i] : b[i + 1]] for _, h, b, s, _ in _sets(batch.column(f"text_{which}").take(_pa(first)), width)
                    for i in range(s.size)]
            side.append((sets, back))
        hit = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = (sets[back[i]] for sets, back in side)
            p, q = _prefix(x.size, percent), _prefix(y.size, percent)
            if not (_meet(x[:p], y[:q]) and _meet(x[-p:], y[-q:])):
                continue
            common = np.intersect1d(x, y, assume_unique=True).size
            hit[i] = 100 * common >= percent * (x.size + y.size - common)
        yield {"a": batch.column("a").filter(_pa(hit)), "b": batch.column("b").filter(_pa(hit))}

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return arrow_map(pairs.select("a", "b").join(b, "b").join(a, "a"), run, {"a": "long", "b": "long"})


def _meet(x: np.ndarray, y: np.ndarray) -> bool:
    at = np.searchsorted(x, y)
    at[at == x.size] = 0
    return bool((x[at] == y).any())


def _pa(values: np.ndarray) -> pa.Array:
    return pa.array(values)


def links(classes: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Verified links (a, b) between classes that connect exactly the classes that links connect."""
    texts = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    )
    keepers = classes.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    keepers = stored(keepers.join(_survivors(texts, width, percent), "node"))
    few = sized_broadcast(keepers.select("doc_id", "node"), keepers.count(), 16)
    sets = stored(_own_texts(texts.join(few, "doc_id").select("node", "text"), width))
    rows = stored(_frequency_prefixes(_tokens(sets, width), keepers.select("node", "n"), percent))

    pivot = rows.groupBy("token").agg(F.min(F.struct("own", "node", "pos", "n")).alias("p"), F.count("*").alias("m"))
    pivot = pivot.where("m > 1").select("token", "p.node", "p.pos", "p.n")
    near = pivot.alias("x").join(rows.alias("y"), F.expr(f"x.token = y.token AND x.node <> y.node AND {_bounds(percent)}"))
    tested = stored(near.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    found = stored(_verified(tested, sets, width, percent))

    label = components(found, "a", "b")
    rows = rows.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per = stored(rows.groupBy("token", "root").agg(F.count("*").alias("m")))
    mixed = per.groupBy("token").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count("*").alias("k"))
    rows = stored(rows.join(mixed.where("k > 1").select("token", "main"), "token"))
    rest = rows.where("root <> main").alias("x").join(
        rows.alias("y"), F.expr(f"x.token = y.token AND x.root <> y.root AND {_bounds(percent)}")
    ).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    rest = stored(rest.join(tested, ["a", "b"], "left_anti"))
    return found.union(stored(_verified(rest, sets, width, percent)))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at least ``percent`` similarity.
    """
    classes = stored(shingle_classes(docs, id_col, text_col, width))
    joined = links(classes, docs, id_col, text_col, width, percent)
    label = components(joined, "a", "b")
    per = classes.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("m"))
    per = per.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = per.groupBy("root").agg(F.min("least").alias("least_id"), F.sum("m").alias("m")).where("m > 1")
    groups = stored(per.select("node", "root").join(groups.select("root", "least_id"), "root").select("node", "least_id"))
    out = classes.join(sized_broadcast(groups, groups.count(), 16), "node", "left")
    least = F.when(F.col("doc_id").isNotNull(), F.coalesce("least_id", "doc_id"))
    return out.select("doc_id", "n_shingles", least.alias("component_id"))
