import random
from unittest import mock

import brute
import numpy as np
import pytest

from fieldloom.llm import queries
from fieldloom.llm import simhash_trees as st


def run(df):
    with mock.patch.object(queries, "table", lambda *_: df):
        return sorted((tuple(r) for r in queries.op11_simhash_trees(df.sparkSession, "").collect()), key=repr)


def expected(rows):
    prints = {i: brute.simhash(t) for i, t in rows}
    label = brute.hamming_components(prints)
    return sorted(((i, f"{prints[i]:016x}", label[i]) for i, _ in rows), key=repr)


def variants(rng, base, n):
    words = base.split()
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(["alpha", "Beta", "gamma", "é"])
        yield " \n".join(w)


def test_equals_brute_force(spark, make):
    rng = random.Random(2)
    rows, i = [], 0
    for _ in range(25):
        base = " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 120)))
        for text in variants(rng, base, rng.randint(1, 25)):
            i += 1
            rows.append((i * 13 % 10007, text))
    rows += [(20_000, None), (20_001, ""), (20_002, " \t"), (20_003, "One"), (20_004, "one"), (20_005, "x y z")]
    assert run(make(rows)) == expected(rows)


def test_null_and_repeated_ids(spark, make):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "something else altogether here"), (5, "A b c d e"), (None, None)]
    got = run(make(rows))
    print_ = f"{brute.simhash('a b c d e'):016x}"
    other = f"{brute.simhash('something else altogether here'):016x}"
    assert got == sorted([(None, print_, None), (3, print_, 3), (3, other, 3), (5, print_, 3), (None, "0" * 16, None)], key=repr)


def test_long_text_and_empty_table(spark, make, empty):
    rng = random.Random(1)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(150_000))
    rows = [(1, long), (2, "short one"), (3, long + " end")]
    assert run(make(rows)) == expected(rows)
    assert run(empty) == []


def _prints(rng, families, size):
    """Random fingerprints and dense families of neighbours in chains and balls."""
    out = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(families):
        x = rng.getrandbits(64)
        for _ in range(size):
            y = x
            for _ in range(rng.randint(0, 5)):
                y ^= 1 << rng.randrange(64)
            out.add(y)
            if rng.random() < 0.1:
                x = y
    return sorted(out)


@pytest.mark.parametrize("group, shard", [(128, 4096), (1, 4096), (10**9, 16), (1, 8)])
def test_groups_shards_and_block_choices(spark, group, shard):
    """Links connect the same classes however the bits are cut and groups are dealt over shards."""
    rng = random.Random(shard)
    prints = _prints(rng, 6, 120)
    ids = {x - (1 << 64) if x >> 63 else x: x for x in prints}
    df = spark.createDataFrame([(i,) for i in ids], "fp long")
    pairs = [(r.a, r.b) for r in st.links(df, group=group, shard=shard).collect()]
    assert all((ids[a] ^ ids[b]).bit_count() <= st.RADIUS for a, b in pairs)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {i: find(i) for i in ids} == brute.hamming_components(ids)


def test_tree_follows_its_definition():
    """Children are keyed by the distance to their parent, keys of a node differ, and a search finds all."""
    rng = np.random.default_rng(3)
    fp = np.unique(np.concatenate([rng.integers(0, 2**64, 400, np.uint64), np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))]))
    tree = np.sort(rng.integers(0, 5, fp.size))
    forest, a, b = st.Forest.grow(fp, tree, st.RADIUS)
    inner = np.flatnonzero(forest.parent >= 0)
    assert (np.bitwise_count(fp[inner] ^ fp[forest.parent[inner]]) == forest.edge[inner]).all()
    assert len({(p, e) for p, e in zip(forest.parent[inner], forest.edge[inner])}) == inner.size
    assert (tree[a] == tree[b]).all()
    root = np.searchsorted(tree, tree)
    q, node = forest.search(fp, root, st.RADIUS)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= st.RADIUS
    near &= tree[:, None] == tree[None, :]
    assert set(zip(q.tolist(), node.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near))))
