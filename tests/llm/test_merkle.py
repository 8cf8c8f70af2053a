import random
from unittest import mock

import brute
import numpy as np
import pytest

from fieldloom.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, key string, idx string, digest string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)
    with mock.patch.object(queries, "table", lambda *_: df.repartition(5)):
        got = queries.op13_merkle_manifest(spark, "").collect()
    return sorted(map(tuple, got), key=repr)


def rows_of(rng, sizes):
    out, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += 1
            text = rng.choice([None, "", "Aé", "plain", "Mixed Case %d" % i])
            out.append((i * 7 % 100_003, rng.choice(["a", None, ""]), lang, rng.choice([None, i]), text))
    return out


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "fr": 9}, {None: 65, "": 3, "é": 64, "z": 1}])
def test_equals_brute_force(spark, sizes):
    rows = rows_of(random.Random(3), sizes)
    assert run(spark, rows) == sorted(brute.merkle(rows), key=repr)


def test_trees_of_several_blocks(spark):
    """Two levels of blocks in one group, exactly one block in another, and one leaf over in a third."""
    rows = rows_of(random.Random(4), {"en": 9000, "fr": 4096, "de": 4097, "es": 5})
    assert run(spark, rows) == sorted(brute.merkle(rows), key=repr)


def test_many_groups_and_one_large(spark):
    rng = random.Random(6)
    rows = rows_of(rng, {f"l{k}": 1 + k % 3 for k in range(70)} | {"big": 600})
    assert run(spark, rows) == sorted(brute.merkle(rows), key=repr)


def test_nulls_ties_long_text_and_empty(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (5, "s", "en", 1, "A" * 500_000),
            (5, "s", "en", 1, "b"), (5, "s", "en", 1, "b"), (None, "s", "en", 0, "")]
    assert run(spark, rows) == sorted(brute.merkle(rows), key=repr)
    assert run(spark, []) == []


def test_layout_is_recursive():
    """Slots are a permutation; the upper half of the levels lies first, every lower subtree is contiguous."""
    for levels in range(1, 6):
        slots = np.concatenate([merkle.addresses(levels, d) for d in range(levels)])
        assert sorted(slots) == list(range(merkle.size(levels)))
        top = levels // 2
        if top:
            above = np.concatenate([merkle.addresses(levels, d) for d in range(top)])
            assert above.max() == merkle.size(top) - 1
            for k in range(8**top):
                part = np.concatenate([merkle.addresses(levels, d)[k * 8 ** (d - top) : (k + 1) * 8 ** (d - top)] for d in range(top, levels)])
                assert part.max() - part.min() + 1 == part.size == merkle.size(levels - top)


def test_siblings_prove_a_row(spark):
    rows = rows_of(random.Random(8), {"en": 20, "fr": 3})
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    made = merkle.build(df, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id")
    for r in merkle.verified(made, with_siblings=True).collect():
        assert r.verified and r.folded_root == r.root == made.root
        assert merkle.hashed(r.siblings) == r.proof_sha256
