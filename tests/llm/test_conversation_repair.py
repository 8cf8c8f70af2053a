import hashlib
import random

import brute
import pytest

from fieldloom.llm import conversation_repair as cr
from fieldloom.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, part string, d1 string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def run(spark, rows):
    from unittest import mock

    with mock.patch.object(queries, "table", lambda *_: table(spark, rows)):
        got = queries.op12_conversation_repair(spark, "").collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def expected(rows):
    want = brute.repaired(brute.damaged(rows))
    return {c: (*v[:-1], hashlib.sha256(v[-1].encode()).hexdigest()) for c, v in want.items()}


def random_rows(seed, conversations, turns):
    rng, rows = random.Random(seed), []
    for c in range(conversations):
        for t in range(rng.randint(1, turns)):
            role = rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None, "ustad", "été"])
            text = rng.choice(["ok.", "no", "why? ", " ", None, "", f"x{t}!", f"line {t}\nmore.\n", "é."])
            rows.append((c if rng.random() > 0.01 else None, rng.choice([t, t, t, t + 1, None]), role, text))
    rng.shuffle(rows)
    return rows


@pytest.fixture
def small(monkeypatch):
    """Short segments and a narrow merge, so that small tables have long conversations."""
    whole = cr.repair
    monkeypatch.setattr(cr, "repair", lambda *a, **k: whole(*a, **k, segment=3, fan=2))


@pytest.mark.parametrize("segment", [256, 3])
def test_equals_brute_force(spark, request, segment):
    if segment == 3:
        request.getfixturevalue("small")
    rows = random_rows(segment, 120, 12)
    assert run(spark, rows) == expected(rows)


def test_one_conversation_holds_most_rows(spark, small):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"{t % 50}{rng.choice('.!a')}") for t in range(3000)]
    rows += random_rows(9, 20, 6)
    rows = [(r[0], *r[1:]) for r in rows if r[0] != 7 or len(r[3] or "") < 20]
    assert run(spark, rows) == expected(rows)


def test_search_equals_all_paths():
    """Tables of segments by the bidirectional search, against relaxation until nothing changes."""
    rng = random.Random(1)
    for _ in range(300):
        turns = tuple((rng.choice(["s", "u", "a", ""]), rng.randrange(4)) for _ in range(rng.randint(0, 6)))
        for entry in cr.STATES:
            least = {(0, entry): (0, "")}
            changed = True
            while changed:
                changed = False
                for node in sorted(least):
                    cost, text = least[node]
                    for to, price, letter in cr._forward(turns, node):
                        if to not in least or (cost + price, text + letter) < least[to]:
                            least[to] = (cost + price, text + letter)
                            changed = True
            for end in cr.STATES:
                assert cr.cheapest_edits(turns, entry, (end,)) == least.get((len(turns), end))


def test_edges(spark):
    rows = [(None, None, None, None), (1, None, "user", "a."), (1, None, "user", "a."), (2, 5, "", ""), (3, 1, "user", "q." * 200_000),
            (3, 2, "assistant", "r."), (4, 1, "system", "only.")]
    assert run(spark, rows) == expected(rows)
    assert run(spark, []) == {}
