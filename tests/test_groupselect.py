"""Selection in many levels at once against dense numpy, level by level."""

import numpy as np
import pytest

from fieldloom.functions import kernels as kn
from fieldloom.operators import groupselect as gs
from fieldloom.operators import progressive as pg
from fieldloom.operators import selection as sl

KERNEL = sl.RadialKernel(kn.matern, nu=2.5, ls=3.0)


def cloud(spark, sizes, seed=0):
    """Levels with points on an irregular grid; ids are paired with levels."""
    rng = np.random.default_rng(seed)
    xs = {lv: rng.uniform(0, 12, size=(n, 2)) for lv, n in sizes.items()}
    rows = [(lv, i * 100 + lv, p.tolist()) for lv, x in xs.items() for i, p in enumerate(x)]
    return xs, spark.createDataFrame(rows, "level long, id long, x array<double>")


def dense_states(xs, level, rule, k):
    """The same passes and clocks with a level's points in one array."""
    x = xs[level]
    ids = np.arange(len(x)) * 100 + level
    state = {"level": level, "ids": [], "rows": [], "inv": [], "scores": [], "dim": 2, "open": True}
    turn = 0
    while state["open"]:
        turn += 1
        cov = rule.kernel(x, x)
        at = [int(i) // 100 for i in state["ids"]]
        low = np.linalg.cholesky(cov[np.ix_(at, at)]) if at else np.zeros((0, 0))
        f = np.linalg.solve(low, cov[at]).T if at else np.zeros((len(x), 0))
        score = np.maximum(np.diag(cov) - (f**2).sum(1), 0)
        score = np.round(score, sl.ROUND) if rule.mode == "greedy" else score
        some = np.flatnonzero((score > (0 if rule.mode == "greedy" else 1e-9)) & ~np.isin(ids, state["ids"]))
        key = -score[some] if rule.mode == "greedy" else -np.log(gs._uniform(ids[some], rule.seed * 1000 + turn, 1)[:, 0]) / score[some]
        order = np.lexsort((ids[some], key))[: rule.pool]
        pick = some[order]
        state = gs.pick_from_pool(level, turn, state, ids[pick], x[pick], score[pick], key[order], rule, k)
    return state["ids"], turn


@pytest.mark.parametrize("mode", ["greedy", "random"])
@pytest.mark.parametrize("pool, tile", [(8, 16), (256, 1024)])
def test_levels_equal_dense(spark, mode, pool, tile):
    xs, df = cloud(spark, {0: 60, 1: 90, 2: 5, 7: 30})
    rule = gs.Rule(KERNEL, mode, 3, pool)
    got = {r["level"]: (r["ids"], r["passes"]) for r in gs.select_by(gs.tiles_of(df, tile), 12, rule).collect()}
    want = {lv: dense_states(xs, lv, rule, 12) for lv in xs}
    assert got == want
    assert {lv: len(i) for lv, (i, _) in got.items()} == {0: 12, 1: 12, 2: 5, 7: 12}


def test_greedy_equals_one_pick_per_pass(spark):
    xs, df = cloud(spark, {0: 70, 4: 40}, 2)
    got = {r["level"]: r["ids"] for r in gs.select_by(gs.tiles_of(df, 16), 10, gs.Rule(KERNEL, "greedy", 0, 8)).collect()}
    for lv, x in xs.items():
        left, want = KERNEL(x, x), []
        for _ in range(10):
            j = int(np.argmax(np.round(np.diag(left), sl.ROUND)))
            want.append(j * 100 + lv)
            left = left - np.outer(left[:, j], left[j]) / left[j, j]
        assert got[lv] == want


def test_columns_equal_dense_svd_and_qr(spark):
    """The factor's modes and the QR stage, from the pivots that the same clocks give."""
    xs, df = cloud(spark, {0: 50, 3: 80, 5: 4}, 4)
    k, over = 6, 8
    got: dict = {}
    for r in gs.gks_by(df, KERNEL, k, over, seed=9, pool=16, tile=16).collect():
        got.setdefault(r["level"], []).append(r["id"])
    for lv, x in xs.items():
        pivots, _ = dense_states(xs, lv, gs.Rule(KERNEL, "random", 9, 16), k + over)
        if len(pivots) <= k:
            assert sorted(got[lv]) == sorted(pivots)
            continue
        at = [i // 100 for i in pivots]
        f = np.linalg.solve(np.linalg.cholesky(KERNEL(x[at], x[at])), KERNEL(x, x[at]).T).T
        rows = np.linalg.svd(f, full_matrices=False)[0][:, :k]
        left, want = rows @ rows.T, []
        for _ in range(k):
            j = int(np.argmax(np.round(np.diag(left), sl.ROUND)))
            want.append(j * 100 + lv)
            left = left - np.outer(left[:, j], left[j]) / left[j, j]
        assert got[lv] == want


def test_rounds_use_it(spark):
    rng = np.random.default_rng(0)
    rows = [(lv, i, i // 10, i % 10, float(np.sin(i % 10 + lv) + 0.1 * rng.normal())) for lv in range(3) for i in range(60)]
    cells = spark.createDataFrame(rows, "level long, loc long, y long, x long, value double")
    config = pg.RoundConfig(0.05, 0.05, 5, 2, strategy="rpgks")
    state = pg.initial_state(cells, "value")
    chosen = pg.choose(state, config, 1, 3).collect()
    assert sorted(r["level"] for r in chosen) == [0] * 5 + [1] * 5 + [2] * 5
    assert len({(r["level"], r["loc"]) for r in chosen}) == 15
    out = pg.run_rounds(cells, "value", config)
    assert [r["n_sensed"] for r in out.records] == [15, 15]


def test_a_pool_is_scored_by_the_new_column_alone(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 12, size=(120, 2))
    scorer, whole = sl.CholeskyScore(sl.RadialKernel(kn.matern, nu=1.5, ls=2.0)), []
    known = scorer.score(x)
    plain = sl.CholeskyScore.score
    monkeypatch.setattr(sl.CholeskyScore, "score", lambda self, at: whole.append(len(at)) or plain(self, at))
    ids, rows, scores = [], [], []
    sl.accept_ticks(np.arange(120), x, known, rng.exponential(size=120) / known, np.inf, scorer, 40, ids, rows, scores, rng)
    assert len(ids) == 40 and not whole
    fresh = sl.CholeskyScore(scorer.kernel)
    for row, score in zip(rows, scores):
        assert score == pytest.approx(plain(fresh, row[None])[0], abs=1e-9)
        fresh.add(row)
    assert np.allclose(fresh.inv, scorer.inv)
