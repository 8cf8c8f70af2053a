import datetime

import numpy as np
import pytest

from fieldloom.functions import kernels as kn
from fieldloom.operators import selection as sl
from fieldloom.operators import slabselect as ss
from fieldloom.plans.runners import s15_random_field

K = sl.RadialKernel(kn.rbf, ls=1.0)


def strip(spark, rows=600, step=0.4):
    xy = np.column_stack([np.repeat(np.arange(rows) * step, 2), np.tile([0.0, 1.0], rows)])
    points = [(i, r.tolist()) for i, r in enumerate(xy)]
    return xy, spark.createDataFrame(points, "id long, x array<double>").repartition(3).cache()


@pytest.fixture(scope="module")
def grown(spark):
    xy, df = strip(spark)
    scorer, whole = ss.SlabScore(K), ss.WHOLE
    ss.WHOLE = 100
    picks = sl.random_select(df, scorer, len(xy), 3)
    ss.WHOLE = whole
    return xy, df, scorer, picks


def test_inverse_of_a_triangle():
    low = np.tril(np.random.default_rng(0).uniform(0.5, 1.0, (75, 75))) + 20 * np.eye(75)
    assert np.allclose(ss.lower_inverse(low) @ low, np.eye(75), rtol=0, atol=1e-13)


def in_order(ids, x, k, seed):
    """All ticks of all points, one after the other."""
    picked, scores, low, high, window = np.zeros(0, int), [], 0.0, ss.FIRST, 0
    nothing = (np.zeros(0, "i8"), np.zeros(0), np.zeros((0, x.shape[1])))
    while len(picked) < k and low < ss.LAST:
        free = np.setdiff1d(np.arange(len(x)), picked)
        near = ss.Near(sl.CholeskyScore(K), x[picked])
        known = np.round(near.score(x[free]), sl.ROUND)
        free, known = free[known > ss.LEAST], known[known > ss.LEAST]
        if not len(free):
            break
        new = ss.settle(near, ids[free], x[free], known, nothing, low, high, (seed << 20) + (window << 12))
        picked, scores = np.concatenate([picked, new[0]]), scores + new[2].tolist()
        window, low, high = window + 1, high, high * ss.GROWTH
    return picked[:k], scores[:k]


def test_slabs_pick_what_all_ticks_in_order_pick(grown):
    xy, _, scorer, picks = grown
    want, scores = in_order(np.arange(len(xy)), xy, len(xy), 3)
    assert scorer.cut.count >= 5 and len(want) > 700
    assert picks.ids.tolist() == want.tolist()
    assert np.allclose(picks.scores, scores, rtol=1e-3, atol=1e-11)
    assert np.array_equal(picks.rows, xy[want])


def test_fewer_picks_are_the_first(spark, grown, monkeypatch):
    monkeypatch.setattr(ss, "WHOLE", 100)
    few = sl.random_select(grown[1], ss.SlabScore(K), 300, 3)
    assert few.ids.tolist() == grown[3].ids[:300].tolist()


def test_factor_by_slabs_equals_the_dense_factor(grown):
    xy, _, scorer, picks = grown
    z = np.random.default_rng(1).standard_normal(len(picks.ids))
    kernel = ss.AxisKernel(kn.rbf, ls=1.0)
    low = np.linalg.cholesky(kernel(picks.rows, picks.rows))
    dense = np.linalg.solve(low, kernel(picks.rows, xy)).T
    drawn, left = scorer.draw(xy, z)
    assert np.abs(drawn - dense @ z).max() < 1e-6
    assert np.abs(left - (1.0 - (dense * dense).sum(1))).max() < 1e-10 and left.max() < 2e-9
    whole = np.zeros_like(dense)
    for slab in range(scorer.cut.count):
        rows = np.flatnonzero(scorer.cut.slab(xy) == slab)
        near, at = scorer.near(xy[rows], slab)
        whole[np.ix_(rows, at)] = near.features(xy[rows])
    assert np.abs(whole @ whole.T - kernel(xy, xy)).max() < 3e-9


def test_points_without_coordinates_stay_alone(spark, grown, monkeypatch):
    monkeypatch.setattr(ss, "WHOLE", 100)
    xy, df, scorer, picks = grown
    more = df.unionByName(spark.createDataFrame([(None, [None, None])], "id long, x array<double>"))
    again = ss.SlabScore(K)
    assert sl.random_select(more, again, len(xy) + 1, 3).ids.tolist() == picks.ids.tolist()
    drawn, left = again.draw(np.vstack([xy[:3], [[np.nan, np.nan]]]), np.ones(len(picks.ids)))
    assert np.isfinite(drawn[:3]).all() and np.isnan(drawn[3]) and np.isnan(left[3])
    assert scorer.deal(more).count() == len(xy) + 1


def test_picks_are_proportional_to_the_variance_left():
    """After the first of two close points, the other one is next with probability left / (left + 1)."""
    x, ids = np.array([[0.0, 0.0], [0.8, 0.0], [30.0, 0.0]]), np.arange(3)
    nothing = (np.zeros(0, "i8"), np.zeros(0), np.zeros((0, 2)))
    firsts, seconds, left = np.zeros(3), [], 1.0 - np.exp(-0.64)
    for seed in range(1500):
        got = ss.settle(ss.Near(sl.CholeskyScore(K), x[:0]), ids, x, np.ones(3), nothing, 0.0, 100.0, seed << 20)[0]
        firsts[got[0]] += 1
        if got[0] == 0:
            seconds.append(got[1] == 1)
    assert np.abs(firsts / 1500 - 1 / 3).max() < 0.045
    assert abs(np.mean(seconds) - left / (left + 1)) < 0.07


def test_close_points_stay_in_one_piece(spark):
    _, df = strip(spark, 60)
    scorer = ss.SlabScore(K)
    picks = sl.random_select(df, scorer, 120, 3)
    assert scorer.cut is None and picks.ids.tolist() == sl.random_select(df, sl.CholeskyScore(K), 120, 3).ids.tolist()


def test_random_field_leaves_no_location_without_its_variance(spark, tmp_path):
    """The factor grows with the locations: 2,048 pivots left most of these short."""
    n = 4700
    rows = [(i, 100.0 + i % 7, 1.0, 0.0, datetime.datetime(1995, 1 + i % 2, 3)) for i in range(n)]
    spark.createDataFrame(rows, "l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_shipdate timestamp"
                          ).write.parquet(str(tmp_path / "lineitem.parquet"))
    field = s15_random_field(spark, str(tmp_path)).toPandas()
    assert sorted(field["loc"]) == list(range(n))
    assert np.isfinite(field["draw"]).all() and field["missing_var"].max() < 2e-9
