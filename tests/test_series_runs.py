"""Series and runs: golden results and plain folds."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import runs as R
from tidemark.operators import series as S


def test_suppression_equals_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(k, round(rng.uniform(0, 20), 3), rng.random()) for k in range(10) for _ in range(50)]
    got = {}
    for r in S.suppress(spark.createDataFrame(rows, "k int, t double, v double"), ["k"], "v").collect():
        got.setdefault(r.k, []).append((r.t, r.v))
    for k in range(10):
        kept = []
        for t, v in sorted((t, v) for kk, t, v in rows if kk == k):
            if not kept or t - kept[-1][0] >= 0.35:
                kept.append((t, v))
            elif v > kept[-1][1]:
                kept[-1] = (t, v)
        assert sorted(got[k]) == kept


def test_smoothing_is_in_place(spark):
    w = spark.createDataFrame([("v", i, m) for i, m in enumerate("ABABA")], "k string, window_no int, mode string")
    assert [r.mode for r in S.smooth_modes(w, ["k"]).orderBy("window_no").collect()] == list("AAAAA")


def test_upper_median(spark):
    assert [spark.range(1).select(S.upper_median(F.array(*map(F.lit, x)))).first()[0] for x in ([1, 2, 3], [1, 2, 3, 4])] == [2, 3]


def test_threshold_equals_statistics(spark):
    v = [random.Random(1).random() for _ in range(101)]
    r = S.robust_threshold(spark.createDataFrame([("a", x) for x in v], "k string, v double"), ["k"], "v").first()
    med = statistics.median(v)
    assert r.med == med and r.mad == statistics.median(abs(x - med) for x in v)


def _rows(spark, values, mode, ink=1.0):
    return spark.createDataFrame([("v", i, i / 2, mode, [x] * 16 if isinstance(x, int) else x, [0] * 16, ink) for i, x in enumerate(values)], "k string, pos int, t double, mode string, pixels array<int>, edges array<int>, ink double")


def _lengths(df):
    return [r["count"] for r in df.groupBy("run").count().orderBy("run").collect()]


def test_two_shades_are_two_runs(spark):
    assert _lengths(R.build_runs(_rows(spark, [200] * 10 + [60] * 10, "B"), ["k"])) == [10, 10]


def test_a_slow_pan_is_one_run_only_where_drift_is_allowed(spark):
    pan = [100 + i for i in range(20)]
    assert _lengths(R.build_runs(_rows(spark, pan, "C"), ["k"])) == [20]
    assert len(_lengths(R.build_runs(_rows(spark, pan, "B"), ["k"]))) > 1


def test_short_runs_join_the_one_before(spark):
    assert _lengths(R.build_runs(_rows(spark, [200] * 8 + [60] + [200] * 8, "B"), ["k"])) == [9, 8]


def test_pictures_of_one_mean_differ(spark):
    a, b = [0] * 8 + [200] * 8, [200] * 8 + [0] * 8
    assert _lengths(R.build_runs(_rows(spark, [a] * 6 + [b] * 6, "B"), ["k"])) == [6, 6]


def loop_runs(rows):
    """(t, mode, pixels, edges, ink) by the plain rule, row by row."""
    near = lambda x, y, m: (np.abs(x[2] - y[2]).mean() <= m[0]) and (np.abs(x[3] - y[3]).mean() <= m[1]) and ((np.abs(x[2] - y[2]) > 12).mean() <= m[2])
    out = []
    for x in rows:
        m = R.SAME[x[1]]
        stay = bool(out) and near(out[-1][-1], x, m) and (m[3] or near(out[-1][0], x, m))
        if stay and x[1] == "C":
            top = max(y[4] for y in out[-1])
            stay = not (top > 0 and x[4] < 0.7 * top)
        out[-1].append(x) if stay else out.append([x])
    joined = []
    for r in out:
        short = r[-1][0] - r[0][0] + 0.5 < 1.5
        joined[-1].extend(r) if short and joined else joined.append(list(r))
    return [k for k, r in enumerate(joined) for _ in r]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_a_loop(seed):
    rng = np.random.default_rng(seed)
    n = 300
    base = np.cumsum(rng.normal(0, 1.5, (n, 12)) * (rng.random((n, 1)) < 0.6) + 40 * rng.normal(size=(n, 12)) * (rng.random((n, 1)) < 0.05), 0) + 100
    edges = np.abs(rng.normal(0, 1, (n, 12)))
    ink = np.abs(np.cumsum(rng.normal(0, 0.2, n))) * (rng.random(n) > 0.02)
    t, mode = np.arange(n) / 2, [("ABCD" * 3)[i // 30] for i in range(n)]
    assert R.run_numbers(t, mode, base, edges, ink).tolist() == loop_runs(list(zip(t, mode, base, edges, ink)))


def test_native_anchor_fold_equals_a_loop(spark):
    rng = random.Random(2)
    v = [rng.uniform(0, 10) for _ in range(80)]
    df = spark.createDataFrame([("a", i, float(i), x) for i, x in enumerate(v)], "k string, pos int, t double, v double")
    got = [(r.start, r.end, r.n) for r in R.anchor_runs(df, ["k"], "v", 4.0, 3.0).orderBy("run").collect()]
    want = []
    for i, x in enumerate(v):
        if want and abs(x - want[-1][3]) <= 4 and abs(x - want[-1][4]) <= 3:
            want[-1][1], want[-1][2], want[-1][4] = float(i), want[-1][2] + 1, x
        else:
            want.append([float(i), float(i), 1, x, x])
    assert got == [tuple(w[:3]) for w in want]
