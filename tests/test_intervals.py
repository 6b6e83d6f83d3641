"""Interval algebra against plain Python."""

import random

from pyspark.sql import functions as F

from tidemark.operators import intervals as I


def test_merge_equals_a_plain_merge(spark):
    rng = random.Random(3)
    rows = [(k, a := rng.uniform(0, 100), a + rng.choice([-1, 0, 2, 5])) for k in range(8) for _ in range(40)]
    got = {}
    for r in I.merge_intervals(spark.createDataFrame(rows, "k int, start double, end double"), ["k"], 0.5).collect():
        got.setdefault(r.k, []).append((r.start, r.end))
    for k in range(8):
        want = []
        for a, b in sorted((a, b) for kk, a, b in rows if kk == k and b > a):
            if want and a <= want[-1][1] + 0.5:
                want[-1] = (want[-1][0], max(want[-1][1], b))
            else:
                want.append((a, b))
        assert sorted(got[k]) == want


def test_uniform_times_golden(spark):
    w = spark.createDataFrame([("v", 0.0, 10.0), ("v", 50.0, 60.0)], "k string, start double, end double")
    assert [r.t for r in I.uniform_times(w, ["k"], 4).orderBy("i").collect()] == [2.5, 7.5, 52.5, 57.5]


def test_containing_first_takes_the_end_only_of_the_last(spark):
    spans = spark.createDataFrame([("v", "a", 0.0, 6.0), ("v", "b", 6.0, 12.0)], "k string, span_id string, start double, end double")
    points = spark.createDataFrame([("v", 1, 5.99), ("v", 2, 6.0), ("v", 3, 12.04), ("v", 4, 12.2), ("v", 5, -1.0)], "k string, id int, t double")
    got = {r.id: r.span_id for r in I.containing_first(points, spans, ["k"], "id").collect()}
    assert got == {1: "a", 2: "b", 3: "b", 4: None, 5: None}


def test_nearest_within_tolerance_and_ties(spark):
    spans = spark.createDataFrame([("v", "a", 0, 0.0, 2.0), ("v", "b", 1, 4.0, 6.0)], "k string, span_id string, pos int, start double, end double")
    points = spark.createDataFrame([("v", 1, 3.0), ("v", 2, 1.0), ("v", 3, 9.0)], "k string, id int, t double")
    got = {r.id: r.span_ids for r in I.containing_or_nearest(points, spans, ["k"], "id").collect()}
    assert got == {1: ["a"], 2: ["a"], 3: []}


def test_empty_tables(spark):
    s = spark.createDataFrame([], "k string, start double, end double, pos int, duration double")
    assert I.merge_intervals(s, ["k"]).count() == 0
    assert I.coverage(s, ["k"], "duration").count() == 0
    assert I.uniform_times(s, ["k"], 4).count() == 0


def test_bucketed_join_equals_the_plain_join(spark):
    rng = random.Random(9)
    p = spark.createDataFrame([(rng.randrange(3), i, rng.uniform(0, 100)) for i in range(200)], "k int, id int, t double")
    s = spark.createDataFrame([(rng.randrange(3), i, a := rng.uniform(0, 100), a + rng.uniform(0, 30)) for i in range(60)], "k int, span int, start double, end double")
    a = {(r.id, r.span) for r in I.bucketed_join(p, s, ["k"], 7.0, 0.5).collect()}
    b = {(r.id, r.span) for r in p.join(s, "k").filter(F.col("t").between(F.col("start") - 0.5, F.col("end") + 0.5)).collect()}
    assert a == b


def test_buckets_change_nothing(spark):
    rng = random.Random(11)
    pts = spark.createDataFrame([(rng.randrange(2), i, rng.uniform(0, 60)) for i in range(80)], "k int, id int, t double")
    spans = spark.createDataFrame([(rng.randrange(2), i, i, a := rng.uniform(0, 60), a + rng.choice([0.0, 1.0, 9.0, 30.0])) for i in range(40)], "k int, span_id int, pos int, start double, end double")
    states = spans.filter("pos % 2 = 0").select("k", F.col("span_id").alias("state_id"), "start", "end")
    other = spans.filter("pos % 2 = 1")
    cases = [
        lambda w: I.containing_first(pts, spans, ["k"], "id", 0.5, width=w),
        lambda w: I.containing_or_nearest(pts, spans, ["k"], "id", 2.0, width=w),
        lambda w: I.nearest_centre(pts, spans, ["k"], "id", 0.5, width=w),
        lambda w: I.latest_start(pts, spans, ["k"], "id", 1.0, width=w),
        lambda w: I.overlap_or_lead(states, other, ["k"], 3.0, width=w),
        lambda w: I.overlap_mean(states, other.withColumn("value", F.col("pos").cast("double")), ["k"], width=w).withColumn("mean", F.round("mean", 9)),
    ]
    for case in cases:
        want = sorted(map(str, case(None).collect()))
        for w in (2.5, 40.0):
            assert sorted(map(str, case(w).collect())) == want
