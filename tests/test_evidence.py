"""Evidence joins, overlays, markup."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import layout as L
from tidemark.functions.markup import faults
from tidemark.operators import evidence as E


def test_targets_keep_what_is_given_and_stay_in_their_chapter(spark):
    seg = spark.createDataFrame([("v", "s1", 10.0, 12.0), ("v", "s2", 12.0, 15.0)], "k string, seg_id string, start double, end double")
    ch = spark.createDataFrame([("v", "c", 0.0, 14.0)], "k string, chapter_id string, start double, end double")
    rows = [("v", "a", "c", "action_result", ["s1", "s2"], "s1", None, None, None), ("v", "b", "c", "state", ["s1", "s2"], None, None, None, None), ("v", "d", "c", "slide", ["s2"], None, 13.0, 1.0, 2.0)]
    t = spark.createDataFrame(rows, "k string, target_id string, chapter_id string, kind string, seg_ids array<string>, action_seg_id string, anchor_t double, lo double, hi double")
    got = {r.target_id: (r.anchor_t, round(r.lo, 3), round(r.hi, 3)) for r in E.normalised_targets(t, seg, ch, ["k"]).collect()}
    assert got == {"a": (12.0, 11.85, 13.999), "b": (12.5, 9.75, 13.999), "d": (13.0, 1.0, 2.0)}


def test_summary_rows_for_all_chapters(spark):
    ch = spark.createDataFrame([("v", "a", "A"), ("v", "b", "B")], "k string, chapter_id string, title string")
    s = spark.createDataFrame([("v", "a", " ")], "k string, chapter_id string, title string")
    full, missing = E.normalised_summary(s, ch, ["k"])
    assert {r.chapter_id: r.title for r in full.collect()} == {"a": "A", "b": "B"} and [r.chapter_id for r in missing.collect()] == ["b"]


def test_binding_depends_on_order(spark):
    s = lambda a, b: spark.createDataFrame([("v", 0, a, "n", None), ("v", 1, b, "n", None)], "k string, pos int, id string, name string, crop string")
    assert E.selections_binding(s("x", "y"), ["k"]).first().sha256 != E.selections_binding(s("y", "x"), ["k"]).first().sha256


def test_sources(spark):
    same = lambda a, b: spark.range(1).select(E.source_matches(F.lit(a), F.lit(b))).first()[0]
    assert same("https://youtu.be/abcdefghijk", "https://www.youtube.com/watch?v=abcdefghijk&t=3") and same(None, "x") and not same("a", "b")


def test_assets(spark):
    a = spark.createDataFrame([("v", "1.jpg", "h", 0.0, 0.0, 0.0), ("v", "2.jpg", "h", 9.0, 0.0, 0.0), ("v", "3.jpg", "h", 0.0, 0.0, 0.0)], "k string, file string, sha256 string, luma_mad double, edge_mad double, changed_ratio double")
    f = spark.createDataFrame([("v", "1.jpg", "h"), ("v", "2.jpg", "x")], "k string, file string, sha256 string")
    assert {r.file: r.faults for r in E.asset_checks(a, f, ["k"], (3.0, 4.0, 0.025)).collect()} == {"1.jpg": [], "2.jpg": ["hash", "picture"], "3.jpg": ["missing"]}


def test_a_moving_corner_is_a_webcam():
    rng = np.random.default_rng(0)
    frames = np.full((60, 90, 160), 120, np.uint8)
    frames[:, 60:85, 110:150] = rng.integers(0, 255, (60, 25, 40))
    (kind, box), = L.overlays(frames)
    assert kind == "webcam" and box[:4] == (110, 60, 150, 85)
    assert L.overlays(np.full((60, 90, 160), 120, np.uint8)) == [] and L.overlays(frames[:20]) == []


def test_boxes_are_four_connected():
    b = np.zeros((5, 6), bool)
    b[0, 0] = b[1, 1] = b[3, 3] = b[3, 4] = b[4, 4] = True
    assert L.boxes(b) == [(0, 0, 1, 1, 1), (1, 1, 2, 2, 1), (3, 3, 5, 5, 3)] and L.boxes(~b & b) == []


def test_scaling_down():
    p = np.arange(16, dtype=np.uint8)
    assert L.box_average(p, 4, 4, 2, 2).tolist() == [[2, 4], [10, 12]]


def test_markup(spark):
    cases = {
        '<p>ok <a href="https://x.org/a">x</a> <img src="assets/a.jpg"></p>': [],
        "<script>1</script>": ["element script"],
        '<p onclick="x" style="y">': ["attribute onclick", "attribute style"],
        '<img src="https://x/y.png"><a href="javascript:x">': ["remote source", "link scheme"],
        "<style>@import 'x'; a{background:url(http://x)}</style>": ["css construct", "css resource"],
        None: [],
        "<!-- <script> --><P>a<br/><a href='#x'>": [],
        "<meta http-equiv=refresh><meta http-equiv='Content-Security-Policy'>": ["meta directive"],
        '<img src="assets/../a.jpg" SRC=assets/b.png>': ["asset path"],
        "<style>a{src:url( 'data:font/woff;base64,AA=' )} <b></style><i>": ["element i"],
        '<a href="https://">x</a><a href="http://u@h">': ["link scheme"],
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r.f for r in rows.select("i", faults(F.col("t")).alias("f")).orderBy("i").collect()] == list(cases.values())
