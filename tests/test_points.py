"""Points and the look-ups beside them."""

import hashlib

import pytest

from tidemark.operators import points as P


def test_points_take_their_targets_segments(spark):
    rows = spark.createDataFrame([("v", 1, 5.0, "cue", None), ("v", 2, 50.0, "scene", 0.5), ("v", 3, 99.0, "odd", 0.1)], "k string, point_id int, t double, reason string, scene_score double")
    ch = spark.createDataFrame([("v", "c0", 0.0, 20.0), ("v", "c1", 20.0, 60.0)], "k string, span_id string, start double, end double")
    tg = spark.createDataFrame([("v", "c0", "t1", "slide", 4.0, 4.96, ["s9"]), ("v", "c1", "t2", "state", 4.0, 6.0, ["s8"])], "k string, chapter_id string, target_id string, kind string, lo double, hi double, seg_ids array<string>")
    seg = spark.createDataFrame([("v", "s1", 0, 0.0, 10.0), ("v", "s2", 1, 45.0, 49.5)], "k string, span_id string, pos int, start double, end double")
    got = {r.point_id: r for r in P.make_points(rows, ch, tg, seg, ["k"]).collect()}
    assert (got[1].chapter_id, got[1].target_ids, got[1].target_kinds, got[1].seg_ids, got[1].priority, got[1].scene_score) == ("c0", ["t1"], ["slide"], ["s9"], 90, 0.0)
    assert (got[2].chapter_id, got[2].target_ids, got[2].seg_ids, got[2].priority) == ("c1", [], ["s2"], 40)
    assert (got[3].chapter_id, got[3].seg_ids, got[3].priority) == (None, [], 0)


def test_entries(spark):
    m = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert P.entries(m).count() == 2 and [r.n for r in P.entries(m, ["b"]).collect()] == [2]
    with pytest.raises(ValueError, match="unknown ids: \\['x'\\]"):
        P.entries(m, ["a", "x"])


def test_file_hashes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    assert [r.sha256 for r in P.file_hashes(spark, str(tmp_path)).collect()] == [hashlib.sha256(b"abc").hexdigest()]
