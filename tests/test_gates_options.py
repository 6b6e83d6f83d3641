"""Gates and options."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import options as O
from tidemark.operators import gates as G


def checks(df):
    return sorted((r.level, r["check"], r["where"]) for r in df.collect())


def test_transcript_gate(spark):
    t = spark.createDataFrame([("a", "ok"), ("b", "weird")], "k string, status string")
    s = spark.createDataFrame([("a", "s1", 0, 0.0, 1.0, "x"), ("a", "s1", 1, 5.0, 5.0, " "), ("a", "s2", 2, 4.0, float("nan"), "y")], "k string, seg_id string, pos int, start double, end double, text string")
    assert checks(G.transcript_rules(t, s, ["k"])) == [("errors", "empty", "transcript"), ("errors", "order", "s2"), ("errors", "status", "transcript"), ("errors", "time", "s2"), ("errors", "unique", "s1"), ("warnings", "empty", "s1"), ("warnings", "text", "s1")]


def test_candidate_gate(spark):
    p = spark.createDataFrame([("a", "h", "h", "model", False), ("b", "h", "x", "user", False)], "k string, bound_sha256 string, current_sha256 string, decided_by string, any_frames boolean")
    c = spark.createDataFrame([("a", "c1", "unresolved"), ("a", "c2", "covered")], "k string, id string, status string")
    v = spark.createDataFrame([("a", "contradicts"), ("b", "contradicts")], "k string, verdict string")
    assert checks(G.candidate_rules(p, c, v, ["k"])) == [("errors", "coverage", "c1"), ("errors", "probe", "chapters"), ("errors", "stale", "candidates"), ("warnings", "probe", "chapters")]


def test_summary_and_brief(spark):
    s = spark.createDataFrame([("a", "xx", "o")], "k string, lang string, overview string")
    ch = spark.createDataFrame([("a", "c1"), ("a", "c2")], "k string, chapter_id string")
    b = spark.createDataFrame([("a", "c1", 0, "", "poem", []), ("a", "c9", 0, "t", None, ["s1"])], "k string, chapter_id string, block_no int, text string, kind string, seg_ids array<string>")
    got = checks(G.summary_rules(s, ch, b, ["k"]))
    assert [c for _, c, _ in got] == ["chapter-coverage", "citation", "kind", "language", "reference", "text"]
    seg = spark.createDataFrame([("a", "s1", 0), ("a", "s2", 1)], "k string, seg_id string, pos int")
    i = spark.createDataFrame([("a", "synthesis", 0, "x", ["s2", "s1"]), ("a", "takeaways", 0, " ", ["s9"]), ("a", "more", 0, "x", ["s1"])], "k string, section string, pos int, text string, seg_ids array<string>")
    assert [(c, w) for _, c, w in checks(G.brief_rules(i, seg, ["k"]))] == [("brief", "more/0"), ("brief", "takeaways/0"), ("order", "synthesis/0"), ("reference", "takeaways/0")]


def test_bindings_and_approvals(spark):
    m = spark.createDataFrame([("a", {"x": "1", "y": "2"}, {"x": "1", "y": "3", "z": "4"})], "k string, recorded map<string,string>, current map<string,string>")
    assert checks(G.manifest_rules(m, ["k"], ("x", "y", "z"))) == [("errors", "binding", "z"), ("errors", "stale", "y")]
    t = spark.createDataFrame([("a", "partial", "f"), ("b", "partial", "f"), ("c", "ok", None)], "k string, status string, fingerprint string")
    a = spark.createDataFrame([("a", "f"), ("b", "old")], "k string, fingerprint string")
    assert {r.k: r.accepted for r in G.partial_accepted(t, a, ["k"]).collect()} == {"a": True, "b": False, "c": True}


def test_reports(spark):
    f = spark.createDataFrame([("a", "errors", "x", "w", "m"), ("a", "warnings", "y", "w", "m")], "k string, level string, check string, where string, message string")
    r = G.report_rows(f, ["x", "y", "z"], ["k"], spark.createDataFrame([("a",)], "k string"))
    assert {x["check"]: x.status for x in r.collect()} == {"x": "FAIL", "y": "WARN", "z": "PASS"}
    s = spark.createDataFrame([("a", 65.0, 70.0), ("a", 5.0, 9.0)], "k string, start double, end double")
    assert G.spans_text(s, ["k"]).first().text == "00:05-00:09, 01:05-01:10"


def test_profiles():
    assert O.resolve_profile("light", {"cap": 7})["cap"] == 7 and O.resolve_profile("advanced") == O.PROFILES["high"]
    for bad in (("x", None), ("high", {"nope": 1})):
        with pytest.raises(ValueError):
            O.resolve_profile(*bad)
    assert O.profile_digest(O.PROFILES["high"]) != O.profile_digest(O.PROFILES["standard"])


def test_columns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(O.target_times(F.lit("action_result"), F.lit(10.0), F.lit(9.85), F.lit(11.0), O.PROFILES["standard"])) == [10.2, 10.8, 11.0]
    assert one(O.target_times(F.lit("slide"), F.lit(10.0), F.lit(0.0), F.lit(20.0), O.PROFILES["high"])) == [10.0, 19.75, 6.0, 14.0]
    assert one(O.first_known(F.lit(""), F.lit("xx"), F.lit("he"), among=("en", "he"), default="en")) == "he"
    assert one(O.caption_fields(F.lit('{"shows": "a", "why": "b"}'))).shows == "a" and one(O.caption_fields(F.lit('"plain"'))).shows == "plain"
    assert one(O.metadata(F.lit('{"title": "t", "uploader": "u", "duration": 5}'))).channel == "u"
    assert one(O.is_asset_name(F.lit("a.jpg"))) and not one(O.is_asset_name(F.lit("../a.jpg"))) and one(O.relative(F.lit("/r/a/b"), F.lit("/r"))) == "a/b"
    assert one(O.tile_times(F.lit(1.0), F.lit(3), F.lit(2.0))) == [1.0, 3.0, 5.0]
    f = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(h).alias("height")) for w, h in ((10, 10), (20, 20), (25, 16))])
    assert one(O.largest_format(f)).width == 20
