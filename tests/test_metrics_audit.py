"""Metrics with golden results; audit rules."""

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import audit as A
from tidemark.operators import metrics as M

STATES = [("v", "s1", 0, 3.0, 8.0, "essential", "s1", ["a"]), ("v", "s2", 1, 13.0, 18.0, "acceptable", "s1", []), ("v", "s3", 2, 23.0, 28.0, "essential", "s3", ["b"]), ("v", "s4", 3, 40.0, 42.0, "essential", "s4", ["c"]), ("v", "s5", 4, 58.0, 59.0, "essential", "s5", ["d"])]


def tables(spark):
    st = spark.createDataFrame(STATES, "k string, state_id string, pos int, start double, end double, class string, root string, spoken array<string>")
    pool = spark.createDataFrame([("v", i, t) for i, t in enumerate((5.0, 15.0, 25.0, 35.0, 45.0, 55.0))], "k string, id int, t double")
    return st, pool, pool.filter("t <= 25").withColumn("anchors", F.when(F.col("t") == 5, F.array(F.lit("a"))).otherwise(F.array(F.lit("x"))))


def test_golden_metrics(spark):
    st, pool, sel = tables(spark)
    r = M.recall(st, pool, ["k"]).first()
    assert (r.hit, r.essential) == (2, 4)
    s = M.score_selection(sel, st, ["k"]).first()
    assert (s.selected, s.precision, round(s.redundancy, 6), round(s.efficiency, 6)) == (3, 1.0, round(1 / 3, 6), round(2 / 3, 6))
    a = M.alignment(sel, st, ["k"]).first()
    assert (a.hits, a.aligned) == (2, 1)
    dropped = spark.createDataFrame([("v", 41.0, "dedup")], "k string, t double, reason string")
    assert {r.state_id: r.reason for r in M.losses(st, sel, pool, dropped, ["k"]).collect()} == {"s4": "dedup_dropped", "s5": "not_in_pool"}


def test_recall_without_essentials_is_nan(spark):
    st, pool, _ = tables(spark)
    r = M.recall(st.filter("class = 'acceptable'"), pool, ["k"]).first()
    assert r.recall != r.recall


def test_text_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.numbers(F.lit("1,200 users, 30% and seven at v2"))) == ["1200", "30", "7"]
    assert one(T.canonical_url(F.lit("HTTPS://youtu.be/abcdefghijk?si=1"))) == "https://www.youtube.com/watch?v=abcdefghijk"
    assert one(T.canonical_url(F.lit("HTTP://Example.org/a?b=1#c"))) == "http://Example.org/a?b=1"
    assert one(T.canonical_url(F.lit("file.mp4"))) == "file.mp4"
    assert one(T.language(F.lit("iw-IL"))) == "he"
    assert one(T.cue(F.lit("As you can see, on this slide"))).lower() == "as you can see"
    assert one(T.loses_negation(F.lit("it works"), F.lit("it doesn't work")))
    assert one(T.version_drift(F.lit("1.2.3"), F.lit("1.3"))) == "minor"
    assert one(T.sanitized(F.lit("\x1b[31ma\nb https://x.y/z?t=1\n\nc\nd"))) == "b <url> | c | d"
    assert one(T.retry_after(F.lit("120"), F.lit(None), F.lit(0.0))) == 120.0
    assert one(T.retry_after(F.lit("Thu, 01 Jan 1970 00:01:40 GMT"), F.lit(None), F.lit(40.0))) == 60.0
    assert one(T.retry_after(F.lit("x"), F.lit("1500"), F.lit(0.0))) == 1.5


def test_entity_rules(spark):
    df = spark.createDataFrame([("v", "b1", ["Kubernets", "Terraform", "Photo-Shop", "ok"], "we use kubernetes, photo: shop."), ("v", "b2", [], None), ("v", "b3", ["Elixir"], None)], "k string, where string, terms array<string>, evidence string")
    assert [r.message.split()[0] for r in A.entity_rules(df, ["k"]).orderBy("where").collect()] == ["Terraform", "Elixir"]


def test_uncited_and_order(spark):
    seg = spark.createDataFrame([("v", f"s{i}", i, i * 30.0, i * 30.0 + 30, True) for i in range(6)], "k string, seg_id string, pos int, start double, end double, in_chapter boolean")
    blocks = spark.createDataFrame([("v", 0, ["s5", "s4"])], "k string, block_no int, seg_ids array<string>")
    assert [r["where"] for r in A.uncited_rules(seg, blocks, ["k"]).collect()] == ["0-120s"]
    assert A.order_rules(blocks, seg, ["k"]).count() == 1
