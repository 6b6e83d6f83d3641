from pyspark.sql import functions as F

from tidemark.functions import options as O
from tidemark.functions import text as T
from tidemark.operators import gates as V
from tidemark.operators import grounding as A

K = ["v"]


def test_glossary_terms_are_plain_words(spark):
    texts = spark.createDataFrame([("a", "uses C++ (x\\Ey) and catalog"), ("a", None), ("b", "cat")], "v string, text string")
    terms = spark.createDataFrame([("a", "C++", "סי"), ("a", "x\\Ey", "איקס"), ("a", "cat", "חתול"), ("b", "cat", "חתול"), ("b", "cat", "cat"), ("b", None, "חתול")], "v string, term string, form string")
    got = {(r.v, r.message) for r in A.glossary_rules(texts, terms, K).collect()}
    assert got == {("a", "C++ is used for סי"), ("a", "x\\Ey is used for איקס"), ("b", "cat is used for חתול")}


def test_statistics_of_empty_summaries(spark):
    segments = spark.createDataFrame([("a", "s1"), ("a", "s2")], "v string, seg_id string")
    blocks = spark.createDataFrame([], "v string, text string, seg_ids array<string>")
    assert [tuple(r) for r in A.summary_statistics(blocks, segments, K).collect()] == [("a", 2, 0, 0.0, 0, 0.0)]
    assert A.summary_statistics(blocks, segments.limit(0), K).count() == 0


def test_length_needs_a_duration(spark):
    s = spark.createDataFrame([("a", 10, 0.5, 0.0), ("b", 10, 0.5, None), ("c", 1000, 0.5, 60.0), ("d", 100, 0.1, 60.0)], "v string, words long, coverage double, duration double")
    assert sorted((r.v, r.check) for r in A.length_rules(s, K).collect()) == [("c", "length"), ("d", "coverage")]


def test_inventory(spark):
    good = '{"id":"a","duration":3,"subtitles":{"en":[{"url":"u"}]},"automatic_captions":null}'
    rows = [(good, None), ('{"id":1,"duration":3}', "bad"), ('{"id":"a","duration":0}', "bad"), ('{"id":"a","duration":"3"}', "bad"), ('{"id":"a","duration":3,"subtitles":[]}', "bad"), ('{"id":"a","duration":3,"subtitles":{"en":["x"]}}', "bad"), (None, "bad"), ("", "bad")]
    df = spark.createDataFrame(rows, "info string, want string")
    assert df.filter(O.inventory_fault(F.col("info")).isNull() != F.col("want").isNull()).collect() == []


def test_missing_values_are_found(spark):
    t = spark.createDataFrame([("a", None)], "v string, status string")
    s = spark.createDataFrame([], "v string, seg_id string, pos int, start double, end double, text string")
    assert {r.check for r in V.transcript_rules(t, s, K).collect()} == {"status", "empty"}


def test_retry_dates_do_not_depend_on_the_session(spark):
    row = spark.range(1).select(T.retry_after(F.lit("Thu, 01 Jan 2026 00:01:00 GMT"), F.lit(None).cast("string"), F.lit(1767225600.0)).alias("w"))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert row.first().w == 60.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_receipt_without_a_measure_is_a_failure(spark):
    a = spark.createDataFrame([("a", "x", 1, 512, 288, None), ("a", "y", 0, 512, 288, 1.0)], "v string, id string, pos int, width int, height int, far double")
    assert [tuple(r) for r in A.shortlist_receipt(a, K, F.col("far") < 2).collect()] == [("a", ["y"], ["x"], 209)]
