"""Registered queries on points and the look-ups beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import signature as G
from tidemark.operators import points as P
from tidemark.plans.tables import CHAPTERS, EVENTS, chapters, events, rounded, table

K = ["user_id"]
QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _streams(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks as cues, purchases as scenes with a score, errors as pins."""
    e = events(spark, sf)
    of = lambda kind, reason: e.filter(F.col("kind") == kind).select("user_id", F.col("pos").alias("point_id"), "t", F.lit(reason).alias("reason"))
    return P.union_points([of("click", "cue"), e.filter("kind = 'purchase'").select("user_id", F.col("pos").alias("point_id"), "t", F.lit("scene").alias("reason"), F.col("value").alias("scene_score")), of("error", "pin")])


_POINTS = "po AS (SELECT user_id, pos AS point_id, t, CASE kind WHEN 'click' THEN 'cue' WHEN 'purchase' THEN 'scene' ELSE 'pin' END AS reason, CASE kind WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS stream, CASE WHEN kind = 'purchase' THEN value ELSE 0 END AS score FROM ev WHERE kind IN ('click', 'purchase', 'error'))"


@query(f"WITH {EVENTS}, {_POINTS} SELECT user_id, reason, stream, count(*) AS points, count(nullif(score, 0)) AS scored FROM po GROUP BY ALL")
def union_points(spark: SparkSession, sf: str) -> DataFrame:
    s = _streams(spark, sf)
    return s.groupBy("user_id", "reason", "stream").agg(F.count("*").alias("points"), F.count(F.nullif(F.col("scene_score"), F.lit(0.0))).alias("scored"))


@query(
    f"""WITH {CHAPTERS}, {_POINTS}, tg AS (SELECT user_id, pos AS target_id, 'c' || floor(t / 259200)::BIGINT AS chapter_id, CASE WHEN pos % 2 = 0 THEN 'slide' ELSE 'state' END AS kind, t - 600 AS lo, t + value * 60 AS hi, [pos, pos + 1] AS seg_ids FROM ev WHERE kind = 'view'),
sg AS (SELECT user_id, pos AS span_id, pos, t AS s, t + value * 60 AS e FROM ev WHERE kind != 'view'),
lc AS (SELECT user_id, max(pos) AS last FROM ch GROUP BY user_id),
pc AS (SELECT po.*, arg_min(ch.span_id, ch.pos) AS chapter_id FROM po LEFT JOIN ch ON ch.user_id = po.user_id AND (po.t >= ch.start AND po.t < ch."end" OR ch.pos = (SELECT last FROM lc WHERE lc.user_id = po.user_id) AND abs(po.t - ch."end") <= 0.05) GROUP BY ALL),
tt AS (SELECT pc.user_id, pc.point_id, list_sort(list_distinct(list(tg.target_id))) AS target_ids, list_sort(list_distinct(list(tg.kind))) AS target_kinds, list_sort(list_distinct(flatten(list(tg.seg_ids)))) AS cited FROM pc JOIN tg ON tg.user_id = pc.user_id AND tg.chapter_id = pc.chapter_id AND pc.t BETWEEN tg.lo - 0.05 AND tg.hi + 0.05 GROUP BY ALL),
hs AS (SELECT po.user_id, po.point_id, list_sort(list(sg.span_id)) AS held FROM po JOIN sg ON sg.user_id = po.user_id AND po.t >= sg.s AND po.t < sg.e GROUP BY ALL),
ns AS (SELECT po.user_id, po.point_id, [arg_min(sg.span_id, (least(abs(po.t - sg.s), abs(po.t - sg.e)), sg.pos))] AS near FROM po JOIN sg ON sg.user_id = po.user_id AND least(abs(po.t - sg.s), abs(po.t - sg.e)) <= 1 GROUP BY ALL)
SELECT pc.user_id, pc.point_id, round(pc.t, 3) AS requested_t, pc.reason, pc.chapter_id, coalesce(target_ids, []) AS target_ids, coalesce(target_kinds, []) AS target_kinds, coalesce(cited, held, near, []) AS seg_ids, pc.score AS scene_score, CASE pc.reason WHEN 'cue' THEN 90 WHEN 'pin' THEN 80 ELSE 40 END AS priority
FROM pc LEFT JOIN tt ON tt.user_id = pc.user_id AND tt.point_id = pc.point_id LEFT JOIN hs ON hs.user_id = pc.user_id AND hs.point_id = pc.point_id LEFT JOIN ns ON ns.user_id = pc.user_id AND ns.point_id = pc.point_id"""
)
def make_points(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    end = F.col("t") + F.col("value") * 60
    targets = e.filter("kind = 'view'").select("user_id", F.col("pos").alias("target_id"), F.concat(F.lit("c"), F.floor(F.col("t") / 259200).cast("string")).alias("chapter_id"), F.when(F.col("pos") % 2 == 0, "slide").otherwise("state").alias("kind"), (F.col("t") - 600).alias("lo"), end.alias("hi"), F.array("pos", F.col("pos") + 1).alias("seg_ids"))
    segments = e.filter("kind != 'view'").select("user_id", F.col("pos").alias("span_id"), "pos", F.col("t").alias("start"), end.alias("end"))
    return rounded(P.make_points(_streams(spark, sf), chapters(spark, sf), targets, segments, K, width=86400.0))


@query(
    f"""WITH {CHAPTERS}, sp AS (SELECT user_id, pos AS state_id, t AS s, t + value * 3600 AS e FROM ev), m AS (SELECT sp.user_id, sp.state_id, list(ch.span_id ORDER BY ch.pos) AS ids FROM sp JOIN ch ON ch.user_id = sp.user_id AND ch.start < sp.e AND ch."end" > sp.s GROUP BY ALL)
SELECT sp.user_id, sp.state_id, coalesce(ids, []) AS chapter_ids FROM sp LEFT JOIN m USING (user_id, state_id)"""
)
def span_chapters(spark: SparkSession, sf: str) -> DataFrame:
    s = events(spark, sf).select("user_id", F.col("pos").alias("state_id"), F.col("t").alias("start"), (F.col("t") + F.col("value") * 3600).alias("end"))
    c = chapters(spark, sf).withColumnRenamed("span_id", "chapter_id")
    return P.span_chapters(s, c, K, "state_id", width=259200.0).select("user_id", "state_id", "chapter_ids")


@query(
    "WITH r AS (SELECT l_suppkey, l_discount::DOUBLE AS luma_mad, CASE WHEN l_linenumber > 1 THEN l_tax::DOUBLE END AS edge_mad, (0.01 * (l_linenumber % 8))::DOUBLE AS edge, 0.05::DOUBLE AS luma FROM lineitem), m AS (SELECT l_suppkey, 'luma_mad' AS metric, luma_mad AS v, luma AS x FROM r UNION ALL SELECT l_suppkey, 'edge_mad', edge_mad, edge FROM r) SELECT l_suppkey, metric, round(greatest(0, max(v)), 6) AS worst, count(*) FILTER (v > x) AS failed FROM m WHERE v IS NOT NULL GROUP BY ALL"
)
def worst_metrics(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_discount").cast("double").alias("luma_mad"), F.when(F.col("l_linenumber") > 1, F.col("l_tax").cast("double")).alias("edge_mad"), (F.lit(0.01) * (F.col("l_linenumber") % 8)).alias("edge"), F.lit(0.05).alias("luma"))
    return rounded(P.worst_by_metric(i, ["l_suppkey"], {"luma_mad": "luma", "edge_mad": "edge"}))


@query("SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return P.first_seen(table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey"], ["o_orderpriority"], ["o_orderkey"])


@query(
    "WITH g AS (SELECT l_orderkey, list_distinct(list(l_suppkey)) AS a, list_distinct(list(l_partkey % 100)) AS b FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, list_sort(list_distinct(list_concat(a, b))) AS either, list_sort(list_intersect(a, b)) AS both, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_left, len(list_intersect(a, b)) > 0 AS common, len(a) AS n FROM g"
)
def id_sets(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("long").alias("l_suppkey"), (F.col("l_partkey") % 100).cast("long").alias("p"))
    a, b = P.distinct_ids(i, ["l_orderkey"], "l_suppkey"), P.distinct_ids(i, ["l_orderkey"], "p").select("l_orderkey", F.col("ids").alias("others"))
    return a.join(b, "l_orderkey").withColumn("s", P.id_sets(F.col("ids"), F.col("others"))).select("l_orderkey", "s.either", "s.both", "s.only_left", F.col("s.any").alias("common"), "n")


@query(
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: (floor(abs(x::DOUBLE) * 1000))::BIGINT % 256) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0) SELECT vec_id, round(list_avg(q), 6) AS mean_luma, round(sqrt(greatest(list_avg(list_transform(q, lambda x: x * x)) - list_avg(q) * list_avg(q), 0)), 6) AS contrast, 'd' || vec_id AS fingerprint, len(list_filter(q, lambda x: x > 99))::INT AS text_chars, least(len(q), 10 + vec_id % 9)::INT AS pairs FROM v"
)
def shown_quality(spark: SparkSession, sf: str) -> DataFrame:
    """What is shown of vectors as pictures, beside two series zipped as far as both reach; private columns stripped."""
    q = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000) % 256)
    v = table(spark, sf, "embeddings").filter("embedding IS NOT NULL AND size(embedding) > 0").select("vec_id", q.alias("_q"))
    v = v.withColumn("_s", G.statistics(F.col("_q"), F.col("_q"))).withColumn("quality", P.public_quality(F.col("_s"), F.concat(F.lit("d"), F.col("vec_id").cast("string")), text_chars=F.size(F.filter("_q", lambda x: x > 99))))
    other = F.sequence(F.lit(1), (F.lit(10) + F.col("vec_id") % 9).cast("int"))
    v = P.strip_private(v.withColumn("pairs", F.size(P.zipped(F.col("_q"), other, ("blur", "frame")))))
    return rounded(v.select("vec_id", "quality.mean_luma", "quality.contrast", "quality.fingerprint", "quality.text_chars", "pairs"))
