"""Registered queries on joins of evidence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import layout, markup
from tidemark.operators import evidence as E
from tidemark.plans.tables import CHAPTERS, EVENTS, chapters, events, rounded, table

K = ["user_id"]
QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _chapters(spark: SparkSession, sf: str) -> DataFrame:
    return chapters(spark, sf).withColumnRenamed("span_id", "chapter_id")


@query(
    f"""WITH {CHAPTERS}, cv AS (SELECT DISTINCT user_id, 'c' || floor(t / 259200)::BIGINT AS chapter_id FROM ev WHERE kind = 'purchase'), op AS (SELECT ch.* FROM ch LEFT JOIN cv ON cv.user_id = ch.user_id AND cv.chapter_id = ch.span_id WHERE needs_frames AND cv.user_id IS NULL)
SELECT user_id, span_id AS chapter_id, round(start + ("end" - start) * f, 3)::DOUBLE AS t, 'coverage' AS reason FROM op, (VALUES (0.5), (0.25)) x(f) UNION ALL SELECT user_id, span_id, "end" - 0.5, 'final' FROM ch WHERE pos = 9 AND needs_frames"""
)
def coverage_points(spark: SparkSession, sf: str) -> DataFrame:
    cov = events(spark, sf).filter("kind = 'purchase'").select("user_id", F.concat(F.lit("c"), F.floor(F.col("t") / 259200).cast("string")).alias("chapter_id"))
    return E.coverage_points(_chapters(spark, sf), cov, K, 2)


_STATE = "st AS (SELECT user_id, pos AS state_id, 'c' || floor(t / 259200)::BIGINT AS chapter_id, CASE kind WHEN 'view' THEN 'A' WHEN 'click' THEN 'B' ELSE 'C' END AS mode, pos % 4 = 0 AS has, t AS rt, t - (pos % 5) AS fs, pos % 3 = 0 AS build FROM ev)"


@query(
    f"""WITH {CHAPTERS}, {_STATE}, j AS (SELECT st.* FROM st JOIN ch ON ch.user_id = st.user_id AND ch.span_id = st.chapter_id WHERE needs_frames AND (mode != 'A' OR has))
SELECT user_id, state_id, round(rt, 6) AS t, CASE WHEN has THEN 'target' ELSE 'state' END AS reason, 'main' AS stage FROM j UNION ALL SELECT user_id, state_id, round(fs, 6), 'target', 'first' FROM j WHERE build AND has AND fs < rt - 2"""
)
def state_points(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("pos")
    mode = F.when(F.col("kind") == "view", "A").when(F.col("kind") == "click", "B").otherwise("C")
    st = events(spark, sf).select("user_id", p.alias("state_id"), F.concat(F.lit("c"), F.floor(F.col("t") / 259200).cast("string")).alias("chapter_id"), mode.alias("mode"), F.when(p % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("target_ids"), F.col("t").alias("representative_t"), (F.col("t") - p % 5).alias("first_settled"), (p % 3 == 0).alias("is_build"))
    return rounded(E.state_points(st, _chapters(spark, sf), K))


@query(
    f"""WITH {CHAPTERS}, s AS (SELECT user_id, pos AS id, t, 'c' || floor((t + CASE WHEN pos % 11 = 0 THEN 259200 ELSE 0 END) / 259200)::BIGINT AS chapter_id, pos % 7 = 0 AS gone, pos % 5 = 0 AS no_asset FROM ev WHERE kind = 'purchase'),
b AS (SELECT s.user_id, s.id, min(e.pos) AS block_no FROM s JOIN ev e ON e.user_id = s.user_id AND e.kind = 'view' AND 'c' || floor(e.t / 259200)::BIGINT = s.chapter_id AND e.pos % 10 = s.id % 10 GROUP BY ALL)
SELECT s.user_id, s.id, s.chapter_id, round(CASE WHEN NOT gone THEN t END, 6) AS t, round(CASE WHEN NOT no_asset THEN t + 1 END, 6) AS actual_t, list_filter([CASE WHEN gone THEN 'unknown candidate' END, CASE WHEN no_asset THEN 'missing asset' END,
 CASE WHEN ch.user_id IS NOT NULL AND ((NOT gone AND NOT (t >= start AND t < "end")) OR (NOT no_asset AND NOT (t + 1 >= start AND t + 1 < "end"))) THEN 'another chapter' END], lambda x: x IS NOT NULL) AS faults, b.block_no FROM s LEFT JOIN ch ON ch.user_id = s.user_id AND ch.span_id = s.chapter_id LEFT JOIN b ON b.user_id = s.user_id AND b.id = s.id"""
)
def selection_evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    s = e.filter("kind = 'purchase'")
    moved = F.floor((F.col("t") + F.when(F.col("pos") % 11 == 0, 259200).otherwise(0)) / 259200).cast("string")
    sel = s.select("user_id", F.col("pos").alias("id"), F.concat(F.lit("c"), moved).alias("chapter_id"), F.array(F.col("pos") % 10).alias("anchors"))
    cand = s.filter("pos % 7 != 0").select("user_id", F.col("pos").alias("id"), "t")
    assets = s.filter("pos % 5 != 0").select("user_id", F.col("pos").alias("id"), (F.col("t") + 1).alias("actual_t"))
    blocks = e.filter("kind = 'view'").select("user_id", F.concat(F.lit("c"), F.floor(F.col("t") / 259200).cast("string")).alias("chapter_id"), F.col("pos").alias("block_no"), F.array(F.col("pos") % 10).alias("seg_ids"))
    return rounded(E.selection_evidence(sel, cand, assets, _chapters(spark, sf), blocks, K))


@query(
    f"""WITH {EVENTS}, s AS (SELECT user_id, pos, t, floor(t / 86400) * 86400 AS p0, floor(t / 86400) * 86400 + 86400 AS p1, t - value / 20 AS c0, t + value / 20 AS c1 FROM ev), w AS (SELECT *, greatest(t - 1.5, p0, c0) AS lo, least(t + 1.5, p1, c1 - 0.25) AS hi FROM s)
SELECT user_id, pos, round(CASE WHEN hi - lo >= 0.1 THEN lo END, 6) AS lo, round(CASE WHEN hi - lo >= 0.1 THEN hi END, 6) AS hi FROM w"""
)
def refinement_windows(spark: SparkSession, sf: str) -> DataFrame:
    d = F.floor(F.col("t") / 86400) * 86400
    s = events(spark, sf).select("user_id", "pos", "t", d.alias("part_start"), (d + 86400).alias("part_end"), (F.col("t") - F.col("value") / 20).alias("start"), (F.col("t") + F.col("value") / 20).alias("end"))
    return rounded(E.refinement_windows(s, K).select("user_id", "pos", "lo", "hi"), 6)


@query("SELECT n_regionkey, n_name AS cache_key, CASE WHEN n_nationkey % 3 = 0 THEN 'miss' WHEN n_nationkey % 4 = 0 THEN 'stale' ELSE 'hit' END AS status FROM nation")
def cached_parts(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    now = n.select("n_regionkey", F.col("n_name").alias("cache_key"), F.sha2("n_name", 256).alias("sha256"))
    old = n.filter("n_nationkey % 3 != 0").select("n_regionkey", F.col("n_name").alias("cache_key"), F.sha2(F.when(F.col("n_nationkey") % 4 == 0, "x").otherwise(F.col("n_name")), 256).alias("sha256"))
    return E.cached_parts(now, old, ["n_regionkey"])


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, sum(1 + o_orderkey % 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS used FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) SELECT o_custkey, o_orderkey, used::BIGINT AS used FROM o WHERE used <= 6"""
)
def ocr_budget(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "slide").when(F.col("o_orderpriority") == "2-HIGH", "diagram").otherwise("state")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("cluster"), F.array(kind).alias("kinds"), (1 + F.col("o_orderkey") % 3).alias("n"))
    return E.ocr_budget(o, ["o_custkey"], 3).select("o_custkey", "o_orderkey", "used")


@query(
    f"""WITH {EVENTS}, l AS (SELECT user_id, floor(t / 86400)::BIGINT AS day, count(*) AS attempts, arg_max((kind, t), (t, pos)) AS x FROM ev GROUP BY user_id, day)
SELECT user_id, day, attempts, CASE WHEN x[1] = 'view' THEN 'done' WHEN x[1] = 'error' THEN 'failed' WHEN attempts >= 3 THEN 'deferred' ELSE 'retry' END AS outcome, round(CASE WHEN x[1] NOT IN ('view', 'error') THEN x[2] + pow(2, attempts) END, 6) AS next_retry_at FROM l"""
)
def retry_plan(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("day", F.floor(F.col("t") / 86400))
    a = e.select("user_id", "day", F.col("t").alias("at"), F.when(F.col("kind") != "view", F.col("kind")).alias("category"), (F.col("kind") != "error").alias("retryable"), F.lit(None).cast("double").alias("wait"))
    return rounded(E.retry_plan(a, [*K, "day"]), 6)


@query(
    f"""WITH {CHAPTERS}, tg AS (SELECT user_id, pos AS target_id, 'c' || floor(t / 259200)::BIGINT AS chapter_id, CASE WHEN pos % 2 = 0 THEN 'action_result' ELSE 'state' END AS kind, t AS s, t + value AS e FROM ev WHERE kind = 'error'), j AS (SELECT tg.*, ch.start AS c0, ch."end" - 0.001 AS c1 FROM tg JOIN ch ON ch.user_id = tg.user_id AND ch.span_id = tg.chapter_id),
a AS (SELECT *, greatest(c0, least(CASE WHEN kind = 'action_result' THEN e ELSE (s + e) / 2 END, c1)) AS anchor FROM j), w AS (SELECT *, greatest(c0, least(CASE WHEN kind = 'action_result' THEN anchor - 0.15 ELSE s - 0.25 END, c1)) AS lo, greatest(c0, least(CASE WHEN kind = 'action_result' THEN anchor + 2.5 ELSE e + 0.75 END, c1)) AS hi FROM a)
SELECT user_id, target_id, round(anchor, 6) AS anchor_t, round(lo, 6) AS lo, round(greatest(hi, lo + 0.05), 6) AS hi FROM w"""
)
def normalised_targets(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).filter("kind = 'error'")
    none = F.lit(None).cast("double")
    t = e.select("user_id", F.col("pos").alias("target_id"), F.concat(F.lit("c"), F.floor(F.col("t") / 259200).cast("string")).alias("chapter_id"), F.when(F.col("pos") % 2 == 0, "action_result").otherwise("state").alias("kind"), F.array("pos").alias("seg_ids"), F.col("pos").alias("action_seg_id"), none.alias("anchor_t"), none.alias("lo"), none.alias("hi"))
    seg = e.select("user_id", F.col("pos").alias("seg_id"), F.col("t").alias("start"), (F.col("t") + F.col("value")).alias("end"))
    return rounded(E.normalised_targets(t, seg, _chapters(spark, sf), K).select("user_id", "target_id", "anchor_t", "lo", "hi"), 6)


@query(markup.faults_sql("pages", "page_id", "html"))
def html_faults(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", markup.faults(F.col("html")).alias("faults"))


@query(None)
def find_overlays(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of 32 x 18 made from vectors: the corner changes from frame to frame, the rest stands still."""
    v = table(spark, sf, "embeddings").select((F.col("vec_id") % 4).alias("video"), F.floor(F.col("vec_id") / 4).alias("i"))
    cell = lambda k: F.when((k % 32 < 8) & (k < 32 * 6), F.pmod(F.xxhash64("video", "i", k), F.lit(200))).otherwise(90)
    hexed = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(32 * 18 - 1)), lambda k: F.lpad(F.hex(cell(k).cast("int")), 2, "0")), "")
    return layout.find_overlays(v.select("video", "i", F.unhex(hexed).alias("pixels")), ["video"], 32, 18)
