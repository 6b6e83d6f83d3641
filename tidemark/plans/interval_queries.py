"""Registered queries on intervals and joins of points with intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import clamp_window
from tidemark.operators import intervals as I
from tidemark.operators.runs import clip_to_chapters
from tidemark.plans.tables import CHAPTERS, EVENTS, SEGMENTS, chapters, events, rounded, segments

K = ["user_id"]
QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_ISLANDS = """, flagged AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sg WHERE "end" > start),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM flagged)"""


@query(f"WITH {SEGMENTS}{_ISLANDS.format(gap=600)} SELECT user_id, round(min(start), 6) AS start, round(max(\"end\"), 6) AS \"end\", count(*) AS n FROM numbered GROUP BY user_id, island")
def merge_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.merge_intervals(segments(spark, sf), K, 600.0))


@query(
    f"""WITH {SEGMENTS}, long AS (SELECT user_id, greatest(0.0, start - 300) AS start, least(duration, "end" + 300) AS "end" FROM sg WHERE duration > 1200), f AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM long WHERE "end" > start),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, round(min(start), 6) AS start, round(max("end"), 6) AS "end" FROM n GROUP BY user_id, island"""
)
def padded_sections(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.sections(segments(spark, sf), K, pad=300.0))


@query(
    f"""WITH {SEGMENTS}, w AS (SELECT *, coalesce(max("end") OVER (PARTITION BY user_id ORDER BY start, "end", pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, lag(start) OVER (PARTITION BY user_id ORDER BY pos) AS prev FROM sg),
a AS (SELECT user_id, count(*) AS segments, sum(greatest(0, "end" - greatest(start, before))) AS covered, max(greatest(0, start - before)) AS largest, count(*) FILTER (greatest(0, start - before) > 30) AS long_gaps, max("end") AS last, max(duration) AS duration,
 count(*) FILTER (start < prev) AS out_of_order, count(*) FILTER ("end" <= start) AS "empty", count(*) FILTER (start > duration + 2) AS beyond FROM w GROUP BY user_id)
SELECT user_id, segments, round(covered, 6) AS covered, round(covered / duration, 6) AS ratio, round(greatest(largest, greatest(0, duration - last)), 6) AS largest_gap, long_gaps + CASE WHEN greatest(0, duration - last) > 30 THEN 1 ELSE 0 END AS long_gaps, out_of_order, "empty", beyond FROM a"""
)
def coverage_health(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.coverage(segments(spark, sf), K, "duration"))


@query(
    f"""WITH {EVENTS}, g AS (SELECT *, CASE WHEN lag(t) OVER (PARTITION BY user_id ORDER BY t, pos) IS NULL OR t - lag(t) OVER (PARTITION BY user_id ORDER BY t, pos) > 21600 THEN 1 ELSE 0 END AS fresh FROM ev),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, pos ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, s AS session, round(min(t), 6) AS start, round(max(t), 6) AS "end", count(*) AS n FROM i GROUP BY user_id, s"""
)
def session_gap_6h(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("prev", F.lag("t").over(Window.partitionBy("user_id").orderBy("t", "pos")))
    s = I.islands(e, K, ["t", "pos"], F.col("t") - F.col("prev") <= 21600, "session")
    return rounded(s.groupBy("user_id", "session").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n")))


@query(
    f"""WITH {SEGMENTS}, s AS (SELECT *, text IN ('view', 'click') AS flag, lead(start) OVER (PARTITION BY user_id ORDER BY pos) AS nxt, lag(text IN ('view', 'click')) OVER (PARTITION BY user_id ORDER BY pos) AS was FROM sg),
i AS (SELECT *, sum(CASE WHEN flag = was THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM s),
r AS (SELECT user_id, island, min(start) AS start, arg_max(coalesce(nxt, "end"), pos) AS "end", count(*) AS n FROM i WHERE flag GROUP BY user_id, island) SELECT user_id, round(start, 6) AS start, round("end", 6) AS "end", n FROM r WHERE "end" - start > 36000"""
)
def uncited_runs(spark: SparkSession, sf: str) -> DataFrame:
    s = segments(spark, sf).withColumn("flag", F.col("text").isin("view", "click"))
    return rounded(I.flagged_runs(s, K, ["pos"], "flag", 36000.0))


@query(
    "WITH d AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user' OR turn % 3 < 2), r AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM d) SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n FROM r GROUP BY conv_id, run"
)
def citation_runs(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/conversations.parquet").filter("role = 'user' OR turn % 3 < 2")
    return I.consecutive_runs(c, ["conv_id"], "turn")


@query(f"WITH {EVENTS} SELECT user_id, pos, round(t, 6) AS t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, pos) - 1 AS rn FROM ev) WHERE rn % 4 = 0")
def every_fourth(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.every_kth(events(spark, sf), K, ["t", "pos"], 4).select("user_id", "pos", "t"))


@query(
    f"""WITH {SEGMENTS}{_ISLANDS.format(gap=0)}, m AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM numbered GROUP BY user_id, island), l AS (SELECT *, sum("end" - start) OVER (PARTITION BY user_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS upto, sum("end" - start) OVER (PARTITION BY user_id) AS total FROM m),
p AS (SELECT user_id, start, upto - ("end" - start) AS "from", upto, total / 8 AS step FROM l)
SELECT user_id, i::INT AS i, round(start + (i + 0.5) * step - "from", 3) AS t FROM p, range(0, 8) r(i) WHERE (i + 0.5) * step >= "from" AND (i + 0.5) * step < upto"""
)
def uniform_times(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.uniform_times(I.merge_intervals(segments(spark, sf), K, 0.0), K, 8), 3)


@query(
    f"""WITH {CHAPTERS}, m AS (SELECT e.user_id, e.pos, c.span_id, row_number() OVER (PARTITION BY e.user_id, e.pos ORDER BY c.start) AS rn FROM ev e JOIN ch c ON e.user_id = c.user_id AND e.t >= c.start AND (e.t < c."end" OR (c.pos = 9 AND abs(e.t - c."end") <= 0.05)))
SELECT e.user_id, e.pos, m.span_id FROM ev e LEFT JOIN m ON m.user_id = e.user_id AND m.pos = e.pos AND m.rn = 1"""
)
def contain_first(spark: SparkSession, sf: str) -> DataFrame:
    return I.containing_first(events(spark, sf), chapters(spark, sf), K, "pos", width=259200.0).select("user_id", "pos", "span_id")


_ERRORS = "er AS (SELECT user_id, pos AS id, t FROM ev WHERE kind = 'error'), sp AS (SELECT user_id, pos AS span_id, pos, t AS start, t + value * 360 AS \"end\" FROM ev WHERE kind = 'purchase')"


def _errors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf)
    spans = e.filter("kind = 'purchase'").select("user_id", F.col("pos").alias("span_id"), "pos", F.col("t").alias("start"), (F.col("t") + F.col("value") * 360).alias("end"))
    return e.filter("kind = 'error'").select("user_id", F.col("pos").alias("id"), "t"), spans


@query(
    f"""WITH {EVENTS}, {_ERRORS}, m AS (SELECT er.user_id, er.id, sp.span_id, sp.pos, er.t >= sp.start AND er.t < sp."end" AS inside, least(abs(er.t - sp.start), abs(er.t - sp."end")) AS edge FROM er JOIN sp USING (user_id)),
k AS (SELECT user_id, id, list(span_id ORDER BY pos) FILTER (inside) AS held, arg_min(span_id, (edge, pos)) FILTER (NOT inside AND edge <= 3600) AS near FROM m WHERE inside OR edge <= 3600 GROUP BY user_id, id)
SELECT er.user_id, er.id, CASE WHEN k.held IS NOT NULL THEN k.held WHEN k.near IS NOT NULL THEN [k.near] ELSE [] END AS span_ids FROM er LEFT JOIN k ON k.user_id = er.user_id AND k.id = er.id"""
)
def nearest_asof(spark: SparkSession, sf: str) -> DataFrame:
    points, spans = _errors(spark, sf)
    return I.containing_or_nearest(points, spans, K, "id", 3600.0, width=7200.0).select("user_id", "id", "span_ids")


@query(
    f"""WITH {EVENTS}, {_ERRORS}, m AS (SELECT er.user_id, er.id, arg_min(sp.span_id, (abs(er.t - (sp.start + sp."end") / 2), sp.pos)) AS span_id FROM er JOIN sp ON er.user_id = sp.user_id AND er.t BETWEEN sp.start - 600 AND sp."end" + 600 GROUP BY ALL)
SELECT er.user_id, er.id, m.span_id FROM er LEFT JOIN m ON m.user_id = er.user_id AND m.id = er.id"""
)
def nearest_centre(spark: SparkSession, sf: str) -> DataFrame:
    points, spans = _errors(spark, sf)
    return I.nearest_centre(points, spans, K, "id", 600.0, width=7200.0).select("user_id", "id", "span_id")


@query(
    f"""WITH {EVENTS}, {_ERRORS}, m AS (SELECT er.user_id, er.id, arg_max(sp.span_id, (sp.start, -sp.pos)) AS span_id FROM er JOIN sp ON er.user_id = sp.user_id AND er.t BETWEEN sp.start - 900 AND sp."end" GROUP BY ALL)
SELECT er.user_id, er.id, m.span_id FROM er LEFT JOIN m ON m.user_id = er.user_id AND m.id = er.id"""
)
def latest_start_asof(spark: SparkSession, sf: str) -> DataFrame:
    points, spans = _errors(spark, sf)
    return I.latest_start(points, spans, K, "id", 900.0, width=7200.0).select("user_id", "id", "span_id")


@query(
    f"""WITH {EVENTS}, st AS (SELECT user_id, pos AS state_id, t AS start, t + value * 360 AS "end" FROM ev WHERE kind = 'error'), sp AS (SELECT user_id, pos AS span_id, t AS s, t + value * 360 AS e FROM ev WHERE kind = 'purchase'),
m AS (SELECT st.user_id, st.state_id, sp.span_id, CASE WHEN s < "end" AND e > start THEN 1 ELSE 2 END AS rank FROM st JOIN sp USING (user_id) WHERE (s < "end" AND e > start) OR (e >= start - 3600 AND e <= start)),
b AS (SELECT *, min(rank) OVER (PARTITION BY user_id, state_id) AS best FROM m), o AS (SELECT user_id, state_id, list(span_id ORDER BY span_id) AS span_ids, CASE WHEN min(rank) = 1 THEN 'overlap' ELSE 'lead' END AS by FROM b WHERE rank = best GROUP BY ALL)
SELECT st.user_id, st.state_id, o.span_ids, o.by FROM st LEFT JOIN o ON o.user_id = st.user_id AND o.state_id = st.state_id"""
)
def overlap_lead_join(spark: SparkSession, sf: str) -> DataFrame:
    s = segments(spark, sf)
    states = s.filter("text = 'error'").select("user_id", F.col("pos").alias("state_id"), "start", "end")
    spans = s.filter("text = 'purchase'").select("user_id", F.col("pos").alias("span_id"), "pos", "start", "end")
    return I.overlap_or_lead(states, spans, K, 3600.0, width=7200.0).select("user_id", "state_id", "span_ids", "by")


@query(
    f"""WITH {EVENTS}, st AS (SELECT user_id, pos AS state_id, pos, t AS start, t + value * 360 AS "end", floor(t / 259200)::BIGINT AS chapter FROM ev WHERE kind != 'error'), tg AS (SELECT user_id, pos AS target_id, floor(t / 259200)::BIGINT AS chapter, CASE WHEN pos % 2 = 0 THEN 'action_result' ELSE 'state' END AS kind, t AS anchor, t - 1800 AS lo, t + 1800 AS hi FROM ev WHERE kind = 'error'),
m AS (SELECT tg.user_id, target_id, state_id, st.pos, st.chapter = tg.chapter AND kind = 'action_result' AND start BETWEEN anchor AND anchor + 7200 AS a, st.chapter = tg.chapter AND start < hi AND "end" > lo AS b, start <= anchor AND anchor < "end" AS c FROM tg JOIN st USING (user_id)),
e AS (SELECT *, unnest(list_filter([CASE WHEN a THEN 1 END, CASE WHEN b THEN 2 END, CASE WHEN c THEN 3 END], lambda x: x IS NOT NULL))::INT AS step FROM m),
f AS (SELECT *, min(step) OVER (PARTITION BY user_id, target_id) AS best FROM e), g AS (SELECT *, row_number() OVER (PARTITION BY user_id, target_id ORDER BY pos) AS rn FROM f WHERE step = best) SELECT user_id, target_id, state_id, step FROM g WHERE step = 2 OR rn = 1"""
)
def fallback_join(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("chapter", F.floor(F.col("t") / 259200))
    states = e.filter("kind != 'error'").select("user_id", "chapter", F.col("pos").alias("state_id"), "pos", F.col("t").alias("start"), (F.col("t") + F.col("value") * 360).alias("end"))
    kind = F.when(F.col("pos") % 2 == 0, "action_result").otherwise("state")
    targets = e.filter("kind = 'error'").select("user_id", "chapter", F.col("pos").alias("target_id"), kind.alias("kind"), F.col("t").alias("anchor"), (F.col("t") - 1800).alias("lo"), (F.col("t") + 1800).alias("hi"))
    return I.fallback_attach(targets, states, K, "chapter", 7200.0, width=14400.0)


@query(
    f"""WITH {EVENTS}, st AS (SELECT user_id, pos AS state_id, t AS start, t + value * 360 AS "end" FROM ev WHERE kind = 'error'), b AS (SELECT user_id, t AS s, t + 3600 AS e, value FROM ev WHERE kind = 'view'),
m AS (SELECT st.user_id, st.state_id, avg(b.value) AS mean FROM st JOIN b ON st.user_id = b.user_id AND s < "end" AND e > start GROUP BY ALL) SELECT st.user_id, st.state_id, round(coalesce(m.mean, 0), 6) AS mean FROM st LEFT JOIN m ON m.user_id = st.user_id AND m.state_id = st.state_id"""
)
def overlap_mean(spark: SparkSession, sf: str) -> DataFrame:
    s = segments(spark, sf).filter("text = 'error'").select("user_id", F.col("pos").alias("state_id"), "start", "end")
    bins = events(spark, sf).filter("kind = 'view'").select("user_id", F.col("t").alias("start"), (F.col("t") + 3600).alias("end"), "value")
    return rounded(I.overlap_mean(s, bins, K, width=7200.0).select("user_id", "state_id", "mean"))


@query(
    f"""WITH {EVENTS}, q AS (SELECT user_id, t, arg_max(value, pos) AS value FROM ev WHERE kind = 'view' GROUP BY user_id, t) SELECT p.user_id, p.pos, CASE WHEN p.t - q.t <= 86400 THEN q.value END AS value
FROM (SELECT * FROM ev WHERE kind = 'purchase') p ASOF LEFT JOIN q ON p.user_id = q.user_id AND p.t >= q.t"""
)
def asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    quotes = e.filter("kind = 'view'").groupBy("user_id", "t").agg(F.max_by("value", "pos").alias("value"))
    return I.asof_backward(e.filter("kind = 'purchase'").select("user_id", "pos", "t"), quotes, K, "value", 86400.0).select("user_id", "pos", "value")


@query(
    f"""WITH {EVENTS}, p AS (SELECT user_id, pos, t FROM ev WHERE kind = 'error'), s AS (SELECT user_id, pos AS span, t AS start, t + value * 360 AS "end" FROM ev WHERE kind = 'click') SELECT p.user_id, p.pos, s.span FROM p JOIN s ON p.user_id = s.user_id AND p.t BETWEEN s.start - 60 AND s."end" + 60"""
)
def bucketed_join(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    spans = e.filter("kind = 'click'").select("user_id", F.col("pos").alias("span"), F.col("t").alias("start"), (F.col("t") + F.col("value") * 360).alias("end"))
    return I.bucketed_join(e.filter("kind = 'error'").select("user_id", "pos", "t"), spans, K, 7200.0, 60.0).select("user_id", "pos", "span")


@query(
    f"""WITH {EVENTS}, r AS (SELECT *, floor(t / 86400)::BIGINT AS chapter, floor(value / 40)::BIGINT AS run FROM ev), g AS (SELECT *, lag(run) OVER w AS r0, lag(chapter) OVER w AS c0 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY t, pos)),
i AS (SELECT *, sum(CASE WHEN run = r0 AND chapter IS NOT DISTINCT FROM c0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, pos ROWS UNBOUNDED PRECEDING) AS piece FROM g) SELECT user_id, piece, run, chapter, round(min(t), 6) AS start, round(max(t) + 0.5, 6) AS "end", count(*) AS n FROM i GROUP BY user_id, piece, run, chapter"""
)
def chapter_clip(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("chapter", F.floor(F.col("t") / 86400)).withColumn("run", F.floor(F.col("value") / 40))
    return rounded(clip_to_chapters(e, K, "chapter"))


@query(f"""WITH {CHAPTERS}, j AS (SELECT e.user_id, e.pos, c.span_id, greatest(e.t - 1800, c.start) AS lo, least(e.t + e.value * 360, c."end") AS hi FROM ev e JOIN ch c ON e.user_id = c.user_id AND e.t >= c.start AND e.t < c."end") SELECT user_id, pos, span_id, round(lo, 6) AS lo, round(hi, 6) AS hi FROM j WHERE hi - lo >= 1805""")
def clamp_to_part(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    c = chapters(spark, sf).select("user_id", "span_id", "start", "end")
    j = I.bucketed_join(e, c, K, 259200.0).filter("t < end")
    w = clamp_window(F.col("t") - 1800, F.col("t") + F.col("value") * 360, F.col("start"), F.col("end"), 1805.0)
    return rounded(j.withColumn("w", w).filter("w IS NOT NULL").select("user_id", "pos", "span_id", "w.lo", "w.hi"))
