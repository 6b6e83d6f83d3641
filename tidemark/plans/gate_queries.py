"""Registered queries on gates, bindings, and what sinks write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evidence as E
from tidemark.operators import gates as V
from tidemark.plans.tables import CHAPTERS, EVENTS, chapters, events, table
from tidemark.sources import captions, logs, sinks

K = ["user_id"]
QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("k"), "c_name", "c_mktsegment")


_SPOKEN = """sp AS (SELECT user_id, pos, CASE WHEN pos % 97 > 0 THEN 's' || (pos % 60) END AS seg_id, t - (pos % 7) * 5000 AS start, CASE WHEN pos % 89 > 0 THEN t - (pos % 7) * 5000 + value - 20 END AS "end", CASE WHEN kind = 'error' THEN ' ' ELSE kind END AS text FROM ev),
so AS (SELECT *, lag(start) OVER (PARTITION BY user_id ORDER BY pos) AS before FROM sp), tr AS (SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'thin' WHEN 2 THEN 'lost' END AS status FROM customer)"""


@query(
    f"""WITH {EVENTS}, {_SPOKEN} SELECT user_id, 'errors' AS level, 'status' AS "check", 'transcript' AS "where", 'status is ' || coalesce(status, 'missing') AS message FROM tr WHERE status IS NULL OR status = 'lost'
UNION ALL SELECT user_id, 'errors', 'empty', 'transcript', 'no segments' FROM tr WHERE user_id NOT IN (SELECT user_id FROM sp)
UNION ALL SELECT user_id, 'errors', 'unique', seg_id, 'repeated ' || count(*) || ' times' FROM sp GROUP BY user_id, seg_id HAVING count(*) > 1
UNION ALL SELECT user_id, 'errors', 'id', pos::VARCHAR, 'no id' FROM sp WHERE seg_id IS NULL
UNION ALL SELECT user_id, 'errors', 'time', seg_id, 'times must be numbers' FROM sp WHERE "end" IS NULL
UNION ALL SELECT user_id, 'warnings', 'empty', seg_id, 'end must be after start' FROM sp WHERE "end" <= start
UNION ALL SELECT user_id, 'errors', 'order', seg_id, 'not in chronological order' FROM so WHERE start < before
UNION ALL SELECT user_id, 'warnings', 'text', seg_id, 'no text' FROM sp WHERE trim(text) = ''"""
)
def transcript_gate(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("t") - (F.col("pos") % 7) * 5000
    seg = F.when(F.col("pos") % 97 > 0, F.concat(F.lit("s"), (F.col("pos") % 60).cast("string")))
    s = events(spark, sf).select("user_id", "pos", seg.alias("seg_id"), start.alias("start"), F.when(F.col("pos") % 89 > 0, start + F.col("value") - 20).alias("end"), F.when(F.col("kind") == "error", " ").otherwise(F.col("kind")).alias("text"))
    t = _customers(spark, sf).select("user_id", F.when(F.col("k") % 4 == 0, "ok").when(F.col("k") % 4 == 1, "thin").when(F.col("k") % 4 == 2, "lost").alias("status"))
    return V.transcript_rules(t, s, K)


_POOLS = "po AS (SELECT c_custkey AS user_id, 'a' || (c_custkey % 3) AS bound, CASE WHEN c_custkey % 7 > 0 THEN 'a' || (c_custkey % 2) END AS now, CASE WHEN c_custkey % 2 = 0 THEN 'user' ELSE 'model' END AS decided, c_custkey % 4 = 0 AS any_frames, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 5 < 3 END AS against FROM customer)"


@query(
    f"""WITH {_POOLS} SELECT user_id, 'errors' AS level, 'stale' AS "check", 'candidates' AS "where", 'made from other inputs' AS message FROM po WHERE bound IS DISTINCT FROM now
UNION ALL SELECT user_id, 'errors', 'coverage', 'c' || user_id, 'needs pictures and has none' FROM po WHERE user_id % 6 = 0
UNION ALL SELECT user_id, CASE WHEN decided = 'user' THEN 'warnings' ELSE 'errors' END, 'probe', 'chapters', 'the probe saw still pictures' FROM po WHERE against AND NOT any_frames"""
)
def candidate_gate(spark: SparkSession, sf: str) -> DataFrame:
    c, k = _customers(spark, sf), F.col("k")
    mark = lambda n: F.concat(F.lit("a"), (k % n).cast("string"))
    pools = c.select("user_id", mark(3).alias("bound_sha256"), F.when(k % 7 > 0, mark(2)).alias("current_sha256"), F.when(k % 2 == 0, "user").otherwise("model").alias("decided_by"), (k % 4 == 0).alias("any_frames"))
    coverage = c.select("user_id", F.concat(F.lit("c"), k.cast("string")).alias("id"), F.when(k % 6 == 0, "unresolved").otherwise("covered").alias("status"))
    verdicts = c.filter(k % 3 > 0).select("user_id", F.when(k % 5 < 3, "contradicts").otherwise("agrees").alias("verdict"))
    return V.candidate_rules(pools, coverage, verdicts, K)


_BLOCKS = """bl AS (SELECT conv_id, 'c' || (turn // 2 + CASE WHEN conv_id % 3 = 0 AND turn = 0 THEN 50 ELSE 0 END) AS chapter_id, turn AS block_no, CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END AS text, CASE turn % 4 WHEN 0 THEN 'prose' WHEN 1 THEN 'code' WHEN 3 THEN 'poem' END AS kind, turn % 3 = 0 AS bare, chapter_id || '/' || turn AS place FROM conversations),
hd AS (SELECT DISTINCT conv_id, 'c' || (turn // 2) AS chapter_id FROM conversations)"""


@query(
    f"""WITH {_BLOCKS} SELECT DISTINCT conv_id, 'errors' AS level, 'language' AS "check", 'summary' AS "where", 'unknown language' AS message FROM conversations WHERE conv_id % 3 > 0
UNION ALL SELECT DISTINCT conv_id, 'warnings', 'overview', 'summary', 'no overview' FROM conversations WHERE conv_id % 4 = 0
UNION ALL SELECT conv_id, 'errors', 'chapter-coverage', chapter_id, 'no blocks' FROM hd ANTI JOIN bl USING (conv_id, chapter_id)
UNION ALL SELECT DISTINCT conv_id, 'errors', 'reference', chapter_id, 'unknown chapter' FROM bl ANTI JOIN hd USING (conv_id, chapter_id)
UNION ALL SELECT conv_id, 'errors', 'text', place, 'no text' FROM bl WHERE trim(text) = ''
UNION ALL SELECT conv_id, 'errors', 'kind', place, 'unknown kind' FROM bl WHERE kind = 'poem'
UNION ALL SELECT conv_id, 'errors', 'citation', place, 'cites nothing' FROM bl WHERE bare"""
)
def summary_gate(spark: SparkSession, sf: str) -> DataFrame:
    c, turn, conv = table(spark, sf, "conversations"), F.col("turn"), F.col("conv_id")
    half = F.floor(turn / 2)
    chapter = lambda n: F.concat(F.lit("c"), n.cast("string")).alias("chapter_id")
    summary = c.select("conv_id").distinct().select("conv_id", F.when(conv % 3 == 0, "en").when(conv % 3 == 1, "xx").alias("lang"), F.when(conv % 4 > 0, "said").alias("overview"))
    kind = F.when(turn % 4 == 0, "prose").when(turn % 4 == 1, "code").when(turn % 4 == 3, "poem")
    ids = F.when(turn % 3 > 0, F.array(turn.cast("string"))).when(turn % 2 == 0, F.array().cast("array<string>"))
    blocks = c.select("conv_id", chapter(half + F.when((conv % 3 == 0) & (turn == 0), 50).otherwise(0)), turn.alias("block_no"), F.when(turn % 5 == 4, " ").otherwise(F.col("text")).alias("text"), kind.alias("kind"), ids.alias("seg_ids"))
    return V.summary_rules(summary, c.select("conv_id", chapter(half)).distinct(), blocks, ["conv_id"])


@query(
    """SELECT c_custkey AS user_id, 'errors' AS level, 'binding' AS "check", 'plan' AS "where", 'not recorded' AS message FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'errors', 'stale', 'text', 'changed since' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'errors', 'stale', 'plan', 'changed since' FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 5 = 0"""
)
def manifest_gate(spark: SparkSession, sf: str) -> DataFrame:
    k, say = F.col("k"), F.lit
    old = F.create_map(say("text"), F.col("c_name"), say("plan"), F.when(k % 3 > 0, F.col("c_mktsegment")))
    new = F.map_filter(F.create_map(say("text"), F.when(k % 2 > 0, F.col("c_name")).otherwise("x"), say("plan"), F.col("c_mktsegment")), lambda n, _: (n == "text") | (k % 5 > 0))
    return V.manifest_rules(_customers(spark, sf).select("user_id", old.alias("recorded"), new.alias("current")), K, ("text", "plan"))


_ITEMS = """it AS (SELECT o_custkey AS user_id, CASE o_orderkey % 4 WHEN 0 THEN 'synthesis' WHEN 1 THEN 'main_points' WHEN 2 THEN 'takeaways' ELSE 'other' END AS section, o_orderkey AS pos, o_orderkey % 20 AS a, o_custkey % 20 AS b, o_orderkey % 11 = 0 AS bare FROM orders), ia AS (SELECT *, section || '/' || pos AS place FROM it),
rf AS (SELECT DISTINCT user_id, place, r FROM (SELECT user_id, place, unnest([a, b]) AS r FROM ia WHERE NOT bare))"""


@query(
    f"""WITH {_ITEMS} SELECT user_id, 'errors' AS level, 'brief' AS "check", 'brief' AS "where", 'needs one synthesis' AS message FROM it GROUP BY user_id HAVING count(*) FILTER (section = 'synthesis') <> 1
UNION ALL SELECT user_id, 'errors', 'brief', place, 'unknown section' FROM ia WHERE section = 'other'
UNION ALL SELECT user_id, 'errors', 'brief', place, 'no text' FROM ia WHERE pos % 9 = 0
UNION ALL SELECT user_id, 'errors', 'brief', place, 'cites nothing' FROM ia WHERE bare
UNION ALL SELECT user_id, 'errors', 'reference', place, 'unknown s' || r FROM rf WHERE r >= 15
UNION ALL SELECT user_id, 'errors', 'order', place, 'citations out of order' FROM ia WHERE NOT bare AND a < 15 AND b < a"""
)
def brief_gate(spark: SparkSession, sf: str) -> DataFrame:
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    seg = lambda n: F.concat(F.lit("s"), n.cast("string"))
    section = F.element_at(F.array(*map(F.lit, ("synthesis", "main_points", "takeaways", "other"))), (key % 4 + 1).cast("int"))
    items = o.select(F.col("o_custkey").alias("user_id"), section.alias("section"), key.alias("pos"), F.when(key % 9 > 0, "said").alias("text"), F.when(key % 11 > 0, F.array(seg(key % 20), seg(F.col("o_custkey") % 20))).alias("seg_ids"))
    said = o.select(F.col("o_custkey").alias("user_id")).distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(14))))
    return V.brief_rules(items, said.withColumn("seg_id", seg(F.col("pos"))), K)


@query("""SELECT c_custkey AS user_id, c_custkey % 2 = 1 OR c_custkey % 3 = 1 AS accepted FROM customer""")
def partial_gate(spark: SparkSession, sf: str) -> DataFrame:
    c, k = _customers(spark, sf), F.col("k")
    mark = lambda first: V.partial_fingerprint(F.lit("partial"), F.array(first, F.lit("c1"))).alias("fingerprint")
    transcripts = c.select("user_id", F.when(k % 2 == 0, "partial").otherwise("ok").alias("status"), mark(F.concat(F.lit("c"), k.cast("string"))))
    approved = c.filter(k % 3 > 0).select("user_id", mark(F.concat(F.when(k % 3 == 1, "c").otherwise("d"), k.cast("string"))))
    return V.partial_accepted(transcripts, approved, K)


@query(
    f"""WITH {EVENTS}, f AS (SELECT user_id, kind AS "check", max(CASE WHEN value > 95 THEN 2 ELSE 1 END) AS x FROM ev WHERE value > 80 GROUP BY ALL), s AS (SELECT DISTINCT user_id, unnest(['click', 'purchase', 'error']) AS "check" FROM ev)
SELECT user_id, "check", CASE x WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS status FROM s LEFT JOIN f USING (user_id, "check")"""
)
def check_report(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    found = e.filter("value > 80").select("user_id", F.col("kind").alias("check"), F.when(F.col("value") > 95, "errors").otherwise("warnings").alias("level"))
    return V.report_rows(found, ["click", "purchase", "error"], K, e)


_CLOCK = "CASE WHEN {x} >= 3600 THEN printf('%d:%02d:%02d', {x} // 3600, {x} % 3600 // 60, {x} % 60) ELSE printf('%02d:%02d', {x} // 60, {x} % 60) END"


@query(
    f"""WITH {EVENTS}, s AS (SELECT user_id, pos, (pos * 37)::BIGINT AS a, (pos * 37 + 20)::BIGINT AS b, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rn FROM ev)
SELECT user_id, string_agg({_CLOCK.format(x="a")} || '-' || {_CLOCK.format(x="b")}, ', ' ORDER BY a) AS text FROM s WHERE rn <= 6 GROUP BY user_id"""
)
def span_texts(spark: SparkSession, sf: str) -> DataFrame:
    return V.spans_text(events(spark, sf).select("user_id", (F.col("pos") * 37.0).alias("start"), (F.col("pos") * 37.0 + 20).alias("end")), K)


@query(
    """SELECT conv_id, 'seg_' || turn AS seg_id, 'seg_' || turn || ' [' || printf('%02d:%02d', turn * 5 // 60, turn * 5 % 60) || '-' || printf('%02d:%02d', (turn * 5 + 4) // 60, (turn * 5 + 4) % 60) || '] ' || text AS value FROM conversations"""
)
def transcript_lines(spark: SparkSession, sf: str) -> DataFrame:
    seg = F.concat(F.lit("seg_"), F.col("turn").cast("string"))
    s = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("pos"), seg.alias("seg_id"), (F.col("turn") * 5.0).alias("start"), (F.col("turn") * 5.0 + 4).alias("end"), "text")
    return sinks.transcript_lines(s, ["conv_id"]).select("conv_id", F.concat(F.lit("seg_"), F.col("pos").cast("string")).alias("seg_id"), "value")


@query(
    """SELECT o_custkey AS k, '{"k":' || o_custkey || ',"orders":[' || string_agg('{"pos":' || o_orderkey || ',"status":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']}' AS document FROM orders GROUP BY o_custkey"""
)
def manifest_documents(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("status"))
    return sinks.manifest(o, ["k"], "orders")


@query("""SELECT '| ' || c_custkey || ' | ' || CASE WHEN c_custkey % 3 = 0 THEN '–' ELSE c_name END || ' | ' || c_mktsegment || ' |' AS value FROM customer""")
def markdown_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.markdown_table(_customers(spark, sf).select("user_id", F.when(F.col("k") % 3 > 0, F.col("c_name")), "c_mktsegment"))


_ESCAPED = "regexp_replace(replace(replace(replace(replace(replace(text || ' `a<b` & \"it''s\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '`([^`\\n]+)`', '<code>\\1</code>', 'g')"


@query(f"SELECT conv_id, string_agg(CASE WHEN turn % 3 = 1 THEN '<pre>' || {_ESCAPED} || '</pre>' ELSE '<p>' || {_ESCAPED} || '</p>' END, chr(10) ORDER BY turn) AS html FROM conversations GROUP BY conv_id")
def chapter_html(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return sinks.block_html(c.select("conv_id", F.col("turn").alias("block_no"), F.when(F.col("turn") % 3 == 1, "code").alias("kind"), F.concat("text", F.lit(" `a<b` & \"it's\"")).alias("text")), ["conv_id"])


@query(f"WITH {EVENTS}, o AS (SELECT user_id, value, unnest([value, value + 30.5, value + 50.04]) AS x FROM ev) SELECT user_id, round(x, 3) AS t FROM o WHERE x >= value + 10 - 0.05 AND x <= value + 50 + 0.05 UNION ALL SELECT user_id, 7.0 FROM ev WHERE 7.0 BETWEEN value + 10 - 0.05 AND value + 50 + 0.05")
def shown_times(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    line = F.concat(F.lit("n:0 pts_time:"), v.cast("string"), F.lit(" x pts_time:"), (v + 30.5).cast("string"), F.lit(" pts_time:"), (v + 50.04).cast("string"), F.lit(" pts_time:7 pts_time:1-2 pts_time:N/A"))
    return logs.showinfo_times(events(spark, sf).select("user_id", line.alias("line"), (v + 10).alias("lo"), (v + 50).alias("hi")), K)


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 2 THEN 'empty_response' ELSE 'malformed_response' END AS fault, CASE WHEN doc_id % 4 = 0 THEN md5('WEBVTT' || chr(10) || coalesce(text, '')) END AS digest FROM documents"""
)
def decoded_files(spark: SparkSession, sf: str) -> DataFrame:
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    whole = F.concat(F.when(k % 8 == 0, "﻿").otherwise(""), F.lit("WEBVTT\n"), text).cast("binary")
    content = F.when(k % 4 == 0, whole).when(k % 4 == 1, F.concat(F.lit("no "), text).cast("binary")).when(k % 4 == 3, F.concat(F.lit("WEBVTT ").cast("binary"), F.unhex(F.lit("FF"))))
    return captions.decoded(table(spark, sf, "documents").select("doc_id", content.alias("content"))).select("doc_id", "fault", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_totalprice > 200000 THEN 'dear' END AS reason FROM orders")
def drop_log(spark: SparkSession, sf: str) -> DataFrame:
    why = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_totalprice") > 200000, "dear")
    kept, dropped = logs.with_rejects(table(spark, sf, "orders"), why)
    return kept.select("o_orderkey", F.lit(None).cast("string").alias("reason")).unionByName(dropped.select("o_orderkey", "reason"))


@query(
    """SELECT o_custkey AS user_id, sha256('[' || string_agg('{"id":' || o_orderkey || ',"name":"' || o_orderstatus || '","crop":' || CASE WHEN o_orderkey % 2 = 0 THEN '"1:2:3:4"' ELSE 'null' END || '}', ',' ORDER BY o_orderkey) || ']') AS sha256 FROM orders GROUP BY o_custkey"""
)
def selection_hashes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, "1:2:3:4").alias("crop"))
    return E.selections_binding(o, K)


@query(
    """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN ['missing'] WHEN c_custkey % 4 = 1 THEN ['hash'] ELSE [] END || CASE WHEN c_custkey % 10 > 4 OR c_custkey % 7 > 5 THEN ['picture'] ELSE [] END AS faults FROM customer"""
)
def asset_faults(spark: SparkSession, sf: str) -> DataFrame:
    c, k = _customers(spark, sf), F.col("k")
    assets = c.select("user_id", F.col("c_name").alias("file"), F.sha2("c_name", 256).alias("sha256"), (k % 10).cast("double").alias("luma_mad"), (k % 7).cast("double").alias("edge_mad"), F.lit(0.1).alias("changed_ratio"))
    files = c.filter(k % 4 > 0).select("user_id", F.col("c_name").alias("file"), F.sha2(F.when(k % 4 == 1, F.lit("else")).otherwise(F.col("c_name")), 256).alias("sha256"))
    return E.asset_checks(assets, files, K, (4.0, 5.0, 0.2)).select("user_id", "faults")


@query(f"WITH {CHAPTERS} SELECT user_id, span_id AS chapter_id, CASE WHEN pos % 3 = 0 AND pos % 5 < 4 THEN 'S' || pos ELSE 'T' || pos END AS title, pos % 5 = 4 AS missing FROM ch")
def titled_chapters(spark: SparkSession, sf: str) -> DataFrame:
    c = chapters(spark, sf).select("user_id", F.col("span_id").alias("chapter_id"), "pos", F.concat(F.lit("T"), F.col("pos").cast("string")).alias("title"))
    s = c.filter("pos % 5 < 4").select("user_id", "chapter_id", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("S"), F.col("pos").cast("string"))).when(F.col("pos") % 3 == 1, " ").alias("title"))
    full, missing = E.normalised_summary(s, c, K)
    return full.join(missing.withColumn("missing", F.lit(True)), ["user_id", "chapter_id"], "left").select("user_id", "chapter_id", "title", F.coalesce("missing", F.lit(False)).alias("missing"))
