"""Registered queries on audits of whole summaries, drafts and receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import options as O
from tidemark.functions import text as T
from tidemark.operators import grounding as A
from tidemark.plans.tables import CHAPTERS, EVENTS, chapters, events, table

K = ["user_id"]
QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_AUDIT = f"""{CHAPTERS}, bl AS (SELECT user_id, 'c' || (CASE WHEN pos % 10 = 0 THEN 3 ELSE least(floor(t / 259200), 9) END)::INT AS chapter_id, pos AS block_no, t, pos % 3 > 0 AS cites FROM ev)"""


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("user_id", F.col("pos").alias("seg_id"), F.col("t").alias("start"), (F.col("t") + 10).alias("end"))


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A block an event; every third cites nothing, every tenth stands in the fourth chapter."""
    place = F.when(F.col("pos") % 10 == 0, 3).otherwise(F.least(F.floor(F.col("t") / 259200), F.lit(9)))
    return events(spark, sf).select("user_id", F.concat(F.lit("c"), place.cast("int").cast("string")).alias("chapter_id"), F.col("pos").alias("block_no"), F.when(F.col("pos") % 3 > 0, F.array("pos")).alias("seg_ids"), F.concat(F.lit("says "), F.col("kind"), F.lit(" שלום")).alias("text"))


def _chapters(spark: SparkSession, sf: str) -> DataFrame:
    return chapters(spark, sf).withColumnRenamed("span_id", "chapter_id")


@query(
    f"""WITH {_AUDIT} SELECT user_id, 'errors' AS level, 'ownership' AS "check", chapter_id || '/' || block_no AS "where", '1 segments lie outside the chapter' AS message FROM bl JOIN (SELECT user_id, span_id AS chapter_id, start, "end" FROM ch) USING (user_id, chapter_id)
WHERE cites AND (t + 10 < start - 5 OR t > "end" + 5)"""
)
def ownership_rules(spark: SparkSession, sf: str) -> DataFrame:
    return A.ownership_rules(_blocks(spark, sf), _segments(spark, sf), _chapters(spark, sf), K)


@query(
    f"""WITH {_AUDIT}, p AS (SELECT user_id, 'c' || least(floor(t / 259200), 9)::INT AS chapter_id, pos, t FROM ev), n AS (SELECT p.user_id, p.chapter_id, count(*) AS inside, count(bl.block_no) AS own FROM p LEFT JOIN bl ON bl.user_id = p.user_id AND bl.chapter_id = p.chapter_id AND bl.block_no = p.pos AND bl.cites AND bl.block_no % 5 = 1 GROUP BY ALL)
SELECT user_id, 'reviews' AS level, 'chapter-coverage' AS "check", chapter_id AS "where", own || ' of ' || inside || ' segments cited' AS message FROM n WHERE inside >= 5 AND own / inside < 0.2"""
)
def chapter_shares(spark: SparkSession, sf: str) -> DataFrame:
    placed = events(spark, sf).select("user_id", F.concat(F.lit("c"), F.least(F.floor(F.col("t") / 259200), F.lit(9)).cast("int").cast("string")).alias("chapter_id"), F.col("pos").alias("seg_id"))
    few = _blocks(spark, sf).withColumn("seg_ids", F.when(F.col("block_no") % 5 == 1, F.col("seg_ids")))
    return A.chapter_share_rules(A.chapter_shares(few, placed, K), K, least=5)


_STATS = "st AS (SELECT user_id, count(*) AS segments, count(*) FILTER (pos % 3 > 0) AS cited_segments, round(count(*) FILTER (pos % 3 > 0) / count(*), 3) AS coverage, count(*) * 3 AS words, sum(4) AS he, sum(4 + length(kind)) AS la FROM ev GROUP BY user_id)"


@query(f"WITH {EVENTS}, {_STATS} SELECT user_id, segments, cited_segments, coverage, words, round(he / (he + la), 3) AS hebrew_ratio FROM st")
def summary_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return A.summary_statistics(_blocks(spark, sf), _segments(spark, sf), K)


@query(
    f"""WITH {EVENTS}, {_STATS}, x AS (SELECT *, (user_id % 5) * 60.0 AS duration FROM st) SELECT user_id, 'warnings' AS level, 'length' AS "check", 'summary' AS "where", round(words * 60 / duration)::BIGINT || ' words a minute' AS message FROM x WHERE duration > 0 AND words * 60 / duration NOT BETWEEN 50 AND 200
UNION ALL SELECT user_id, 'reviews', 'coverage', 'summary', 'few segments are cited' FROM x WHERE coverage < 0.667"""
)
def length_rules(spark: SparkSession, sf: str) -> DataFrame:
    s = A.summary_statistics(_blocks(spark, sf), _segments(spark, sf), K)
    return A.length_rules(s.withColumn("duration", (F.col("user_id") % 5) * 60.0), K, least=0.667)


@query(
    f"""WITH {EVENTS} SELECT DISTINCT user_id, 'warnings' AS level, 'glossary' AS "check", 'summary' AS "where", kind || ' is used for צורה' AS message FROM ev WHERE kind IN ('click', 'error')"""
)
def glossary_rules(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    words = F.explode(F.array(*[F.struct(F.lit(a).alias("term"), F.lit(b).alias("form")) for a, b in (("click", "צורה"), ("error", "צורה"), ("purchase", "buy"), ("lic", "צורה"), ("view", "view"))]))
    glossary = e.select("user_id").distinct().select("user_id", words.alias("g")).select("user_id", "g.*")
    return A.glossary_rules(_blocks(spark, sf), glossary, K)


@query("""SELECT page_id AS user_id, 'errors' AS level, 'caption' AS "check", page_id::VARCHAR AS "where", 'not in Hebrew' AS message FROM pages WHERE page_id % 3 = 0""")
def caption_rules(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    text = F.when(k % 3 == 0, F.regexp_replace("url", "[א-ת]", "")).when(k % 3 == 1, F.concat("url", F.lit(" תמונה"))).otherwise(" ")
    return A.caption_rules(table(spark, sf, "pages").select(k.alias("user_id"), k.alias("id"), text.alias("text")), K, "he")


@query(
    """SELECT c_custkey AS user_id, sha256(c_name) AS summary, CASE WHEN c_custkey % 2 = 0 THEN sha256(c_mktsegment) END AS chapters, NULL::VARCHAR AS candidates, CASE WHEN c_custkey % 3 = 0 THEN 'he' ELSE 'en' END AS lang FROM customer"""
)
def audit_bindings(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "user_id")
    files = c.select("user_id", F.lit("summary").alias("name"), F.sha2("c_name", 256).alias("sha256")).unionByName(c.filter("user_id % 2 = 0").select("user_id", F.lit("chapters").alias("name"), F.sha2("c_mktsegment", 256).alias("sha256")))
    b = A.audit_bindings(files, K, c.select("user_id", F.when(F.col("user_id") % 3 == 0, "he").otherwise("en").alias("lang")))
    return b.select("user_id", *[F.col("inputs")[f"{n}_sha256"].alias(n) for n in ("summary", "chapters", "candidates")], F.col("inputs")["lang"].alias("lang"))


@query(
    f"""WITH {CHAPTERS} SELECT user_id, CASE WHEN pos % 3 > 0 THEN span_id ELSE 'ch' || lpad((pos + 1)::VARCHAR, 2, '0') END AS chapter_id, pos, pos % 2 = 0 AS needs_frames, CASE pos % 4 WHEN 0 THEN ['slide'] WHEN 1 THEN ['state', 'code'] ELSE [] END AS kinds FROM ch"""
)
def normalised_chapters(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("pos")
    targets = lambda *kinds: F.array(*[F.struct(F.lit(k).cast("string").alias("kind")) for k in kinds])
    c = chapters(spark, sf).select(
        "user_id", F.when(p % 3 > 0, F.col("span_id")).when(p % 2 == 0, "").alias("chapter_id"), "pos", F.when(p % 2 == 0, True).alias("needs_frames"),
        F.when(p % 4 == 0, targets("slide")).when(p % 4 == 1, targets()).alias("visual_targets"), F.when(p % 4 < 2, targets(None, "code")).alias("cues"),
    )
    return A.normalised_chapters(c, K).select("user_id", "chapter_id", "pos", "needs_frames", F.col("visual_targets.kind").alias("kinds"))


@query(
    f"""WITH {EVENTS}, s AS (SELECT user_id, pos, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rn FROM ev), t AS (SELECT user_id, string_agg(printf('%02d:%02d-%02d:%02d', pos % 3000 // 60, pos % 3000 % 60, (pos % 3000 + 9) // 60, (pos % 3000 + 9) % 60) || CASE WHEN pos % 2 = 0 THEN ' (c1, c2)' ELSE '' END, ', ' ORDER BY pos % 3000, pos) AS x FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos % 3000, pos) AS r FROM s) WHERE r <= 3 GROUP BY user_id)
SELECT user_id, 'the probe contradicts the decision against pictures: ' || x || '; moves' AS text FROM t"""
)
def probe_refusals(spark: SparkSession, sf: str) -> DataFrame:
    at = (F.col("pos") % 3000).cast("double")
    ids = F.when(F.col("pos") % 2 == 0, F.array(F.lit("c1"), F.lit("c2"))).otherwise(F.array().cast("array<string>"))
    s = events(spark, sf).select("user_id", at.alias("start"), (at + 9 + F.col("pos") / 1e9).alias("end"), ids.alias("chapter_ids"))
    return A.spans_with_chapters(s, K).select("user_id", A.probe_refusal(F.col("text"), F.lit("moves")).alias("text"))


@query(
    """SELECT o_custkey AS user_id, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey % 4 IN (1, 2)), []) AS written, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey % 4 IN (0, 3)), []) AS failures, coalesce(sum(209) FILTER (o_orderkey % 4 IN (1, 2)), 0)::BIGINT AS image_tokens FROM orders GROUP BY o_custkey"""
)
def shortlist_receipt(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), key.alias("id"), key.alias("pos"), F.lit(512).alias("width"), F.lit(288).alias("height"), F.when(key % 4 > 0, (key % 4).cast("double")).alias("far"))
    return A.shortlist_receipt(o, K, F.col("far") <= 2)


@query(
    """SELECT o_custkey AS user_id, 'errors' AS level, 'candidate' AS "check", o_orderkey::VARCHAR AS "where", 'unknown ' || o_orderkey AS message FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_custkey, 'errors', 'chapter', o_orderkey::VARCHAR, 'belongs to c' || (o_orderkey % 7) FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 3 = 0 AND o_orderkey % 7 != 1"""
)
def selection_failures(spark: SparkSession, sf: str) -> DataFrame:
    key, o = F.col("o_orderkey"), table(spark, sf, "orders")
    picked = o.select(F.col("o_custkey").alias("user_id"), key.alias("pos"), key.alias("id"), F.when(key % 3 == 0, "c1").when(key % 3 == 1, "").alias("chapter_id"))
    pool = o.filter(key % 5 > 0).select(F.col("o_custkey").alias("user_id"), key.alias("id"), F.concat(F.lit("c"), (key % 7).cast("string")).alias("chapter_id"))
    return A.selection_failures(picked, pool, K)


@query(
    f"""WITH {EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS i FROM ev), m AS (SELECT user_id, i // 3 AS s, count(*) AS n, median(value) AS luma, median(value / 100) AS edge, CASE WHEN count(*) > 1 THEN median(value / 10) ELSE 0 END AS diff FROM n GROUP BY ALL), w AS (SELECT user_id, max(i) AS top FROM n GROUP BY user_id)
SELECT user_id, 's' || CASE WHEN s < 10 THEN '0' || s ELSE s::VARCHAR END AS state_id, (s * 6)::DOUBLE AS start, (s * 6 + 4 + CASE WHEN top > 0 THEN 2 ELSE 0 END)::DOUBLE AS "end", CASE WHEN luma < 90 AND edge < 0.15 THEN 'talking_head_or_dark' WHEN luma < 120 AND edge >= 0.15 THEN 'code_or_terminal' WHEN diff > 8 THEN 'dynamic_ui' WHEN luma > 190 THEN 'slide_or_canvas' ELSE 'unknown' END AS kind, n FROM m JOIN w USING (user_id)"""
)
def annotation_draft(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("pos")) - 1
    tiles = events(spark, sf).select("user_id", i.alias("index"), (i * 2.0).alias("t"), F.col("value").alias("luma"), (F.col("value") / 100).alias("edge"), (F.col("value") / 10).alias("diff"))
    s = F.floor(F.col("index") / 3)
    states = tiles.groupBy("user_id", s.alias("pos")).agg(F.array_sort(F.collect_list("index")).alias("tiles")).select("user_id", "pos", (F.col("pos") * 6.0).alias("start"), (F.col("pos") * 6.0 + 4).alias("end"), "tiles")
    return A.annotation_draft(states, tiles, K).select("user_id", "state_id", "start", "end", "kind", F.size("tiles").cast("long").alias("n"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'malformed_response' END AS fault FROM customer"""
)
def inventory_faults(spark: SparkSession, sf: str) -> DataFrame:
    k, say = F.col("c_custkey"), F.lit
    info = F.when(k % 6 == 0, F.concat(say('{"id":"'), "c_name", say('","duration":12.5,"subtitles":{"en":[{"url":"u","ext":"vtt"},{}]},"automatic_captions":{}}')))
    info = info.when(k % 6 == 1, '{"id":" ","duration":3}').when(k % 6 == 2, '{"id":"a","duration":true}').when(k % 6 == 3, '{"id":"a","duration":3,"subtitles":{"en":{"url":"u"}}}')
    info = info.when(k % 6 == 4, '{"id":"a","duration":3,"automatic_captions":{"en":[{"url":7}]}}').otherwise("no document")
    return table(spark, sf, "customer").select("c_custkey", O.inventory_fault(info).alias("fault"))


@query(
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'data:image/png;base64,' || to_base64(encode(html)) WHEN 1 THEN 'data:image/jpeg;base64,' || to_base64(encode(url)) END AS uri, page_id % 4 < 2 AS host FROM pages"""
)
def data_uris(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    name = F.when(k % 3 == 0, "a.b.PNG").when(k % 3 == 1, "x.jpeg").otherwise("x.svg")
    url = F.when(k % 4 == 0, F.col("url")).when(k % 4 == 1, F.upper("url")).when(k % 4 == 2, F.concat(F.lit("-"), "url")).otherwise("http:///path")
    return table(spark, sf, "pages").select("page_id", O.data_uri(name, F.when(k % 3 == 0, F.col("html")).otherwise(F.col("url")).cast("binary")).alias("uri"), T.has_host(url).alias("host"))


@query(
    f"""WITH {EVENTS} SELECT user_id, pos, pos % 6 IN (0, 1, 3) AS corrects FROM ev"""
)
def corrections(spark: SparkSession, sf: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("scratch that, go on", "טעיתי קודם", "בעצם הכל טוב", "בעצם זה לא נכון", "actually fine", "all well"))), (F.col("pos") % 6 + 1).cast("int"))
    return events(spark, sf).select("user_id", "pos", T.is_correction(said).alias("corrects"))
