"""Registered queries on budgets, selections, near-duplicates and picture signatures."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import clock as C
from tidemark.functions import signature as G
from tidemark.operators import dedup as D
from tidemark.operators import selection as S
from tidemark.plans.tables import CHAPTERS, EVENTS, chapters, events, rounded, table

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_ROWS = "rw AS (SELECT l_suppkey % 10 AS grp, l_orderkey * 10 + l_linenumber AS id, l_orderkey * 10 + l_linenumber AS pos, l_extendedprice AS score, l_quantity AS t, CASE WHEN l_linenumber % 3 = 0 THEN ['t' || (l_partkey % 40)] ELSE [] END::VARCHAR[] AS target_ids, 'c' || (l_partkey % 25) AS chapter_id, l_partkey % 25 < 12 AS needs_frames FROM lineitem WHERE l_returnflag = 'R')"


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """Returned line items as scored candidates of ten entities."""
    i = table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    ident = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    target = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.concat(F.lit("t"), (F.col("l_partkey") % 40).cast("string")))).otherwise(F.array().cast("array<string>"))
    chapter = F.col("l_partkey") % 25
    return i.select((F.col("l_suppkey") % 10).alias("grp"), ident.alias("id"), ident.alias("pos"), F.col("l_extendedprice").alias("score"), F.col("l_quantity").alias("t"), target.alias("target_ids"), F.concat(F.lit("c"), chapter.cast("string")).alias("chapter_id"), (chapter < 12).alias("needs_frames"))


@query(f"WITH {_ROWS} SELECT grp, tg, id, score FROM (SELECT *, row_number() OVER (PARTITION BY grp, tg ORDER BY score DESC, pos) AS rn FROM (SELECT *, unnest(target_ids) AS tg FROM rw)) WHERE rn <= 3")
def topk_per_target(spark: SparkSession, sf: str) -> DataFrame:
    r = rows(spark, sf).withColumn("tg", F.explode("target_ids"))
    return S.top_k(r, ["grp", "tg"], [F.desc("score"), "pos"], 3).select("grp", "tg", "id", "score")


@query(
    f"""WITH {_ROWS}, tk AS (SELECT DISTINCT grp, id FROM (SELECT *, row_number() OVER (PARTITION BY grp, tg ORDER BY score DESC, pos) AS rn FROM (SELECT *, unnest(target_ids) AS tg FROM rw)) WHERE rn <= 2),
m AS (SELECT rw.*, tk.id IS NOT NULL AS bt FROM rw LEFT JOIN tk ON tk.grp = rw.grp AND tk.id = rw.id), n AS (SELECT *, bool_or(bt) OVER (PARTITION BY grp, chapter_id) AS held, row_number() OVER (PARTITION BY grp, chapter_id ORDER BY score DESC, pos) = 1 AS best FROM m),
o AS (SELECT *, bt OR (needs_frames AND NOT held AND best) AS reserved FROM n), p AS (SELECT *, greatest(60, count(*) FILTER (reserved) OVER (PARTITION BY grp) + 12) AS cap_eff FROM o), q AS (SELECT *, row_number() OVER (PARTITION BY grp, reserved ORDER BY score DESC, pos) AS rk FROM p)
SELECT grp, id, reserved, cap_eff::BIGINT AS cap_eff, CASE WHEN reserved THEN CASE WHEN rk <= cap_eff THEN 'reserved' ELSE 'cap' END WHEN len(target_ids) = 0 THEN 'free' ELSE 'cap' END AS status FROM q"""
)
def cap_with_floor(spark: SparkSession, sf: str) -> DataFrame:
    return S.reserve_and_cap(rows(spark, sf), ["grp"], 2, 60, 12).select("grp", "id", "reserved", F.col("cap_eff").cast("long").alias("cap_eff"), "status")


def fill_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with an importance and a signature of 16 numbers that DuckDB can compute as well."""
    return rows(spark, sf).withColumn("importance", F.col("score") / 1e5).withColumn("signature", F.array(*[(F.col("id") * (3 * i + 7) % 251).cast("int") for i in range(16)]))


@query(
    f"""WITH RECURSIVE {_ROWS}, tk AS (SELECT DISTINCT grp, id FROM (SELECT *, row_number() OVER (PARTITION BY grp, tg ORDER BY score DESC, pos) AS rn FROM (SELECT *, unnest(target_ids) AS tg FROM rw)) WHERE rn <= 1),
m AS (SELECT rw.*, tk.id IS NOT NULL AS bt FROM rw LEFT JOIN tk ON tk.grp = rw.grp AND tk.id = rw.id), n AS (SELECT *, bool_or(bt) OVER (PARTITION BY grp, chapter_id) AS held, row_number() OVER (PARTITION BY grp, chapter_id ORDER BY score DESC, pos) = 1 AS best FROM m),
o AS (SELECT *, bt OR (needs_frames AND NOT held AND best) AS reserved FROM n), p AS (SELECT *, greatest(20, count(*) FILTER (reserved) OVER (PARTITION BY grp) + 6) AS cap FROM o),
f AS (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY pos, t, score) AS pos, t, score / 1e5 AS importance, cap, reserved, list_transform(range(0, 4), lambda k: (id * (12 * k + 7)) % 251) AS sig FROM p WHERE reserved OR len(target_ids) = 0),
g AS (SELECT grp, greatest(max(t) - min(t), 1.0)::DOUBLE / 4 AS quarter, count(*) FILTER (NOT reserved) <= max(cap) - count(*) FILTER (reserved) AS all_fit, max(cap) - count(*) FILTER (reserved) AS slots FROM f GROUP BY grp),
a AS (SELECT x.grp, x.id, x.pos, x.t, x.importance, x.sig, x.reserved, least(1.0, coalesce(min(list_sum(list_transform(range(1, 5), lambda k: abs(x.sig[k] - y.sig[k]))) / 4.0 / 12), 1.0))::DOUBLE AS novelty, least(1.0, coalesce(min(abs(x.t - y.t) / g.quarter), 1.0))::DOUBLE AS gap, g.quarter, g.slots
 FROM f x JOIN g USING (grp) LEFT JOIN f y ON y.grp = x.grp AND y.reserved WHERE NOT g.all_fit GROUP BY ALL),
s AS (SELECT 0 AS step, a.*, reserved AS kept, 0.5 * importance + 0.3 * novelty + 0.2 * gap AS worth FROM a
 UNION ALL SELECT step + 1, grp, id, pos, t, importance, sig, reserved, nov, gp, quarter, slots, kept OR pos = pick.pos, 0.5 * importance + 0.3 * nov + 0.2 * gp FROM (
  SELECT s.*, pick, least(novelty, list_sum(list_transform(range(1, 5), lambda k: abs(s.sig[k] - pick.sig[k]))) / 4.0 / 12) AS nov, least(gap, abs(s.t - pick.t) / quarter) AS gp FROM (
   SELECT *, first(CASE WHEN NOT kept THEN struct_pack(pos := pos, t := t, sig := sig) END) OVER (PARTITION BY grp ORDER BY kept, worth DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS pick FROM s) s WHERE step < slots))
SELECT grp, id, CASE WHEN reserved THEN 'reserved' ELSE 'free' END AS status FROM s WHERE kept AND step = slots UNION ALL SELECT grp, id, CASE WHEN reserved THEN 'reserved' ELSE 'free' END FROM f JOIN g USING (grp) WHERE all_fit"""
)
def greedy_fill(spark: SparkSession, sf: str) -> DataFrame:
    r = fill_rows(spark, sf)
    return S.greedy_fill(S.reserve_and_cap(r, ["grp"], 1, 20, 6), ["grp"]).select("grp", "id", "status")


@query(
    f"""WITH {_ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY t, pos) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM rw), k AS (SELECT grp, list_distinct(list_transform(range(0, 12), lambda j: round_even(j * (max(n) - 1) / 11.0, 0)::BIGINT)) AS ix FROM (SELECT DISTINCT grp, n FROM n) GROUP BY grp)
SELECT n.grp, n.id FROM n JOIN (SELECT grp, unnest(ix) AS i FROM k) u ON u.grp = n.grp AND u.i = n.i"""
)
def uniform_pick(spark: SparkSession, sf: str) -> DataFrame:
    return S.uniform_pick(rows(spark, sf), ["grp"], ["t", "pos"], 12).select("grp", "id")


@query(
    f"""WITH {CHAPTERS}, cd AS (SELECT user_id, 'c' || floor(t / 259200)::BIGINT AS chapter_id, t, pos AS id FROM ev WHERE kind = 'purchase'), g AS (SELECT user_id, chapter_id, list(id ORDER BY t, id) AS ids FROM cd GROUP BY ALL)
SELECT ch.user_id, span_id AS id, CASE WHEN ids IS NOT NULL THEN 'covered' WHEN needs_frames THEN 'unresolved' ELSE 'not-required' END AS status, coalesce(ids, []) AS candidate_ids FROM ch LEFT JOIN g ON g.user_id = ch.user_id AND g.chapter_id = ch.span_id"""
)
def coverage_status(spark: SparkSession, sf: str) -> DataFrame:
    c = chapters(spark, sf).select("user_id", F.col("span_id").alias("chapter_id"), "needs_frames")
    cand = events(spark, sf).filter("kind = 'purchase'").select("user_id", F.concat(F.lit("c"), F.floor(F.col("t") / 259200).cast("string")).alias("chapter_id"), "t", F.col("pos").alias("id"))
    return S.coverage_status(c, cand, ["user_id"])


@query(
    """WITH im AS (SELECT p_brand, 320 + 64 * (p_size % 7) AS width, 180 + 36 * (p_size % 7) AS height FROM part), d AS (SELECT p_brand, width || 'x' || height AS dim, count(*) AS n, sum(ceil(width / 28.0)::BIGINT * ceil(height / 28.0)::BIGINT)::BIGINT AS tokens FROM im GROUP BY ALL)
SELECT p_brand, sum(n)::BIGINT AS images, sum(tokens)::BIGINT AS tokens, round(sum(tokens) / sum(n), 6)::DOUBLE AS mean, string_agg(dim || ':' || n, ',' ORDER BY dim) AS dimensions FROM d GROUP BY p_brand"""
)
def token_cost_hist(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_brand", (320 + 64 * (F.col("p_size") % 7)).alias("width"), (180 + 36 * (F.col("p_size") % 7)).alias("height"))
    r = S.reading_cost(p, ["p_brand"])
    listed = F.array_join(F.transform(F.map_entries("dimensions"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return rounded(r.withColumn("dimensions", listed))


def _draws(pages: int, per: int = 15, seed: int = 7) -> str:
    """What the generator gives for each page, by the number of rows on it, after ``sheet`` full pages: VALUES (sheet, n, sentinel, sentinel_id)."""
    out, rng = [], random.Random(seed)
    for page in range(pages):
        state = rng.getstate()
        for n in [*range(1, per), per]:
            rng.setstate(state)
            slot = rng.randint(1, n) if n > 1 else 1
            out.append(f"({page}, {n}, {slot}, 'x_{page:02d}{rng.randint(10, 99)}')")
    return ", ".join(out)


@query(
    f"""WITH {_ROWS}, p AS (SELECT grp, chapter_id, id, (row_number() OVER (PARTITION BY grp, chapter_id ORDER BY t, pos) - 1)::INT AS i FROM rw), q AS (SELECT *, (i // 15)::INT AS sheet, i % 15 AS place, count(*) OVER (PARTITION BY grp, chapter_id, i // 15) AS n FROM p)
SELECT grp, chapter_id, id, q.sheet, d.sentinel::INT AS sentinel, d.sentinel_id, (place + (place >= d.sentinel)::INT)::INT AS slot FROM q LEFT JOIN (VALUES {_draws(64)}) d(sheet, n, sentinel, sentinel_id) ON d.sheet = q.sheet AND d.n = q.n"""
)
def sheet_pages(spark: SparkSession, sf: str) -> DataFrame:
    return S.sheet_pages(rows(spark, sf), ["grp", "chapter_id"]).select("grp", "chapter_id", "id", "sheet", "sentinel", "sentinel_id", "slot")


@query(
    f"""WITH {_ROWS}, g AS (SELECT grp, id, t, pos, unnest(CASE WHEN len(target_ids) > 0 THEN list_transform(target_ids, lambda x: 'target:' || x) ELSE ['chapter:' || chapter_id] END) AS "group" FROM rw), n AS (SELECT *, row_number() OVER (PARTITION BY grp, "group" ORDER BY t, pos) AS slot FROM g) SELECT grp, "group", id, slot FROM n WHERE slot <= 4"""
)
def strip_groups(spark: SparkSession, sf: str) -> DataFrame:
    return S.strip_groups(rows(spark, sf), ["grp"]).select("grp", "group", "id", F.col("slot").cast("long").alias("slot"))


@query(
    """WITH w AS (SELECT DISTINCT o_custkey AS grp, o_orderkey AS id FROM orders), k AS (SELECT w.*, l.id IS NOT NULL AS known FROM w LEFT JOIN (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linenumber < 7 AND l_orderkey % 11 > 0) l ON l.id = w.id)
SELECT grp, count(*) AS n, coalesce(list_sort(list(id) FILTER (NOT known)), []) AS unknown, CASE WHEN count(*) FILTER (NOT known) > 0 THEN 'unknown ids' WHEN count(*) > 8 THEN 'too many' ELSE 'ok' END AS verdict FROM k GROUP BY grp"""
)
def shortlist_check(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("id"))
    pool = table(spark, sf, "lineitem").filter("l_linenumber < 7 AND l_orderkey % 11 > 0").select(F.col("l_orderkey").alias("id")).distinct()
    return S.shortlist_check(w, w.join(pool, "id").select("grp", "id"), ["grp"], most=8)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 5")
def newest_runs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("pos", F.col("o_orderkey"))
    return S.newest(o, ["o_custkey"], "o_orderdate", 5).select("o_custkey", "o_orderkey")


_REASON = "CASE WHEN list_contains(r, 'target') THEN 'target' WHEN list_contains(r, 'cue') THEN 'cue' WHEN list_contains(r, 'pin') THEN 'pin' WHEN list_contains(r, 'coverage') THEN 'coverage' WHEN list_contains(r, 'state') THEN 'state' WHEN list_contains(r, 'scene') THEN 'scene' WHEN list_contains(r, 'final') THEN 'final' ELSE 'scene' END"


@query(
    f"""WITH {EVENTS}, f AS (SELECT pos, t / 3600 AS t, value, CASE kind WHEN 'view' THEN ['state'] WHEN 'click' THEN ['cue', 'target'] WHEN 'error' THEN ['scene'] WHEN 'purchase' THEN ['coverage', 'pin'] ELSE ['final'] END AS r, kind FROM ev)
SELECT pos, {_REASON} AS reason, CASE {_REASON} WHEN 'target' THEN 100 WHEN 'pin' THEN 80 WHEN 'state' THEN 50 WHEN 'scene' THEN 40 WHEN 'final' THEN 20 END AS priority,
 round(CASE {_REASON} WHEN 'target' THEN 100 WHEN 'pin' THEN 80 WHEN 'state' THEN 50 WHEN 'scene' THEN 40 WHEN 'final' THEN 20 END + least(value, 50::DOUBLE) * 0.8::DOUBLE + least(value * 2, 80::DOUBLE) * 0.2::DOUBLE + least(value / 50, 1::DOUBLE) * 20 + CASE WHEN kind = 'click' THEN 30 ELSE 0 END - CASE WHEN pos % 9 = 0 THEN 25 ELSE 0 END
  + CASE WHEN pos % 2 = 0 THEN least((pos % 300)::DOUBLE, 200::DOUBLE) / 200 * 15 ELSE 0 END + CASE WHEN kind = 'purchase' THEN t * 0.0001 WHEN kind = 'click' THEN -least(abs(t - 10), abs(t - 400)) ELSE 0 END, 6) AS score FROM f"""
)
def frame_score(spark: SparkSession, sf: str) -> DataFrame:
    lists = {"view": ["state"], "click": ["cue", "target"], "error": ["scene"], "purchase": ["coverage", "pin"]}
    reasons = F.array(F.lit("final"))
    for k, v in lists.items():
        reasons = F.when(F.col("kind") == k, F.array(*map(F.lit, v))).otherwise(reasons)
    e = events(spark, sf).withColumn("t", F.col("t") / 3600).withColumn("reasons", reasons).withColumn("priority", S.priority(F.col("reasons")))
    v, click = F.col("value"), F.col("kind") == "click"
    none = F.array().cast("array<string>")
    row = {
        "priority": F.col("priority"), "sharpness": v, "contrast": v * 2, "scene_score": v / 50, "target_ids": F.when(click, F.array(F.lit("x"))).otherwise(none), "people": F.col("pos") % 9 == 0,
        "text_chars": F.when(F.col("pos") % 2 == 0, F.col("pos") % 300), "target_kinds": F.when(F.col("kind") == "purchase", F.array(F.lit("action_result"))).otherwise(none),
        "t": F.col("t"), "anchors": F.when(click, F.create_map(F.lit("a"), F.lit(10.0), F.lit("b"), F.lit(400.0))),
    }
    return rounded(e.select("pos", S.primary_reason(F.col("reasons")).alias("reason"), "priority", S.frame_score(row).alias("score")))


_VEC = "vq AS (SELECT vec_id, list_transform(embedding, lambda x: floor(abs(x) * 200)::INT % 256) AS q FROM embeddings)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 64 small whole numbers, in place of pictures; multiplied as floats, like DuckDB does, as the double's product can fall below a whole number."""
    return table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: (F.floor(F.abs(x) * F.lit(200).cast("float")) % 256).cast("int")).alias("q"))


_DIFF = "list_sum(list_transform(range(1, 65), lambda i: abs(a.q[i] - b.q[i]))) / 64.0"


@query(f"WITH {_VEC} SELECT a.vec_id, round({_DIFF}, 6)::DOUBLE AS luma_mad, round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN abs(a.q[i] - b.q[i]) > 12 THEN 1 ELSE 0 END)) / 64.0, 6)::DOUBLE AS changed_ratio, round(least(1.0, list_sum(list_transform(range(0, 16), lambda i: abs(a.q[4 * i + 1] - b.q[4 * i + 1]))) / 16.0 / 12), 6)::DOUBLE AS quick FROM vq a JOIN vq b ON b.vec_id = a.vec_id + 1")
def signature_distance(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    j = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("q").alias("o")), "vec_id")
    c = G.compare(F.col("q"), F.col("q"), F.col("o"), F.col("o"))
    return rounded(j.withColumn("c", c).select("vec_id", "c.luma_mad", "c.changed_ratio", G.quick_distance(F.col("q"), F.col("o")).alias("quick")))


@query(f"WITH {_VEC}, k AS (SELECT vec_id, q, label AS grp FROM vq JOIN embeddings USING (vec_id)) SELECT a.grp, a.vec_id AS a, b.vec_id AS b FROM k a JOIN k b ON a.grp = b.grp AND a.vec_id < b.vec_id WHERE {_DIFF} <= 24")
def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), "q")
    return D.close_pairs(v, ["grp"], "q", 64, 24)


@query(
    f"WITH {_VEC}, e AS (SELECT vec_id, q, list_transform(range(1, 65), lambda i: (floor((abs(q[i] - CASE WHEN i % 8 = 0 THEN q[i] ELSE q[i + 1] END) + abs(q[i] - CASE WHEN i + 8 > 64 THEN q[i] ELSE q[i + 8] END)) / 2))::INT) AS e FROM vq) SELECT vec_id, e AS edges, round(list_avg(e), 6) AS sharpness, round(list_avg(q), 6) AS mean, round(sqrt(greatest(list_avg(list_transform(q, lambda x: x * x)) - list_avg(q) * list_avg(q), 0)), 6) AS contrast, round(CASE WHEN list_avg(q) >= 128 THEN list_avg(list_transform(q, lambda x: CASE WHEN x < 140 THEN 1.0 ELSE 0.0 END)) ELSE list_avg(list_transform(q, lambda x: CASE WHEN x >= 140 THEN 1.0 ELSE 0.0 END)) END, 6) AS ink FROM e"
)
def edge_map(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).withColumn("edges", G.edge_map(F.col("q"), 8)).withColumn("s", G.statistics(F.col("q"), F.col("edges")))
    return rounded(v.select("vec_id", "edges", "s.sharpness", "s.mean", "s.contrast", G.ink_ratio(F.col("q")).alias("ink")))


_EDGES = "list_transform(range(1, 65), lambda i: (floor((abs(q[i] - CASE WHEN i % 8 = 0 THEN q[i] ELSE q[i + 1] END) + abs(q[i] - CASE WHEN i + 8 > 64 THEN q[i] ELSE q[i + 8] END)) / 2))::INT)"


@query(
    f"""WITH RECURSIVE {_VEC}, n AS (SELECT label AS grp, vec_id AS pos, q, {_EDGES} AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM vq JOIN embeddings USING (vec_id)),
nr AS (SELECT b.grp, b.rn, list(a.rn) AS near FROM n a JOIN n b ON a.grp = b.grp AND a.rn < b.rn WHERE {_DIFF} <= 30 AND list_sum(list_transform(range(1, 65), lambda i: abs(a.e[i] - b.e[i]))) / 64.0 <= 30 AND list_sum(list_transform(range(1, 65), lambda i: CASE WHEN abs(a.q[i] - b.q[i]) > 12 THEN 1 ELSE 0 END)) / 64.0 <= 0.8 GROUP BY ALL),
o AS (SELECT n.grp, n.pos, n.rn, coalesce(near, []) AS near FROM n LEFT JOIN nr USING (grp, rn)),
r AS (SELECT grp, pos, rn, [rn] AS leaders, rn AS leader FROM o WHERE rn = 1
 UNION ALL SELECT o.grp, o.pos, o.rn, CASE WHEN list_has_any(leaders, near) THEN leaders ELSE list_append(leaders, o.rn) END, coalesce(list_min(list_intersect(leaders, near)), o.rn) FROM r JOIN o ON o.grp = r.grp AND o.rn = r.rn + 1)
SELECT r.grp, r.pos, n.pos AS leader FROM r JOIN n ON n.grp = r.grp AND n.rn = r.leader"""
)
def leader_families(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).select(F.col("label").alias("grp"), F.col("vec_id").alias("pos"), F.col("q").alias("pixels"), G.edge_map(F.col("q"), 8).alias("edges"))
    return D.leader_families(v, ["grp"], (30.0, 30.0, 0.8)).select("grp", "pos", "leader")


@query(None)
def deduplicate_frames(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).withColumn("edges", G.edge_map(F.col("q"), 8))
    r = v.select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("vec_id").cast("double").alias("t"), F.col("vec_id").alias("pos"), (F.col("vec_id") % 3).alias("chapter_id"), (F.col("vec_id") % 17).cast("double").alias("score"), F.array(F.when(F.col("vec_id") % 4 == 0, "target").otherwise("scene")).alias("reasons"), F.transform("q", lambda x: (x / 16).cast("int")).alias("pixels"), F.transform("edges", lambda x: (x / 16).cast("int")).alias("edges"))
    return D.deduplicate_frames(r, ["grp"]).select("grp", "id", "cluster", "family_id", "status", "kept_by", "revisit")


@query("WITH s AS (SELECT o_custkey, o_orderkey, o_orderpriority AS grp FROM orders) SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey, grp ORDER BY o_orderkey) > 1 AS redundant FROM s")
def redundant_rows(spark: SparkSession, sf: str) -> DataFrame:
    return D.redundant(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", ["o_orderkey"]).select("o_custkey", "o_orderkey", "redundant")


@query(
    """WITH RECURSIVE c AS (SELECT o_custkey AS k, o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS up FROM orders),
r AS (SELECT k, id, id AS root, up FROM c UNION ALL SELECT r.k, r.id, c.id, c.up FROM r JOIN c ON c.k = r.k AND c.id = r.up) SELECT k, id, root FROM r WHERE up IS NULL"""
)
def duplicate_root(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf, "orders")
    up = F.when(F.col("o_orderkey") % 3 > 0, F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return D.chain_roots(o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), up.alias("duplicates_of")), ["k"])


@query(f"WITH {EVENTS}, o AS (SELECT user_id, pos, t, unnest([(0, 0.25), (1, 0.5), (2, 1.0), (3, -0.25), (4, -0.5)]) AS o FROM ev WHERE value < 5), r AS (SELECT user_id, pos, o[1]::INT AS try, round(t + o[2], 3) AS retry_t, floor(t) AS s FROM o) SELECT user_id, pos, try, retry_t FROM r WHERE retry_t >= s AND retry_t < s + 1")
def blank_recovery(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).filter("value < 5").withColumn("s", F.floor("t").cast("double")).withColumn("e", F.col("s") + 1)
    return D.recovery_times(e, "s", "e").select("user_id", "pos", "try", "retry_t")


@query(
    f"""WITH {EVENTS} SELECT pos, printf('%02d:%02d', round_even(t % 7200, 0)::BIGINT // 60, round_even(t % 7200, 0)::BIGINT % 60) AS short,
 CASE WHEN round_even(t, 0) >= 3600 THEN printf('%d:%02d:%02d', round_even(t, 0)::BIGINT // 3600, round_even(t, 0)::BIGINT % 3600 // 60, round_even(t, 0)::BIGINT % 60) ELSE printf('%02d:%02d', round_even(t, 0)::BIGINT // 60, round_even(t, 0)::BIGINT % 60) END AS long, round_even(t, 0) AS parsed FROM ev"""
)
def clock_format(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("long", C.format_clock(F.col("t")))
    return e.select("pos", C.format_clock(F.col("t") % 7200, hours=False).alias("short"), "long", C.parse_clock(F.col("long")).alias("parsed"))


@query(
    """WITH c AS (SELECT o_orderkey, (o_totalprice * 400)::BIGINT AS size, o_totalprice / 97 AS secs FROM orders), n AS (SELECT *, greatest(1, ceil(size / 24000000), ceil(secs / 598))::INT AS n FROM c), e AS (SELECT *, unnest(range(0, n)) AS i FROM n),
s AS (SELECT o_orderkey, i, i * (secs / n) AS off, CASE WHEN i = n - 1 THEN secs - i * (secs / n) ELSE secs / n END AS dur FROM e) SELECT o_orderkey, i::INT AS i, round(off, 6) AS "offset", round(dur, 6) AS duration, round(greatest(0, off - 2), 6) AS start FROM s"""
)
def chunk_plan(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 400).cast("long").alias("size"), (F.col("o_totalprice") / 97).alias("secs"))
    p = o.select("o_orderkey", F.posexplode(C.chunk_plan(F.col("size"), F.col("secs"))).alias("i", "c"))
    return rounded(p.select("o_orderkey", "i", "c.offset", "c.duration", C.look_back(F.col("c.offset"), F.col("c.duration"))["start"].alias("start")))


@query(
    """WITH p AS (SELECT p_partkey, (p_retailprice * 10)::INT AS budget, p_size * 30 AS sheets, ceil((320 + 64 * (p_size % 7)) / 28.0)::INT * 11 AS per FROM part) SELECT p_partkey, greatest(0, least(30, floor((budget - sheets) / per)))::INT AS allowed, budget - sheets < 0 AS over_budget, (least(1280, 512) - least(1280, 512) % 2)::INT AS w, (round_even(720 * 512 / 1280.0, 0)::INT - round_even(720 * 512 / 1280.0, 0)::INT % 2)::INT AS h FROM p"""
)
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    per = (F.ceil((320 + 64 * (F.col("p_size") % 7)) / 28) * 11).cast("int")
    allowed, over = C.token_budget(F.round(F.col("p_retailprice") * 10).cast("int"), F.col("p_size") * 30, per)
    w, h = C.even_size(F.lit(1280), F.lit(720), F.lit(512))
    return table(spark, sf, "part").select("p_partkey", allowed.alias("allowed"), over.alias("over_budget"), w.alias("w"), h.alias("h"))


@query(
    f"""WITH {EVENTS} SELECT pos, list_sort(list_distinct([round(t + value * 0.1, 6), round(t + value * 0.3, 6), round(t + value * 0.5, 6), round(t + value * 0.7, 6), round(t + value * 0.9, 6)])) AS times, abs(value - floor(value)) > greatest(0.10, 2.5 * 0.04) AS drifted FROM ev"""
)
def sample_times(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    times = F.array_sort(C.sample_fractions(F.col("t"), F.col("t") + F.col("value"), [0.1, 0.3, 0.5, 0.7, 0.9]))
    return e.select("pos", times.alias("times"), C.drifted(F.col("value"), F.floor("value"), C.frame_duration(F.lit(25.0))).alias("drifted"))


@query(
    """SELECT p_brand, p_type, grouping(p_brand, p_type) AS level, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY ROLLUP (p_brand, p_type)"""
)
def rollup_totals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").rollup("p_brand", "p_type").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))
