"""Registered queries on sampled series and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import runs as R
from tidemark.operators import series as S
from tidemark.operators.dedup import merge_points as merge
from tidemark.plans.tables import EVENTS, events, rounded

K = ["user_id"]
QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_TH = "th AS (SELECT user_id, med, median(abs(value - med)) AS mad FROM ev JOIN (SELECT user_id, median(value) AS med FROM ev GROUP BY user_id) USING (user_id) GROUP BY user_id, med)"


def _threshold(floor: float, times: float) -> str:
    return f"greatest({floor}, med + {times} * mad)"


@query(f"WITH {EVENTS}, {_TH} SELECT user_id, round(med, 6) AS med, round(mad, 6) AS mad, round({_threshold(0.04, 8)}, 6) AS threshold FROM th")
def adaptive_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.robust_threshold(events(spark, sf), K, "value"))


_PEAKS = f"""nb AS (SELECT *, coalesce(lag(value) OVER w, -1) AS p, coalesce(lead(value) OVER w, -1) AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, pos)),
pk AS (SELECT nb.* FROM nb JOIN th USING (user_id) WHERE value >= p AND value >= n AND value >= {_threshold(0.04, 1)})"""


@query(f"WITH {EVENTS}, {_TH}, {_PEAKS} SELECT user_id, pos, round(t, 6) AS t, value FROM pk")
def adaptive_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.local_maxima(events(spark, sf), K, ["t", "pos"], "value", times=1.0).select("user_id", "pos", "t", "value"))


_NMS = "list_reduce(list_transform(list(struct_pack(t := t, v := value) ORDER BY t, value), lambda x: [x]), lambda a, b: CASE WHEN b[1].t - a[-1].t >= {gap} THEN list_concat(a, b) WHEN b[1].v > a[-1].v THEN list_concat(a[1:len(a)-1], b) ELSE a END)"


@query(f"WITH {EVENTS}, {_TH}, {_PEAKS}, k AS (SELECT user_id, unnest({_NMS.format(gap=172800)}) AS x FROM pk GROUP BY user_id) SELECT user_id, round(x.t, 6) AS t, x.v AS value FROM k")
def peaks_nms(spark: SparkSession, sf: str) -> DataFrame:
    peaks = S.local_maxima(events(spark, sf), K, ["t", "pos"], "value", times=1.0)
    return rounded(S.suppress(peaks, K, "value", 172800.0))


@query(
    f"""WITH {EVENTS}, a AS (SELECT user_id, list_sort(list(value)) AS v FROM ev GROUP BY user_id), b AS (SELECT user_id, v, v[len(v) // 2 + 1] AS med FROM a), c AS (SELECT user_id, med, list_sort(list_transform(v, lambda x: abs(x - med))) AS d FROM b)
SELECT user_id, med, round(d[len(d) // 2 + 1], 6) AS mad, round(greatest(0.12, least(50.0, med + 4 * d[len(d) // 2 + 1])), 6) AS threshold FROM c"""
)
def motion_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.motion_threshold(events(spark, sf), K, "value", most=50.0))


_FRAMES = "fr AS (SELECT user_id, pos, t, value, kind, (value % 10) / 20 AS motion, 100 + value * 4 AS luma, value % 30 AS edge, value AS ink, (value % 7) / 1000 AS changed FROM ev)"


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Events as frames: motion, luma, edge, ink and changed derived from their value."""
    v = F.col("value")
    return events(spark, sf).select("*", ((v % 10) / 20).alias("motion"), (100 + v * 4).alias("luma"), (v % 30).alias("edge"), v.alias("ink"), ((v % 7) / 1000).alias("changed"))


_MODES = f"""w0 AS (SELECT *, floor((t - min(t) OVER (PARTITION BY user_id)) / 259200)::BIGINT AS window_no FROM fr), w1 AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_no ORDER BY t, pos) AS rn, count(*) OVER (PARTITION BY user_id, window_no) AS n FROM w0),
w2 AS (SELECT user_id, window_no, count(*) AS n, min(t) AS start, max(t) + 0.5 AS "end", avg(CASE WHEN rn > 1 THEN CASE WHEN motion > 0.02 THEN 1.0 ELSE 0.0 END END) AS motion_freq, avg(CASE WHEN rn > 1 THEN CASE WHEN motion > 0.25 THEN 1.0 ELSE 0.0 END END) AS big_motion, avg(luma) AS luma, avg(edge) AS edge,
 avg(CASE WHEN rn <= greatest(1, n // 4) THEN ink END) AS ink_first, avg(CASE WHEN rn > n - greatest(1, n // 4) THEN ink END) AS ink_last FROM w1 GROUP BY user_id, window_no),
w3 AS (SELECT *, CASE WHEN big_motion > 0.5 THEN 'A' WHEN motion_freq < 0.15 THEN 'B' WHEN luma > 150 AND edge < 14 THEN 'C' ELSE 'D' END AS mode FROM w2 WHERE n >= 2)"""


@query(
    f"WITH {EVENTS}, {_FRAMES}, {_MODES} SELECT user_id, window_no, n, round(start, 6) AS start, round(\"end\", 6) AS \"end\", round(motion_freq, 6) AS motion_freq, round(big_motion, 6) AS big_motion, round(luma, 6) AS luma, round(edge, 6) AS edge, round(ink_first, 6) AS ink_first, round(ink_last, 6) AS ink_last, mode FROM w3"
)
def tumbling_mode(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.anchored_windows(frames(spark, sf), K, 259200.0, "motion", "motion", "luma", "edge", "ink"))




@query(
    f"""WITH RECURSIVE {EVENTS}, {_FRAMES}, {_MODES}, nn AS (SELECT user_id, window_no, mode, row_number() OVER (PARTITION BY user_id ORDER BY window_no) AS i, lead(mode) OVER (PARTITION BY user_id ORDER BY window_no) AS nxt FROM w3),
st AS (SELECT user_id, window_no, i, mode FROM nn WHERE i = 1 UNION ALL SELECT nn.user_id, nn.window_no, nn.i, CASE WHEN nn.nxt = st.mode THEN st.mode ELSE nn.mode END FROM st JOIN nn ON nn.user_id = st.user_id AND nn.i = st.i + 1) SELECT user_id, window_no, mode FROM st"""
)
def smooth_modes(spark: SparkSession, sf: str) -> DataFrame:
    return S.smooth_modes(S.anchored_windows(frames(spark, sf), K, 259200.0, "motion", "motion", "luma", "edge", "ink"), K)


@query(
    f"""WITH {EVENTS}, {_FRAMES}, {_MODES}, p AS (SELECT user_id, pos, t FROM ev WHERE kind = 'error'), m AS (SELECT p.user_id, p.pos, arg_min(w.mode, CASE WHEN p.t >= w.start AND p.t < w."end" THEN w.window_no END) AS own, max(w."end") AS over, arg_max(w.mode, w.window_no) AS final, max(p.t) AS t FROM p JOIN w3 w USING (user_id) GROUP BY p.user_id, p.pos)
SELECT p.user_id, p.pos, coalesce(m.own, CASE WHEN m.t >= m.over THEN m.final END, 'B') AS mode FROM p LEFT JOIN m ON m.user_id = p.user_id AND m.pos = p.pos"""
)
def mode_at(spark: SparkSession, sf: str) -> DataFrame:
    w = S.anchored_windows(frames(spark, sf), K, 259200.0, "motion", "motion", "luma", "edge", "ink")
    return S.mode_at(events(spark, sf).filter("kind = 'error'"), w, K, "pos", width=259200.0).select("user_id", "pos", "mode")


@query(f"WITH {EVENTS} SELECT user_id, pos, round(abs(value - lag(value) OVER (PARTITION BY user_id, kind ORDER BY t, pos)), 6) AS delta FROM ev")
def lag_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.lag_features(events(spark, sf), K, "kind", ["t", "pos"], "value").select("user_id", "pos", "delta"))


@query(
    f"""WITH {EVENTS}, {_FRAMES}, a AS (SELECT *, changed <= 0.002 AS one, lag(changed <= 0.002) OVER (PARTITION BY user_id, kind ORDER BY t, pos) AS was FROM fr), b AS (SELECT *, one AND coalesce(was, false) AS two FROM a)
SELECT user_id, kind, pos, CASE WHEN bool_or(two) OVER (PARTITION BY user_id, kind) THEN two ELSE one END AS settled FROM b"""
)
def settled_frames(spark: SparkSession, sf: str) -> DataFrame:
    return S.settled(frames(spark, sf), ["user_id", "kind"], "changed", 0.002).select("user_id", "kind", "pos", "settled")


@query(
    f"""WITH {EVENTS}, {_FRAMES}, a AS (SELECT *, changed <= 0.002 AS one, lag(changed <= 0.002) OVER (PARTITION BY user_id, kind ORDER BY t, pos) AS was FROM fr), b AS (SELECT *, one AND coalesce(was, false) AS two FROM a),
c AS (SELECT *, CASE WHEN bool_or(two) OVER (PARTITION BY user_id, kind) THEN two ELSE one END AS settled, row_number() OVER (PARTITION BY user_id, kind ORDER BY t, pos) - 1 AS i, count(*) OVER (PARTITION BY user_id, kind) AS n FROM b),
d AS (SELECT user_id, kind, arg_max(t, (ink, -i)) FILTER (settled AND i >= n * 2 // 3) AS late, arg_max(t, (ink, -i)) FILTER (settled) AS any_, arg_max(t, i) AS last, arg_min(t, i) AS first, arg_min(t, i) FILTER (settled) AS fs, arg_max(t, i) FILTER (settled) AS ls, arg_max(t, (ink, -i)) AS mi FROM c GROUP BY user_id, kind)
SELECT user_id, kind, round(CASE WHEN kind = 'view' THEN coalesce(late, any_, last) ELSE coalesce(ls, last) END, 6) AS t, round(coalesce(fs, first), 6) AS first_settled, round(coalesce(ls, last), 6) AS last_settled, round(mi, 6) AS max_ink FROM d"""
)
def representative(spark: SparkSession, sf: str) -> DataFrame:
    k = ["user_id", "kind"]
    f = S.settled(frames(spark, sf), k, "changed", 0.002).withColumn("mode", F.when(F.col("kind") == "view", "C").otherwise("B"))
    return rounded(S.representative(f, k, "mode", "ink"))


@query(
    f"""WITH {EVENTS}, {_FRAMES}, l AS (SELECT *, lag(ink) OVER (PARTITION BY user_id, kind ORDER BY t, pos) AS a FROM fr),
g AS (SELECT user_id, kind, count(*) AS n, arg_min(ink, (t, pos)) AS ink_first, arg_max(ink, (t, pos)) AS ink_last, avg(CASE WHEN a IS NOT NULL THEN CASE WHEN ink >= a * 0.98 THEN 1.0 ELSE 0.0 END END) AS mono, count(*) FILTER (a > 0 AND ink > a * 1.05) AS steps, avg(CASE WHEN motion / 10 > 0.03 THEN 1.0 ELSE 0.0 END) > 1::DOUBLE - 0.8::DOUBLE AS pan FROM l GROUP BY user_id, kind)
SELECT user_id, kind, n, ink_first, ink_last, CASE WHEN n >= 3 AND NOT pan THEN steps ELSE 0 END AS steps, pan, n >= 3 AND NOT pan AND mono >= 0.8 AND ink_first > 0 AND ink_last >= 1.15 * ink_first AS is_build FROM g"""
)
def build_record(spark: SparkSession, sf: str) -> DataFrame:
    return S.build_record(frames(spark, sf).withColumn("m", F.col("motion") / 10), ["user_id", "kind"], "ink", "m")


@query(
    f"""WITH {EVENTS}, sc AS (SELECT user_id, t, value / 103 AS score FROM ev), md AS (SELECT user_id, median(score) AS med FROM sc GROUP BY user_id), ta AS (SELECT user_id, greatest(0.015, med + 6 * median(abs(score - med))) AS tau FROM sc JOIN md USING (user_id) GROUP BY user_id, med),
e AS (SELECT user_id, tau, max(CASE WHEN score >= tau AND score >= 0.15 AND t <= 1000000 THEN t END) AS b, min(CASE WHEN score >= tau AND score >= 0.15 AND t > 1000000 THEN t END) AS a FROM sc JOIN ta USING (user_id) GROUP BY user_id, tau),
r AS (SELECT user_id, tau, greatest(500000, coalesce(b, 500000)) AS rs, coalesce(a, 2000000) AS st, CASE WHEN a IS NOT NULL THEN a - 0.2 ELSE 2000000 - 0.25 END AS w, a IS NOT NULL AS flipped FROM e)
SELECT user_id, round(greatest(rs, least(w, 2000000)), 3) AS terminal_t, round(rs, 3) AS run_start, round(st, 3) AS stop, flipped, round(tau, 4) AS step_tau, count(*) FILTER (score >= tau AND score < 0.15 AND t >= rs AND t < st) AS build_steps, count(*) FILTER (score >= tau) AS events FROM sc JOIN r USING (user_id) GROUP BY ALL"""
)
def stable_terminal(spark: SparkSession, sf: str) -> DataFrame:
    s = events(spark, sf).select("user_id", "t", (F.col("value") / 103).alias("score"))
    a = s.select("user_id").distinct().select("user_id", F.lit(1000000.0).alias("anchor"), F.lit(500000.0).alias("lo"), F.lit(2000000.0).alias("hi"))
    return S.stable_terminal(s, a, K, "score")


@query(
    f"""WITH {EVENTS}, b AS (SELECT *, value > 3 AND value < 60 AS ok, abs(t - 1200000) AS far FROM ev), r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM b),
n AS (SELECT user_id, min((far, t, run, ok, value)) AS near FROM r GROUP BY user_id), m AS (SELECT r.user_id, min((r.value, r.far, r.t)) AS best FROM r JOIN n USING (user_id) WHERE r.ok AND near[4] AND r.run = near[3] GROUP BY r.user_id)
SELECT n.user_id, round(CASE WHEN coalesce(best[1] <= near[5] * (1 - 0.1), false) THEN best[3] ELSE near[2] END, 6) AS t, coalesce(best[1] <= near[5] * (1 - 0.1), false) AS moved FROM n LEFT JOIN m USING (user_id)"""
)
def sharpest_near(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("t0", F.lit(1200000.0))
    return rounded(S.sharpest_near(e, K, "t0", "value", (F.col("value") > 3) & (F.col("value") < 60)))


@query(
    f"""WITH {EVENTS}, g AS (SELECT *, CASE WHEN abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY t, pos)) <= 10 THEN 0 ELSE 1 END AS fresh FROM ev), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, pos ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, run, count(*) AS n, round(min(t), 6) AS start, round(max(t), 6) AS "end" FROM i GROUP BY user_id, run"""
)
def drift_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = R.drift_runs(events(spark, sf), K, "value", 10.0)
    return rounded(r.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("t").alias("start"), F.max("t").alias("end")))


_FOLD = "list_reduce(list_transform(list(struct_pack(t := t, p := pos, v := value) ORDER BY t, pos), lambda x: [struct_pack(s := x.t, e := x.t, n := 1::BIGINT, a := x.v, l := x.v)]), lambda a, b: CASE WHEN {same} THEN list_concat(a[1:len(a)-1], [struct_pack(s := a[-1].s, e := b[1].s, n := a[-1].n + 1, a := a[-1].a, l := b[1].l)]) ELSE list_concat(a, b) END)"


@query(
    f"WITH {EVENTS}, f AS (SELECT user_id, {_FOLD.format(same='abs(b[1].a - a[-1].a) <= 12 AND abs(b[1].a - a[-1].l) <= 8')} AS r FROM ev GROUP BY user_id), u AS (SELECT user_id, unnest(range(0, len(r))) AS run, r FROM f) SELECT user_id, run::INT AS run, round(r[run + 1].s, 6) AS start, round(r[run + 1].e, 6) AS \"end\", r[run + 1].n AS n FROM u"
)
def anchor_runs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.anchor_runs(events(spark, sf), K, "value", 12.0, 8.0))


@query(
    f"""WITH {EVENTS}, ti AS (SELECT user_id, pos, t, value * 4 AS luma, (pos % 25)::DOUBLE AS diff FROM ev), f AS (SELECT user_id, list_reduce(list_transform(list(struct_pack(t := t, p := pos, v := luma, d := diff) ORDER BY t, pos), lambda x: [struct_pack(s := x.t, e := x.t, n := 1::BIGINT, a := x.v, d := x.d)]),
 lambda a, b: CASE WHEN abs(b[1].a - a[-1].a) > 25 OR b[1].d > 18 THEN list_concat(a, b) ELSE list_concat(a[1:len(a)-1], [struct_pack(s := a[-1].s, e := b[1].s, n := a[-1].n + 1, a := a[-1].a, d := 0.0)]) END) AS r FROM ti GROUP BY user_id), u AS (SELECT user_id, unnest(range(0, len(r))) AS run, r FROM f)
SELECT user_id, run::INT AS run, round(r[run + 1].s, 6) AS start, round(r[run + 1].e, 6) AS "end", r[run + 1].n AS n FROM u"""
)
def coarse_states(spark: SparkSession, sf: str) -> DataFrame:
    t = events(spark, sf).select("user_id", "pos", "t", (F.col("value") * 4).alias("luma"), (F.col("pos") % 25).cast("double").alias("diff"))
    return rounded(R.coarse_states(t, K))


@query(
    f"""WITH {EVENTS}, m AS (SELECT user_id, kind, median(value * 6) AS luma, median((pos % 40) / 100) AS edge, CASE WHEN count(*) > 1 THEN median((pos % 25)::DOUBLE) ELSE 0.0 END AS diff FROM ev GROUP BY user_id, kind)
SELECT user_id, kind, CASE WHEN luma < 90 AND edge < 0.15 THEN 'talking_head_or_dark' WHEN luma < 120 AND edge >= 0.15 THEN 'code_or_terminal' WHEN diff > 8 THEN 'dynamic_ui' WHEN luma > 190 THEN 'slide_or_canvas' ELSE 'unknown' END AS guess FROM m"""
)
def mode_guess(spark: SparkSession, sf: str) -> DataFrame:
    t = events(spark, sf).select("user_id", "kind", (F.col("value") * 6).alias("luma"), ((F.col("pos") % 40) / 100).alias("edge"), (F.col("pos") % 25).cast("double").alias("diff"))
    return R.mode_guess(t, ["user_id", "kind"])


@query(
    f"""WITH {EVENTS}, st AS (SELECT user_id, 's' || pos AS state_id, pos, CASE WHEN pos % 3 = 0 THEN 'f' || (pos % 5) END AS family_id, floor(value / 4)::BIGINT AS settled_samples, pos % 7 = 0 AS is_build FROM ev),
g AS (SELECT user_id, coalesce(family_id, state_id) AS grp, sum(settled_samples) / 2.0 AS seconds, bool_or(is_build) AS is_build, min(pos) AS pos FROM st WHERE settled_samples >= 2 GROUP BY ALL),
b AS (SELECT user_id, arg_max(grp, (seconds, -pos)) FILTER (NOT is_build) AS backdrop, sum(seconds) AS tot, coalesce(max(seconds) FILTER (NOT is_build), 0) AS own FROM g GROUP BY user_id), sc AS (SELECT user_id, (max(t) - min(t)) / 3600 AS scanned FROM ev GROUP BY user_id)
SELECT sc.user_id, backdrop, round(coalesce(tot - own, 0), 6)::DOUBLE AS non_talk, CASE WHEN scanned <= 0 THEN 'unavailable' WHEN coalesce(tot - own, 0) >= least(90.0, 0.2 * scanned) THEN 'contradicts' ELSE 'supports' END AS verdict FROM sc LEFT JOIN b USING (user_id)"""
)
def probe_verdict(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    st = e.select(
        "user_id", F.concat(F.lit("s"), F.col("pos").cast("string")).alias("state_id"), "pos", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("f"), (F.col("pos") % 5).cast("string"))).alias("family_id"), F.floor(F.col("value") / 4).alias("settled_samples"), (F.col("pos") % 7 == 0).alias("is_build")
    )
    scanned = e.groupBy("user_id").agg(((F.max("t") - F.min("t")) / 3600).alias("scanned"))
    return rounded(R.probe_verdict(st, scanned, K))


def _far(first: str) -> str:
    """Whether a picture n differs too much from the one whose luma and edge are columns ``first``l and ``first``e."""
    d = [f"abs((n.l + n.e * {k}) - ({first}l + {first}e * {k}))" for k in range(4)]
    moved = " + ".join(f"({x} > 12)::INT" for x in d)
    return f"((({d[0]} + {d[1]}) + ({d[2]} + {d[3]})) / 4 > m.luma OR abs(n.e - {first}e) > m.edge OR ({moved}) / 4 > m.changed)"


@query(
    f"""WITH RECURSIVE {EVENTS}, {_FRAMES}, n AS (SELECT user_id, pos, t, ['A', 'B', 'C', 'D'][floor(t / 86400)::INT % 4 + 1] AS mode, luma AS l, edge AS e, ink, row_number() OVER (PARTITION BY user_id ORDER BY t, pos) AS rn FROM fr),
m(mode, luma, edge, changed, drift) AS (VALUES ('A', 8.0::DOUBLE, 6.0::DOUBLE, 0.10::DOUBLE, false), ('B', 3.0, 4.0, 0.06, false), ('C', 6.0, 6.0, 0.20, true), ('D', 4.0, 5.0, 0.06, true)),
r AS (SELECT user_id, rn, pos, t, l, e, l AS fl, e AS fe, ink AS peak, true AS opens FROM n WHERE rn = 1
 UNION ALL SELECT user_id, rn, pos, t, l, e, CASE WHEN o THEN l ELSE fl END, CASE WHEN o THEN e ELSE fe END, CASE WHEN o THEN ink ELSE greatest(peak, ink) END, o FROM (
  SELECT n.*, r.fl, r.fe, r.peak, {_far("r.")} OR (NOT m.drift AND {_far("r.f")}) OR (n.mode = 'C' AND r.peak > 0 AND n.ink < 0.7::DOUBLE * r.peak) AS o FROM r JOIN n ON n.user_id = r.user_id AND n.rn = r.rn + 1 JOIN m ON m.mode = n.mode)),
g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY rn) AS piece FROM r), p AS (SELECT *, max(t) OVER (PARTITION BY user_id, piece) - min(t) OVER (PARTITION BY user_id, piece) + 0.5 >= 1.5 OR piece = 1 AS stays FROM g)
SELECT user_id, pos, (sum((opens AND stays)::INT) OVER (PARTITION BY user_id ORDER BY rn) - 1)::INT AS run FROM p"""
)
def build_runs(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).select("user_id", "pos", "t", F.element_at(F.array(*map(F.lit, "ABCD")), (F.floor(F.col("t") / 86400) % 4 + 1).cast("int")).alias("mode"), F.array(*[(F.col("luma") + F.col("edge") * (k % 4)).alias(f"p{k}") for k in range(16)]).alias("pixels"), F.array_repeat("edge", 16).alias("edges"), "ink")
    return R.build_runs(f, K).select("user_id", "pos", "run")


@query(
    f"""WITH {EVENTS}, po AS (SELECT user_id, pos, t, floor(t / 259200)::BIGINT::VARCHAR AS chapter, (pos % 3)::DOUBLE AS priority, value AS scene, pos % 5 = 0 AS action, [kind] AS reasons, ['t' || (pos % 4)] AS ids FROM ev),
f AS (SELECT user_id, list_reduce(list_transform(list(struct_pack(t := t, p := pos, c := chapter, pr := priority, s := scene, ac := action, r := reasons, i := ids) ORDER BY t, pos), lambda x: [struct_pack(t := x.t, c := x.c, pr := x.pr, s := x.s, ac := x.ac, r := x.r, i := x.i)]),
 lambda a, b: CASE WHEN a[-1].c = b[1].c AND b[1].t - a[-1].t <= 14400 THEN list_concat(a[1:len(a)-1], [struct_pack(
   t := CASE WHEN (b[1].pr, b[1].s, CASE WHEN b[1].ac THEN b[1].t ELSE -b[1].t END) > (a[-1].pr, a[-1].s, CASE WHEN a[-1].ac THEN a[-1].t ELSE -a[-1].t END) THEN b[1].t ELSE a[-1].t END, c := a[-1].c, pr := greatest(a[-1].pr, b[1].pr), s := greatest(a[-1].s, b[1].s),
   ac := CASE WHEN (b[1].pr, b[1].s, CASE WHEN b[1].ac THEN b[1].t ELSE -b[1].t END) > (a[-1].pr, a[-1].s, CASE WHEN a[-1].ac THEN a[-1].t ELSE -a[-1].t END) THEN b[1].ac ELSE a[-1].ac END, r := list_sort(list_distinct(list_concat(a[-1].r, b[1].r))), i := list_sort(list_distinct(list_concat(a[-1].i, b[1].i))))]) ELSE list_concat(a, b) END) AS m FROM po GROUP BY user_id),
u AS (SELECT user_id, unnest(range(0, len(m))) AS k, m FROM f) SELECT user_id, k::INT AS pos, round(m[k + 1].t, 6) AS requested_t, m[k + 1].c AS chapter, m[k + 1].pr AS priority, m[k + 1].s AS scene_score, m[k + 1].ac AS action, m[k + 1].r AS reasons, m[k + 1].i AS target_ids FROM u"""
)
def merge_points(spark: SparkSession, sf: str) -> DataFrame:
    p = events(spark, sf).select(
        "user_id", F.col("t").alias("requested_t"), "pos", F.floor(F.col("t") / 259200).cast("string").alias("chapter"), (F.col("pos") % 3).alias("priority"), F.col("value").alias("scene_score"), (F.col("pos") % 5 == 0).alias("action"), F.array("kind").alias("reasons"), F.array(F.concat(F.lit("t"), (F.col("pos") % 4).cast("string"))).alias("target_ids")
    )
    return rounded(merge(p, K, "chapter", 14400.0))


@query(
    f"""WITH {EVENTS}, r AS (SELECT *, list(kind) OVER (PARTITION BY user_id ORDER BY t, pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS recent FROM ev) SELECT user_id, count(*) AS n, count(*) FILTER (list_contains(recent, kind)) AS repeated FROM r GROUP BY user_id"""
)
def repeat_in_last_5(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t", "pos").rowsBetween(-5, -1)
    e = events(spark, sf).withColumn("recent", F.collect_list("kind").over(w))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.array_contains("recent", F.col("kind"))).alias("repeated"))
