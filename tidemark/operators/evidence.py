"""Joins of the evidence tables: points, states, candidates, selections, assets, chapters, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clock as C
from tidemark.operators.intervals import merge_intervals


def normalised_targets(targets: DataFrame, segments: DataFrame, chapters: DataFrame, keys: list[str]) -> DataFrame:
    """Targets (target_id, chapter_id, kind, seg_ids, action_seg_id, anchor_t, lo, hi) with anchor and window filled in and cut to their chapter.

    Anchor: as given, else the end of the action's segment (for actions; the first end of its
    segments where none is named), else the middle of what its segments span. Window: as given,
    else [anchor - 0.15, anchor + 2.5] for actions, else the span widened by 0.25 and 0.75.
    Both end before the chapter does and are 0.05 wide at least.
    """
    t = targets.withColumn("ref", F.explode_outer("seg_ids"))
    s = segments.select(*keys, F.col("seg_id").alias("ref"), F.col("start").alias("s"), F.col("end").alias("e"))
    own = [*keys, "target_id"]
    span = t.join(s, [*keys, "ref"], "left").groupBy(*own).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("e").alias("first_end"), F.max(F.when(F.col("ref") == F.col("action_seg_id"), F.col("e"))).alias("action_end"))
    c = chapters.select(*keys, "chapter_id", F.col("start").alias("c0"), F.col("end").alias("c1"))
    x = targets.join(span, own, "left").join(c, [*keys, "chapter_id"], "left")
    action = F.col("kind") == "action_result"
    anchor = F.coalesce("anchor_t", F.when(action, F.coalesce("action_end", "first_end")), (F.col("s") + F.col("e")) / 2)
    top = F.col("c1") - 0.001
    clamp = lambda v: F.greatest("c0", F.least(v, top))
    x = x.withColumn("anchor_t", clamp(anchor))
    lo = F.coalesce("lo", F.when(action, F.col("anchor_t") - 0.15).otherwise(F.col("s") - 0.25))
    hi = F.coalesce("hi", F.when(action, F.col("anchor_t") + 2.5).otherwise(F.col("e") + 0.75))
    x = x.withColumn("lo", clamp(lo)).withColumn("hi", clamp(hi))
    return x.withColumn("hi", F.greatest("hi", F.col("lo") + 0.05)).select(*targets.columns)


def visual_windows(chapters: DataFrame, keys: list[str], gap: float = 0.5) -> DataFrame:
    """Merged stretches of the chapters that need pictures."""
    return merge_intervals(chapters.filter("needs_frames"), keys, gap)


def coverage_points(chapters: DataFrame, covered: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """(keys, chapter_id, t, reason): sample times of chapters that need pictures and have no target yet: the middle, then the quarters; and half a second before the end of the last one."""
    need = chapters.filter("needs_frames")
    open_ = need.join(covered.select(*keys, "chapter_id").distinct(), [*keys, "chapter_id"], "left_anti")
    at = F.array(*[F.round(F.col("start") + (F.col("end") - F.col("start")) * f, 3) for f in ((0.5,) if least <= 1 else (0.5, 0.25, 0.75)[:least])])
    points = open_.select(*keys, "chapter_id", F.explode(at).alias("t"), F.lit("coverage").alias("reason"))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("start"))) == 1
    final = chapters.withColumn("last", last).filter("last AND needs_frames").select(*keys, "chapter_id", F.round(F.col("end") - 0.5, 3).alias("t"), F.lit("final").alias("reason"))
    return points.unionByName(final)


def state_points(states: DataFrame, chapters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state_id, t, reason, stage): one point a state of a chapter that needs pictures (mode A only with a target), and the first settled row of a build that has a target and settles 2 s before its representative."""
    s = states.join(chapters.filter("needs_frames").select(*keys, "chapter_id"), [*keys, "chapter_id"])
    some = F.size("target_ids") > 0
    s = s.filter((F.col("mode") != "A") | some).withColumn("reason", F.when(some, "target").otherwise("state"))
    main = s.select(*keys, "state_id", F.col("representative_t").alias("t"), "reason", F.lit("main").alias("stage"))
    first = s.filter(F.col("is_build") & some & (F.col("first_settled") < F.col("representative_t") - 2)).select(*keys, "state_id", F.col("first_settled").alias("t"), F.lit("target").alias("reason"), F.lit("first").alias("stage"))
    return main.unionByName(first)


def selection_evidence(selected: DataFrame, candidates: DataFrame, assets: DataFrame, chapters: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Each selection (id, chapter_id, anchors) with its candidate's time (t), its asset's (actual_t), faults, and the first block of its chapter that cites one of its anchors.

    Faults: unknown candidate, missing asset, a time outside its chapter.
    """
    c = candidates.select(*keys, "id", "t", F.lit(True).alias("known"))
    a = assets.select(*keys, "id", "actual_t")
    ch = chapters.select(*keys, "chapter_id", "start", "end")
    x = selected.join(c, [*keys, "id"], "left").join(a, [*keys, "id"], "left").join(ch, [*keys, "chapter_id"], "left")
    inside = lambda t: C.within(t, F.col("start"), F.col("end"))
    fault = F.array_compact(
        F.array(
            F.when(F.col("known").isNull(), "unknown candidate"),
            F.when(F.col("actual_t").isNull(), "missing asset"),
            F.when(F.coalesce(~inside(F.col("t")) | ~inside(F.col("actual_t")), F.lit(False)), "another chapter"),
        )
    )
    b = selected.select(*keys, "id", "chapter_id", "anchors").join(blocks.select(*keys, "chapter_id", "block_no", "seg_ids"), [*keys, "chapter_id"])
    first = b.filter(F.arrays_overlap("anchors", "seg_ids")).groupBy(*keys, "id").agg(F.min("block_no").alias("block_no"))
    return x.withColumn("faults", fault).join(first, [*keys, "id"], "left").select(*keys, "id", "chapter_id", "t", "actual_t", "faults", "block_no")


def normalised_summary(summary: DataFrame, chapters: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Every chapter with its summary's title (its own where it has none), and the chapters without a summary."""
    x = chapters.join(summary.select(*keys, "chapter_id", F.col("title").alias("own_title"), F.lit(True).alias("there")), [*keys, "chapter_id"], "left")
    full = x.withColumn("title", F.coalesce(F.when(F.trim("own_title") != "", F.col("own_title")), F.col("title"))).drop("own_title", "there")
    return full, x.filter("there IS NULL").select(*keys, "chapter_id")


def refinement_windows(selected: DataFrame, keys: list[str], around: float = 1.5, margin: float = 0.25, least: float = 0.1) -> DataFrame:
    """``selected`` (t, part_start, part_end, start, end) plus lo, hi: where a sharper frame may be looked for, null if too short."""
    lo = F.greatest(F.col("t") - around, F.col("part_start"), F.col("start"))
    hi = F.least(F.col("t") + around, F.col("part_end"), F.col("end") - margin)
    fits = hi - lo >= least
    return selected.withColumn("lo", F.when(fits, lo)).withColumn("hi", F.when(fits, hi))


def ocr_budget(clusters: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Clusters of slides and diagrams, in order, while their rows fit into 2 * ``cap``."""
    wanted = clusters.filter(F.arrays_overlap("kinds", F.array(F.lit("slide"), F.lit("diagram"))))
    used = F.sum("n").over(Window.partitionBy(*keys).orderBy("cluster").rowsBetween(Window.unboundedPreceding, 0))
    return wanted.withColumn("used", used).filter(F.col("used") <= 2 * cap)


def cached_parts(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cache_key, status): hit where the cache has the key with the hash of the file there is, stale where the hash differs, else miss."""
    x = wanted.join(cache.select(*keys, "cache_key", F.col("sha256").alias("stored")), [*keys, "cache_key"], "left")
    return x.select(*keys, "cache_key", F.when(F.col("stored").isNull(), "miss").when(F.col("stored").eqNullSafe(F.col("sha256")), "hit").otherwise("stale").alias("status"))


def selections_binding(selected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sha256) of what of the selections decides pixels: id, name and crop, in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("id", "name", "crop").alias("x")))), lambda r: r["x"])
    return selected.groupBy(*keys).agg(F.sha2(F.to_json(rows, {"ignoreNullFields": "false"}), 256).alias("sha256"))


def source_matches(recorded: Column, expected: Column) -> Column:
    """Whether two sources (addresses or paths) are the same; true where either is unknown."""
    from tidemark.functions.text import canonical_url

    return F.coalesce(canonical_url(recorded) == canonical_url(expected), F.lit(True))


def asset_checks(assets: DataFrame, files: DataFrame, keys: list[str], limits: tuple[float, float, float]) -> DataFrame:
    """``assets`` (file, sha256, luma_mad, edge_mad, changed_ratio) plus faults: missing file, other hash, picture too far from the one selected."""
    f = files.select(*keys, "file", F.col("sha256").alias("real"))
    far = (F.col("luma_mad") > limits[0]) | (F.col("edge_mad") > limits[1]) | (F.col("changed_ratio") > limits[2])
    faults = F.array_compact(F.array(F.when(F.col("real").isNull(), "missing"), F.when(F.col("real") != F.col("sha256"), "hash"), F.when(far, "picture")))
    return assets.join(f, [*keys, "file"], "left").withColumn("faults", faults).drop("real")


def retry_plan(attempts: DataFrame, keys: list[str], most: int = 3, longest: float = 60.0) -> DataFrame:
    """(keys, attempts, outcome, next_retry_at) of a log (at, category, retryable, wait): done, retry, deferred or failed."""
    last = attempts.groupBy(*keys).agg(F.count("*").alias("attempts"), F.max_by(F.struct("category", "retryable", "wait", "at"), "at").alias("x"))
    wait = F.coalesce("x.wait", F.pow(F.lit(2.0), F.col("attempts")))
    again = F.coalesce("x.retryable", F.lit(False))
    outcome = F.when(F.col("x.category").isNull(), "done").when(~again, "failed").when((F.col("attempts") >= most) | (wait > longest), "deferred").otherwise("retry")
    return last.select(*keys, "attempts", outcome.alias("outcome"), F.when(F.col("x.category").isNotNull() & again, F.col("x.at") + wait).alias("next_retry_at"))
