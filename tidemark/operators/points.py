"""Points: streams of them united, and each placed in its chapter with targets, segments and a priority; small look-ups beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import containing_first, containing_or_nearest, meet

#: The priority of each reason; others have 0.
PRIORITY = {"target": 100, "cue": 90, "pin": 80, "coverage": 70, "state": 50, "scene": 40, "final": 20}


def union_points(streams: list[DataFrame]) -> DataFrame:
    """Streams of points as one, in the order given (``stream``); columns that a stream lacks are null."""
    named = [s.withColumn("stream", F.lit(i)) for i, s in enumerate(streams)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def priority(reason: Column) -> Column:
    out = F.lit(0)
    for name, value in PRIORITY.items():
        out = F.when(reason == name, value).otherwise(out)
    return out


def make_points(points: DataFrame, chapters: DataFrame, targets: DataFrame, segments: DataFrame, keys: list[str], slack: float = 0.05, width: float | None = None) -> DataFrame:
    """(keys, point_id, requested_t, reason, chapter_id, target_ids, target_kinds, seg_ids, scene_score, priority) for every row of ``points``.

    ``points`` has point_id, t, reason, scene_score (null counts 0); ``chapters`` span_id, start,
    end; ``targets`` target_id, chapter_id, kind, lo, hi, seg_ids; ``segments`` span_id, pos, start,
    end. A point has the targets of its chapter whose window, widened by ``slack``, holds it, and
    their segments; without any, the segments that hold it or the nearest one. Arrays are sorted.
    """
    p = containing_first(points.select(*keys, "point_id", "t", "reason", "scene_score"), chapters, keys, "point_id", width=width).withColumnRenamed("span_id", "chapter_id")
    t = targets.select(*keys, F.col("chapter_id").alias("own_"), "target_id", "kind", "lo", "hi", F.col("seg_ids").alias("cited_"))
    met = meet(p.select(*keys, "point_id", "t", "chapter_id"), t, keys, (F.col("t"), F.col("t")), (F.col("lo") - slack, F.col("hi") + slack), width)
    met = met.filter(F.col("t").between(F.col("lo") - slack, F.col("hi") + slack) & (F.col("own_") == F.col("chapter_id")))
    unique = lambda c: F.array_sort(F.collect_set(c))
    aimed = met.groupBy(*keys, "point_id").agg(unique("target_id").alias("target_ids"), unique("kind").alias("target_kinds"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cited_")))).alias("cited_"))
    near = containing_or_nearest(points.select(*keys, "point_id", "t"), segments, keys, "point_id", width=width).select(*keys, "point_id", F.array_sort("span_ids").alias("near_"))
    out = p.join(aimed, [*keys, "point_id"], "left").join(near, [*keys, "point_id"], "left")
    kinds = {c: t for c, t in out.dtypes}
    none = lambda c: F.coalesce(c, F.array().cast(kinds[c]))
    cited = F.when(F.size(none("cited_")) > 0, F.col("cited_")).otherwise(none("near_"))
    return out.select(*keys, "point_id", F.round("t", 3).alias("requested_t"), "reason", "chapter_id", none("target_ids").alias("target_ids"), none("target_kinds").alias("target_kinds"), cited.alias("seg_ids"), F.coalesce("scene_score", F.lit(0.0)).alias("scene_score"), priority(F.col("reason")).alias("priority"))


def span_chapters(spans: DataFrame, chapters: DataFrame, keys: list[str], span_id: str, width: float | None = None) -> DataFrame:
    """``spans`` (start, end) plus chapter_ids: the chapters (chapter_id, pos, start, end) that overlap each, in their order; none: empty."""
    c = chapters.select(*keys, "chapter_id", F.col("pos").alias("pos_"), F.col("start").alias("s_"), F.col("end").alias("e_"))
    met = meet(spans.select(*keys, span_id, "start", "end"), c, keys, (F.col("start"), F.col("end")), (F.col("s_"), F.col("e_")), width).filter((F.col("s_") < F.col("end")) & (F.col("e_") > F.col("start")))
    ids = met.groupBy(*keys, span_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos_", "chapter_id"))), lambda x: x["chapter_id"]).alias("chapter_ids"))
    return spans.join(ids, [*keys, span_id], "left").withColumn("chapter_ids", F.coalesce("chapter_ids", F.array().cast(dict(ids.dtypes)["chapter_ids"])))


def worst_by_metric(rows: DataFrame, keys: list[str], limits: dict[str, str]) -> DataFrame:
    """(keys, metric, worst, failed): the largest value of each metric (0 at least) and how many rows exceed their own limit; ``limits`` names each metric's limit column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.col(x).cast("double").alias("limit")) for m, x in limits.items()]))
    one = rows.select(*keys, pairs.alias("m")).select(*keys, "m.*").filter(F.col("value").isNotNull())
    return one.groupBy(*keys, "metric").agg(F.greatest(F.lit(0.0), F.max("value")).alias("worst"), F.count_if(F.col("value") > F.col("limit")).alias("failed"))


def first_seen(rows: DataFrame, keys: list[str], same: list[str], order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each value of ``same`` within the keys."""
    rn = F.row_number().over(Window.partitionBy(*keys, *same).orderBy(*order))
    return rows.withColumn("rn_", rn).filter("rn_ = 1").drop("rn_")


def id_sets(left: Column, right: Column) -> Column:
    """either, both, only_left and whether there is any common id; sorted arrays."""
    return F.struct(F.array_sort(F.array_union(left, right)).alias("either"), F.array_sort(F.array_intersect(left, right)).alias("both"), F.array_sort(F.array_except(left, right)).alias("only_left"), F.arrays_overlap(left, right).alias("any"))


def distinct_ids(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, ids, n): the sorted distinct values that are not null, and their number."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias("ids"), F.countDistinct(name).alias("n"))


def public_quality(statistics: Column, digest: Column, faces: Column | None = None, text_chars: Column | None = None, ocr_text: Column | None = None) -> Column:
    """What of a signature's statistics is shown: mean_luma, contrast, sharpness, blank, fingerprint, and what else was measured; nulls where it was not."""
    shown = [F.coalesce(statistics["mean"], F.lit(0.0)).alias("mean_luma"), F.coalesce(statistics["contrast"], F.lit(0.0)).alias("contrast"), F.coalesce(statistics["sharpness"], F.lit(0.0)).alias("sharpness"), F.coalesce(statistics["blank"], F.lit(False)).alias("blank"), F.coalesce(digest, F.lit("")).alias("fingerprint")]
    more = {"faces": faces, "text_chars": None if text_chars is None else text_chars.cast("int"), "ocr_text": None if ocr_text is None else F.when(ocr_text != "", ocr_text)}
    return F.struct(*shown, *[c.alias(n) for n, c in more.items() if c is not None])


def strip_private(rows: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` without columns whose name starts with "_" and without those named."""
    return rows.drop(*[c for c in rows.columns if c.startswith("_") or c in also])


def zipped(first: Column, second: Column, names: tuple[str, str]) -> Column:
    """Two arrays side by side, as far as both reach."""
    n = F.least(F.size(first), F.size(second))
    return F.when(n > 0, F.arrays_zip(F.slice(first, F.lit(1), n).alias(names[0]), F.slice(second, F.lit(1), n).alias(names[1])))


def entries(manifest: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """The rows of a manifest with the wanted ids, all where none are named; ids that it lacks are an error."""
    if not ids:
        return manifest
    wanted = sorted(set(ids))
    chosen = manifest.filter(F.col("id").isin(wanted))
    missing = sorted(set(wanted) - {r.id for r in chosen.select("id").distinct().collect()})  # at most as many as were asked for
    if missing:
        raise ValueError(f"unknown ids: {missing}")
    return chosen


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file that ``path`` names."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
