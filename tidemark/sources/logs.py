"""Tool logs, operation logs, speech responses, heat maps, JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATION = T.StructType(
    [
        T.StructField("at", T.DoubleType()),
        T.StructField("operation", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("category", T.StringType()),
        T.StructField("elapsed_s", T.DoubleType()),
        T.StructField("cache_hit", T.BooleanType()),
        T.StructField("tool_invocations", T.IntegerType()),
        T.StructField("api_attempts", T.IntegerType()),
        T.StructField("http_attempts", T.IntegerType()),
    ]
)


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document a file, with ``fault`` invalid_json where it cannot be read as ``schema``."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.withColumn("fault", F.when(F.col("_bad").isNotNull(), "invalid_json")).drop("_bad")


def read_operations(spark: SparkSession, path: str) -> DataFrame:
    """The operation log; lines that are not JSON are left out."""
    return spark.read.schema(OPERATION).option("mode", "DROPMALFORMED").json(path)


def operation_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, operations, cache_hits, tool_invocations, api_attempts, http_attempts, failures)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("operations"), F.count_if(F.coalesce("cache_hit", F.lit(False))).alias("cache_hits"), total("tool_invocations"), total("api_attempts"), total("http_attempts"), F.count("category").alias("failures")
    )


def metadata_series(lines: DataFrame, keys: list[str], key: str) -> DataFrame:
    """(keys, t, value): each time line (pts_time:) with the first later ``key``=value before the next time line; NaN keeps its place, times and values without a partner are left out.

    ``lines`` has line_no and line.
    """
    by = Window.partitionBy(*keys).orderBy("line_no")
    t = F.regexp_extract("line", r"pts_time:\s*(-?[0-9.]+)", 1).try_cast("double")
    v = F.regexp_extract("line", key.replace(".", r"\.") + r"=(\S+)", 1)
    rows = lines.withColumn("t", t).withColumn("v", F.when(v != "", v.try_cast("double")))
    rows = rows.withColumn("group", F.count("t").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.filter("group > 0").groupBy(*keys, "group").agg(F.first("t", ignorenulls=True).alias("t"), F.min_by("v", F.when(F.col("v").isNotNull(), F.col("line_no"))).alias("value"))
    return out.filter("value IS NOT NULL").select(*keys, "t", "value")


def showinfo_times(lines: DataFrame, keys: list[str], tolerance: float = 0.05) -> DataFrame:
    """(keys, t): times of a log (line, lo, hi) within its window, to 3 places."""
    t = F.explode(F.regexp_extract_all("line", F.lit(r"pts_time:([-0-9.]+)"), F.lit(1))).alias("x")
    rows = lines.select(*keys, "lo", "hi", t).withColumn("t", F.col("x").try_cast("double")).filter("t IS NOT NULL")
    return rows.filter(F.col("t").between(F.col("lo") - tolerance, F.col("hi") + tolerance)).select(*keys, F.round("t", 3).alias("t"))


def sampled_times(rows: DataFrame, fps: float) -> DataFrame:
    """``rows`` (pts, start, i) plus t: the time that was read, else the place in the sample grid."""
    return rows.withColumn("t", F.coalesce("pts", F.col("start") + F.col("i") / fps))


def heat_bins(info: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, value) of a heat map in JSON (column ``heatmap``); none for what cannot be read."""
    kind = "array<struct<start_time:double,end_time:double,value:double>>"
    return info.select(*keys, F.explode(F.from_json("heatmap", kind)).alias("b")).select(*keys, F.col("b.start_time").alias("start"), F.col("b.end_time").alias("end"), "b.value")


def speech_segments(responses: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Segments and rejects of speech responses (JSON ``body``, ``offset`` and ``duration`` of the chunk in seconds).

    Segments without finite times, with end <= start, or that end beyond the chunk are
    rejects; blank texts are left out; times get the chunk's offset.
    """
    kind = "struct<segments:array<struct<start:double,end:double,text:string>>>"
    s = responses.select(*keys, "offset", "duration", F.posexplode(F.from_json("body", kind)["segments"]).alias("pos", "s")).select(*keys, "offset", "duration", "pos", "s.*")
    finite = F.col("start").isNotNull() & F.col("end").isNotNull() & ~F.isnan("start") & ~F.isnan("end")
    good = F.coalesce(finite & (F.col("end") > F.col("start")) & (F.col("end") <= F.col("duration") + 1e-6) & (F.col("start") >= 0), F.lit(False))
    text = F.trim(F.coalesce("text", F.lit("")))
    kept = s.filter(good & (text != "")).select(*keys, "pos", F.round(F.col("start") + F.col("offset"), 3).alias("start"), F.round(F.col("end") + F.col("offset"), 3).alias("end"), text.alias("text"))
    return kept, s.filter(~good).select(*keys, "pos", F.lit("untimed or out of range").alias("fault"))


def merge_chunks(kept: DataFrame, incoming: DataFrame, keys: list[str], width: float | None = None) -> DataFrame:
    """``incoming`` (pos, start, end, text, overlap_start, overlap_end) without what ``kept`` has said already.

    In the overlap of two chunks, an incoming segment goes if a kept one overlaps it in time
    and has the same words, or holds its words (two or more) as a run. With a ``width`` the two
    meet in buckets of that many seconds.
    """
    from tidemark.functions.text import tokens
    from tidemark.operators.intervals import meet

    word = lambda c: F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))
    k = kept.select(*keys, F.col("start").alias("s"), F.col("end").alias("e"), word(F.col("text")).alias("said"))
    i = incoming.withColumn("words", word(F.col("text"))).withColumn("n", F.size(tokens(F.col("text"))))
    zone = i.filter((F.col("end") >= F.col("overlap_start")) & (F.col("start") <= F.col("overlap_end")) & (F.col("n") > 0))
    met = meet(zone, k, keys, (F.col("start"), F.col("end")), (F.col("s"), F.col("e")), width).filter((F.col("s") < F.col("end")) & (F.col("e") > F.col("start")) & (F.col("e") >= F.col("overlap_start")) & (F.col("s") <= F.col("overlap_end")))
    same = (F.col("words") == F.col("said")) | ((F.col("n") >= 2) & F.contains("said", F.col("words")))
    gone = met.filter(same).select(*keys, "pos").distinct()
    return incoming.join(gone, [*keys, "pos"], "left_anti")


def with_rejects(rows: DataFrame, reason) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and the others with it as ``reason``: a drop log beside the result."""
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")
