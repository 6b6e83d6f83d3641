"""Caption files and caption tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import cue_seconds
from tidemark.functions.text import language

_TIMES = r"(\d{2}:\d{2}:\d{2}[.,]\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}[.,]\d{3})"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files as bytes; nothing is decoded yet."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def decoded(files: DataFrame) -> DataFrame:
    """``files`` (content BINARY) plus text and fault: empty_response, malformed_response (not UTF-8, or no WEBVTT at the start) or null; text is null with a fault."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    plain = F.regexp_replace(text, "^\\uFEFF", "")
    fault = F.when(F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "empty_response").when(plain.isNull() | ~F.startswith(plain, F.lit("WEBVTT")), "malformed_response")
    return files.withColumn("fault", fault).withColumn("text", F.when(F.col("fault").isNull(), plain))


def cues(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, start, end, text) of the cues of caption texts: lines of a cue joined, tags stripped, empty cues left out, times to 2 places."""
    block = F.posexplode(F.split(F.regexp_replace("text", "\\r\\n?", "\n"), "\\n[ \\t]*\\n+")).alias("block_no", "block")
    b = files.filter("text IS NOT NULL").select(*keys, block)
    b = b.withColumn("a", F.regexp_extract("block", _TIMES, 1)).withColumn("z", F.regexp_extract("block", _TIMES, 2)).filter("a != ''")
    lines = F.split(F.regexp_replace("block", "(?s)^.*?" + _TIMES + "[^\\n]*\\n?", ""), "\\n")
    text = F.array_join(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))), lambda x: x != ""), " ")
    text = F.trim(F.regexp_replace(F.replace(F.replace(F.replace(F.replace(text, F.lit("&nbsp;"), F.lit(" ")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")), r"\s+", " "))
    out = b.select(*keys, "block_no", F.round(cue_seconds(F.col("a")), 2).alias("start"), F.round(cue_seconds(F.col("z")), 2).alias("end"), text.alias("text")).filter("text != ''")
    return out.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("block_no")) - 1).select(*keys, "pos", "start", "end", "text")


def numbered(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments in the order of (start, end) with ids seg_0000, ... and whether that changed their order."""
    by = Window.partitionBy(*keys).orderBy("start", "end", "pos")
    s = segments.withColumn("n", F.row_number().over(by) - 1).withColumn("input_", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1)
    moved = F.max(F.col("n") != F.col("input_")).over(Window.partitionBy(*keys))
    return s.withColumn("seg_id", F.format_string("seg_%04d", "n")).withColumn("reordered", moved).withColumn("pos", F.col("n")).drop("n", "input_")


def tracks(info: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, key, entries) from maps of manual and automatic tracks."""
    one = lambda c, k: info.select(*keys, "language", F.lit(k).alias("kind"), F.explode(c).alias("key", "entries"))
    return one("subtitles", "manual").unionByName(one("automatic_captions", "auto"))


def rank_tracks(found: DataFrame, keys: list[str], wanted: tuple[str, ...] = ("he", "en")) -> DataFrame:
    """``found`` (kind, key, language, translated) plus base, original, score and rank; translated tracks are left out.

    Scores: 0 manual in the recording's language, 1 manual in a wanted one, 2 automatic in the
    original (key ends with -orig, or its language), 3 automatic in a wanted one, 4 other
    manual, 5 other automatic. Ties: the order of wanted languages, -orig first, the key.
    """
    orig = language(F.col("language"))
    suffix = F.endswith(F.col("key"), F.lit("-orig"))
    base = language(F.regexp_replace("key", "-orig$", ""))
    place = F.array_position(F.array(*[F.lit(w) for w in wanted]), base)
    rows = found.filter(~F.col("translated")).withColumn("base", base).withColumn("place", F.when(place > 0, place - 1).otherwise(len(wanted)))
    own = F.coalesce(F.col("base") == orig, F.lit(False))
    liked = F.col("place") < len(wanted)
    score = F.when(F.col("kind") == "manual", F.when(own, 0).when(liked, 1).otherwise(4)).otherwise(F.when(suffix | own, 2).when(liked, 3).otherwise(5))
    rows = rows.withColumn("original", suffix | own).withColumn("score", score)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("score", "place", F.when(suffix, 0).otherwise(1), "key")))


def is_translated(entries: Column) -> Column:
    """Whether any address of a track asks for a translation."""
    return F.exists(entries, lambda e: F.contains(F.coalesce(e["url"], F.lit("")), F.lit("tlang=")))
