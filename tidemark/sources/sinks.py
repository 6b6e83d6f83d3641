"""Sinks: tables, manifests, logs and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.clock import format_clock


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet through Spark's commit protocol: a table appears whole or not at all."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def manifest(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One JSON document a key: its rows as an array, in the order of pos."""
    rest = [c for c in df.columns if c not in keys]
    rows = F.array_sort(F.collect_list(F.struct("pos", F.struct(*rest).alias("row"))))
    return df.groupBy(*keys).agg(F.to_json(F.struct(*keys, F.transform(rows, lambda x: x["row"]).alias(name))).alias("document"))


def empty_manifest(spark, schema: T.StructType) -> DataFrame:
    """No rows in full shape."""
    return spark.createDataFrame([], schema)


def transcript_lines(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): a line a segment, seg_id [mm:ss-mm:ss] text."""
    line = F.concat(F.col("seg_id"), F.lit(" ["), format_clock(F.col("start")), F.lit("-"), format_clock(F.col("end")), F.lit("] "), F.col("text"))
    return segments.select(*keys, "pos", line.alias("value"))


def append_operations(rows: DataFrame, path: str) -> None:
    """Appends to the operation log; only the columns it knows are written."""
    from tidemark.sources.logs import OPERATION

    known = [f.name for f in OPERATION.fields if f.name in rows.columns]
    rows.select(*known).write.mode("append").json(path)


def markdown_table(df: DataFrame) -> DataFrame:
    """(value): a Markdown row for each row, in column order; callers sort and write it as text."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("–")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def block_html(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, html): the paragraphs and code blocks of a chapter in order, escaped."""
    from tidemark.functions.text import inline_markup

    one = F.when(F.col("kind") == "code", F.concat(F.lit("<pre>"), inline_markup(F.col("text")), F.lit("</pre>"))).otherwise(F.concat(F.lit("<p>"), inline_markup(F.col("text")), F.lit("</p>")))
    rows = F.array_sort(F.collect_list(F.struct("block_no", one.alias("html"))))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["html"]), "\n").alias("html"))
