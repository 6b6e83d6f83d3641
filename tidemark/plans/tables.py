"""The driver's tables as timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where events' seconds begin.
EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id (the recording), pos, t (seconds), kind, value."""
    t = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{EPOCH}', ts)") / F.lit(1e6)
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), t.alias("t"), F.col("event_type").alias("kind"), "value")


#: The same in DuckDB.
EVENTS = "ev AS (SELECT user_id, event_id AS pos, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, event_type AS kind, value FROM events)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of value * 360 seconds, with the recording's length."""
    return events(spark, sf_dir).select("user_id", "pos", F.col("t").alias("start"), (F.col("t") + F.col("value") * 360).alias("end"), F.col("kind").alias("text"), F.lit(2592000.0).alias("duration"))


SEGMENTS = EVENTS + ", sg AS (SELECT user_id, pos, t AS start, t + value * 360 AS \"end\", kind AS text, 2592000.0::DOUBLE AS duration FROM ev)"


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days a chapter for every recording; every other one needs pictures."""
    users = events(spark, sf_dir).select("user_id").distinct()
    c = users.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return c.select("user_id", F.concat(F.lit("c"), F.col("n").cast("string")).alias("span_id"), F.col("n").alias("pos"), (F.col("n") * 259200.0).cast("double").alias("start"), ((F.col("n") + 1) * 259200.0).cast("double").alias("end"), (F.col("n") % 2 == 0).alias("needs_frames"))


CHAPTERS = EVENTS + ", ch AS (SELECT user_id, 'c' || n AS span_id, n::INT AS pos, (n * 259200.0)::DOUBLE AS start, ((n + 1) * 259200.0)::DOUBLE AS \"end\", n % 2 = 0 AS needs_frames FROM (SELECT DISTINCT user_id FROM ev), range(0, 10) r(n))"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, so that the order of sums does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
