"""Views of the event and embedding tables in the engine's packet, frame and audio schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Streams of the packet view, in index order, with their media.
STREAMS = [("click", "V"), ("error", "A"), ("purchase", "A"), ("signup", "A"), ("view", "V")]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """One stream per event type, in order of event_id."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return read(spark, folder, "events").select(
        F.col("event_type").alias("stream_id"),
        F.col("event_id").alias("seq"),
        us.alias("arrival_us"),
        us.alias("pts_us"),
        us.alias("dts_us"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("size"),
        (F.col("event_id") % 10 == 0).alias("is_key"),
        F.when(F.col("event_type").isin("view", "click"), "V").otherwise("A").alias("media"),
        "user_id",
        "value",
    )


def reordered(spark: SparkSession, folder: str) -> DataFrame:
    """Packets of which every seventh is two hours late, in milliseconds."""
    ms = F.expr("pts_us div 1000")
    return packets(spark, folder).withColumn("dts_ms", ms - F.when(F.col("seq") % 7 == 0, 7_200_000).otherwise(0)).withColumn("pts_ms", ms)


def with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Packets with missing timestamps."""
    p = packets(spark, folder)
    return p.withColumn("pts_us", F.when(F.col("seq") % 5 != 0, F.col("pts_us"))).withColumn("dts_us", F.when(F.col("seq") % 10 >= 5, F.col("dts_us")))


def video(spark: SparkSession, folder: str) -> DataFrame:
    """Frames whose size changes with seq."""
    p = packets(spark, folder).where("media = 'V'")
    return p.select("stream_id", "seq", "arrival_us", "pts_us", (1280 + F.col("seq") % 3 * 320).alias("width"), (720 + F.col("seq") % 3 * 180).alias("height"), F.lit("yuv420p").alias("pix_fmt"), "is_key")


def audio(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of 64 samples at 48 kHz in two channels, one stream per label."""
    e = read(spark, folder, "embeddings")
    return e.select(
        F.col("label").cast("string").alias("stream_id"),
        F.col("vec_id").alias("seq"),
        (F.col("vec_id") % 2).alias("channel"),
        F.expr("(vec_id div 2) * 64 * 1000000 div 48000").alias("pts_us"),
        F.lit(48000).alias("sample_rate"),
        F.lit(64).alias("n_samples"),
        F.expr("transform(embedding, x -> cast(x as double) * 2.2D)").alias("samples"),
    )
