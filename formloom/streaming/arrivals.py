"""Landmark sets as they arrive. The batch engine has no notion of time; this follows a folder, and no more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from formloom.sources.landmarks import markups_points


def landmark_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of landmarks of markups files that appear in a folder, as the batch reader has them."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return markups_points(raw.select(F.col("_metadata.file_path").alias("path"), "value"))


def running_mean(stream: DataFrame, name: str) -> StreamingQuery:
    """The mean landmarks of all that has arrived, as a table in memory; its state is one row for each landmark."""
    return stream.groupBy("lm_id").agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName(name).start()
