"""Extensions for streams: cases from a folder as they arrive, and runs of events as session windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gambrel.sources.drawings import PLAN


def watch_plans(spark: SparkSession, folder: str, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Run a batch function over every batch of new plan files; with ``once`` over all that are there, then stop."""
    plans = spark.readStream.schema(PLAN).option("multiLine", True).json(folder)
    named = plans.withColumn("graph", F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1), r"\.json$", "")).withColumn("status", F.lit("ok"))
    writer = named.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_runs(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of each user's events closed by a gap, for streams and batches alike: (user_id, start, stop, n)."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    w = marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
