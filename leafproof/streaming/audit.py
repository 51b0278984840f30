"""The audit log as a stream: budgets for each user and UTC day, late lines included up to the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """JSON lines of the audit folder as they arrive, at most `files` new files a batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(path)


def spent(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """user_id, period, spent: paid calls in each day; a day's state is dropped once the watermark has passed it."""
    paid = events.filter("event_type = 'purchase'").withWatermark("ts", late)
    return paid.groupBy(F.window("ts", "1 day").alias("day"), "user_id").agg(F.count("*").alias("spent")).select("user_id", F.date_format("day.start", "yyyy-MM-dd").alias("period"), "spent")


#: The ten fields of a line, and nothing else. Only paid and material tools are audited.
LINE = "user_id string, run_id string, session_id string, tool string, page_ids array<string>, dpi int, input_tokens int, output_tokens int, cache_hit boolean, latency_ms int"
AUDITED = ("read", "fetch")


def lines(calls: DataFrame) -> DataFrame:
    """Audit lines of calls: the ten fields in order, with their defaults; other columns are left out."""
    names = [x.split()[0] for x in LINE.split(", ")]
    defaults = {"run_id": F.lit(""), "session_id": F.lit(""), "page_ids": F.array().cast("array<string>"), "dpi": F.lit(0), "input_tokens": F.lit(0), "output_tokens": F.lit(0), "cache_hit": F.lit(False), "latency_ms": F.lit(0)}
    cell = lambda n: (F.coalesce(n, defaults[n]) if n in defaults else F.col(n)) if n in calls.columns else defaults[n]
    return calls.filter(F.col("tool").isin(*AUDITED)).select(*[cell(n).alias(n) for n in names])


def sink(calls: DataFrame, path: str, checkpoint: str):
    """Append the lines of a stream of calls as JSON, each once; ends when the input is read."""
    return lines(calls).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
