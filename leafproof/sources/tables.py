"""The page table and the answer cache as tables of fixed schema: created once, written by document, never doubled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_SCHEMA = (
    "page_id string, doc_id string, revision string, page_no int, is_current boolean, has_text boolean, text string, text_trust string, lang string, "
    "codes array<string>, printed_label string, section string, summary string"
)
CACHE_SCHEMA = "key string, body string, at timestamp"


class DuplicatePage(ValueError):
    """A batch holds a page twice."""


def create(spark: SparkSession, name: str, schema: str = PAGE_SCHEMA, partition: str | None = "doc_id", replace: bool = False) -> None:
    """An empty table; one that is there stays as it is, unless it is to be replaced."""
    if replace:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    by = f" PARTITIONED BY ({partition})" if partition else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{by}")


def upsert(pages: DataFrame, name: str) -> None:
    """Write the pages of whole documents: each document's partition is replaced, others stay, so a second run doubles
    nothing. Pages that are there twice, or that have no id, are refused before anything is written."""
    twice = pages.groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1 or page_id is null")
    bad = [r.page_id for r in twice.limit(5).collect()]
    if bad:
        raise DuplicatePage(", ".join(map(str, bad)))
    spark = pages.sparkSession
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        pages.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def put(entries: DataFrame, name: str) -> None:
    """Append answers (key, body, at) to a cache table."""
    entries.select(*spark_columns(entries.sparkSession, name)).write.insertInto(name)


def spark_columns(spark: SparkSession, name: str) -> list[str]:
    return spark.table(name).columns


def get(asked: DataFrame, name: str) -> DataFrame:
    """asked (key) with the first body that was stored for it, null if there is none: an answer once given stays."""
    known = asked.sparkSession.table(name)
    first = known.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("at", "body"))).filter("n = 1").select("key", "body")
    return asked.join(first, "key", "left")
