"""Files as pages: a scan of a document store, with the content hash of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafproof.functions import text as T
from leafproof.sources.store import listed


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row for each page of each file `<doc_id>@<revision>.<ext>`: doc_id, revision, page_no, text, sha256.

    Pages are parted by form feeds, as text extractors write them. Bytes that are no UTF-8 become replacement
    characters; an empty file has no page. Files are listed and read by Spark, in any store.
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    named = f.select(F.substring_index(stem, "@", 1).alias("doc_id"), F.regexp_extract(stem, "@(.+)$", 1).alias("revision"), F.sha2("content", 256).alias("sha256"), F.col("content").cast("string").alias("body"))
    pages = named.select("doc_id", "revision", "sha256", F.posexplode(F.split("body", "\f")).alias("at", "text"))
    return pages.select("doc_id", "revision", (F.col("at") + 1).alias("page_no"), "text", "sha256", T.page_id(F.col("doc_id"), F.col("revision"), F.col("at") + 1).alias("page_id"))


#: Bytes of an upload, and how it begins.
MOST_BYTES, MAGIC = 256 * 1024 * 1024, b"%PDF-"


def check_uploads(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """path, size, error: empty_upload, upload_too_large, not_a_pdf, or null. Only the first bytes of a file are judged,
    not what its name claims."""
    f = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, len(MAGIC)).alias("head"))
    spool = spark.createDataFrame([(p, n) for p, n, _ in listed(spark, path)], "path string, size long")  # the scan skips empty files
    error = F.when(F.col("size") == 0, "empty_upload").when(F.col("size") > most, "upload_too_large").when(F.col("head") != F.lit(MAGIC), "not_a_pdf")
    return spool.join(f, "path", "left").select("path", "size", error.alias("error"))


def spool_name(filename: str, run_id: str) -> str:
    """A file's own name, of the characters that names may have, else the run's."""
    import re
    from pathlib import PurePosixPath

    stem = re.sub(r"[^A-Za-z0-9._+-]+", "-", PurePosixPath(filename or "").stem).strip("-.")
    return f"{stem or run_id}.pdf"


def fixture(spark: SparkSession, path: str) -> DataFrame:
    """Hand-written pages, one JSON file each beside a document.json of their document's fields, as page rows. A page's
    own fields come first; a revision other than the document's is not current; text and trust follow the text."""
    doc = spark.read.json(f"{path}/document.json", multiLine=True).first().asDict()
    schema = "page_no int, section string, page_kind string, text string, codes array<string>, topics array<string>, summary string, is_current boolean, revision string, has_text boolean, text_trust string"
    p = spark.read.schema(schema).json(f"{path}/page-*.json", multiLine=True)
    revision = F.coalesce("revision", F.lit(doc["revision"]))
    has = F.coalesce("has_text", F.coalesce(F.trim("text"), F.lit("")) != "")
    p = p.select(
        F.lit(doc["doc_id"]).alias("doc_id"), revision.alias("revision"), "page_no", "section", "page_kind", F.coalesce("text", F.lit("")).alias("text"), "codes", "topics", "summary",
        F.coalesce("is_current", revision == doc["revision"]).alias("is_current"), has.alias("has_text"), F.coalesce("text_trust", F.when(has, "ok").otherwise("no_text")).alias("text_trust"),
    )
    return p.withColumn("page_id", T.page_id(F.col("doc_id"), F.col("revision"), F.col("page_no"))).withColumn("norm", T.normal(F.col("text")))
