"""Grounding, trust and document health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafproof.functions import text as T

OK, DEGRADED = 0.8, 0.2


def folded(codes: Column) -> Column:
    """Lower-cased codes with single spaces, each once."""
    return F.array_distinct(F.transform(codes, lambda k: F.lower(F.trim(F.regexp_replace(k, r"\s+", " ")))))


def backed(codes: Column, norm: Column) -> Column:
    """The codes that the text prints: lower-cased, distinct, sorted."""
    return F.array_sort(F.filter(folded(codes), lambda k: T.printed(norm, k)))


def grounded_rate(codes: Column, norm: Column, has_text: Column) -> Column:
    """Null without text; 1 without codes; else the share of distinct codes printed."""
    return F.when(~has_text, None).when(F.size(codes) == 0, 1.0).otherwise(F.size(backed(codes, norm)) / F.size(folded(codes)))


def band(rate: Column) -> Column:
    """Trust of a page that has text: a null rate is degraded."""
    return F.when(rate >= OK, "ok").when(rate.isNull() | (rate >= DEGRADED), "degraded").otherwise("untrusted")


def rated(forms: DataFrame) -> DataFrame:
    return forms.withColumn("rate", grounded_rate(F.col("codes"), F.col("norm"), F.col("has_text")))


def documents(forms: DataFrame) -> DataFrame:
    """Per (doc_id, revision): pages, with_text, ratio, median (of rates that are there), trust, fully_scanned, collapsed."""
    g = rated(forms).groupBy("doc_id", "revision").agg(F.count("*").alias("pages"), F.count_if(F.expr("has_text")).alias("with_text"), F.median("rate").alias("median"))
    trust = F.when(F.col("with_text") == 0, "no_text").otherwise(band(F.col("median")))
    return g.select("*", (F.col("with_text") / F.col("pages")).alias("ratio"), trust.alias("trust"), (F.col("with_text") == 0).alias("fully_scanned"), F.coalesce(F.col("median") < DEGRADED, F.lit(False)).alias("collapsed"))


def page_trust(forms: DataFrame) -> DataFrame:
    """Pages with their trust; an untrusted document demotes each of its pages that has text. The documents' rows are
    joined, so their size decides how."""
    d = documents(forms).select("doc_id", "revision", F.col("trust").alias("doc_trust"))
    own = F.when(~F.col("has_text"), "no_text").when(F.col("doc_trust") == "untrusted", "untrusted").otherwise(band(F.col("rate")))
    return rated(forms).join(d, ["doc_id", "revision"]).withColumn("trust", own)
