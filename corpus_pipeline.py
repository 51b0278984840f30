"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's docs.

What holds for every stage: docs has doc_id and text, and any other columns, which all but the last stage return as they
are, whatever their names. Null ids and ids that several rows share are no reason to lose a row. A null text counts as
empty. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafproof.llm import bpe, common, decontam, neardup, quality, toxicity

JUDGED = common.ROW


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on the labelled ones, does not reject.

    Empty texts get the lowest score and stay. Repeated rows have one score. Without labels nothing is rejected, as the
    score is then the smoothed share of toxic labels.
    """
    common.prepare(spark)
    model = toxicity.learn(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, JUDGED).filter(F.col(JUDGED) < 0.5).drop(JUDGED)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and the compression bands. Empty texts have too few words and go; repeated
    rows are judged alike."""
    common.prepare(spark)
    return quality.judge(docs, out=JUDGED).filter(F.col(JUDGED)["kept"]).drop(JUDGED)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one with the least doc_id, null ids last.

    Rows that share doc_id and text are one document; rows that share only one of them are told apart by both. Texts
    without words resemble nothing and stay.
    """
    common.prepare(spark)
    return neardup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Empty texts hold none and stay; repeated rows go or stay alike; without
    items all stay."""
    common.prepare(spark)
    return decontam.remove_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document that is left: doc_id, n_tokens, ids (little-endian unsigned 32-bit). A row for each
    row; empty texts have no ids."""
    common.prepare(spark)
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: Fitted, compressed and tokenised decisions are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each keeps is written to the shared folder for the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
