"""No two documents share a row key, whatever their ids hold."""

from pyspark.sql import functions as F

from leafproof.llm import neardup
from leafproof.llm.common import prepare, row_key
from leafproof.llm.resync import keyed

ROWS = [("a", "b|c"), ("a|b", "c"), (None, "x"), ("null", "x"), ("n", "x"), ("", "nx"), ("1:", "x"), ("1", ":x"), ("2:1", ""), (None, ""), ("", ""), (None, None), ("", None)]


def test_row_keys_differ(spark):
    docs = spark.createDataFrame(ROWS, "doc_id string, text string")
    keys = [bytes(r.k) for r in docs.select(row_key().alias("k")).collect()]
    told = {(i, t or "") for i, t in ROWS}  # a null text is an empty one
    assert len(set(keys)) == len(told)
    assert keyed(docs).select("key").distinct().count() == len(told)
    assert spark.createDataFrame([(7, "x"), (None, "x")], "item_id long, text string").select(row_key("item_id").alias("k")).distinct().count() == 2


def test_documents_that_shared_a_key_are_kept_apart(spark):
    prepare(spark)
    docs = spark.createDataFrame([("a", "b|c"), ("a|b", "c"), (None, "one lone text"), ("null", "another lone text")], "doc_id string, text string")
    assert neardup.keep_one(docs).select(F.count("*")).first()[0] == 4
