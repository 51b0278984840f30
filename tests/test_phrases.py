"""The positional index against plain substring search, its layout, and resolving many labels at once."""

import random
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafproof.functions import text as T
from leafproof.operators import exact, phrases
from leafproof.sources import corpus, store
from leafproof.sources.corpus import Corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(5)
    rows = [(n, " ".join(rng.choice(["a", "b", "c", "k", "1", "12", "k12"]) for _ in range(rng.randint(0, 25)))) for n in range(60)]
    df = spark.createDataFrame(rows, "row_id long, text string").withColumn("norm", T.normal(F.col("text")))
    labels = ["a", "a a", "a a a", "b c k", "k12", "K 12", "k 1", "c c b a", "zz", "...", "", "1 2", "a b a b"]
    return df, dict(rows), labels


def spelled(label):
    return [" ".join(w) for w in phrases.label_words(label)]


def test_phrases_equal_substring_search(spark, small):
    df, texts, labels = small
    want = {(la, n) for la in labels for n, t in texts.items() if any(f" {s} " in f" {t} " for s in spelled(la))}
    positions = phrases.positions_of(df, "row_id")
    table = spark.createDataFrame([(la,) for la in labels * 2], "claim string")  # repeated labels count once
    got = [tuple(r) for r in phrases.hits(table, positions).select("claim", "row_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    pairs = table.crossJoin(spark.createDataFrame([(n,) for n in range(0, 60, 2)], "row_id long"))
    assert {tuple(r) for r in phrases.pair_hits(pairs, positions).collect()} == {(la, n) for la, n in want if n % 2 == 0}
    for la in labels:
        assert {r.row_id for r in phrases.literal_hits(positions, la).collect()} == {n for x, n in want if x == la}, la


def test_no_text_is_read_for_a_phrase(spark):
    c = Corpus(spark, SF)
    plans = [exact.lookup_hits(c.pages, "of the", positions=c.positions).select("page_id"), exact.lookup_summary(c.pages, c.claims, positions=c.positions, terms=c.terms)]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        read = [line.split("ReadSchema")[1] for line in plan.splitlines() if "ReadSchema" in line]
        assert len(read) >= 2 and not any("norm" in r or "seen" in r for r in read)
    assert "In(term" in plans[0]._jdf.queryExecution().executedPlan().toString()


def test_pages_are_laid_out_by_document(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages = store.durable(Corpus(spark, SF)._make_pages(), "laid-out")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per = pages.groupBy(F.input_file_name().alias("f")).agg(F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("a", "b").collect()
    assert len(per) > 1 and all(x.b <= y.a for x, y in zip(per, per[1:]))  # files hold ranges: a document is in few


def test_two_builders_of_one_table(spark):
    path = f"{store.shared_dir(spark)}/leafproof/raced"
    made, got, bad = threading.Barrier(2), [], []

    def build(n):
        def make():
            made.wait(30)
            return spark.range(5).select((F.col("id") * 0 + n).alias("x"))

        try:
            store.written(spark, path, make, "x bigint")
            got.append(n)
        except Exception as e:  # noqa: BLE001
            bad.append(e)

    threads = [threading.Thread(target=build, args=(n,)) for n in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not bad and len(got) == 2
    rows = [r.x for r in store.written(spark, path, lambda: pytest.fail("is there"), "x bigint").collect()]
    assert rows in ([1] * 5, [2] * 5)  # one of them, whole


def test_many_labels_resolve_as_one_by_one(spark, monkeypatch):
    rows = [("D", "1.0", n, True, "ok", f" page {n} of 9 and 7 " if n != 4 else " no number ", None if n == 4 else str(n)) for n in range(1, 10)]
    forms = spark.createDataFrame(rows, "doc_id string, revision string, page_no int, is_current boolean, text_trust string, norm string, printed_label string")
    forms = forms.withColumn("page_id", T.page_id(F.col("doc_id"), F.col("revision"), F.col("page_no")))
    labels = spark.createDataFrame([(x,) for x in ("3", "Page 3 of 55", "4", "77", "7", "3")], "label string")
    got = sorted((r.label, r.page_id[-1], r.interpolated, r.total, r.capped) for r in exact.resolve_all(forms, labels).collect())
    assert got == [("3", "3", False, 1, False), ("4", "4", True, 0, False), ("7", "7", False, 8, False), ("Page 3 of 55", "3", False, 1, False)]
    monkeypatch.setattr(exact, "RESOLVE_ROWS", 3)  # 7 is printed on eight pages; the first three are compared
    got = [(r.page_id[-1], r.total, r.capped) for r in exact.resolve(forms, "7").collect()]
    assert got == [] and [(r.total, r.capped) for r in exact.resolve(forms, "1").collect()] == [(1, False)]


def test_phrases_as_written_are_in_no_other_spelling(spark):
    """phrase_lookup, printed_on, hit_projection and exact_count ask for the words as they are."""
    pages = spark.createDataFrame([(1, "top of the page"), (2, "top ofthe page"), (3, "of a the"), (4, "Of, the")], "row_id long, text string")
    pages = pages.withColumn("norm", T.normal(F.col("text"))).withColumn("page_id", F.col("row_id").cast("string"))
    index = phrases.positions_of(pages, "row_id")
    ids = lambda df: {r.row_id for r in df.collect()}
    assert ids(exact.printing(pages, "of the", index, as_written=True)) == {1, 4}
    assert ids(exact.printing(pages, "of the", as_written=True)) == {1, 4} and ids(exact.printing(pages, "of the", index)) == {1, 2, 4}
    assert ids(phrases.literal_hits(index, " - ", as_written=True)) == set()


def test_places_are_given_on_in_bounded_batches():
    texts = [" ".join(f"w{(n * k) % 50}" for k in range(5_000)) for n in range(100)]
    batch = pa.record_batch([pa.array(range(100), pa.int64()), pa.array([n % 2 == 0 for n in range(100)]), pa.array(texts)], names=["row_id", "is_current", "norm"])
    out = list(corpus.placed(iter([batch, batch.slice(0, 0)])))
    words = [sum(len(p) for p in b.column(3).to_pylist()) for b in out]
    assert sum(words) == 500_000 and max(words) <= corpus.PLACED_WORDS + 5_000 and len(out) >= 5
    got = [(t, r, cur, p) for b in out for t, r, cur, p in zip(*(x.to_pylist() for x in b.columns))]
    want = [(w, n, n % 2 == 0, [k for k, x in enumerate(t.split()) if x == w]) for n, t in enumerate(texts) for w in dict.fromkeys(t.split())]
    assert got == want


def test_no_sort_holds_texts_while_pages_are_made(spark):
    plan = Corpus(spark, SF)._make_pages()._jdf.queryExecution().sparkPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [" in line]
    assert "ShuffledHashJoin" in plan and not any("source" in x for x in sorts)
