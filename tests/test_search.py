"""Golden rows for exact search, ranking and ids, on literal pages."""

import uuid

import pytest
from pyspark.sql import functions as F

from leafproof.functions import text as T
from leafproof.operators import exact, health, ingest, rank

#: (doc_id, revision, page_no, text, is_current, has_text, text_trust)
PAGES = [
    ("DOC-1", "1.0", 1, "Alarm SF 1.1A near K 158", True, True, "ok"),
    ("DOC-1", "1.0", 2, "see K158 and SF1.1A", True, True, "ok"),
    ("DOC-1", "1.0", 3, "SF 121.1 relay", True, True, "degraded"),
    ("DOC-1", "1.0", 5, "", True, False, "no_text"),
    ("DOC-1", "1.0", 8, "1.1A stands before SF", True, True, "ok"),
    ("DOC-1", "1.0", 10, "K404 drawn badly", True, True, "untrusted"),
    ("DOC-1", "0.9", 1, "SF 7.7A and K 158", False, True, "ok"),
]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "doc_id string, revision string, page_no int, text string, is_current boolean, has_text boolean, text_trust string")
    df = df.withColumn("page_id", T.page_id(F.col("doc_id"), F.col("revision"), F.col("page_no"))).withColumn("lang", F.lit("en"))
    return df.withColumn("norm", T.normal(F.col("text")))


def found(pages, label, **scope):
    return [r.page_no for r in exact.lookup_hits(pages, label, scope).orderBy("page_no").collect()]


def test_phrases_are_exact(pages):
    assert found(pages, "SF 1.1A") == [1, 2]  # apart, and by its spelling without spaces
    assert found(pages, "SF1.1A") == [2]  # a spelling never joins what the page has apart
    assert found(pages, "SF 1") == [1, 2]
    assert found(pages, "K158") == [1, 2] and found(pages, "K 158") == [1, 2]
    assert found(pages, "K404") == [] and found(pages, "SF 7.7A") == [] and found(pages, "K15") == []
    assert found(pages, "K158", page_no=[2, 3]) == [2] and found(pages, "K158", doc_id="NO") == []


def test_unknown_scope_keys_are_refused_before_planning(pages):
    with pytest.raises(exact.ScopeError):
        exact.scope(pages, {"colour": "red"})


def test_lookup_summary_has_typed_absence(spark, pages):
    labels = spark.createDataFrame([(1, "SF 1.1A"), (2, "K404"), (3, "K999"), (4, "...")], "item_id long, claim string")
    got = {r.item_id: (r.total, r.unverified, r.status) for r in exact.lookup_summary(pages, labels).collect()}
    assert got == {1: (2, 0, "ok"), 2: (0, 1, "not_found"), 3: (0, 0, "not_found"), 4: (0, 0, "not_found")}
    # a scope whose pages cannot be trusted answers not_searchable, with text or without; an empty scope is another thing
    for page, want in (([10], "not_searchable"), ([5], "not_searchable"), ([5, 10], "not_searchable"), ([3, 10], "not_found"), ([99], "out_of_scope")):
        scoped = exact.scope(pages, {"page_no": page})
        assert {r.status for r in exact.lookup_summary(scoped, labels.filter("item_id = 2")).collect()} == {want}, page
    rows = [(r.claim, r.nth, r.page_id[-1]) for r in exact.lookup_rows(pages, labels).orderBy("nth").collect()]
    assert rows == [("SF 1.1A", 1, "1"), ("SF 1.1A", 2, "2")]


def test_resolve_leads_to_labels_and_brackets(spark):
    rows = [("D", "1.0", n, True, "ok", f" page {n} of 9 and 7 " if n != 4 else " no number ", None if n == 4 else f"Page {n} of 9" if n == 2 else str(n)) for n in range(1, 10)]
    forms = spark.createDataFrame(rows, "doc_id string, revision string, page_no int, is_current boolean, text_trust string, norm string, printed_label string")
    forms = forms.withColumn("page_id", T.page_id(F.col("doc_id"), F.col("revision"), F.col("page_no")))
    got = lambda label: sorted((r.page_id[-1], r.interpolated) for r in exact.resolve(forms, label).collect())
    assert got("3") == [("3", False)] and got("Page 3 of 55") == [("3", False)] and got("4") == [("4", True)]
    assert got("2") == [("2", False)] and got("9") == [("2", False), ("9", False)]  # the longer label holds both numbers
    assert got("77") == [] and got("iv") == []


def test_verdicts(spark, pages):
    asked = [("SF 1.1A", 1, "1.0"), ("SF 1.1A", 8, "1.0"), ("SF 9.9", 5, "1.0"), ("K404", 10, "1.0"), ("SF 7.7A", 1, "0.9"), ("K158", 99, "1.0")]
    pairs = spark.createDataFrame([(c, f"DOC-1@{v}#p{n:03d}") for c, n, v in asked], "claim string, page_id string")
    got = {(r.claim, r.page_id[-3:]): (r.state, r.reason) for r in exact.verify_matrix(pairs, pages).collect()}
    assert got == {
        ("SF 1.1A", "001"): ("present", None), ("SF 1.1A", "008"): ("absent", None), ("SF 9.9", "005"): ("unverifiable", "no_text"),
        ("K404", "010"): ("unverifiable", "untrusted"), ("SF 7.7A", "001"): ("unverifiable", "not_current"), ("K158", "099"): ("unverifiable", "page_not_found"),
    }
    folded = {r.claim: (r.state, r.reason) for r in exact.verify_claims(exact.verify_matrix(pairs, pages)).collect()}
    assert folded["SF 1.1A"] == ("present", None) and folded["K404"] == ("unverifiable", "untrusted")


def test_present_instead_takes_the_longest_shared_prefix(spark):
    inv = spark.createDataFrame([("d", t) for t in ("k78", "k7", "k158", "q25")], "doc_id string, token string")
    claims = spark.createDataFrame([("K73", "d"), ("x1", "d"), ("K78", "d")], "claim string, doc_id string")
    got = {(r.claim, r.token) for r in exact.present_instead(claims, inv).collect()}
    assert got == {("K73", "k7"), ("K73", "k78"), ("K78", "k7")}


def test_text_functions(spark):
    df = spark.createDataFrame([("84-5140.0020 ÄB c3",)], "s string")
    r = df.select(T.tokens(F.col("s")).alias("t"), T.tok_udf(F.lit("ﬁne K²")).alias("n"), T.variants(F.lit("SF  1.1A")).alias("v"), T.uuid5(F.lit("a@1#p001")).alias("u"), T.slug(F.lit("--A b/c-")).alias("s"), F.size(T.mutations(F.lit("ab12345"))).alias("m")).first()
    assert r.t == ["84", "5140", "0020", "äb", "c3"] and r.n == ["fine", "k2"]
    assert r.v == ["SF 1.1A", "SF1.1A", "SF 1.1 A"] and r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "a@1#p001"))
    assert r.s == "A-b-c" and r.m == 7 * 35
    ids = spark.createDataFrame([("D@1.0#p001",), ("D@1.0#p0001",), ("D@1.0#p1000",), ("D@1.0#p000",), ("x",)], "p string")
    assert [x.ok for x in ids.select(T.parse_page_id(F.col("p"))[3].alias("ok")).collect()] == [True, False, True, False, False]
    u = df.select(T.ulid(F.lit(1469918176385).cast("long"), F.lit("0" * 20)).alias("u")).first().u
    assert u == "01ARYZ6S41" + "0" * 16


def test_fusion_adds_weights_in_order(spark):
    ranks = [("dense", 1, 1), ("dense", 2, 2), ("lexical", 2, 1), ("captions", 3, 1)]
    got = {r.row_id: (r.score, r.best_rank, r.why) for r in rank.fuse([spark.createDataFrame(ranks, "surface string, row_id long, rank int")]).collect()}
    assert got == {1: (1 / 61, 1, "dense"), 2: (1 / 62 + 1 / 61, 1, "dense,lexical"), 3: (0.4 / 61, 1, "captions")}


def test_grounding_and_windows(spark):
    f = spark.createDataFrame([(["K 1", "k9"], " k 1 ", True), ([], " x ", True), (["k1"], "  ", False)], "codes array<string>, norm string, has_text boolean")
    assert [r.r for r in f.select(health.grounded_rate(F.col("codes"), F.col("norm"), F.col("has_text")).alias("r")).collect()] == [0.5, 1.0, None]
    twice = spark.createDataFrame([(["K1", "k1"], " k1 ", True)], "codes array<string>, norm string, has_text boolean")
    assert twice.select(health.grounded_rate(F.col("codes"), F.col("norm"), F.col("has_text")).alias("r")).first().r == 1.0
    pages = spark.createDataFrame([(1, 30), (2, 31), (3, 70)], "doc_id long, pages int")
    starts = spark.createDataFrame([(3, 5), (3, 40), (3, 99)], "doc_id long, start int")
    got = sorted((r.doc_id, r.start, r.stop, r.level) for r in ingest.plan_windows(starts, pages).collect())
    assert got == [(1, 1, 30, 0), (2, 1, 30, 2), (2, 31, 31, 2), (3, 1, 4, 1), (3, 5, 34, 1), (3, 35, 39, 1), (3, 40, 69, 1), (3, 70, 70, 1)]
    folds = spark.createDataFrame([(1, 1, 5), (1, 6, 25), (2, 1, 14), (2, 15, 28), (2, 29, 30), (3, 1, 25), (3, 26, 34), (4, 1, 12), (4, 13, 14), (4, 15, 16)], "doc_id long, start int, stop int")
    packed = sorted((r.doc_id, r.start, r.stop) for r in ingest.pack(folds).collect())
    # only a small range joins the one before, and never past the cap
    assert packed == [(1, 1, 5), (1, 6, 25), (2, 1, 14), (2, 15, 30), (3, 1, 25), (3, 26, 34), (4, 1, 16)]
