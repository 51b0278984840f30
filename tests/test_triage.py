"""Marks, routes, the loop's machine, coverage and abstention, on literal rows."""

import pytest
from pyspark.sql import functions as F

from leafproof.operators import triage

ROWS = "page_id string, rank int, why string, summary string, text_trust string, rate double"


def marks(spark, rows, query):
    got = triage.marked(spark.createDataFrame(rows, ROWS), query)
    return {r.page_id: (r.mark, r.reason) for r in got.collect()}, [r.page_id for r in got.orderBy(*triage.ordered()).collect()]


def test_marks_by_the_order_of_the_rules(spark):
    rows = [
        ("a", 1, "dense", "the relay panel", "ok", 1.0), ("b", 2, "lexical", "cooling", "ok", 1.0), ("c", 3, "dense", "cooling", "untrusted", 1.0),
        ("d", 4, "captions", "cooling", "ok", 0.5), ("e", 5, "dense", " ", "ok", None), ("f", 6, "dense", "cooling", "ok", 0.9),
    ]
    got, order = marks(spark, rows, "where is the relay")
    assert got == {"a": ("relevant", "summary_match"), "b": ("uncertain", "lexical_unshown"), "c": ("uncertain", "untrusted_text"), "d": ("uncertain", "weak_grounding"), "e": ("uncertain", "no_summary"), "f": ("irrelevant", "no_overlap")}
    assert order == ["a", "b", "c", "d", "e", "f"]
    got, order = marks(spark, rows, "where is K158")
    assert got["b"] == ("relevant", "exact_hit") and got["a"] == ("irrelevant", "no_overlap")  # the article is no term


def test_a_small_set_is_read_whole(spark):
    rows = [("a", 1, "dense", "cooling", "ok", 1.0), ("b", 2, "dense", "relay", "ok", 1.0), ("c", 3, "lexical", "x", "ok", 1.0)]
    got, order = marks(spark, rows, "relay")
    assert got == {"a": ("relevant", "small_set"), "b": ("relevant", "summary_match"), "c": ("relevant", "small_set")}
    assert order == ["c", "a", "b"]  # a lexical hit comes before a better rank


@pytest.mark.parametrize(
    ("caller", "pages", "want"),
    [
        ((True, 5, 0, False), 5, ("fetch", "default_fetch")), ((True, 5, 1, False), 6, ("read", "context_budget")), ((True, 5, 0, False), 6, (None, "budget_exhausted")),
        ((False, 5, 1, False), 1, ("read", "caller_not_vision_capable")), ((False, 5, 0, False), 1, (None, "budget_exhausted")),
        ((True, 0, 0, True), 9, ("fetch", "zoom_required")), ((False, 5, 9, True), 1, (None, "zoom_requires_vision")),
    ],
)
def test_one_route_for_a_set(spark, caller, pages, want):
    route, reason = triage.decide(*[F.lit(x) for x in caller], F.lit(pages))
    r = spark.range(1).select(route.alias("a"), reason.alias("b")).first()
    assert (r.a, r.b) == want


def test_pages_past_the_cap_wait(spark):
    look = spark.createDataFrame([(f"p{k}", k) for k in range(1, 8)], "page_id string, place int")
    callers = spark.createDataFrame([("eyes", True, 9, 0, False), ("blind", False, 9, 1, False), ("none", False, 9, 0, False)], "caller string, vision boolean, slots int, reads int, zoom boolean")
    got = {(r.caller, r.page_id): (r.route, r.reason) for r in triage.routed(look, callers).collect()}
    assert [got["eyes", f"p{k}"][0] for k in (1, 5, 6)] == ["fetch", "fetch", None] and got["eyes", "p6"][1] == "deferred_over_cap"
    assert [got["blind", f"p{k}"][0] for k in (3, 4)] == ["read", None] and got["none", "p1"] == got["none", "p7"] == (None, "budget_exhausted")


def test_the_machine_widens_only_after_the_pool_is_drained():
    edges = {(s, g): n for s, g, n in triage.EDGES}
    assert len(edges) == len(triage.EDGES) == 18 and {s for s, _ in edges} == set(triage.STATES) - {"answer", "abstain"}
    assert edges["look", "insufficient"] == "drain_uncertain" and [s for (s, _), n in edges.items() if n == "widen"] == ["drain_uncertain"]
    assert [s for (s, _), n in edges.items() if n == "answer"] == ["verify"] and {g for _, g in edges} <= set(triage.SIGNALS)


def test_claims_fold_to_the_first_page_in_order(spark):
    rows = [(1, "k1", 0, "z", "absent"), (1, "k1", 1, "y", "present"), (1, "k1", 2, "a", "present"), (1, "k2", 1, "b", "absent"), (1, "k2", 0, "c", "absent"), (1, "k3", 0, "d", "unverifiable")]
    got = {r.claim: (r.state, r.cited) for r in triage.folded(spark.createDataFrame(rows, "id int, claim string, place int, page_id string, state string"), ["id"]).collect()}
    assert got == {"k1": ("present", "y"), "k2": ("absent", "c"), "k3": ("unverifiable", None)}


def said(spark, reason, docs, pages, no_text, looked, blind=()):
    df = spark.createDataFrame([(list(docs), pages, no_text, looked, list(blind))], "docs array<string>, pages int, no_text int, looked int, blind array<string>")
    return df.select(triage.abstention(F.lit(reason)).alias("t")).first().t


def test_abstentions_name_what_was_not_looked_at(spark):
    gap = said(spark, "not_found", ["A", "B", "C"], 40, 5, 2, ["C"])
    assert gap.startswith("Not found in the searchable text of A, B and C. 40 page(s) searched across 3 document(s). 3 image-only page(s) in C were not examined")
    assert triage.COMPLETE not in gap
    assert said(spark, "rejected", ["A"], 9, 2, 2).endswith("All 2 image-only page(s) in scope were examined, so this is not in these documents.")
    assert said(spark, "no_pages", ["A"], 9, 0, 0).endswith("Every page in scope has a text layer, so this is not in these documents.")
    assert triage.COMPLETE not in said(spark, "insufficient", [], 0, 0, 0) and "the scope searched" in said(spark, "insufficient", [], 0, 0, 0)


def test_coverage_is_the_widest_scope_searched(spark):
    rows = [(1, 2, ["B"], 5, 3, 0, ["B"]), (1, 1, ["A"], 9, 1, 1, []), (1, 3, ["A"], 9, 1, 0, ["A"])]
    r = triage.merged(spark.createDataFrame(rows, "q int, place int, docs array<string>, pages int, no_text int, looked int, blind array<string>"), "q").first()
    assert (r.docs, r.blind, r.pages, r.no_text, r.looked) == (["A", "B"], ["B", "A"], 9, 3, 1)
