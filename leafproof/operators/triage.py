"""Marks of skim rows, the look's route, the loop's machine, coverage and abstention."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafproof.functions import text as T
from leafproof.operators import exact, health, rank

#: A set of so many candidates is read whole; shorter prose tokens are no terms.
SMALL_SET, LEAST_TERM = 3, 4
FETCH_PAGES, READ_PAGES = 5, 3
MARKS = ("relevant", "uncertain", "irrelevant")
#: The loop's states, its signals and its edges.
STATES = ("descend", "triage", "look", "drain_uncertain", "widen", "vision_first", "draft", "verify", "answer", "abstain")
SIGNALS = ("candidates", "empty_searchable", "empty_no_text", "look_set", "empty_look_set", "sufficient", "insufficient", "pool_empty", "contradicted", "cleared", "widened", "exhausted", "budget_exhausted", "no_pages")
EDGES = (
    ("descend", "candidates", "triage"),
    ("descend", "empty_searchable", "abstain"),
    ("descend", "empty_no_text", "vision_first"),
    ("triage", "look_set", "look"),
    ("triage", "empty_look_set", "drain_uncertain"),
    ("look", "sufficient", "draft"),
    ("look", "insufficient", "drain_uncertain"),
    ("look", "budget_exhausted", "abstain"),
    ("drain_uncertain", "candidates", "look"),
    ("drain_uncertain", "pool_empty", "widen"),
    ("widen", "widened", "descend"),
    ("widen", "empty_no_text", "vision_first"),
    ("widen", "exhausted", "abstain"),
    ("vision_first", "candidates", "look"),
    ("vision_first", "no_pages", "abstain"),
    ("draft", "candidates", "verify"),
    ("verify", "cleared", "answer"),
    ("verify", "contradicted", "triage"),
)
#: How an abstention begins, for each reason.
LEADS = {
    "not_found": "Not found in the searchable text of {docs}.",
    "scope_exhausted": "Not found in the searchable text of {docs}, and there is no wider scope left to search.",
    "no_pages": "Nothing in {docs} matched, and no image-only page was available to look at.",
    "insufficient": "The pages looked at in {docs} do not answer this.",
    "rejected": "A draft answer was written from {docs} and rejected: the codes it cited are not printed on the pages it cited them from.",
}
#: The numbers that follow, and how an abstention ends: with pages that nobody looked at, nothing searched,
#: all image-only pages looked at, or none there. Only the last two claim completeness.
COUNT = "{pages} page(s) searched across {n} document(s)."
ENDS = {
    "unexamined": "{left} image-only page(s) in {docs} were not examined \u2014 look at them with `fetch` or `read` before concluding anything about the corpus.",
    "nothing": "No page was searched, so nothing follows about the corpus \u2014 widen the scope or check that this release has a published document.",
    "examined": "All {no_text} image-only page(s) in scope were examined, so this is not in these documents.",
    "text": "Every page in scope has a text layer, so this is not in these documents.",
}
COMPLETE = "not in these documents"


def together():
    """All rows of a skim, 150 at most, as one window."""
    return Window.partitionBy(F.lit(1))


def terms_of(query: str) -> tuple[list[str], list[str]]:
    """(tokens of the identifiers, longer tokens of the prose) of a question, each once."""
    codes, prose = rank.split(query)
    ids = list(dict.fromkeys(t for w in codes for t in T.tok(w)))
    return ids, [t for t in dict.fromkeys(T.tok(" ".join(prose))) if len(t) >= LEAST_TERM and t not in ids]


def marked(rows: DataFrame, query: str) -> DataFrame:
    """rows: page_id, rank, why (surfaces, comma-separated), summary, text_trust, rate. Adds mark, reason, matched (the
    question's terms that the summary shows) and promoted; see ordered() for their order.

    What a page prints is no input: a row is judged by its summary, the surfaces that found it and its trust. An exact
    identifier found in the text needs no look at the summary; a set of SMALL_SET rows or fewer is relevant as a whole.
    """
    ids, prose = terms_of(query)
    lexical = F.array_contains(F.split("why", ","), "lexical")
    told = T.tokens(F.col("summary"))
    lists = lambda x: F.array(*[F.lit(t) for t in x]).cast("array<string>")
    exact_hit = lexical & F.lit(bool(ids))
    shown = F.filter(lists([*ids, *prose]), lambda t: F.array_contains(told, t))
    reason = (
        F.when(exact_hit, "exact_hit").when(F.size(shown) > 0, "summary_match").when(lexical, "lexical_unshown")
        .when(F.col("text_trust").isin("untrusted", "no_text"), "untrusted_text").when(F.col("rate") < health.OK, "weak_grounding")
        .when(F.trim("summary") == "", "no_summary").otherwise("no_overlap")
    )
    r = F.col("reason")
    mark = F.when(r.isin("exact_hit", "summary_match"), "relevant").when(r == "no_overlap", "irrelevant").otherwise("uncertain")
    out = rows.withColumn("reason", reason).withColumn("mark", mark).withColumn("matched", F.when(r == "exact_hit", lists(ids)).otherwise(shown))
    out = out.withColumn("promoted", r == "exact_hit").withColumn("lexical", lexical)
    small = F.count(F.lit(1)).over(together()) <= SMALL_SET
    rest = small & (F.col("mark") != "relevant")
    return out.withColumn("reason", F.when(rest, "small_set").otherwise(r)).withColumn("mark", F.when(rest, "relevant").otherwise(F.col("mark")))


def marked_all(rows: DataFrame) -> DataFrame:
    """`marked` and `ordered` for the rows of many questions. rows: qid, page_id, rank, why, summary, text_trust, rate, own
    (tokens of the question's identifiers), shown (all its terms that a summary may show). Adds place."""
    lexical = F.array_contains(F.split("why", ","), "lexical")
    told = T.tokens(F.col("summary"))
    out = rows.withColumn("lexical", lexical).withColumn("seen", F.array_intersect("shown", told))
    reason = (
        F.when(F.col("lexical") & (F.size("own") > 0), "exact_hit").when(F.size("seen") > 0, "summary_match").when(F.col("lexical"), "lexical_unshown")
        .when(F.col("text_trust").isin("untrusted", "no_text"), "untrusted_text").when(F.col("rate") < health.OK, "weak_grounding")
        .when(F.trim("summary") == "", "no_summary").otherwise("no_overlap")
    )
    r = F.col("reason")
    mark = F.when(r.isin("exact_hit", "summary_match"), "relevant").when(r == "no_overlap", "irrelevant").otherwise("uncertain")
    out = out.withColumn("reason", reason).withColumn("mark", mark).withColumn("promoted", r == "exact_hit").withColumn("matched", F.when(r == "exact_hit", F.col("own")).otherwise(F.col("seen")))
    rest = (F.count(F.lit(1)).over(Window.partitionBy("qid")) <= SMALL_SET) & (F.col("mark") != "relevant")
    out = out.withColumn("rest", rest).withColumn("reason", F.when(F.col("rest"), "small_set").otherwise(r)).withColumn("mark", F.when(F.col("rest"), "relevant").otherwise(F.col("mark")))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*ordered()))).drop("seen", "rest")


def routed_all(look: DataFrame) -> DataFrame:
    """One route for each question's look set: qid, page_id, place, vision, slots, reads -> qid, page_id, route, reason."""
    each = look.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("qid"))).withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy("place")))
    route, reason = decide(F.col("vision"), F.col("slots"), F.col("reads"), F.lit(False), F.col("n"))
    each = each.withColumn("route", route).withColumn("reason", reason)
    late = F.col("route").isNotNull() & (F.col("at") > F.when(F.col("route") == "read", READ_PAGES).otherwise(FETCH_PAGES))
    return each.select("qid", "page_id", F.when(~late, F.col("route")).alias("route"), F.when(late, "deferred_over_cap").otherwise(F.col("reason")).alias("reason"))


def ordered() -> list[Column]:
    """By state, then lexical hits first, then rank, then page id."""
    state = F.array_position(F.array(*[F.lit(m) for m in MARKS]), F.col("mark"))
    return [state, (~F.col("lexical")).cast("int"), F.col("rank"), F.col("page_id")]


def decide(vision: Column, slots: Column, reads: Column, zoom: Column, pages: Column) -> tuple[Column, Column]:
    """(route, reason) of a whole look set; a null route: none is there. Needs no model call."""
    read = F.when(reads > 0, "read")
    spent = lambda why: F.when(reads > 0, why).otherwise("budget_exhausted")
    full = pages > slots
    route = F.when(zoom, F.when(vision, "fetch")).when(~vision, read).when(full, read).otherwise("fetch")
    reason = F.when(zoom, F.when(vision, "zoom_required").otherwise("zoom_requires_vision")).when(~vision, spent("caller_not_vision_capable")).when(full, spent("context_budget")).otherwise("default_fetch")
    return route, reason


def routed(look: DataFrame, callers: DataFrame) -> DataFrame:
    """look: page_id, place (1, 2, ... in the order to look); callers: caller, vision, slots, reads, zoom: a short
    list. One route for the set; pages past its cap wait for a second call."""
    route, reason = decide(F.col("vision"), F.col("slots"), F.col("reads"), F.col("zoom"), F.col("n"))
    cap = F.when(F.col("route") == "read", READ_PAGES).otherwise(FETCH_PAGES)
    each = look.withColumn("n", F.count(F.lit(1)).over(together())).withColumn("one", F.lit(1)).join(F.broadcast(callers.withColumn("one", F.lit(1))), "one")
    each = each.withColumn("route", route).withColumn("reason", reason)
    late = F.col("route").isNotNull() & (F.col("place") > cap)
    return each.select("caller", "page_id", F.when(~late, F.col("route")).alias("route"), F.when(late, "deferred_over_cap").otherwise(F.col("reason")).alias("reason"))


def folded(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """The gate's verdict on each claim: the first page that prints it, else the first that does not, else unverifiable.
    verdicts: keys, claim, place (a cited page's), page_id, state."""
    first = lambda s: F.min(F.when(F.col("state") == s, F.struct("place", "page_id")))
    g = verdicts.groupBy(*keys, "claim").agg(first("present").alias("p"), first("absent").alias("a"))
    state = F.when(F.col("p").isNotNull(), "present").when(F.col("a").isNotNull(), "absent").otherwise("unverifiable")
    return g.select(*keys, "claim", state.alias("state"), F.coalesce("p", "a")["page_id"].alias("cited"))


def merged(rungs: DataFrame, key: str) -> DataFrame:
    """Coverage of a question: documents in the order they were searched, each once, and the largest of each count.
    rungs: key, place, docs (array), pages, no_text, looked, blind (array): the few searches of one question."""
    inorder = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda x: x[c]))).alias(c)
    return rungs.groupBy(key).agg(inorder("docs"), inorder("blind"), *[F.max(c).alias(c) for c in ("pages", "no_text", "looked")])


def names(docs: Column) -> Column:
    n = F.size(docs)
    head, last = F.array_join(F.slice(docs, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.get(docs, n - 1)
    return F.when(n == 0, "the scope searched").when(n == 1, last).otherwise(F.concat(head, F.lit(" and "), last))


def filled(template: str, cells: dict[str, Column]) -> Column:
    """A template with its {names} replaced."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[cells[x].cast("string") if k % 2 else F.lit(x) for k, x in enumerate(parts)])


def abstention(reason: Column) -> Column:
    """What is said when no answer is: what was done, the numbers, and what nobody looked at. Completeness is claimed
    only where no page is left unexamined. Reads docs, blind, pages, no_text, looked."""
    docs, blind = F.col("docs"), F.col("blind")
    left = F.greatest(F.lit(0), F.col("no_text") - F.col("looked"))
    cells = {"docs": names(docs), "pages": F.col("pages"), "n": F.size(docs)}
    lead = F.lit(None).cast("string")
    for r, text in LEADS.items():
        lead = F.when(reason == r, filled(text, cells)).otherwise(lead)
    end = {k: filled(v, {"left": left, "docs": names(F.when(F.size(blind) > 0, blind).otherwise(docs)), "no_text": F.col("no_text")}) for k, v in ENDS.items()}
    gap = F.when(left > 0, end["unexamined"]).when(F.col("pages") == 0, end["nothing"]).when(F.col("no_text") > 0, end["examined"]).otherwise(end["text"])
    return F.concat_ws(" ", lead, filled(COUNT, cells), gap)


def verdicts(cited: DataFrame, pages: DataFrame, keys: list[str], positions: DataFrame | None = None) -> DataFrame:
    """cited: keys, claim, place, page_id. The state of each claim on each cited page."""
    m = exact.verify_matrix(cited.select("claim", "page_id").distinct(), pages, positions).select("claim", "page_id", "state")
    return cited.join(m, ["claim", "page_id"]).select(*keys, "claim", "place", "page_id", "state")
