"""Typed refusals of calls, in batch: each names the first bound that a call breaks. Nothing is clamped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafproof.operators.exact import SCOPE_KEYS
from leafproof.operators.triage import FETCH_PAGES, READ_PAGES

#: The resolutions there are, the highest one without a region, and the bounds of calls.
DPI = (36, 72, 150, 220, 300, 400)
WHOLE_PAGE_DPI, MEGAPIXELS, PAIRS, ROWS = 220, 12.0, 200, 25


def region_wrong(region: Column) -> Column:
    """A region is x0, y0, x1, y1 within 0..1, with x0 < x1 and y0 < y1; none is fine."""
    at = lambda k: F.get(region, F.lit(k))
    wrong = (F.size(region) != 4) | ~F.forall(region, lambda x: (x >= 0) & (x <= 1)) | (at(0) >= at(2)) | (at(1) >= at(3))
    return region.isNotNull() & F.coalesce(wrong, F.lit(True))


def dpi_wrong(dpi: Column, region: Column) -> Column:
    return F.when(~dpi.isin(*DPI), "dpi_not_allowed").when((dpi > WHOLE_PAGE_DPI) & region.isNull(), "dpi_requires_region")


def refusal(c: dict[str, Column]) -> Column:
    """The error of a call, or null. c: tool, pages, question, reads, dpi, region, megapixels, claims, limit, cap, label,
    scope (keys); what a tool does not take is not looked at."""
    unknown = F.size(F.array_except(c["scope"], F.array(*[F.lit(k) for k in SCOPE_KEYS]))) > 0
    read = F.when(c["pages"] == 0, "read_empty").when(c["pages"] > READ_PAGES, "read_page_cap_exceeded").when(F.trim(c["question"]) == "", "read_question_missing").when(c["reads"] <= 0, "budget_exhausted")
    fetch = (
        F.when(c["pages"] == 0, "fetch_empty").when(c["pages"] > FETCH_PAGES, "fetch_budget_exceeded")
        .otherwise(F.coalesce(dpi_wrong(c["dpi"], c["region"]), F.when(region_wrong(c["region"]), "region_invalid").when(c["megapixels"] > MEGAPIXELS, "fetch_budget_exceeded")))
    )
    verify = F.when((c["claims"] == 0) | (c["pages"] == 0), "verify_empty").when(c["claims"] * c["pages"] > PAIRS, "verify_budget_exceeded")
    skim = F.when(~c["limit"].between(1, ROWS), "limit_out_of_range").when(F.trim(c["question"]) == "", "query_required").when(unknown, "filter_unknown_key")
    lookup = F.when(F.trim(c["label"]) == "", "label_empty").when(c["cap"] < 1, "cap_out_of_range").when(unknown, "filter_unknown_key")
    tool = c["tool"]
    return F.when(tool == "read", read).when(tool == "fetch", fetch).when(tool == "verify", verify).when(tool == "skim", skim).when(tool == "lookup", lookup)
