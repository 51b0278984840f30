"""Ingest planning and checks: windows, labels, offsets, reattribution, stitching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from leafproof.functions import text as T

CAP, SMALL = 30, 10
#: Bits of a column that say which pages are bad.
WORD = 62
#: Pages of a window whose label a neighbour prints that make it be off.
WITNESSES = 2


def by_page() -> Window:
    """A document revision's pages in order."""
    return Window.partitionBy("doc_id", "revision").orderBy("page_no")


#: Bytes that a call carries inline.
INLINE = 18 * 1024 * 1024


def inline_cap(pages: Column, size: Column, cap: int = CAP, inline: int = INLINE) -> Column:
    """Pages of a window: cap, or fewer if the file is too large to be carried whole, one at least."""
    fewer = F.floor(inline / (size / pages)).cast("int")
    return F.when((size <= inline) | (pages < 1), cap).otherwise(F.greatest(F.lit(1), F.least(F.lit(cap), fewer)))


def split_oversized(ranges: DataFrame, cap: int = CAP) -> DataFrame:
    """(doc_id, start, stop) -> windows of cap pages at most, each filled before the next."""
    at = F.explode(F.sequence("start", "stop", F.lit(cap))).alias("at")
    return ranges.select("doc_id", at, "stop").select("doc_id", F.col("at").alias("start"), F.least("stop", F.col("at") + cap - 1).alias("stop"))


def pack(ranges: DataFrame, cap: int = CAP, small: int = SMALL) -> DataFrame:
    """Merge a range of under `small` pages into the one before, if both fit into cap: an ordered fold over a
    document's ranges (its chapters, a short list). A small first range stays, and so does what follows it if that is
    large enough."""
    span = lambda r: r["stop"] - r["start"] + 1
    sorted_ = ranges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("r"))

    def fold(acc: Column, r: Column) -> Column:
        fits = (F.size(acc) > 0) & (span(r) < small)
        joined = F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), r["stop"].alias("stop"))
        merge = fits & (span(joined) <= cap)
        return F.when(merge, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(r)))

    zero = F.array().cast("array<struct<start:int,stop:int>>")
    return sorted_.select("doc_id", F.explode(F.aggregate("r", zero, fold)).alias("w")).select("doc_id", "w.start", "w.stop")


def chapters(starts: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, start, stop) from table-of-contents starts within 1..pages; the first chapter begins at 1."""
    inside = starts.join(pages, "doc_id").filter("start between 1 and pages").select("doc_id", "start", "pages")
    ones = pages.select("doc_id", F.lit(1).alias("start"), "pages")
    w = Window.partitionBy("doc_id").orderBy("start")
    return inside.unionByName(ones).distinct().withColumn("stop", F.lead("start").over(w)).select("doc_id", "start", F.coalesce(F.col("stop") - 1, F.col("pages")).cast("int").alias("stop"))


def plan_windows(starts: DataFrame, pages: DataFrame, cap: int = CAP) -> DataFrame:
    """(doc_id, start, stop, level): whole documents up to cap pages; else chapters, split and packed; else flat."""
    whole = pages.filter(F.col("pages") <= cap).select("doc_id", F.lit(1).alias("start"), F.col("pages").cast("int").alias("stop"), F.lit(0).alias("level"))
    large = pages.filter(F.col("pages") > cap)
    told = starts.join(large, "doc_id").filter("start between 2 and pages").select("doc_id").distinct()
    by = pack(split_oversized(chapters(starts, large.join(told, "doc_id", "left_semi")), cap), cap).withColumn("level", F.lit(1))
    flat = split_oversized(large.join(told, "doc_id", "left_anti").select("doc_id", F.lit(1).alias("start"), F.col("pages").cast("int").alias("stop")), cap).withColumn("level", F.lit(2))
    return whole.unionByName(by).unionByName(flat)


def beside(forms: DataFrame, step: int, column: str, name: str) -> DataFrame:
    """(doc_id, revision, page_no, name): the column of the page `step` pages on, by an equi-join key."""
    return forms.select("doc_id", "revision", (F.col("page_no") - step).alias("page_no"), F.col(column).alias(name))


ON = ["doc_id", "revision", "page_no"]


def interpolate(forms: DataFrame) -> DataFrame:
    """An unlabelled page between digit labels n - 1 and n + 1 gets n."""
    number = lambda c: F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).cast("long"))
    both = forms.join(beside(forms, -1, "printed_label", "_before"), ON, "left").join(beside(forms, 1, "printed_label", "_after"), ON, "left")
    fill = F.col("printed_label").isNull() & (number("_after") - number("_before") == 2)
    label = F.when(fill, (number("_before") + 1).cast("string")).otherwise(F.col("printed_label"))
    return both.withColumn("interpolated", F.coalesce(fill, F.lit(False))).withColumn("label", label).drop("_before", "_after")


def drops(forms: DataFrame) -> DataFrame:
    """Per document: decreases between consecutive numeric labels."""
    n = forms.filter(F.col("printed_label").rlike("^[0-9]+$")).select(*ON, F.col("printed_label").cast("long").alias("v"))
    n = n.withColumn("p", F.lag("v").over(by_page()))
    return n.groupBy("doc_id", "revision").agg(F.count("*").alias("labelled"), F.count_if(F.expr("v < p")).alias("drops"))


def printed_around(forms: DataFrame, codes: Column, window: int | None = None) -> DataFrame:
    """Per page: page_id, doc_id, revision, page_no, codes, and which of them the page itself (here), the one before
    (prev) and the one after (next) print; of the same `window` pages only, if given.

    Pages meet their neighbours by an equi-join on the page number; each text is shuffled once, and texts of no group
    meet in one task.
    """
    asked = forms.select("page_id", *ON, codes.alias("codes"), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d"))
    if window:
        block = lambda c: F.floor((c - 1) / window)
        asked = asked.filter(block(F.col("page_no") + F.col("d")) == block(F.col("page_no")))
    asked = asked.withColumn("at", F.col("page_no") + F.col("d"))
    near = forms.select("doc_id", "revision", F.col("page_no").alias("at"), "norm").join(asked, ["doc_id", "revision", "at"])
    seen = near.select("page_id", *ON, "codes", "d", F.filter("codes", lambda c: T.printed(F.col("norm"), c)).alias("hit"))
    none = F.array().cast("array<string>")
    side = lambda d: F.coalesce(F.max(F.when(F.col("d") == d, F.col("hit"))), none)
    return seen.groupBy("page_id", *ON).agg(F.first("codes").alias("codes"), side(0).alias("here"), side(-1).alias("prev"), side(1).alias("next"))


def sightings(forms: DataFrame, window: int | None = None) -> DataFrame:
    """(page, code): whether the page, the one before or the one after prints it."""
    around = printed_around(forms, F.col("codes"), window)
    each = around.select("page_id", *ON, F.explode("codes").alias("code"), "here", "prev", "next")
    has = lambda c, n: F.array_contains(c, F.col("code")).alias(n)
    return each.select("page_id", *ON, "code", has("here", "here"), has("prev", "on_prev"), has("next", "on_next"))


def label_witnesses(forms: DataFrame) -> DataFrame:
    """Pages with text and a label of their own: page_id, label, confirms (the page prints it), witness (it does not,
    but a neighbour does), printed_on (which neighbours: -1, 1)."""
    read = forms.filter("has_text and trim(printed_label) != ''").select("page_id", F.trim("printed_label").alias("label"))
    around = printed_around(forms, F.array_compact(F.array(F.trim("printed_label")))).join(read, "page_id")
    here, before, after = (F.size(c) > 0 for c in ("here", "prev", "next"))
    on = F.array_compact(F.array(F.when(before, -1), F.when(after, 1)))
    return around.select("page_id", *ON, "label", here.alias("confirms"), (~here & (before | after)).alias("witness"), F.when(~here, on).otherwise(F.array().cast("array<int>")).alias("printed_on"))


def offset_check(forms: DataFrame, window: int = CAP) -> DataFrame:
    """Per window of pages: confirmed, witnesses, shifted. A window is off if WITNESSES of its pages read a label that a
    neighbour prints, or one does and no page confirms its own. Labels printed nowhere near are misreadings and count
    for neither."""
    block = F.floor((F.col("page_no") - 1) / window).alias("window")
    every = forms.select("doc_id", "revision", block).distinct()
    g = label_witnesses(forms).groupBy("doc_id", "revision", block).agg(F.count_if(F.col("confirms")).alias("confirmed"), F.count_if(F.col("witness")).alias("witnesses"))
    g = every.join(g, ["doc_id", "revision", "window"], "left").fillna(0, ["confirmed", "witnesses"])
    return g.withColumn("shifted", (F.col("witnesses") >= WITNESSES) | ((F.col("witnesses") > 0) & (F.col("confirmed") == 0)))


def reattribute(forms: DataFrame, window: int = CAP) -> DataFrame:
    """(page_id, code, moved_from, added, flag): a code that its page does not print moves to the one neighbour within
    the window that does. Printed by both neighbours it stays, flagged ambiguous; by none, it stays. `added` is false
    for a moved code that its new page already has, in whatever case, or got from the page before."""
    s = sightings(forms, window)
    alone = ~F.col("here") & (F.col("on_prev") != F.col("on_next"))
    ambiguous = ~F.col("here") & F.col("on_prev") & F.col("on_next")
    key = F.lower(F.regexp_replace("code", r"\s+", "")).alias("key")
    stay = s.filter(~alone).select("page_id", "code", key, F.lit(None).cast("string").alias("moved_from"), F.lit(0).alias("place"), F.when(ambiguous, "ambiguous_reattribution").alias("flag"))
    to = F.when(F.col("on_prev"), F.col("page_no") - 1).otherwise(F.col("page_no") + 1)
    move = s.filter(alone).select(T.page_id(F.col("doc_id"), F.col("revision"), to).alias("page_id"), "code", key, F.col("page_id").alias("moved_from"), F.col("page_no").alias("place"), F.lit("codes_reattributed").alias("flag"))
    w = Window.partitionBy("page_id", "key").orderBy("place", "code")  # what stays comes first, then the page before
    every = stay.unionByName(move).withColumn("nth", F.row_number().over(w))
    return every.select("page_id", "code", "moved_from", (F.col("moved_from").isNull() | (F.col("nth") == 1)).alias("added"), "flag")


def stitched(forms: DataFrame) -> DataFrame:
    """Sections by key: title, extent, pages, the pages that declare a start (a section's few, in order), ordinal,
    contiguous, straddles, uncertain."""
    starts = F.array_sort(F.collect_list(F.when(F.col("is_start"), F.col("page_no")))).alias("starts")
    g = forms.groupBy("doc_id", "revision", "section").agg(F.min("section").alias("title"), F.min("page_no").alias("first"), F.max("page_no").alias("last"), F.count_distinct("page_no").alias("pages"), starts)
    w = Window.partitionBy("doc_id", "revision").orderBy("first", "section")
    return g.select(
        "*", F.row_number().over(w).alias("ordinal"), (F.col("pages") == F.col("last") - F.col("first") + 1).alias("contiguous"),
        (F.col("first") != F.col("last")).alias("straddles"), (F.size("starts") != 1).alias("uncertain"),
    )


def extracted(windows: DataFrame, bad: DataFrame, cap: int = CAP) -> DataFrame:
    """Extraction that halves and bills again: (doc_id, start, stop, state, calls).

    windows: (doc_id, start, stop) of cap pages at most; bad: (doc_id, page_no) that no call can place. A window with a
    bad page fails and is halved, each half is a call of its own; a failing single page is unsplittable. `calls` counts
    the calls that led to the window. Each round halves, so log2(cap) rounds end it.

    A window meets the bad pages of its block of cap pages and the next one as the bits of one row, or of as many columns
    as 2 * cap bits need: pages are never joined as rows of their own. Arrow batches of windows are halved in numpy.
    """
    words = range(-(-2 * cap // WORD))
    block = lambda page: F.floor((page - 1) / cap).alias("block")
    lost = bad.select("doc_id", F.col("page_no").cast("long").alias("page_no"), block(F.col("page_no")).alias("own"))
    lost = lost.select("doc_id", "page_no", F.explode(F.array(F.col("own") - 1, F.col("own"))).alias("block"))
    lost = lost.select("doc_id", "block", (F.col("page_no") - 1 - F.col("block") * cap).alias("at"))
    bit = lambda k: F.expr(f"bit_or(if(at div {WORD} = {k}, shiftleft(1L, cast(at % {WORD} as int)), 0L))").alias(f"m{k}")
    lost = lost.groupBy("doc_id", "block").agg(*[bit(k) for k in words])
    near = windows.filter("start is not null and stop is not null").select("doc_id", "start", "stop").distinct().withColumn("block", block(F.col("start")))
    near = near.join(lost, ["doc_id", "block"], "left").select("doc_id", "start", "stop", "block", *[F.coalesce(f"m{k}", F.lit(0)).alias(f"m{k}") for k in words])
    out = ST.StructType([windows.schema["doc_id"], *ST.StructType.fromDDL("start int, stop int, state string, calls int").fields])
    return near.mapInArrow(_halved(cap), out)


def _halved(cap: int):
    """Windows (doc_id, start, stop, block, bits of their blocks' bad pages) to what is left of them: doc_id, start, stop,
    state, calls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = pa.array(["ok", "window_unsplittable"])
        one = np.uint64(1)
        for b in batches:
            start, stop, first = (b.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3))
            if (stop - start >= cap).any():
                raise ValueError(f"a window has over {cap} pages")
            first = first * cap + 1
            masks = [b.column(k).to_numpy().astype(np.uint64) for k in range(4, b.num_columns)]
            w, calls, parts = np.arange(len(start)), 1, []
            while len(w):
                failed = np.zeros(len(w), bool)
                for k, m in enumerate(masks):
                    low, high = (np.clip(x - first[w] - k * WORD, 0, WORD).astype(np.uint64) for x in (start, stop + 1))
                    failed |= (m[w] & ((one << high) - (one << low))) != 0
                whole = ~failed | (start == stop)
                parts.append((w[whole], start[whole], stop[whole], failed[whole], np.full(whole.sum(), calls)))
                w, start, stop, calls = w[~whole], start[~whole], stop[~whole], calls + 1
                half = (start + stop) // 2
                w, start, stop = np.concatenate([w, w]), np.concatenate([start, half + 1]), np.concatenate([half, stop])
            if parts:
                w, start, stop, failed, calls = (np.concatenate(x) for x in zip(*parts))
                whole = lambda x: pa.array(x.astype(np.int32))
                yield pa.record_batch([b.column(0).take(pa.array(w)), whole(start), whole(stop), states.take(whole(failed)), whole(calls)], names=["doc_id", "start", "stop", "state", "calls"])

    return run


def tilings(forms: DataFrame, evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """Where windows sit whose place is lost: doc_id, win, start, found.

    forms: (doc_id, win, at, label), the pages of each window numbered from 1; evidence: (doc_id, page_no, label), what
    is known of a document's pages; pages: (doc_id, pages). The windows of a document must cover its pages, each once.

    A label that one page alone is known to have votes for that page less its place in the window. A window goes where
    its votes agree; a window without votes goes into a gap of its width, if no other such window or gap has that width.
    Then each page's label must be one that is known of its page, or nothing be known of the page. found: 1 if all
    windows of the document have their places, 0 if votes, labels or widths contradict one another, 2 if nothing tells
    where some go. start is null unless found is 1. Rows are joined by label, page and width: as many as there are pages.
    """
    on = ["doc_id", "win"]
    w = forms.groupBy(*on).agg(F.count("*").cast("int").alias("width"))
    lone = evidence.select("doc_id", "page_no", "label").distinct().groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.max("page_no").alias("page_no")).filter("n = 1 and label is not null")
    votes = forms.join(lone, ["doc_id", "label"]).groupBy(*on).agg(F.min(F.col("page_no") - F.col("at") + 1).alias("lo"), F.max(F.col("page_no") - F.col("at") + 1).alias("hi"))
    told = w.join(votes, on, "left").join(pages, "doc_id")
    inside = (F.col("lo") >= 1) & (F.col("lo") + F.col("width") - 1 <= F.col("pages"))
    told = told.withColumn("torn", F.col("lo").isNotNull() & ((F.col("lo") != F.col("hi")) | ~inside))
    set_ = told.filter("lo is not null and not torn").select(*on, "width", "pages", F.col("lo").cast("int").alias("start"))
    by = Window.partitionBy("doc_id").orderBy("start", "win")  # a document's windows, not its pages
    after = set_.withColumn("next", F.coalesce(F.lead("start").over(by), F.col("pages") + 1)).withColumn("end", F.col("start") + F.col("width"))
    over = after.filter("end > next").select("doc_id").distinct()
    first = set_.groupBy("doc_id").agg(F.min("start").alias("first"))
    head = pages.join(first, "doc_id", "left").select("doc_id", F.lit(1).alias("start"), (F.coalesce(F.col("first"), F.col("pages") + 1) - 1).alias("width"))
    gaps = after.select("doc_id", F.col("end").alias("start"), (F.col("next") - F.col("end")).alias("width")).unionByName(head).filter("width > 0")
    alone = lambda df: df.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "width"))).filter("n = 1").drop("n")
    free = alone(told.filter("lo is null").select(*on, "width"))
    filled = free.join(alone(gaps), ["doc_id", "width"]).select(*on, "width", F.col("start").cast("int").alias("start"))
    places = set_.select(*on, "width", "start").unionByName(filled)
    known = evidence.groupBy("doc_id", "page_no").agg(F.collect_set("label").alias("labels"))
    each = forms.join(places, on).withColumn("page_no", F.col("start") + F.col("at") - 1).join(known, ["doc_id", "page_no"])
    wrong = each.filter(~F.coalesce(F.array_contains("labels", F.col("label")), F.lit(False))).select("doc_id").distinct()
    sums = told.groupBy("doc_id").agg(F.sum("width").alias("sum"), F.max("pages").alias("pages"), F.max("torn").alias("torn"), F.count("*").alias("n"))
    bad = over.unionByName(wrong).distinct().withColumn("bad", F.lit(True))
    facts = sums.join(bad, "doc_id", "left").join(places.groupBy("doc_id").agg(F.count("*").alias("placed")), "doc_id", "left")
    found = F.when(F.col("torn") | F.col("bad").isNotNull() | (F.col("sum") != F.col("pages")), 0).when(F.col("placed") == F.col("n"), 1).otherwise(2)
    facts = facts.select("doc_id", found.alias("found"))
    out = w.join(places.select(*on, "start"), on, "left").join(facts, "doc_id")
    return out.select(*on, F.when(F.col("found") == 1, F.col("start")).alias("start"), "found")
