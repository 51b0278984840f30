"""Queries over ingest, publishing, budgets, the answer gate and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from leafproof.functions import text as T
from leafproof.operators import exact, health, ingest, nearmiss, triage
from leafproof.plans.registry import query
from leafproof.plans.search import cites
from leafproof.sources import snapshots, store
from leafproof.sources.corpus import KINDS, Corpus
from leafproof.streaming import control

LADDER = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


# sources


@query
def scan_documents(c: Corpus) -> DataFrame:
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return c.table("pages").select("page_id", title.alias("title"), F.length("html").alias("n_chars"), F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"))


@query
def content_hash(c: Corpus) -> DataFrame:
    return c.table("pages").select("page_id", F.sha2("html", 256).alias("sha256"))


@query
def filename_tags(c: Corpus) -> DataFrame:
    stem = F.regexp_extract("url", "^[^?#]*?([^/?#]+)/?(?:[?#].*)?$", 1)
    tags = F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(stem, "[^A-Za-z0-9]+", " ")), " "), lambda t: t != ""))
    return c.table("pages").select("page_id", F.array_join(tags, ",").alias("tags"))


@query
def manifest_facets(c: Corpus) -> DataFrame:
    """Declared facets first, then the page's own, then the url's."""
    p = c.table("pages")
    own = F.nullif(F.regexp_extract("html", r'<html lang="([a-z]+)"', 1), F.lit(""))
    path = F.nullif(F.regexp_extract("url", r"://[^/]+/([a-z]{2})/", 1), F.lit(""))
    declared = F.when(F.col("page_id") % 11 == 0, "xx")
    return p.select("page_id", F.coalesce(declared, own, path, F.lit("unknown")).alias("lang"))


@query
def facet_disagreement(c: Corpus) -> DataFrame:
    """Pages whose declared language (the manifest's, else the url's) is not the one they say they are in."""
    own = F.nullif(F.regexp_extract("html", r'<html lang="([a-z]+)"', 1), F.lit(""))
    path = F.nullif(F.regexp_extract("url", r"://[^/]+/([a-z]{2})/", 1), F.lit(""))
    p = c.table("pages").select("page_id", own.alias("read"), F.coalesce(F.when(F.col("page_id") % 11 == 0, "xx"), path).alias("declared"))
    return p.filter("read is not null and declared is not null and read != declared")


@query
def store_entries(c: Corpus) -> DataFrame:
    return c.pages.groupBy(F.concat("doc_id", F.lit("@"), "revision", F.lit(".pdf")).alias("entry")).agg(F.count("*").alias("pages"), F.sum(F.octet_length("text")).alias("bytes"))


@query
def replay_cache_hits(c: Corpus) -> DataFrame:
    cache = c.pages.filter("row_id % 3 != 0").select(T.cache_key(F.lit("read"), F.col("page_id")).alias("key"), F.lit(True).alias("hit"))
    asked = c.current.select("page_id", T.cache_key(F.lit("read"), F.col("page_id")).alias("key"))
    return asked.join(cache, "key", "left").groupBy(F.coalesce("hit", F.lit(False)).alias("hit")).agg(F.count("*").alias("n"))


@query
def strict_json_parse(c: Corpus) -> DataFrame:
    """A body parses if it has the declared keys and no other."""
    body = F.when(F.col("event_id") % 7 == 0, F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "x": 1}'))).when(F.col("event_id") % 11 == 0, F.lit("{broken")).otherwise(F.col("props"))
    a = c.table("events").select("event_id", body.alias("body"))
    parsed, keys = F.from_json("body", "k int"), F.json_object_keys("body")
    state = F.when(keys.isNull(), "not_json").when(F.size(F.array_except(keys, F.array(F.lit("k")))) > 0, "unknown_field").when(parsed["k"].isNull(), "missing_field").otherwise("ok")
    return a.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


DECLARED = ST.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "integer").add("title", "string")


@query
def schema_problems(c: Corpus) -> DataFrame:
    have = {f.name: f.dataType.simpleString() for f in c.table("documents").schema}
    want = {f.name: f.dataType.simpleString() for f in DECLARED}
    rows = [(n, "missing" if n not in have else "undeclared" if n not in want else "type") for n in sorted({*have, *want}) if have.get(n) != want.get(n)]
    return c.spark.createDataFrame(rows, "name string, problem string")


@query
def duplicate_pages(c: Corpus) -> DataFrame:
    batch = c.pages.select("page_id").unionByName(c.pages.filter("row_id % 50 = 0").select("page_id"))
    return batch.groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1")


@query
def fingerprint_diff(c: Corpus) -> DataFrame:
    now = c.table("embeddings").agg(F.max(F.size("embedding")).cast("string").alias("dim"))
    stored = F.map_from_arrays(F.array(F.lit("dim"), F.lit("distance"), F.lit("embed_model")), F.array(F.lit("768"), F.lit("cosine"), F.lit("stub")))
    live = F.map_from_arrays(F.array(F.lit("dim"), F.lit("distance"), F.lit("embed_model")), F.array(F.col("dim"), F.lit("cosine"), F.lit("stub")))
    return now.select(F.explode(stored).alias("field", "stored"), live.alias("live")).select("field", "stored", F.element_at("live", F.col("field")).alias("live")).filter("stored != live")


@query
def embed_reuse(c: Corpus) -> DataFrame:
    """Rows whose vector can be used again: there is one, made from the same composition."""
    key = lambda text: T.cache_key(F.lit("embed"), F.md5(text))
    was = F.when(F.col("row_id") % 9 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    have = c.table("embeddings").select(F.col("vec_id").alias("row_id")).join(c.pages.select("row_id", key(was).alias("embed_key")), "row_id").withColumn("reused", F.lit(True))
    return c.pages.select("row_id", key(F.col("text")).alias("embed_key")).join(have, ["row_id", "embed_key"], "left").groupBy(F.coalesce("reused", F.lit(False)).alias("reused")).agg(F.count("*").alias("n"))


@query
def export_labels(c: Corpus) -> DataFrame:
    body = F.to_json(F.struct("page_id", F.col("page_no"), F.col("printed_label"), F.col("section")))
    return c.forms.filter("is_current and printed_label is not null").select("page_id", body.alias("line"))


@query
def export_observed_tokens(c: Corpus) -> DataFrame:
    g = c.inventory.groupBy("doc_id").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return g.select("doc_id", F.to_json(F.struct("doc_id", "tokens")).alias("line"))


@query
def export_complete(c: Corpus) -> DataFrame:
    g = c.pages.groupBy("doc_id", "revision").agg(F.count("*").alias("produced"), F.max("page_no").cast("long").alias("last"))
    return g.select("doc_id", "revision", "produced", (F.col("produced") == F.col("last")).alias("complete"))


@query
def corpus_documents(c: Corpus) -> DataFrame:
    return c.pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.expr("is_current")).alias("current"), F.count_distinct("revision").alias("revisions"), F.count_if(F.expr("has_text and is_current")).alias("with_text"))


@query
def corpus_revisions(c: Corpus) -> DataFrame:
    return c.pages.groupBy("doc_id", "revision").agg((F.count_if(F.expr("is_current")) > 0).alias("is_current"), F.count("*").alias("pages"))


@query
def corpus_pages(c: Corpus) -> DataFrame:
    """A keyset page of each document: at most 20 rows from page 3 on, and where the next begins, if it is full."""
    rows = c.pages.filter("page_no between 3 and 22").select("doc_id", "revision", "page_id", "page_no")
    last = rows.groupBy("doc_id", "revision").agg(F.max("page_no").alias("last"), F.count("*").alias("n"))
    return rows.join(last, ["doc_id", "revision"]).select("page_id", "page_no", F.when(F.col("n") == 20, F.col("last") + 1).alias("next_offset"))


@query
def corpus_totals(c: Corpus) -> DataFrame:
    return c.pages.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("pages"), (F.count_distinct("doc_id") > 10).alias("truncated"))


# health


@query
def searchable_ratio(c: Corpus) -> DataFrame:
    return c.current.groupBy("doc_id").agg(F.round(F.count_if(F.expr("has_text")) / F.count("*"), 6).alias("ratio"))


@query
def grounded_rate(c: Corpus) -> DataFrame:
    return health.rated(c.forms).select("page_id", F.round("rate", 6).alias("rate"))


@query
def codes_in_text(c: Corpus) -> DataFrame:
    return c.forms.select("page_id", F.array_join(health.backed(F.col("codes"), F.col("norm")), "|").alias("codes"))


@query
def ungrounded_codes(c: Corpus) -> DataFrame:
    return c.forms.select("page_id", F.explode(F.array_except("codes", health.backed(F.col("codes"), F.col("norm")))).alias("code"))


@query
def grounded_median(c: Corpus) -> DataFrame:
    return health.rated(c.forms).groupBy("doc_id").agg(F.round(F.median("rate"), 6).alias("median"))


@query
def document_health(c: Corpus) -> DataFrame:
    return health.documents(c.forms).select("doc_id", "revision", "pages", "with_text", F.round("median", 6).alias("median"), F.round("ratio", 6).alias("ratio"), "trust", "fully_scanned", "collapsed")


@query
def text_trust(c: Corpus) -> DataFrame:
    return health.page_trust(c.forms).select("page_id", "trust")


@query
def rate_distribution(c: Corpus) -> DataFrame:
    r = health.rated(c.forms).filter("rate is not null")
    bucket = F.least(F.floor(F.col("rate") * 5), F.lit(4)).cast("int")
    pct = [F.round(F.expr(f"percentile_disc({p}) within group (order by rate)"), 6).alias(f"p{round(p * 100)}") for p in (0.1, 0.5, 0.9)]
    return r.agg(F.count("*").alias("n"), F.round(F.min("rate"), 6).alias("lo"), F.round(F.max("rate"), 6).alias("hi"), F.round(F.avg("rate"), 6).alias("mean"), *pct, *[F.count_if(bucket == k).alias(f"b{k}") for k in range(5)])


@query
def threshold_sweep(c: Corpus) -> DataFrame:
    r = health.rated(c.forms).filter("rate is not null")
    each = r.select("rate", F.explode(F.array(*[F.lit(x) for x in LADDER])).alias("threshold"))
    return each.groupBy("threshold").agg(F.count_if(F.expr("rate < threshold")).alias("below"), F.round(F.count_if(F.expr("rate < threshold")) / F.count("*"), 6).alias("share"))


@query
def threshold_recommend(c: Corpus) -> DataFrame:
    m = health.rated(c.forms).agg(F.median("rate").alias("m"))
    rung = F.array_max(F.filter(F.array(*[F.lit(x) for x in LADDER]), lambda x: x <= F.col("m") - 0.05))
    return m.select(F.round("m", 6).alias("median"), F.least(rung, F.lit(0.8)).alias("threshold"))


@query
def worst_pages(c: Corpus) -> DataFrame:
    return health.rated(c.forms).filter("rate is not null").orderBy("rate", "page_no", "page_id").limit(10).select("page_id", F.round("rate", 6).alias("rate"))


@query
def busiest_pages(c: Corpus) -> DataFrame:
    own = c.code_tokens.filter(F.col("is_current") & ~F.col("text_trust").isin("untrusted", "no_text"))
    return own.groupBy("page_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "page_id").limit(3)


# ingest


def ranges(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """(toc starts, page counts): orders stand in for documents, line numbers and quantities for contents."""
    li = c.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity") * 2).cast("int").alias("start"))
    pages = li.groupBy("doc_id").agg((F.max("start") + F.count("*") * 3).cast("int").alias("pages"))
    return li.filter("doc_id % 3 != 0").distinct(), pages


@query
def window_plan(c: Corpus) -> DataFrame:
    return ingest.plan_windows(*ranges(c))


@query
def ladder_sweep(c: Corpus) -> DataFrame:
    plan = ingest.plan_windows(*ranges(c))
    per = plan.groupBy("doc_id", "level").agg(F.count("*").alias("w"), F.sum(F.col("stop") - F.col("start") + 1).alias("covered")).join(ranges(c)[1], "doc_id")
    return per.groupBy("level").agg(F.count("*").alias("documents"), F.sum("w").alias("windows"), F.count_if(F.expr("covered != pages")).alias("violations"))


@query
def split_oversized(c: Corpus) -> DataFrame:
    return ingest.split_oversized(ranges(c)[1].select("doc_id", F.lit(1).alias("start"), F.col("pages").alias("stop")))


@query
def chapter_ranges(c: Corpus) -> DataFrame:
    return ingest.chapters(*ranges(c))


@query
def pack_windows(c: Corpus) -> DataFrame:
    return ingest.pack(ingest.chapters(*ranges(c)))


@query
def bisect_windows(c: Corpus) -> DataFrame:
    """The plan's windows after extraction, halved and billed again where a page cannot be placed."""
    plan, pages = ingest.plan_windows(*ranges(c)), ranges(c)[1]
    bad = pages.select("doc_id", F.explode(F.sequence(F.lit(1), "pages")).alias("page_no")).filter((F.col("doc_id") + 7 * F.col("page_no")) % 37 == 0)
    return ingest.extracted(plan.drop("level"), bad)


@query
def window_tiling(c: Corpus) -> DataFrame:
    """Each document's windows of thirty pages, put back in their places by the labels known of its pages."""
    f = c.forms.select(F.concat_ws("@", "doc_id", "revision").alias("doc_id"), "page_no", F.col("printed_label").alias("label"))
    forms = f.select("doc_id", F.floor((F.col("page_no") - 1) / 30).alias("win"), ((F.col("page_no") - 1) % 30 + 1).alias("at"), "label")
    return ingest.tilings(forms, f.filter("label is not null"), f.groupBy("doc_id").agg(F.count("*").alias("pages"))).select("doc_id", "win", "start", "found")


@query
def inline_cap(c: Corpus) -> DataFrame:
    """Pages a call may have of each document, whose file is larger than what a call carries inline (here: 20 kB)."""
    size = c.pages.groupBy("doc_id", "revision").agg(F.count("*").alias("pages"), F.sum(F.octet_length("seen")).alias("bytes"))
    return size.select("doc_id", "revision", ingest.inline_cap(F.col("pages"), F.col("bytes"), inline=20_000).alias("cap"))


@query
def page_index_problems(c: Corpus) -> DataFrame:
    """Windows whose answer's page indices are not 1 to N: which ones come twice, lack, or are outside. N is one more
    than asked in every seventh window, and one index is said twice in every fifth."""
    li = c.table("lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("no"))
    said = li.unionByName(li.filter("l_orderkey % 5 = 0 and no = 1"))
    g = said.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("no")).alias("said"), F.count_distinct("no").alias("d"))
    n = F.when(F.col("l_orderkey") % 7 == 0, F.col("d") + 1).when(F.col("l_orderkey") % 11 == 0, F.col("d") - 1).otherwise(F.col("d")).cast("int")
    every = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.greatest("n", F.lit(1)))).otherwise(F.array().cast("array<int>"))
    once = F.array_distinct("said")
    twice = F.filter(once, lambda x: F.size(F.filter("said", lambda y: y == x)) > 1)
    lists = {"duplicate": twice, "missing": F.array_except(every, once), "outside": F.array_except(once, every)}
    out = g.withColumn("n", n).select("l_orderkey", *[F.array_join(v.cast("array<string>"), ",").alias(k) for k, v in lists.items()])
    return out.filter("duplicate != '' or missing != '' or outside != ''")


@query
def extraction_counts(c: Corpus) -> DataFrame:
    return c.forms.groupBy("doc_id", F.floor((F.col("page_no") - 1) / 30).alias("window")).agg(F.count("*").alias("forms"), F.sum(F.size("codes")).alias("codes"))


@query
def form_page_join(c: Corpus) -> DataFrame:
    forms = c.table("lineitem").select((F.col("l_orderkey") % 1000).alias("row_id"), "l_linenumber").distinct()
    p = c.pages.select("row_id", "page_no")
    return forms.join(p, (forms["row_id"] == p["row_id"]) & (forms["l_linenumber"] == p["page_no"])).select(p["row_id"], "page_no")


@query
def missing_pages(c: Corpus) -> DataFrame:
    have = c.table("lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("no")).distinct()
    want = have.groupBy("l_orderkey").agg(F.max("no").alias("n")).select("l_orderkey", F.explode(F.sequence(F.lit(1), "n")).alias("no"))
    return want.join(have, ["l_orderkey", "no"], "left_anti")


@query
def offset_witness(c: Corpus) -> DataFrame:
    s = ingest.sightings(c.forms)
    return s.select("page_id", "code", "here", "on_prev", "on_next")


@query
def label_witnesses(c: Corpus) -> DataFrame:
    return ingest.label_witnesses(c.forms).select("page_id", "label", "confirms", "witness", F.array_join(F.col("printed_on").cast("array<string>"), ",").alias("printed_on"))


@query
def offset_check(c: Corpus) -> DataFrame:
    return ingest.offset_check(c.forms)


@query
def reattribute_codes(c: Corpus) -> DataFrame:
    return ingest.reattribute(c.forms)


@query
def interpolate_labels(c: Corpus) -> DataFrame:
    return ingest.interpolate(c.forms).select("page_id", "label", "interpolated")


@query
def label_monotonic(c: Corpus) -> DataFrame:
    return ingest.drops(c.forms)


@query
def attribute_labels(c: Corpus) -> DataFrame:
    """Of the model's label and the file's, the one the text confirms; else the only one; else both are candidates."""
    file = F.when(F.col("row_id") % 3 != 0, F.col("page_no").cast("string"))
    a, b, norm = F.col("printed_label"), F.col("file"), F.col("norm")
    seen = lambda x: F.coalesce(T.printed(norm, x), F.lit(False))
    label = F.when(a.eqNullSafe(b), a).when(seen(a) & ~seen(b), a).when(seen(b) & ~seen(a), b).when(a.isNull(), b).when(b.isNull(), a)
    return c.forms.withColumn("file", file).select("page_id", label.alias("label"), (label.isNull() & a.isNotNull()).alias("ambiguous"))


@query
def page_neighbours(c: Corpus) -> DataFrame:
    """The ids of the pages before and after, within 1 and the document's last page: made, not looked up."""
    size = c.pages.groupBy("doc_id", "revision").agg(F.max("page_no").alias("last"))
    at = lambda d: T.page_id(F.col("doc_id"), F.col("revision"), F.col("page_no") + d)
    return c.pages.select("page_id", "doc_id", "revision", "page_no").join(size, ["doc_id", "revision"]).select("page_id", F.when(F.col("page_no") > 1, at(-1)).alias("prev_page"), F.when(F.col("page_no") < F.col("last"), at(1)).alias("next_page"))


@query
def resolve_bracket(c: Corpus) -> DataFrame:
    """Pages without a label between pages labelled n - 1 and n + 1, two apart."""
    f = c.forms.select("page_id", "doc_id", "revision", "page_no", F.col("printed_label").cast("long").alias("n"))
    lo = f.select("doc_id", "revision", (F.col("page_no") + 1).alias("page_no"), F.col("n").alias("lo"))
    hi = f.select("doc_id", "revision", (F.col("page_no") - 1).alias("page_no"), F.col("n").alias("hi"))
    on = ["doc_id", "revision", "page_no"]
    return f.filter("n is null").join(lo, on).join(hi, on).filter("hi - lo = 2").select("page_id", (F.col("lo") + 1).alias("label"))


@query
def resolve_label(c: Corpus) -> DataFrame:
    """The pages that each label leads to: the number of every page, alone and as a citation of a longer document."""
    no = c.forms.filter("is_current").select(F.col("page_no").cast("string").alias("no")).distinct()
    labels = no.select(F.explode(F.array(F.col("no"), F.concat(F.lit("Page "), F.col("no"), F.lit(" of 9999")))).alias("label"))
    return exact.resolve_all(c.forms, labels, c.positions, c.terms)


@query
def stitch_sections(c: Corpus) -> DataFrame:
    return ingest.stitched(c.forms).select("doc_id", "revision", "section", "title", "first", "last", "pages", F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"))


@query
def section_contiguity(c: Corpus) -> DataFrame:
    return ingest.stitched(c.forms.filter("row_id % 23 != 0")).select("doc_id", "revision", "section", "contiguous", "straddles", "uncertain")


@query
def section_ordinals(c: Corpus) -> DataFrame:
    return ingest.stitched(c.forms).select("doc_id", "revision", "section", "ordinal")


@query
def stitch_pages(c: Corpus) -> DataFrame:
    s = ingest.stitched(c.forms).select("doc_id", "revision", "section", "ordinal")
    return c.forms.join(s, ["doc_id", "revision", "section"]).select("page_id", T.section_id(F.col("doc_id"), F.col("revision"), F.col("ordinal")).alias("section_id"))


@query
def page_kind(c: Corpus) -> DataFrame:
    """A reading that is none of the kinds, letter by letter, is prose."""
    return c.forms.groupBy(F.when(F.col("read_kind").isin(*KINDS[:-1]), F.col("read_kind")).otherwise("prose").alias("kind")).agg(F.count("*").alias("n"))


@query
def missing_summary_langs(c: Corpus) -> DataFrame:
    return c.forms.select("page_id", F.array_join(F.array_except(F.array("lang", F.lit("en")), F.array(F.when(F.col("row_id") % 2 == 0, F.col("lang")).otherwise("en"))), ",").alias("missing"))


@query
def caption_terms(c: Corpus) -> DataFrame:
    own = T.tokens(F.col("text"))
    words = F.filter(T.tokens(F.concat_ws(" ", "summary", "section")), lambda t: ~F.array_contains(own, t))
    return c.forms.select("page_id", F.array_join(words, " ").alias("terms"))


@query
def compose_embedding_text(c: Corpus) -> DataFrame:
    """The parts that a page's vector is made of: titles, section, summary, topics, codes, the text's beginning; empty
    ones are left out, and within topics and codes what is there before."""
    topics = F.slice(F.split(F.trim("norm"), " "), 9, 4)
    once = lambda x, by: F.array_join(F.array_distinct(F.filter(F.transform(x, lambda v: F.trim(v)), lambda v: v != "")), by)
    parts = F.filter(F.array(F.col("doc_id"), F.trim("section"), F.trim("summary"), once(topics, "; "), once(F.col("codes"), " "), F.expr("substring(trim(text), 1, 2000)")), lambda p: p != "")
    return c.forms.select("page_id", F.size(parts).alias("parts"), F.md5(F.array_join(parts, "\n")).alias("digest"))


@query
def derive_pages(c: Corpus) -> DataFrame:
    """Each page's record flags, sorted."""
    f = ingest.interpolate(c.forms)
    flags = F.array_compact(F.array(F.when(~F.col("has_text"), "no_text"), F.when(F.size(F.array_except("codes", health.backed(F.col("codes"), F.col("norm")))) > 0, "ungrounded_codes"), F.when(F.col("interpolated"), "label_interpolated")))
    return f.select("page_id", "label", F.array_join(F.array_sort(F.array_distinct(flags)), ",").alias("flags"), F.size("codes").alias("n_codes"), F.round(health.grounded_rate(F.col("codes"), F.col("norm"), F.col("has_text")), 6).alias("rate"))


WORST = 10


def records(c: Corpus) -> DataFrame:
    """The forms that extraction gave back: a page in forty-one has none."""
    return c.forms.filter("row_id % 41 != 0")


def gates(c: Corpus) -> DataFrame:
    """Per document revision, a row for each of the five gates: gate, passed, blocking, skipped, metric, threshold,
    flag, evidence (of a gate that does not pass: the first pages or windows in question).

    Coverage, offsets and grounding block; text coverage and label order never do, they flag. Grounding is skipped for
    a document without any text.
    """
    on = ["doc_id", "revision"]
    got = records(c)
    h = health.documents(got)
    pages = c.pages.select(*on, "page_no", F.lit(True).alias("here"))
    lost = c.pages.join(got.select(*on, "page_no"), [*on, "page_no"], "left_anti")
    worst = lambda df, by, show: df.groupBy(*on).agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(*by, F.col(show).cast("string").alias("show")))), 1, WORST), lambda x: x["show"]), ",").alias("evidence"))
    top = lambda df, by: df.withColumn("n_", F.row_number().over(Window.partitionBy(*on).orderBy(*by))).filter(F.col("n_") <= WORST)  # noqa: E731  so few rows that they may meet
    cover = pages.groupBy(*on).agg(F.count("*").alias("n")).join(got.groupBy(*on).agg(F.count("*").alias("m")), on, "left").join(worst(top(lost, ["page_no"]), ["page_no"], "page_no"), on, "left")
    windows = ingest.offset_check(got)
    off = windows.groupBy(*on).agg(F.count("*").alias("n"), F.count_if(F.col("shifted")).alias("bad"))
    off = off.join(worst(top(windows.filter("shifted"), ["window"]), ["window"], "window"), on, "left")
    weak = top(health.rated(got).filter("rate is not null").select(*on, "rate", "page_no", "page_id"), ["rate", "page_no"])
    ground = h.join(worst(weak, ["rate", "page_no"], "page_id"), on, "left")
    order = got.select(*on).distinct().join(ingest.drops(got), on, "left")

    def gate(df: DataFrame, name: str, passed, blocking: bool, metric, threshold, flag=None, skipped=None, evidence=None) -> DataFrame:
        shown = F.when(~passed, F.coalesce(evidence, F.lit(""))).otherwise("") if evidence is not None else F.lit("")
        return df.select(
            *on, F.lit(name).alias("gate"), passed.alias("passed"), F.lit(blocking).alias("blocking"), (F.lit(False) if skipped is None else skipped).alias("skipped"),
            F.round(metric.cast("double"), 6).alias("metric"), F.lit(threshold).cast("double").alias("threshold"), F.when(~passed, flag).alias("flag") if flag else F.lit(None).cast("string").alias("flag"), shown.alias("evidence"),
        )

    e, m = F.col("evidence"), F.coalesce("m", F.lit(0))
    none = F.col("fully_scanned")
    parts = [
        gate(cover, "window_coverage", m == F.col("n"), True, m / F.col("n"), 1.0, evidence=e),
        gate(off, "offset_check", F.col("bad") == 0, True, (F.col("n") - F.col("bad")) / F.col("n"), 1.0, evidence=e),
        gate(ground, "grounded_rate", none | F.coalesce(F.col("median") >= health.OK, F.lit(False)), True, F.col("median"), health.OK, skipped=none, evidence=e),
        gate(h, "text_coverage", F.col("ratio") >= 0.5, False, F.col("ratio"), None, "mostly_scanned"),
        gate(order, "label_monotonic", F.coalesce("drops", F.lit(0)) == 0, False, F.coalesce("drops", F.lit(0)), 0.0, "label_conflict"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def publish_gates(c: Corpus) -> DataFrame:
    return gates(c)


@query
def gate_failures(c: Corpus) -> DataFrame:
    """Gauges: how many documents fail each gate, and the least metric."""
    return gates(c).groupBy("gate").agg(F.count_if(~F.col("passed")).alias("failures"), F.count_if(F.col("skipped")).alias("skipped"), F.min("metric").alias("least"))


def overrides(c: Corpus) -> DataFrame:
    """Releases that were asked for: gate and reason."""
    rows = [("src1", "grounded_rate", "checked by hand"), ("src2", "grounded_rate", "  "), ("src3", "window_coverage", "let it go"), ("src6", "grounded_rate", "known scans")]
    return c.spark.createDataFrame(rows, "doc_id string, over string, why string")


def decided(c: Corpus) -> DataFrame:
    """Blocking failures less overrides. Only grounding may be overridden, and only with a reason; other requests are
    refused and change nothing."""
    bad = gates(c).groupBy("doc_id", "revision").agg(
        F.array_sort(F.collect_set(F.when(F.col("blocking") & ~F.col("passed"), F.col("gate")))).alias("failed"), F.array_sort(F.collect_set("flag")).alias("flags")
    )
    d = bad.join(F.broadcast(overrides(c)), "doc_id", "left")
    refusal = F.when(F.col("over") != "grounded_rate", "override_not_allowed").when(F.trim("why") == "", "override_reason_required")
    d = d.withColumn("refused", refusal)
    used = F.col("over").isNotNull() & F.col("refused").isNull() & F.array_contains("failed", "grounded_rate")
    d = d.withColumn("used", F.coalesce(used, F.lit(False)))
    d = d.withColumn("left", F.when(F.col("used"), F.array_remove("failed", "grounded_rate")).otherwise(F.col("failed")))
    flags = F.when(F.col("used"), F.array_union("flags", F.array(F.lit("published_with_override")))).otherwise(F.col("flags"))
    return d.select("doc_id", "revision", "left", "refused", F.array_join(F.array_sort(flags), ",").alias("flags"))


@query
def gate_decision(c: Corpus) -> DataFrame:
    return decided(c).select("doc_id", "revision", F.array_join("left", ",").alias("blocking"), (F.size("left") == 0).alias("publish"), "refused", "flags")


# publishing and control plane


def runs(c: Corpus) -> DataFrame:
    """Events as run records: run by order of time, a document by user, a state by type."""
    a = c.audit
    return a.select(F.concat(F.lit("r"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("run_id"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("doc"), F.col("tool").alias("state"), "ts", "value", "k")


@query
def run_history(c: Corpus) -> DataFrame:
    """The twenty newest runs of each document."""
    w = Window.partitionBy("doc").orderBy(F.desc("ts"), F.desc("run_id"))
    return runs(c).withColumn("nth", F.row_number().over(w)).filter("nth <= 20").select("doc", "nth", "run_id", "state")


@query
def run_latest(c: Corpus) -> DataFrame:
    return runs(c).groupBy("doc").agg(F.max("run_id").alias("run_id"), F.max_by("state", "run_id").alias("state"))


@query
def window_latest(c: Corpus) -> DataFrame:
    return runs(c).groupBy("doc", (F.col("k") % 4).alias("start")).agg(F.max_by("state", "run_id").alias("state"), F.count("*").alias("writes"))


@query
def gate_gauges(c: Corpus) -> DataFrame:
    done = runs(c).filter("state = 'purchase'")
    return done.groupBy("doc").agg(F.round(F.max_by("value", "run_id"), 4).alias("last_value"), F.count_if(F.expr("value < 5")).alias("failures"))


@query
def current_pointer(c: Corpus) -> DataFrame:
    point = runs(c).filter("state = 'purchase'").groupBy("doc").agg(F.max("run_id").alias("run_id"))
    return c.pages.join(point, F.col("doc_id") == F.col("doc"), "left").select("page_id", (F.col("run_id").isNotNull() & (F.col("revision") == "1.0")).alias("is_current"))


@query
def publish_state(c: Corpus) -> DataFrame:
    """A document without a blocking failure is current, or superseded if another revision is; others are held."""
    ok = F.size("left") == 0
    return decided(c).select("doc_id", "revision", F.when(ok & (F.col("revision") == "1.0"), "current").when(ok, "superseded").otherwise("held").alias("state"))


@query
def retirement_counts(c: Corpus) -> DataFrame:
    return c.pages.groupBy("doc_id").agg(F.count_if(F.expr("revision = '1.0' and row_id % 6 = 0")).alias("deleted"), F.count_if(F.expr("revision <> '1.0'")).alias("demoted"), F.count_if(F.expr("revision = '1.0' and row_id % 6 <> 0")).alias("kept"))


SNAPSHOT_PAGES = "page_id string, doc_id string, revision string, page_no int, text_trust string"


def published(c: Corpus) -> snapshots.Snapshots:
    """Three runs published one after another: the older revisions, the newer ones, and the newer ones again with pages
    gone. Documents whose pages are off are held back and not flipped; the other gates are released here, as few documents
    of these tables pass them all."""
    shots = snapshots.Snapshots(c.spark, f"{store.shared_dir(c.spark)}/leafproof/published-{uuid.uuid4().hex}", SNAPSHOT_PAGES)
    decisions = store.durable(decided(c).select("doc_id", "revision", (~F.array_contains("left", "offset_check")).alias("publish"), F.split("flags", ",").alias("flags")), "decisions")
    for run, part in (("r1", "revision = '0.9'"), ("r2", "revision = '1.0'"), ("r3", "revision = '1.0' and row_id % 6 != 0")):
        shots.publish(run, c.pages.filter(part).select(*[x.split()[0] for x in SNAPSHOT_PAGES.split(", ")]), decisions)
    return shots


@query
def publish_snapshot(c: Corpus) -> DataFrame:
    """What readers see after the last commit: each document revision's run, whether it is current, its pages and flags."""
    p = published(c).pages()
    return p.groupBy("doc_id", "revision", "run", "is_current").agg(F.count("*").alias("pages"), F.array_join(F.first("flags"), ",").alias("flags"))


@query
def publish_records(c: Corpus) -> DataFrame:
    """What each run published and retired."""
    shots, out = published(c), None
    for run in ("r1", "r2", "r3"):
        one = c.spark.read.schema(snapshots.RECORD).parquet(f"{shots.root}/runs/run={run}").drop("published_at").withColumn("run", F.lit(run))
        out = one if out is None else out.unionByName(one)
    return out


LEASE_MS, QUOTA, PER_QUESTION = 6 * 3_600_000, 3, 2


def commands(c: Corpus) -> DataFrame:
    """Events as commands to fifty runs."""
    k, tool = F.col("k"), F.col("tool")
    kind = F.when(tool == "view", "renew").when(tool == "click", "claim").when(tool == "purchase", "start").when(tool == "signup", "stop").when(k % 2 == 0, "fail").otherwise("override")
    name = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    return c.audit.select(
        name("r", F.col("user_id") % 50).alias("run"), "event_id", F.expr("unix_millis(cast(ts as timestamp))").alias("ms"), kind.alias("kind"),
        name("w", k % 3).alias("owner"), (k % 10 == 0).alias("steal"), F.when(k % 4 == 1, " ").otherwise("checked by hand").alias("reason"),
    )


@query
def lease_log(c: Corpus) -> DataFrame:
    """What becomes of every command and lease."""
    log = commands(c)
    return control.replayed(log, log.agg(F.max("ms")).first()[0], LEASE_MS)


@query
def lease_states(c: Corpus) -> DataFrame:
    """The last state of each run: what a resume finds."""
    last = F.max_by(F.struct("state", "owner", "expires"), F.struct("ms", "event_id")).alias("s")
    return lease_log(c).filter("event_id >= 0").groupBy("run").agg(last, F.count("*").alias("commands"), F.count_if(F.col("outcome").isin("ok", "stolen")).alias("taken")).select("run", "s.*", "commands", "taken")


@query
def call_admission(c: Corpus) -> DataFrame:
    """Which paid calls are admitted, with the least of a user's quota a day and a question's budget."""
    calls = c.audit.filter("tool != 'view'").select(F.col("user_id").alias("caller"), F.date_format("ts", "yyyy-MM-dd").alias("period"), (F.col("k") % 3).alias("question"), F.col("ts").alias("at"), F.col("event_id").alias("call_id"))
    return control.admitted(calls, QUOTA, PER_QUESTION).select("call_id", "caller", "period", "question", "admitted", "reason", "reads_remaining")


@query
def stamp_flags(c: Corpus) -> DataFrame:
    old = F.array(F.lit("seen"), F.col("text_trust"))
    return c.pages.select("page_id", F.array_join(F.array_distinct(F.concat(old, F.array(F.when(F.col("is_current"), "seen").otherwise("old"), F.col("lang")))), ",").alias("flags"))


@query
def hash_mismatch(c: Corpus) -> DataFrame:
    want = c.pages.select("page_id", F.when(F.col("row_id") % 40 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("text", 256)).alias("expected"))
    return c.pages.join(want, "page_id").filter(F.sha2("text", 256) != F.col("expected")).select("page_id")


@query
def audit_log(c: Corpus) -> DataFrame:
    return c.audit.groupBy("user_id", "tool").agg(F.count("*").alias("calls"), F.round(F.max("value"), 4).alias("latency"))


@query
def budget_remaining(c: Corpus) -> DataFrame:
    spent = c.audit.filter("tool = 'purchase'").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("period")).agg(F.count("*").alias("spent"))
    return spent.select("user_id", "period", "spent", F.greatest(F.lit(0), 2 - F.col("spent")).alias("remaining"), (F.col("spent") > 2).alias("refused"))


@query
def unknown_scope_keys(c: Corpus) -> DataFrame:
    asked = F.array(F.lit("doc_id"), F.concat(F.lit("k"), (F.col("k") % 5).cast("string")), F.lit("lang"))
    return c.audit.groupBy(F.array_join(F.array_except(asked, F.array(*[F.lit(x) for x in exact.SCOPE_KEYS])), ",").alias("unknown")).agg(F.count("*").alias("n"))


# the answer gate and the runner


def draft_verdicts(c: Corpus) -> DataFrame:
    """Each draft's claims, the codes its prose names, on the pages it cites, in their order."""
    claims = c.drafts.select("conv_id", "turn", F.explode(F.array_distinct(F.filter(T.tokens(F.col("text")), T.is_code))).alias("claim"))
    cited = cites(c, c.drafts, F.col("conv_id") + F.col("turn"), ["conv_id", "turn"])
    return triage.verdicts(claims.join(cited, ["conv_id", "turn"]), c.pages, ["conv_id", "turn"], c.positions)


@query
def draft_claims(c: Corpus) -> DataFrame:
    prose = c.drafts.select("conv_id", "turn", F.explode(F.array_distinct(F.filter(T.tokens(F.col("text")), T.is_code))).alias("claim"))
    declared = prose.filter("claim like 'k%' and turn % 4 = 1")
    return declared.withColumn("declared", F.lit(True)).unionByName(prose.join(declared, ["conv_id", "turn", "claim"], "left_anti").withColumn("declared", F.lit(False)))


@query
def answer_gate(c: Corpus) -> DataFrame:
    """Each claim of a draft with its verdict and the page it rests on; one that no page prints rejects the draft."""
    f = triage.folded(draft_verdicts(c), ["conv_id", "turn"])
    bad = f.groupBy("conv_id", "turn").agg((F.count_if(F.col("state") == "absent") > 0).alias("rejected"))
    return f.join(bad, ["conv_id", "turn"])


def rungs(c: Corpus) -> DataFrame:
    """The searches of a conversation: each answer's, over the current pages of one source."""
    by = c.current.groupBy(F.col("doc_id").alias("doc")).agg(F.count("*").alias("pages"), F.count_if(~F.col("has_text")).alias("no_text"))
    asked = c.drafts.select("conv_id", F.col("turn").alias("place"), F.concat(F.lit("src"), ((F.col("conv_id") + F.col("turn")) % 20).cast("string")).alias("doc"))
    got = asked.join(by, "doc", "left").fillna(0, ["pages", "no_text"])
    blind = F.when(F.col("no_text") > 0, F.array("doc")).otherwise(F.array().cast("array<string>"))
    return got.select("conv_id", "place", F.array("doc").alias("docs"), "pages", "no_text", F.when(F.col("conv_id") % 3 == 0, F.col("no_text")).otherwise(F.col("place") % 2).alias("looked"), blind.alias("blind"))


@query
def coverage_merge(c: Corpus) -> DataFrame:
    m = triage.merged(rungs(c), "conv_id")
    return m.select("conv_id", F.array_join("docs", ",").alias("docs"), F.array_join("blind", ",").alias("blind"), "pages", "no_text", "looked", (F.col("no_text") <= F.col("looked")).alias("complete"))


@query
def abstention_text(c: Corpus) -> DataFrame:
    reason = F.get(F.array(*[F.lit(r) for r in triage.LEADS]), (F.col("conv_id") % len(triage.LEADS)).cast("int"))
    return triage.merged(rungs(c), "conv_id").select("conv_id", triage.abstention(reason).alias("text"))


@query
def read_stamps(c: Corpus) -> DataFrame:
    """Codes that a reading returned, stamped printed or not."""
    return c.forms.select("page_id", F.explode("codes").alias("code"), "norm").select("page_id", "code", T.printed(F.col("norm"), F.col("code")).alias("printed"))


# evaluation


@query
def near_misses(c: Corpus) -> DataFrame:
    """A hundred fakes that no page prints in any spelling, one for each source in turn; a source whose fake an earlier
    one has taken draws again."""
    return nearmiss.near_misses(c.inventory.select("token").distinct(), c.positions, 100, c.terms)


@query
def abstention_correctness(c: Corpus) -> DataFrame:
    sample = near_misses(c).select(F.col("fake").alias("claim"), F.monotonically_increasing_id().alias("item_id"))
    hits = exact.lookup_summary(c.pages, sample, positions=c.positions, terms=c.terms)
    return hits.agg(F.count("*").alias("sample"), F.count_if(F.expr("total = 0")).alias("abstained"), F.round(F.coalesce(F.count_if(F.expr("total = 0")) / F.count("*"), F.lit(0.0)), 6).alias("correctness"))


def emitted(c: Corpus) -> DataFrame:
    return c.forms.select("page_id", F.explode("codes").alias("code"))


@query
def dropped_codes(c: Corpus) -> DataFrame:
    accepted = emitted(c).filter("code like '%1%'")
    withheld = emitted(c).filter("code like 'k%'")
    return emitted(c).join(accepted, ["page_id", "code"], "left_anti").join(withheld, ["page_id", "code"], "left_anti")


@query
def gains_by_code(c: Corpus) -> DataFrame:
    d = dropped_codes(c).join(c.pages.select("page_id", "norm"), "page_id").filter(T.printed(F.col("norm"), F.col("code")))
    return d.groupBy("code").agg(F.count("*").alias("pages"), F.min("page_id").alias("first"))


@query
def parity_containment(c: Corpus) -> DataFrame:
    """Accepted codes that a lookup finds on each page they were accepted on."""
    accepted = emitted(c).join(c.searchable.select("page_id", "norm"), "page_id").filter(F.col("norm").contains(F.concat(F.lit(" "), F.col("code"), F.lit(" "))))
    hits = c.searchable.select("page_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("code"), F.lit(1).alias("hit"))
    return accepted.select("page_id", "code").join(hits, ["page_id", "code"], "left").groupBy("code").agg((F.count_if(F.expr("hit is null")) == 0).alias("contained"))


@query
def table_symdiff(c: Corpus) -> DataFrame:
    a = c.forms.select("page_id", F.col("printed_label").alias("label"))
    b = c.forms.select("page_id", F.col("page_no").cast("string").alias("label"))
    return a.exceptAll(b).withColumn("side", F.lit("read")).unionByName(b.exceptAll(a).withColumn("side", F.lit("true")))


@query
def acceptance_rows(c: Corpus) -> DataFrame:
    """Expected verdicts of benchmark claims against what verification says."""
    expected = c.claims.select("item_id", "claim", F.when(F.col("item_id") % 2 == 0, "ok").otherwise("not_found").alias("expected"))
    got = exact.lookup_summary(c.pages, c.claims, positions=c.positions, terms=c.terms).select("item_id", "status")
    return expected.join(got, "item_id").select("item_id", "expected", "status", (F.col("expected") == F.col("status")).alias("passed"))
