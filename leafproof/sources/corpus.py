"""The driver's tables projected onto the page model.

pages: one row for each document, numbered within its source and revision, with what a vision model would have read of
it; claims: benchmark passages; audit: events; surfaces: postings and embeddings. The same projection is written in SQL
in plans/oracle.py.

Pages, the places of their terms and their code-like tokens are an index: written once in the shared folder (see store)
and read from there, so that scopes and projections reach a scan and no query tokenises the corpus. Pages are laid out in
ranges of document and page number, terms' places by term. A digest of the code that makes the index is part of its name, so a
change of the projection gets an index of its own.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafproof.functions import text as T
from leafproof.sources import store

#: Tokens of a claim, and codes and summary words that a page's form has at most: the projection's own choice.
CLAIM_TOKENS, FORM_CODES, SUMMARY_TOKENS = 12, 5, 8
#: The kinds of a page. The last one is a reading that is no kind.
KINDS = ("prose", "table", "schematic", "exploded", "cover", "toc", "index", "blank", "Chart")
#: What the index depends on besides the tables.
CODE = hashlib.sha256(b"".join(Path(f).read_bytes() for f in (__file__, T.__file__, store.__file__))).hexdigest()[:12]
PAGES = (
    "row_id bigint, doc_id string, revision string, is_current boolean, has_text boolean, text_trust string, lang string, page_no int, seen string, page_id string, norm string, "
    "codes array<string>, printed_label string, section string, is_start boolean, read_kind string, summary string"
)
POSITIONS, TERMS = "term string, row_id bigint, is_current boolean, places array<int>", "term string, df bigint"
CAPTIONS, CODES = "row_id bigint, term string, tf bigint", "page_id string, doc_id string, revision string, page_no int, is_current boolean, text_trust string, token string, tf bigint"
#: Files of a term's places are dealt by the term's hash; a frequent term's pages go to so many of them.
TERM_BUCKETS, PAGE_SALTS = 64, 16
#: Words whose places one Arrow batch of the positional index holds, unless a page alone has more.
PLACED_WORDS = 100_000
SCHEMAS: dict[tuple[str, str], object] = {}


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (row_id, is_current, norm) as one row a term: term, row_id, is_current, places. A batch is given on as soon as
    it has PLACED_WORDS words, so a task holds that many and one page's, whatever the batches it is given."""
    for b in batches:
        terms: list[str] = []
        rows: list[int] = []
        current: list[bool] = []
        places: list[list[int]] = []
        n = 0
        for row_id, is_current, norm in zip(b.column(0), b.column(1), b.column(2)):
            found: dict[str, list[int]] = defaultdict(list)
            for k, w in enumerate(norm.as_py().split()):
                found[w].append(k)
                n += 1
            terms += found
            places += found.values()
            rows += [row_id.as_py()] * len(found)
            current += [is_current.as_py()] * len(found)
            if n >= PLACED_WORDS:
                yield _term_rows(terms, rows, current, places)
                terms, rows, current, places, n = [], [], [], [], 0
        if terms:
            yield _term_rows(terms, rows, current, places)


def _term_rows(terms: list[str], rows: list[int], current: list[bool], places: list[list[int]]) -> pa.RecordBatch:
    cols = [pa.array(terms, pa.string()), pa.array(rows, pa.int64()), pa.array(current, pa.bool_()), pa.array(places, pa.list_(pa.int32()))]
    return pa.record_batch(cols, names=["term", "row_id", "is_current", "places"])


class Corpus:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        """A given table. Its schema is read once a session and path."""
        path, key = f"{self.sf_dir}/{name}.parquet", (self.spark.sparkContext.applicationId, f"{self.sf_dir}/{name}")
        if key not in SCHEMAS:
            SCHEMAS[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(SCHEMAS[key]).parquet(path)

    @cached_property
    def index(self) -> str:
        """The folder of this corpus's index."""
        made_of = [f"{self.sf_dir}/{t}.parquet" for t in ("documents", "labels")]
        return f"{store.shared_dir(self.spark)}/leafproof/index-{store.signature(self.spark, made_of)}-{CODE}"

    def _make_pages(self) -> DataFrame:
        d = self.table("documents").select(F.col("doc_id").alias("row_id"), "text", "lang", "source")
        revision = F.when(F.col("row_id") % 10 == 9, "0.9").otherwise("1.0")
        # the narrow tables meet first; a text moves twice, to its place and to its order
        slim = d.select("row_id", "source", revision.alias("revision")).distinct()
        known = self.table("labels").select(F.col("doc_id").alias("row_id"), "quality")
        places = store.numbered(slim.join(known, "row_id", "left"), ["source", "revision"], "row_id", "page_no").select(F.col("row_id").alias("_row"), F.col("source").alias("_source"), "page_no", "quality")
        # the places are hashed and ranges are not sorted inside, so no sort holds or spills texts
        d = d.join(places.hint("shuffle_hash"), F.col("row_id").eqNullSafe(F.col("_row")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_row", "_source")
        d = d.repartitionByRange("source", "page_no", "row_id")
        sure = lambda c: F.coalesce(c, F.lit(True))  # noqa: E731  a null source or id is like any other
        has = sure(F.col("source") != "src7") & sure(F.col("row_id") % 17 != 0)
        foot = F.when(F.col("row_id") % 3 == 2, None).when(F.col("row_id") % 29 == 0, F.col("page_no") + 1).otherwise(F.col("page_no"))
        seen = F.concat(F.coalesce("text", F.lit("")), F.coalesce(F.concat(F.lit("\nPage "), foot.cast("string")), F.lit("")))
        trust = F.when(~has, "no_text").when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "untrusted").otherwise("degraded")
        p = d.select(
            "row_id", F.col("source").alias("doc_id"), F.when(F.col("row_id") % 10 == 9, "0.9").otherwise("1.0").alias("revision"), sure(F.col("row_id") % 10 != 9).alias("is_current"),
            has.alias("has_text"), trust.alias("text_trust"), "lang", "page_no", seen.alias("seen"), T.tokens(seen).alias("words"),
        )
        codes = F.slice(F.array_distinct(F.filter("words", T.is_code)), 1, FORM_CODES)
        fake = F.concat(F.lit("k"), (F.col("row_id") % 97).cast("string"))
        label = F.when(F.col("page_no") % 5 == 0, None).when(F.col("row_id") % 13 == 0, F.col("page_no") + 1).otherwise(F.col("page_no"))
        return p.select(
            "*", T.page_id(F.col("doc_id"), F.col("revision"), F.col("page_no")).alias("page_id"),
            T.padded(F.when(F.col("has_text"), F.col("words")).otherwise(F.array())).alias("norm"),
            F.array_distinct(F.concat(codes, F.array(fake))).alias("codes"), label.cast("string").alias("printed_label"),
            F.concat(F.lit("Section "), F.floor((F.col("page_no") - 1) / 7).cast("string")).alias("section"), ((F.col("page_no") - 1) % 7 == 0).alias("is_start"),
            F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("row_id") % len(KINDS)).cast("int")).alias("read_kind"),
            F.when(F.col("row_id") % 19 == 0, "").otherwise(F.array_join(F.slice("words", 1, SUMMARY_TOKENS), " ")).alias("summary"),
        ).drop("words")

    @cached_property
    def forms(self) -> DataFrame:
        """Pages with what a vision model would have read of each: codes (some not printed), a printed label, a section."""
        stored = store.written(self.spark, f"{self.index}/pages", self._make_pages, PAGES)
        return stored.withColumn("text", F.when(F.col("has_text"), F.col("seen")).otherwise(""))

    @cached_property
    def pages(self) -> DataFrame:
        return self.forms.drop("codes", "printed_label", "section", "is_start", "read_kind", "summary")

    @cached_property
    def current(self) -> DataFrame:
        return self.pages.filter("is_current")

    @cached_property
    def searchable(self) -> DataFrame:
        return self.current.filter(~F.col("text_trust").isin("untrusted", "no_text"))

    def _make_positions(self) -> DataFrame:
        store.small_batches(self.spark)
        each = self.forms.filter("has_text").select("row_id", "is_current", "norm").mapInArrow(placed, POSITIONS)
        dealt = each.repartition(F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)), F.pmod("row_id", F.lit(PAGE_SALTS)))
        return dealt.sortWithinPartitions("term", "row_id")

    @cached_property
    def positions(self) -> DataFrame:
        """(term, row_id, is_current, places): where each term is on each page that has text, sorted by term."""
        return store.written(self.spark, f"{self.index}/positions", self._make_positions, POSITIONS)

    @cached_property
    def postings(self) -> DataFrame:
        """(row_id, term, tf) of current pages that have text."""
        return self.positions.filter("is_current").select("row_id", "term", F.size("places").cast("long").alias("tf"))

    def _make_captions(self) -> DataFrame:
        words = self.forms.filter("is_current").select("row_id", F.explode(T.tokens(F.concat_ws(" ", "summary", "section"))).alias("term"))
        tf = words.groupBy("row_id", "term").agg(F.count("*").alias("tf"))
        return tf.repartitionByRange("term", "row_id").sortWithinPartitions("term", "row_id")

    @cached_property
    def captions(self) -> DataFrame:
        """(row_id, term, tf) of current pages' summaries and sections, sorted by term."""
        return store.written(self.spark, f"{self.index}/captions", self._make_captions, CAPTIONS)

    @cached_property
    def terms(self) -> DataFrame:
        """(term, df): in how many current pages a term is."""
        return store.written(self.spark, f"{self.index}/terms", lambda: self.postings.groupBy("term").agg(F.count("*").alias("df")), TERMS)

    def _make_code_tokens(self) -> DataFrame:
        words = F.filter(F.split(F.trim("norm"), " "), lambda w: T.is_code(w))
        each = self.pages.filter("has_text").select("page_id", "doc_id", "revision", "page_no", "is_current", "text_trust", F.explode(words).alias("token"))
        return each.groupBy("page_id", "doc_id", "revision", "page_no", "is_current", "text_trust", "token").agg(F.count("*").alias("tf"))

    @cached_property
    def code_tokens(self) -> DataFrame:
        """(page_id, doc_id, revision, page_no, is_current, text_trust, token, tf): the code-like tokens of pages with
        text."""
        return store.written(self.spark, f"{self.index}/codes", self._make_code_tokens, CODES)

    @cached_property
    def inventory(self) -> DataFrame:
        """(doc_id, token): the distinct code-like tokens of current, trusted pages."""
        here = self.code_tokens.filter(F.col("is_current") & ~F.col("text_trust").isin("untrusted", "no_text"))
        return here.select("doc_id", "token").distinct()

    @cached_property
    def claims(self) -> DataFrame:
        b = self.table("benchmark")
        return b.select("item_id", F.array_join(F.slice(T.tokens(F.col("text")), 1, CLAIM_TOKENS), " ").alias("claim"))

    @cached_property
    def questions(self) -> DataFrame:
        return self.table("conversations").filter("role = 'user'").select("conv_id", "turn", "text")

    @cached_property
    def drafts(self) -> DataFrame:
        """Answers, each naming a code of its conversation's and one that some pages print."""
        said = F.concat("text", F.lit(" K"), (F.col("conv_id") % 97).cast("string"), F.lit(" and 555"))
        return self.table("conversations").filter("role = 'assistant'").select("conv_id", "turn", said.alias("text"))

    @cached_property
    def audit(self) -> DataFrame:
        return self.table("events").select("event_id", "ts", "user_id", F.col("event_type").alias("tool"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"), "props")
