"""Ranked lexical search over postings that are dealt to buckets by term.

`index` reads each text once. A task packs its documents in chunks of CHUNK_DOCS documents or CHUNK_TERMS terms: a row
is one term in one chunk, with the documents that hold it, how often each does, and how many terms each has. Rows are
written to the shared folder, by bucket of the term and sorted by term, so a search reads its terms' buckets and row
groups alone. A frequent term has a row a chunk; its rows are spread over SALTS tasks, and no row outgrows a chunk.

`search` joins the items' terms with the postings, scores each match in 64-bit integers, sums by item and document, and
keeps each item's best k by a window. All rows of a chunk meet in one task before they are unpacked, so the sums need no
further shuffle, and Spark's group limit leaves k rows of an item in each task for the last one. Items are taken in
blocks whose terms fit in a broadcast of BROADCAST_TERMS rows: every item meets all postings, whatever their number.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafproof.sources.store import shared_dir

from .common import TO_LOWER, durable

#: What a term is made of, and what parts terms.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Code points that are split into terms at once; a slice ends where no term goes on.
SLICE = 1 << 20
CHUNK_DOCS, CHUNK_TERMS = 4096, 1 << 20
BUCKETS, SALTS = 32, 8
#: Rows of (item, term) in one block of items: some 60 MB when broadcast.
BROADCAST_TERMS = 1_000_000


def terms_of(text: str | None) -> Iterator[list[str]]:
    """The terms of a text in order, a list a slice; only A-Z are lower-cased."""
    at, text = 0, text or ""
    while at < len(text):
        gap = GAP.search(text, at + SLICE) if at + SLICE < len(text) else None
        end = gap.start() if gap else len(text)
        yield TERM.findall(text[at:end].translate(TO_LOWER))
        at = end


class Chunk:
    """Documents of one task, turned from documents with terms into terms with documents."""

    def __init__(self):
        self.vocab: defaultdict[str, int] = defaultdict()
        self.vocab.default_factory = self.vocab.__len__
        self.ids: list = []
        self.copies: Counter = Counter()
        self.nth: list[int] = []
        self.sizes: list[int] = []
        self.tokens = 0
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_id: object, text: str | None) -> None:
        find = self.vocab.__getitem__
        parts = [np.fromiter(map(find, words), dtype=np.int64, count=len(words)) for words in terms_of(text) if words]
        if not parts:
            return
        codes, counts = np.unique(np.concatenate(parts), return_counts=True)
        self.ids.append(doc_id)
        self.nth.append(self.copies[doc_id])
        self.copies[doc_id] += 1
        self.sizes.append(sum(map(len, parts)))
        self.tokens += self.sizes[-1]
        self.codes.append(codes)
        self.counts.append(counts)

    def full(self) -> bool:
        return len(self.ids) >= CHUNK_DOCS or self.tokens >= CHUNK_TERMS

    def rows(self, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The chunk's postings, and one row without a term: how many documents and terms it has."""
        if not self.ids:
            return
        of = lambda name: schema.field(name).type.value_type
        total = [[None], [number], [[]], [[]], [[len(self.ids)]], [[sum(self.sizes)]]]
        yield pa.record_batch([pa.array(v, type=f.type) for v, f in zip(total, schema)], schema=schema)
        codes = np.concatenate(self.codes)
        places = np.repeat(np.arange(len(self.ids)), [len(c) for c in self.codes])
        order = np.argsort(codes, kind="stable")
        places, tf = places[order], np.concatenate(self.counts)[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.vocab)))]).astype(np.int32)
        at, names, n = pa.array(places), list(self.vocab), np.array(self.sizes)
        ids, nth = pa.array(self.ids, type=of("ids")).take(at), np.array(self.nth)[places]
        for a in range(0, len(names), 50_000):
            b = min(len(names), a + 50_000)
            cut, first, last = pa.array(ends[a : b + 1] - ends[a]), ends[a], ends[b]
            lists = [ids.slice(first, last - first)] + [pa.array(x[first:last], type=of(c)) for x, c in ((nth, "nth"), (tf, "tf"), (n[places], "n"))]
            cols = [pa.array(names[a:b]), pa.array(np.full(b - a, number))] + [pa.ListArray.from_arrays(cut, x) for x in lists]
            yield pa.record_batch([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)


@dataclass
class Index:
    postings: DataFrame  # bucket, term, chunk, ids, nth, tf, n
    documents: int
    terms: int


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def index(docs: DataFrame) -> Index:
    """The postings of all documents (doc_id, text), written to the shared folder.

    A row is a document: rows that share an id, or are equal, are told apart; a null id is an id like others. Null or
    empty texts, or texts without a term, have no postings and count nowhere. Empty docs give an empty index. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    ddl = f"term string, chunk bigint, ids array<{kind.simpleString()}>, nth array<int>, tf array<int>, n array<int>"
    lists = [("ids", to_arrow_type(kind)), ("nth", pa.int32()), ("tf", pa.int32()), ("n", pa.int32())]
    schema = pa.schema([("term", pa.string()), ("chunk", pa.int64()), *[(name, pa.list_(t)) for name, t in lists]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 32, Chunk()  # a rerun task numbers alike
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                chunk.add(doc_id, text.as_py())
                if chunk.full():
                    yield from chunk.rows(number, schema)
                    number, chunk = number + 1, Chunk()
        yield from chunk.rows(number, schema)

    packed = docs.select("doc_id", "text").mapInArrow(pack, ddl).withColumn("bucket", bucket(F.col("term")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = packed.repartition(parts, "bucket", F.pmod("chunk", F.lit(SALTS))).sortWithinPartitions("bucket", "term", "chunk")
    path = f"{shared_dir(spark)}/leafproof/postings-{uuid.uuid4().hex}"
    dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(path)
    stored = spark.read.schema(dealt.schema).parquet(path)
    totals = stored.filter("term is null").agg(F.coalesce(F.sum(F.get("tf", F.lit(0))), F.lit(0)).alias("d"), F.coalesce(F.sum(F.get("n", F.lit(0)).cast("long")), F.lit(0)).alias("t")).first()
    return Index(stored.filter("term is not null"), totals.d, totals.t)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, tf): how often an item asks for a term. Equal rows ask once; rows that share only an id ask for
    both texts."""
    kind = items.schema["item_id"].dataType.simpleString()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item_id, text in zip(b["item_id"], b["text"]):
                found = Counter(w for words in terms_of(text) for w in words)
                rows += [(item_id, w, n) for w, n in found.items()]
            yield pd.DataFrame(rows, columns=["item_id", "term", "tf"])

    each = items.select("item_id", "text").distinct()
    # the id travels as text: pandas would make floats of whole numbers beside a null
    each = each.withColumn("item_id", F.col("item_id").cast("string")).mapInPandas(counted, "item_id string, term string, tf bigint")
    return each.groupBy(F.col("item_id").cast(kind).alias("item_id"), "term").agg(F.sum("tf").alias("tf"))


def search(found: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item (item_id, text) with a score above 0.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))); a document's match of it counts weight *
    ((10^9 tf) div (1000 tf + 8 m)), m = 25 + (75 n N) div L, for each time the item has the term. Equal scores go by
    ascending doc_id, nulls first. Items without terms, or with none that any document has, return no row; an empty
    index or no items give an empty result. Other columns are ignored.
    """
    asked = durable(item_terms(items).withColumn("bucket", bucket(F.col("term"))), "asked")
    blocks = max(1, -(-asked.count() // BROADCAST_TERMS))
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs, terms = F.lit(found.documents), F.lit(max(1, found.terms)).cast("long")
    out = None
    for i in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)
        wanted = block.select("bucket", "term").distinct()
        often = found.postings.join(F.broadcast(wanted), ["bucket", "term"]).groupBy("term").agg(F.sum(F.size("tf")).alias("df"))
        weight = F.floor(1000 * F.log((2 * docs + 2) / (2 * F.col("df") + 1))).cast("long")
        weighed = durable(block.join(often, "term").select("item_id", "bucket", "term", (weight * F.col("tf")).alias("w")).filter("w > 0"), "weights")
        held = found.postings.join(F.broadcast(weighed.select("bucket", "term").distinct()), ["bucket", "term"])
        held = held.repartition(parts, "chunk").select("chunk", "term", F.inline(F.arrays_zip("ids", "nth", "tf", "n")))
        m = F.lit(25).cast("long") + F.call_function("div", 75 * F.col("n").cast("long") * docs, terms)
        match = F.call_function("div", F.lit(10**9) * F.col("tf").cast("long"), 1000 * F.col("tf").cast("long") + 8 * m)
        scored = held.select("chunk", "term", F.col("ids").alias("doc_id"), "nth", match.alias("match")).join(F.broadcast(weighed.select("item_id", "term", "w")), "term")
        summed = scored.groupBy("chunk", "doc_id", "nth", "item_id").agg(F.sum(F.col("w") * F.col("match")).alias("score")).filter("score > 0")
        best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "chunk", "nth")
        one = summed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = one if out is None else out.unionByName(one)
    return out
