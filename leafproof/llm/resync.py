"""Overlapping chunks of huge documents and where their encodings meet again.

Chunk i of a text covers code points [i C, (i + 1) C + W): neighbours share W code points. A task scans one chunk on its
own and reports the starts of its pre-tokens inside the two shared zones, with the number of tokens before each.

Pre-tokenisation runs left to right and a match depends only on the text from its start. So a position that starts a
pre-token in both neighbours is a proven meeting point: chunk 0 is right from its first character; if chunk i is
right from its own meeting point on, it is right at the next one, and chunk i + 1 is right from there on. Matches
that reach a chunk's end, or special strings that its end may cut, are kept out by a guard of GUARD code points.

Where two neighbours share no start (one very long run of letters, say), the document is chunked again with fourfold
chunks and overlaps, until it meets or is a single chunk: the exact way for the rest. Only such documents are rescanned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, row_key

CHUNKS = "key string, i int, last boolean, base bigint, body string"
ZONE = "array<struct<at:bigint,seen:bigint>>"
SCANS = f"key string, i int, last boolean, n bigint, head {ZONE}, tail {ZONE}"
GUARD = 32
#: scan(body) -> (number of tokens, [(start of a pre-token, tokens before it)])
Scan = Callable[[str], tuple[int, list[tuple[int, int]]]]


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): the key is a digest of doc_id and text, so repeated rows share it and may be told once."""
    return docs.select(F.hex(row_key()).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, bool, int, str]]:
    """(i, whether it is the last, first code point, body) of each chunk."""
    i, at, last = 0, 0, False
    while not last:
        last = at + chunk + overlap >= len(text)
        yield i, last, at, text[at : at + chunk + overlap]
        i, at = i + 1, at + chunk


def chunked(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunk rows of keyed documents, dealt out evenly: a document's chunks go to many tasks."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, text in zip(b["key"], b["text"]):
                rows = []
                for r in cut(text, chunk, overlap):
                    rows.append((key, *r))
                    if len(rows) == 64:
                        yield pd.DataFrame(rows, columns=["key", "i", "last", "base", "body"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["key", "i", "last", "base", "body"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select("key", "text").mapInPandas(split, CHUNKS).repartition(parts)


def scanned(chunks: DataFrame, make_scan: Callable[[], Scan], chunk: int, overlap: int) -> DataFrame:
    def scan_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = make_scan()
        for b in batches:
            rows = []
            for key, i, last, base, body in b.itertuples(index=False):
                n, starts = scan(body)
                head = [{"at": base + a, "seen": s} for a, s in starts if a < overlap] if i else []
                tail = [] if last else [{"at": base + a, "seen": s} for a, s in starts if chunk <= a <= len(body) - GUARD]
                rows.append((key, i, last, n, head, tail))
            yield pd.DataFrame(rows, columns=["key", "i", "last", "n", "head", "tail"])

    return chunks.mapInPandas(scan_all, SCANS)


def meet(scans: DataFrame) -> DataFrame:
    """key, i, last, n, from_at, from_seen, to_at, to_seen, failed: what each chunk owns, [from_at, to_at).

    from_at is 0 for the first chunk, to_at null for the last. failed: no meeting point with the next chunk.
    """
    w = Window.partitionBy("key").orderBy("i")
    one = scans.dropDuplicates(["key", "i"])  # repeated rows scan alike
    at = lambda zone: F.transform(zone, lambda z: z["at"])
    one = one.withColumn("next", F.lead("head").over(w))
    one = one.withColumn("to_at", F.when(~F.col("last"), F.array_min(F.array_intersect(at(F.col("tail")), at(F.col("next"))))))
    seen = lambda zone: F.get(F.filter(zone, lambda z: z["at"] == F.col("to_at")), F.lit(0))["seen"]
    one = one.withColumn("to_seen", seen(F.col("tail"))).withColumn("next_seen", seen(F.col("next")))
    return one.select(
        "key", "i", "last", "n",
        F.lag("to_at", 1, 0).over(w).alias("from_at"), F.lag("next_seen", 1, 0).over(w).alias("from_seen"),
        "to_at", "to_seen", (~F.col("last") & F.col("to_at").isNull()).alias("failed"),
    )


def resynchronise(docs: DataFrame, make_scan: Callable[[], Scan], chunk: int, overlap: int) -> list[tuple[int, int, DataFrame]]:
    """Rounds of (chunk, overlap, spans) over keyed documents; each document's spans are in one round only.

    Rounds end when every document has met: at the latest when its chunk holds it whole.
    """
    assert chunk >= 4 * overlap > 4 * GUARD
    rounds, rest = [], docs
    while True:
        spans = durable(meet(scanned(chunked(rest, chunk, overlap), make_scan, chunk, overlap)), "spans")
        failed = spans.filter("failed").select("key").distinct()
        rounds.append((chunk, overlap, spans.join(failed, "key", "left_anti")))
        if failed.isEmpty():
            return rounds
        rest = rest.join(failed, "key", "left_semi")
        chunk, overlap = 4 * chunk, 4 * overlap
