"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

The sketch of a set has T bins. In round i of T each element falls into a random bin with a random value of round i;
in T further rounds all elements fall into bin i. A bin keeps its least value, earlier rounds before later ones, so
every bin fills, usually within a few rounds, and equal bins estimate similarity with the concentration of T
independent ones. Bands of ROWS bins are joined. Their number makes a pair at the limit meet with all but MISS
probability.

Equal sets are told once, as a class. A bucket's pairs are never written out. Its members are first compared with one
pivot, the member that shares most buckets with others, which in a group of copies is the text they were made from;
links are confirmed on full sets. Classes of one component need no comparison with each other, so only buckets that
still hold several components are left. Their members are compared by an exact prefix join: of two sets that reach the
limit, the rarest few shingles of each share one, and the first they share leaves enough shingles after it in both (the
positional filter). Copies that differ by more than the limit have too many shingles of their own for that, so a group
of n copies costs in the order of n comparisons, and no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, bitmap, durable, in_bitmap, mix64, row_key
from .components import components
from .shingles import Shingler

ROWS, MISS = 7, 1e-5
EMPTY = np.uint64(2**64 - 1)
#: Classes up to which a bucket's pairs have all been compared with the pivot's.
LEAST_OPEN = 2


def bands_for(limit: int, rows: int = ROWS) -> int:
    """Bands with which a pair of similarity limit / 100 shares none with a probability of MISS at most."""
    return math.ceil(math.log(MISS) / math.log(1 - (limit / 100) ** rows))


def sketch(elements: np.ndarray, bins: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty array of distinct uint64 hashes."""
    n, low = len(elements), np.uint64(2**32 - 1)
    out = np.full(bins, EMPTY)
    done, at_once = 0, max(1, math.ceil(2 * bins / n))
    while done < bins:
        rounds = np.arange(done, min(bins, done + at_once), dtype=np.uint64)
        h = mix64(elements[None, :] + (rounds[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        at = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        np.minimum.at(out, at.ravel().astype(np.int64), ((rounds[:, None] << np.uint64(32)) | (h & low)).ravel())
        done += len(rounds)
        if not (out == EMPTY).any():
            return out
    for b in np.flatnonzero(out == EMPTY):
        i = np.array([bins + b], dtype=np.uint64)
        h = mix64(elements + (i + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        out[b] = (i[0] << np.uint64(32)) | (h & low).min()
    return out


def band_keys(bins: np.ndarray, rows: int) -> np.ndarray:
    m = bins.reshape(-1, rows)
    out = np.arange(len(m), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(rows):
        out = mix64(out + m[:, j])
    return out.view(np.int64)


def set_key(elements: np.ndarray) -> bytes:
    """A 128-bit digest of a sorted set."""
    import xxhash

    return xxhash.xxh3_128_digest(elements.tobytes())


def _sketches(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """row (see row_key), doc_id, n_shingles, key (null for empty sets), bands."""

    @F.pandas_udf("n bigint, key binary, bands array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        s = Shingler()
        for b in batches:
            rows = []
            for t in b:
                e = np.unique(s.windows(s.hashes(s.words(t or "")), k))
                rows.append((len(e), set_key(e), band_keys(sketch(e, bands * ROWS), ROWS)) if len(e) else (0, None, np.zeros(0, dtype=np.int64)))
            yield pd.DataFrame(rows, columns=["n", "key", "bands"])

    return docs.select(row_key().alias("row"), "doc_id", run("text").alias("s")).select("row", "doc_id", F.col("s.n").alias("n_shingles"), "s.key", "s.bands")


def _sets(docs: DataFrame, k: int, classes: DataFrame) -> DataFrame:
    """(c, elements) of classes (c, key, row). Their representatives' texts are shingled again: a bounded bitmap of
    row keys thins out the others, and the join decides. Where there are too many for the bitmap, rows are joined first."""
    keyed = docs.select("text", row_key().alias("row"))
    bits, raw = bitmap(classes.select(F.xxhash64("row").alias("h")), "h")
    if bits is None:
        keyed = keyed.join(classes.select("row"), "row", "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, words = Shingler(), np.frombuffer(shared.value, dtype=np.uint32)
        for b in batches:
            rows = []
            here = in_bitmap(bits, words, b["h"].to_numpy(dtype=np.int64).view(np.uint64))
            for t in b["text"][here]:
                e = np.unique(s.windows(s.hashes(s.words(t or "")), k))
                if len(e):
                    rows.append((set_key(e), e.view(np.int64)))
            yield pd.DataFrame(rows, columns=["key", "elements"])

    found = keyed.select("text", F.xxhash64("row").alias("h")).mapInPandas(run, "key binary, elements array<bigint>")
    return found.join(classes.select("key", "c"), "key").groupBy("c").agg(F.first("elements").alias("elements"))


def _confirmed(pairs: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the limit."""
    one = sets.select(F.col("c").alias("a"), F.col("elements").alias("ea"))
    two = sets.select(F.col("c").alias("b"), F.col("elements").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    return pairs.join(one, "a").join(two, "b").filter(100 * both >= limit * (F.size("ea") + F.size("eb") - both)).select("a", "b")


def _may_reach(n: Column, m: Column, limit: int) -> Column:
    return 100 * F.least(n, m) >= limit * F.greatest(n, m)


def _pivot_pairs(members: DataFrame, limit: int) -> DataFrame:
    """members: (bucket, c, n, m), m classes of a bucket. Each member with its bucket's pivot: of the classes whose
    buckets hold most, the last."""
    central = members.groupBy("c").agg(F.sum("m").alias("w"))
    of = F.struct("w", "c", "n")
    pivots = members.join(central, "c").groupBy("bucket").agg(F.max(of).alias("p")).select("bucket", F.col("p.c").alias("q"), F.col("p.n").alias("qn"))
    pairs = members.join(pivots, "bucket").filter((F.col("c") != F.col("q")) & _may_reach(F.col("n"), F.col("qn"), limit))
    return pairs.select(F.least("c", "q").alias("a"), F.greatest("c", "q").alias("b")).distinct()


def _prefix_pairs(some: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """some: (c, component). All pairs of classes of different components that may reach the limit.

    Shingles are ordered by rarity among `some`. Two sets that reach the limit share at least
    limit (n + m) / (100 + limit) of them; so among the first n - ceil(limit n / 100) + 1 of each there is one that both
    have, and after the first such one, at places i and j, n - i and m - j are at least as many.
    """
    each = some.join(sets, "c").select("c", "component", F.size("elements").alias("n"), F.explode("elements").alias("e"))
    often = each.groupBy("e").agg(F.count("*").alias("df"))
    rare = each.join(often, "e").groupBy("c").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "e"))).alias("es"))
    length = F.col("n") - F.ceil(F.lit(limit) * F.col("n") / 100).cast("int") + 1
    heads = rare.select("c", "component", "n", F.posexplode(F.slice("es", F.lit(1), length)).alias("i", "x")).filter("x.df > 1")
    heads = heads.select("c", "component", "n", (F.col("n") - F.col("i")).alias("left"), "x.e")
    for _ in range(2):  # a shingle is of use if classes of several components have it early enough for the shortest of them
        at = heads.groupBy("e").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least")).filter("lo != hi").select("e", "least")
        heads = heads.join(at, "e").filter((100 + limit) * F.col("left") >= limit * (F.col("n") + F.col("least"))).drop("least")
    other = heads.select("e", *[F.col(x).alias("q" + x) for x in ("c", "component", "n", "left")])
    enough = (100 + limit) * F.least("left", "qleft") >= limit * (F.col("n") + F.col("qn"))
    pairs = heads.join(other, "e").filter((F.col("component") < F.col("qcomponent")) & enough)
    return pairs.select(F.least("c", "qc").alias("a"), F.greatest("c", "qc").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, limit: int = 80) -> DataFrame:
    """Link docs (doc_id, text) whose sets of k-word shingles have 100 * intersection >= limit * union.

    Words are runs of anything but ASCII white space, A-Z lower-cased. With fewer than k words the whole sequence is
    one shingle; without words, or text, the set is empty and linked with nothing. Returns a row for each row of docs:
    row (see row_key), doc_id, n_shingles, component_id (least doc_id reachable, itself included), class_id (hex; null
    for empty sets), kept (doc_id = component_id), chosen (whether the row's key is the least, null doc_ids last, of
    its component). Repeated rows have one component and are kept, or chosen, or not alike. A null doc_id takes part,
    is never a component_id unless no other is there, and is not kept then, but one row key of each component is
    chosen, and each row without shingles. Empty docs give an empty result; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    rows = durable(_sketches(docs, k, bands_for(limit)), "sketches")
    filled = rows.filter("key is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("rep")
    classes = filled.groupBy("key").agg(first, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = durable(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay
    buckets = classes.select("c", "n", F.explode("bands").alias("bucket"))
    several = buckets.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
    members = durable(buckets.join(several, "bucket"), "buckets")  # of buckets with two classes or more
    alike = classes.select("c", "key", F.col("rep.row").alias("row")).join(members.select("c").distinct(), "c", "left_semi")
    sets = durable(_sets(docs, k, durable(alike, "alike")), "sets")
    pairs = durable(_pivot_pairs(members, limit), "pairs")
    links = durable(_confirmed(pairs, sets, limit), "confirmed")
    labels = components(links)
    now = members.filter(F.col("m") > LEAST_OPEN).join(labels, members["c"] == labels["node"], "left").select("c", "bucket", F.coalesce("component", "c").alias("component"))
    now = durable(now, "labelled")
    mixed = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("bucket")
    some = durable(now.join(mixed, "bucket").select("c", "component").distinct(), "open")
    more = durable(_confirmed(_prefix_pairs(some, sets, limit).join(pairs, ["a", "b"], "left_anti"), sets, limit), "confirmed")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    named = classes.select("c", "key", "rep").join(labels, F.col("c") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "c").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    ids = named.join(least, "component").select("key", "least")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    out = filled.join(ids, "key").unionByName(rows.filter("key is null").withColumn("least", own))
    kept = F.coalesce(F.col("doc_id") == F.col("least.doc_id"), F.lit(False))
    chosen = F.col("row") == F.col("least.row")
    return out.select("row", "doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), F.lower(F.hex("key")).alias("class_id"), kept.alias("kept"), chosen.alias("chosen"))


def keep_one(docs: DataFrame, k: int = 5, limit: int = 80) -> DataFrame:
    """docs with one row of each component of near duplicates: the row with the least doc_id, null ids last.

    Columns stay, whatever their names. Texts without shingles (null, empty or white space) resemble nothing and stay.
    Rows that share doc_id and text are one document: one of them stays. Rows that share only the doc_id are documents
    of their own. Empty docs stay empty.
    """
    found = near_duplicates(docs, k, limit).filter("chosen").select(F.col("row").alias(ROW)).distinct()
    return docs.withColumn(ROW, row_key()).join(found, ROW, "left_semi").dropDuplicates([ROW]).drop(ROW)
