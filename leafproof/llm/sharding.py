"""Sharding by a Feistel permutation over global row numbers.

Rows are numbered 0..N-1 in the order of (doc_id, text). A keyed generalised Feistel network permutes a * a >= N
numbers, a = ceil(sqrt(N)); numbers outside 0..N-1 are permuted again until they fall inside (cycle walking), so the
result is a permutation of 0..N-1. Row r goes to shard perm(r) % shards, slot perm(r) div shards: counts of shards
differ by one at most, slots have no gaps, and either direction is computable from the seed alone without any table.

The law is `rows`: counts are even, sizes only on average. Rows of equal texts are rows like any others, so a group of
them is spread over the shards, as evenly as chance has it, and no shard holds a group whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: A Mersenne prime: products of two residues stay below 2^62.
PRIME = 2**31 - 1
ROUNDS = 6
#: Numbers outside 0..N-1 are at most 2 ceil(sqrt(N)) of N, so a walk of W steps stays outside with (2 / sqrt(N))^W.
WALK = 64


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Multiplier, addend and second addend of each round."""
    x, out = seed % PRIME, []
    for _ in range(ROUNDS):
        three = []
        for _ in range(3):
            x = (x * 48271 + 11) % PRIME  # a Lehmer step
            three.append(x or 1)
        out.append(tuple(three))
    return out


def side(n: int) -> int:
    return max(1, math.isqrt(max(0, n - 1)) + 1)


def permute_one(x: int, n: int, seed: int) -> int:
    """Where row x of n goes: the scalar form."""
    a = side(n)
    while True:
        left, right = divmod(x, a)
        for m, b, c in round_keys(seed):
            t = (right * m + b) % PRIME
            left, right = right, (left + (t * t + c) % PRIME % a) % a
        x = left * a + right
        if x < n:
            return x


def invert_one(y: int, n: int, seed: int) -> int:
    """The row that goes to y."""
    a = side(n)
    while True:
        left, right = divmod(y, a)
        for m, b, c in reversed(round_keys(seed)):
            t = (left * m + b) % PRIME
            left, right = (right - (t * t + c) % PRIME % a) % a, left
        y = left * a + right
        if y < n:
            return y


def permute(x: Column, n: int, seed: int) -> Column:
    """permute_one as an expression; raises if a walk has not ended after WALK steps."""
    a = side(n)

    def network(v: Column) -> Column:
        state = F.struct(F.floor(v / F.lit(a)).cast("long").alias("l"), (v % a).alias("r"))
        keys = F.array(*[F.struct(*[F.lit(k).cast("long").alias(c) for k, c in zip(ks, "mbc")]) for ks in round_keys(seed)])

        def step(s: Column, k: Column) -> Column:
            t = (s["r"] * k["m"] + k["b"]) % PRIME
            return F.struct(s["r"].alias("l"), ((s["l"] + ((t * t + k["c"]) % PRIME) % a) % a).alias("r"))

        return F.aggregate(keys, state, step, lambda s: s["l"] * a + s["r"])

    walk = F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), network(x), lambda v, _: F.when(v < n, v).otherwise(network(v)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("cycle walk has not ended")).cast("long"))


def shard(docs: DataFrame, shards: int = 24, seed: int = 20240607) -> DataFrame:
    """Deal docs (doc_id, text) into shards 0..shards-1.

    Returns doc_id, size (UTF-8 bytes of the text plus 8; null text: 8), text_crc32 (null text: that of no bytes),
    row_number, shard, slot: a row for each row of docs. Rows are numbered by doc_id (null first), crc, size and a
    64-bit text hash; rows equal in all four are interchangeable. Empty docs give an empty result. Other columns are
    ignored. Texts never move: only their digests are sorted. Per-partition row counts, one number for each
    partition, are the only thing summed outside the executors.
    """
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    slim = docs.select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("_h"))
    order = ["doc_id", "text_crc32", "size", "_h"]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = slim.repartitionByRange(parts, *[F.asc_nulls_first(c) for c in order]).sortWithinPartitions(*[F.asc_nulls_first(c) for c in order])
    # the id is partition << 33 | position; written, so that counts and rows come from one and the same numbering
    at = durable(ordered.withColumn("_id", F.monotonically_increasing_id()), "shard-rows")
    part, place = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    n, starts = 0, {}
    for p, k in counts:
        starts[p], n = n, n + k
    offsets = F.array(*[F.lit(starts.get(p, 0)).cast("long") for p in range(1 + max(starts, default=0))])
    to = permute(F.col("row_number"), max(1, n), seed)
    return (
        at.withColumn("row_number", F.get(offsets, part) + place)
        .withColumn("_to", to)
        .select("doc_id", "size", "text_crc32", "row_number", (F.col("_to") % shards).cast("int").alias("shard"), F.floor(F.col("_to") / shards).cast("long").alias("slot"))
    )
