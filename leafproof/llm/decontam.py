"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed, LEAST tokens in a row, are joined by the seed's hash. For each pair,
running Karp-Rabin greedy string tiling marks the longest non-overlapping common token runs, longest first, down to
LEAST tokens. The part of the item's tokens under tiles is its coverage; since tiles may come in any order, reordered
passages are caught. Every common run of LEAST tokens or more lies wholly in windows that are seeds, so only the
document's stretches of seed windows travel, not its text.

A tile of k tokens holds k - LEAST + 1 seeds, so coverage of T tokens needs T / LEAST shared seeds at least. So pairs
are joined only by each item's rarest seeds, as many as it has less that number plus one, and pairs that share fewer
seeds are not tiled: a phrase that many items and documents hold makes no pair by itself, and no leak is lost.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, bitmap, durable, in_bitmap, row_key
from .shingles import Shingler

LEAST = 5
BASE, MODULUS = 1_000_003, (1 << 61) - 1
TOKEN = re.compile(r"[^\W_]+")


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def _windows(seq: list, used: bytearray, size: int) -> Iterator[tuple[int, int]]:
    """(start, hash) of every unmarked run of `size` tokens, by a rolling hash."""
    top, h, run = pow(BASE, size - 1, MODULUS), 0, 0
    for i, x in enumerate(seq):
        if used[i] or x < 0:
            h = run = 0
            continue
        if run >= size:
            h -= seq[i - size] * top
        h = (h * BASE + x) % MODULUS
        run += 1
        if run >= size:
            yield i - size + 1, h


def tile(pattern: list[str], segments: list[list[str]], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (start in pattern, start in the joined segments, length) of a greedy string tiling; none shorter than
    least or across segments."""
    ids = {w: k + 1 for k, w in enumerate(dict.fromkeys(pattern))}
    p = [ids[w] for w in pattern]
    t: list[int] = []
    for s in segments:
        t += [ids.get(w, -1) for w in s] + [-1]
    p_used, t_used, tiles = bytearray(len(p)), bytearray(len(t)), []

    def same(i: int, j: int) -> bool:
        return p[i] == t[j] and not p_used[i] and not t_used[j]

    def matches(size: int) -> list[tuple[int, int, int]]:
        """(-length, i, j) of the unmarked common runs of `size` tokens or more, each as long as can be."""
        at: dict[int, list[int]] = {}
        for j, h in _windows(t, t_used, size):
            at.setdefault(h, []).append(j)
        out = []
        for i, h in _windows(p, p_used, size):
            for j in at.get(h, ()):
                if i and j and same(i - 1, j - 1):
                    continue  # part of the run that begins before
                k = 0
                while i + k < len(p) and j + k < len(t) and same(i + k, j + k):
                    k += 1
                if k >= size:
                    out.append((-k, i, j))
        return out

    size = max(least, min(20, len(p)))
    while True:
        heap = matches(size)
        longest = -min(heap)[0] if heap else 0
        if longest > 2 * size:
            size = longest  # much longer runs: look for their like first
            continue
        heapq.heapify(heap)
        while heap:  # the longest first, then the first in the pattern
            k, i, j = heapq.heappop(heap)
            free = [x for x in range(-k) if not p_used[i + x] and not t_used[j + x]]
            if len(free) == -k:
                p_used[i : i - k] = t_used[j : j - k] = b"\1" * -k
                tiles.append((i, j, -k))
                continue
            start = 0  # its free parts take their places in the order
            for x in range(1, len(free) + 1):
                if x == len(free) or free[x] != free[x - 1] + 1:
                    if x - start >= size:
                        heapq.heappush(heap, (start - x, i + free[start], j + free[start]))
                    start = x
        if size <= least:
            return tiles
        size = max(least, size // 2)


def least_seeds(words: Column, seeds: Column, threshold: float) -> Column:
    """Different seeds that an item and a document share at least if coverage reaches the threshold. An item whose
    windows repeat has fewer seeds than windows, and a seed may then cover as often as it is there."""
    windows = words - LEAST + 1
    tokens = F.ceil(words * threshold - 1e-9)
    return F.ceil(tokens / LEAST - (windows - seeds) - 1e-9).cast("int")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of a document and a benchmark item whose coverage reaches the threshold.

    docs: doc_id, text; items: item_id, text. Tokens are runs of letters and digits, lower-cased. Items of fewer than
    LEAST tokens (null and empty ones too) can't be told from chance and match nothing; null or short documents match
    nothing. Returns key (see row_key), doc_id, item_id, coverage, n_tiles, longest: repeated rows of either side give
    one pair. Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession

    def seeds_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Shingler()
        for b in batches:
            rows = []
            for key, text in zip(b["item"], b["text"]):
                w = tokens_of(text)
                if len(w) >= LEAST:
                    rows.append((key, w, np.unique(s.windows(s.hashes(w), LEAST)).view(np.int64)))
            yield pd.DataFrame(rows, columns=["item", "words", "seeds"])

    item_key = F.hex(row_key("item_id"))
    base = items.select(item_key.alias("item"), "item_id", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["item"])
    cut = durable(base.select("item", "text").mapInPandas(seeds_of, "item string, words array<string>, seeds array<bigint>"), "items")
    seeds = cut.select("item", F.explode("seeds").alias("seed"))
    needed = F.greatest(F.lit(1), least_seeds(F.size("words"), F.size("seeds"), threshold))
    bits, raw = bitmap(seeds.select("seed").distinct(), "seed")
    shared = spark.sparkContext.broadcast(raw)  # 8 MB at most, see bitmap

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, words = Shingler(), np.frombuffer(shared.value, dtype=np.uint32)
        for b in batches:
            rows = []
            for key, text in zip(b["key"], b["text"]):
                w = tokens_of(text)
                if len(w) < LEAST:
                    continue
                h = s.windows(s.hashes(w), LEAST)
                hit = np.flatnonzero(in_bitmap(bits, words, h))
                if not len(hit):
                    continue
                runs = np.split(hit, np.flatnonzero(np.diff(hit) >= LEAST) + 1)  # stretches that share tokens are one
                rows.append((key, [w[r[0] : r[-1] + LEAST] for r in runs], np.unique(h[hit]).view(np.int64)))
            yield pd.DataFrame(rows, columns=["key", "segments", "seeds"])

    keyed = docs.select(row_key().alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hits = keyed.select("key", "text").mapInPandas(stretches, "key binary, segments array<array<string>>, seeds array<bigint>")
    hits = durable(hits.dropDuplicates(["key"]), "stretches")
    held = hits.select("key", F.explode("seeds").alias("seed"))
    often = held.groupBy("seed").agg(F.count("*").alias("df"))
    places = Window.partitionBy("item").orderBy("df", "seed")  # an item's seeds
    rare = seeds.join(cut.select("item", needed.alias("need"), F.size("seeds").alias("n")), "item").join(often, "seed", "left").fillna(0, ["df"])
    rare = rare.withColumn("place", F.row_number().over(places)).filter("df > 0 and place <= n - need + 1").select("item", "seed")
    pairs = held.join(rare, "seed").select("key", "item").distinct()
    asked = cut.select("item", "words", F.col("seeds").alias("own"), needed.alias("need"))
    both = pairs.join(asked, "item").join(hits, "key").filter(F.size(F.array_intersect("own", "seeds")) >= F.col("need"))

    def tiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, item, segments, words in zip(b["key"], b["item"], b["segments"], b["words"]):
                tiles = tile(list(words), [list(x) for x in segments])
                n = sum(k for _, _, k in tiles)
                if n >= threshold * len(words):
                    rows.append((key, item, n / len(words), len(tiles), max(k for _, _, k in tiles)))
            yield pd.DataFrame(rows, columns=["key", "item", "coverage", "n_tiles", "longest"])

    out = both.select("key", "item", "segments", "words").mapInPandas(tiled, "key binary, item string, coverage double, n_tiles int, longest int")
    out = durable(out, "leaks")
    ids = keyed.select("key", "doc_id").join(out.select("key").distinct(), "key").distinct()
    return out.join(ids, "key").join(base.select("item", "item_id"), "item").select("key", "doc_id", "item_id", "coverage", "n_tiles", "longest")


def remove_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that leak an item; columns, nulls and repeated rows stay."""
    bad = leaks(docs, items, threshold).select(F.col("key").alias(ROW)).distinct()
    return docs.withColumn(ROW, row_key()).join(bad, ROW, "left_anti").drop(ROW)
