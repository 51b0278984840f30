"""Exact phrases by a positional index: (term, page, places), no text.

A phrase of n words is on a page at place s if its word k is there at place s + k for every k. So each word's places,
less k, are starts it would agree to, and a start that n words agree to is a hit. Pages are known by a key column, `on`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafproof.functions import text as T


def positions_of(pages: DataFrame, on: str = "page_id") -> DataFrame:
    """(term, on, places): the positional index of pages (on, norm) that have none stored."""
    words = pages.select(on, F.posexplode(F.split(F.trim("norm"), " ")).alias("at", "term")).filter("term != ''")
    return words.groupBy("term", on).agg(F.array_sort(F.collect_list("at")).alias("places"))


def spelt(labels: DataFrame) -> DataFrame:
    """(claim, spelling): a label's spellings as tokens with a space between; a label without tokens has none."""
    each = labels.select("claim").distinct().select("claim", F.explode(T.variants(F.col("claim"))).alias("v"))
    return each.select("claim", F.trim(T.normal(F.col("v"))).alias("spelling")).filter("spelling != ''").distinct()


def words_of(spellings: DataFrame) -> DataFrame:
    """(spelling, n, k, term) of distinct spellings."""
    parts = F.split("spelling", " ")
    return spellings.select("spelling").distinct().select("spelling", F.size(parts).alias("n"), F.posexplode(parts).alias("k", "term"))


def less(places: Column, k: Column) -> Column:
    return F.transform(places, lambda p: p - k)


def hits(labels: DataFrame, positions: DataFrame, terms: DataFrame | None = None, on: str = "row_id") -> DataFrame:
    """(claim, on), each once: the pages that print a spelling of a label (claim).

    A spelling's rarest word names the candidate pages and starts; its other words are then looked up on those pages
    alone, by term and page. So no page is touched that shares only common words with a label. terms: (term, df), else
    counted here.
    """
    sp = spelt(labels)
    words = words_of(sp)
    often = terms if terms is not None else positions.groupBy("term").agg(F.count("*").alias("df"))
    known = words.join(often, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = known.groupBy("spelling", "n").agg(F.min_by(F.struct("k", "term"), F.struct("df", "k")).alias("r")).select("spelling", "n", "r.k", "r.term")
    first = positions.join(rare, "term").select("spelling", "n", on, F.col("k").alias("own"), less(F.col("places"), F.col("k")).alias("starts"))
    others = first.join(words.select("spelling", "k", "term"), "spelling").filter("k != own")
    agreed = others.join(positions.select("term", on, "places"), ["term", on]).select("spelling", "n", on, F.explode(F.array_intersect("starts", less(F.col("places"), F.col("k")))).alias("start"))
    whole = agreed.groupBy("spelling", "n", on, "start").agg(F.count("*").alias("c")).filter("c = n - 1").select("spelling", on)
    return whole.unionByName(first.filter("n = 1").select("spelling", on)).join(sp, "spelling").select("claim", on).distinct()


def pair_hits(pairs: DataFrame, positions: DataFrame, on: str = "row_id") -> DataFrame:
    """(claim, on), each once: those of pairs (claim, on) whose page prints a spelling of the claim. Only the claims'
    words on their own pages are looked up."""
    sp = spelt(pairs)
    asked = pairs.select("claim", on).distinct().join(sp, "claim").select("spelling", on).distinct()
    places = asked.join(words_of(sp), "spelling").join(positions.select("term", on, "places"), ["term", on])
    starts = places.select("spelling", "n", on, F.explode(less(F.col("places"), F.col("k"))).alias("start"))
    whole = starts.groupBy("spelling", "n", on, "start").agg(F.count("*").alias("c")).filter("c = n").select("spelling", on).distinct()
    return whole.join(sp, "spelling").join(pairs.select("claim", on).distinct(), ["claim", on], "left_semi").select("claim", on).distinct()


def label_words(label: str) -> list[list[str]]:
    """The tokens of each spelling of a label, on the driver."""
    one, bare = re.sub(r"\s+", " ", label).strip(), re.sub(r"\s+", "", label)
    apart = re.sub(r"([0-9])([^\W\d_])", r"\1 \2", re.sub(r"([^\W\d_])([0-9])", r"\1 \2", bare))
    found = [tuple(T.tok(v)) for v in (one, bare, apart)]
    return [list(w) for w in dict.fromkeys(found) if w]


def literal_hits(positions: DataFrame, label: str, on: str = "row_id", as_written: bool = False) -> DataFrame:
    """(on), each once: the pages that print a label known on the driver, in any spelling or only as it is written. Its
    words reach the scan of the index."""
    each = [w for w in [T.tok(label)] if w] if as_written else label_words(label)
    if not each:
        return positions.select(on).limit(0)
    own = positions.filter(F.col("term").isin(sorted({w for ws in each for w in ws})))
    if all(len(ws) == 1 for ws in each):
        return own.select(on).distinct()
    marks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(len(ws)).alias("n"), F.lit(k).alias("k"), F.lit(w).alias("w")) for i, ws in enumerate(each) for k, w in enumerate(ws)])
    mine = F.filter(marks, lambda m: m["w"] == F.col("term"))
    starts = F.flatten(F.transform(mine, lambda m: F.transform("places", lambda p: F.struct(m["i"].alias("i"), m["n"].alias("n"), (p - m["k"]).alias("start")))))
    agreed = own.select(on, F.inline(starts)).groupBy(on, "i", "n", "start").agg(F.count("*").alias("c"))
    return agreed.filter("c = n").select(on).distinct()
