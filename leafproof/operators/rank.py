"""Ranked narrowing: dense and sparse branches, reciprocal rank fusion, grouping by document and section."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafproof.functions import text as T
from leafproof.operators import exact

#: Rows a branch returns, whatever the caller's limit: the limit never changes the order.
DEPTH = 50
RRF_K = 60
WEIGHTS = {"dense": 1.0, "lexical": 1.0, "captions": 0.4}


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine with a fixed vector, summed left to right in double."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(v, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, dot / (norm * math.sqrt(sum(x * x for x in query)))).otherwise(0.0)


def dense(vectors: DataFrame, query: list[float], depth: int = DEPTH) -> DataFrame:
    """(row_id, score) of the nearest rows: a top-k by score, then id."""
    return vectors.select("row_id", F.round(cosine(F.col("embedding"), query), 9).alias("score")).orderBy(F.desc("score"), "row_id").limit(depth)


def sparse(postings: DataFrame, query: dict[str, int], rows: DataFrame, collection: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(row_id, score): sum of query tf * document tf * idf, idf = ln(1 + (N - df + 0.5) / (df + 0.5)) over `collection`,
    whatever the scope. Of `rows` (row_id) only, those inside the scope. Only postings of the query's terms are read;
    a row without any is not returned.
    """
    if not query:
        return postings.select("row_id", F.lit(0.0).alias("score")).limit(0)
    own = postings.filter(F.col("term").isin(*query))
    n = collection.agg(F.count("*").alias("n")).scalar()
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    own = own.join(rows, "row_id", "left_semi")
    qtf = F.lit(0)
    for term, k in query.items():
        qtf = F.when(F.col("term") == term, k).otherwise(qtf)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = own.join(df, "term").select("row_id", F.round(qtf * F.col("tf") * idf, 9).cast("decimal(28,9)").alias("s"))
    return scored.groupBy("row_id").agg(F.sum("s").cast("double").alias("score")).orderBy(F.desc("score"), "row_id").limit(depth)


def narrowed(pages: DataFrame, query: str, wanted: dict[str, object] | None = None, exclude: DataFrame | None = None, positions: DataFrame | None = None) -> DataFrame:
    """The pages every branch runs inside: current ones in scope that print each identifier of the query, less the
    excluded (page_id). Trust is no condition: a skim row is a candidate, not evidence."""
    out = exact.current_only(exact.scope(pages, wanted or {}))
    for word in split(query)[0]:
        out = exact.printing(out, word, positions)
    return out if exclude is None else out.join(exclude.select("page_id"), "page_id", "left_anti")


def ranked(branch: DataFrame, surface: str) -> DataFrame:
    """(surface, row_id, rank), 1-based. A branch has DEPTH rows at most."""
    w = Window.partitionBy("surface").orderBy(F.desc("score"), "row_id")
    return branch.withColumn("surface", F.lit(surface)).withColumn("rank", F.row_number().over(w)).select("surface", "row_id", "rank")


def fuse(branches: list[DataFrame], weights: dict[str, float] = WEIGHTS, keys: list[str] | None = None) -> DataFrame:
    """row_id (or other keys), score, best_rank, why: the sum of weight / (RRF_K + rank), added in the order of the weights."""
    every = branches[0]
    for b in branches[1:]:
        every = every.unionByName(b)
    keys = keys or ["row_id"]
    one = every.groupBy(*keys).agg(*[F.min(F.when(F.col("surface") == s, F.col("rank"))).alias(s) for s in weights])
    score = F.lit(0.0)
    for s, w in weights.items():
        if w:
            score = score + F.when(F.col(s).isNotNull(), F.lit(w) / (RRF_K + F.col(s))).otherwise(0.0)
    used = [s for s, w in weights.items() if w]
    why = F.array_join(F.array_compact(F.array(*[F.when(F.col(s).isNotNull(), s) for s in used])), ",")
    best = F.least(*[F.coalesce(s, F.lit(10**6)) for s in used])
    return one.select(*keys, score.alias("score"), best.alias("best_rank"), why.alias("why")).filter("why != ''")


def in_order() -> list[Column]:
    return [F.desc("score"), F.asc("best_rank"), F.col("row_id").cast("string")]


def split(query: str) -> tuple[list[str], list[str]]:
    """`decompose` of a string on the driver."""
    words = query.split()
    has = [any(ch.isnumeric() for ch in w) for w in words]
    return [w for w, h in zip(words, has) if h], [w for w, h in zip(words, has) if not h]


def stub_vector(text: str, dim: int) -> list[float]:
    """A vector that depends on the text alone, for tests and corpora whose embedder is not at hand: each value is
    made of the first 16 bits of the sha256 of the text and the value's number."""
    import hashlib

    return [int(hashlib.sha256(f"{text}|{k}".encode()).hexdigest()[:4], 16) / 32767.5 - 1.0 for k in range(dim)]


def decompose(query: Column) -> tuple[Column, Column]:
    """(identifiers, prose): words with a digit, and the others."""
    words = F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != "")
    return F.filter(words, T.is_code), F.filter(words, lambda w: ~T.is_code(w))


def group(fused: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """Fused, numbered rows (fused_rank) by a key: pages_matched, best_rank, preview (the best page); best first, then
    more pages, then key."""
    return fused.groupBy(key).agg(F.count("*").alias("pages_matched"), F.min("fused_rank").alias("best_rank"), F.min_by("page_id", "fused_rank").alias("preview")).orderBy("best_rank", F.desc("pages_matched"), key).limit(limit)
