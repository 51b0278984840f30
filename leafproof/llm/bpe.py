"""Byte-level BPE encoding and decoding by overlapping chunks.

Huge texts are pre-tokenised chunk by chunk in parallel; the chunks are stitched where their pre-token starts meet
again (see resync); then each chunk encodes the pieces between its two meeting points. Every piece is encoded on its
own by its ranks, so no merge crosses a piece. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resync import chunked, keyed, resynchronise

#: Distinct pieces a task keeps the ids of; the cache is emptied when full.
CACHE = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers, encoded when first asked for."""

    def __init__(self, ranks_path: str, pattern: str):
        super().__init__()
        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.encoding._encode_single_piece(piece.encode()), dtype="<u4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[piece] = out
        return out


def starts_of(pattern: str) -> Callable:
    """Makes scan(body) -> (pre-tokens, [(start, pre-tokens before it)])."""

    def make():
        import regex

        find = regex.compile(pattern).finditer

        def scan(body: str) -> tuple[int, list[tuple[int, int]]]:
            starts = [(m.start(), k) for k, m in enumerate(find(body))]
            return len(starts), starts

        return scan

    return make


def encode(docs: DataFrame, ranks_path: str, pattern: str, huge: int = 16_384, chunk: int = 16_384, overlap: int = 512) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit ids): a row for each row of docs (doc_id, text).

    Null text encodes as empty; null doc_ids stay; repeated rows are kept. Empty docs give an empty result. Other
    columns are ignored. The pattern must match every character, as the public ones do.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    @F.pandas_udf("binary")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import regex

        find, pieces = regex.compile(pattern).findall, Pieces(ranks_path, pattern)
        for b in batches:
            yield pd.Series([b"".join(map(pieces.__getitem__, find(t))) for t in b])

    short = base.filter(F.length("text") <= huge).select("doc_id", whole("text").alias("ids"))
    long = keyed(base.filter(F.length("text") > huge))

    def owned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        find, pieces = regex.compile(pattern).finditer, Pieces(ranks_path, pattern)
        for b in batches:
            rows = []
            for key, i, at, body, first, last in zip(b["key"], b["i"], b["base"], b["body"], b["from_at"], b["to_at"]):
                stop = len(body) if pd.isna(last) else int(last) - at
                # the text beyond the span stays in view: a match may look ahead
                own = []
                for m in find(body, int(first) - at):
                    if m.start() >= stop:
                        break
                    own.append(pieces[m.group()])
                rows.append((key, i, b"".join(own)))
            yield pd.DataFrame(rows, columns=["key", "i", "ids"])

    encoded = None
    for c, w, spans in resynchronise(long, starts_of(pattern), chunk, overlap):
        todo = chunked(long.join(spans.select("key").distinct(), "key", "left_semi"), c, w).join(spans.select("key", "i", "from_at", "to_at"), ["key", "i"])
        one = todo.select("key", "i", "base", "body", "from_at", "to_at").mapInPandas(owned, "key string, i int, ids binary")
        encoded = one if encoded is None else encoded.unionByName(one)
    # a document's ids are one value of one row; repeated rows encode alike, so one copy of each chunk is kept
    parts = F.array_sort(F.collect_list(F.struct("i", "ids")))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    stitched = encoded.dropDuplicates(["key", "i"]).groupBy("key").agg(parts.alias("parts")).select("key", joined.alias("ids"))
    return short.unionByName(long.select("key", "doc_id").join(stitched, "key").select("doc_id", "ids"))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded's columns and decoded (binary): the bytes of ids, concatenated. Null ids decode to null.
    An existing column named decoded is replaced. Raises for an id outside the ranks."""

    @F.pandas_udf("binary")
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks = read_ranks(ranks_path)
        raw = [b""] * (1 + max(ranks.values()))
        for piece, k in ranks.items():
            raw[k] = piece
        for b in batches:
            yield pd.Series([None if x is None else b"".join(map(raw.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in b])

    return encoded.withColumn("decoded", bytes_of("ids"))
