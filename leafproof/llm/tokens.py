"""Token counts by overlap resynchronisation, as the tokenizers library gives them.

Texts of up to `huge` code points are encoded whole. Longer ones are encoded as overlapping chunks spread over the
cluster, with offsets; the counts are spliced at proven common pre-token starts (see resync), and chunks and overlaps
are widened for documents whose chunks do not meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resync import keyed, resynchronise


def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


#: Distinct pieces a task keeps the count of; the cache is emptied when full.
CACHE = 400_000


class PieceCounts(dict):
    """pre-token -> its number of tokens, asked from the library once. Only for tokenizers that split texts by their
    special strings and then by `pattern`, and whose pieces are encoded apart."""

    def __init__(self, tok, pattern: str):
        super().__init__()
        import regex

        self.tok, self.pattern = tok, regex.compile(pattern)
        special = [regex.escape(t.content) for t in tok.get_added_tokens_decoder().values()]
        self.special = regex.compile("(" + "|".join(special or ["(?!)"]) + ")")

    def __missing__(self, piece: str) -> int:
        out = len(self.tok.encode(piece, add_special_tokens=False))
        if len(self) >= CACHE:
            self.clear()
        self[piece] = out
        return out

    def count(self, text: str) -> int:
        if not self.special.search(text):
            return sum(map(self.__getitem__, self.pattern.findall(text)))
        parts = self.special.split(text)  # texts and special strings, in turn
        return len(parts) // 2 + sum(sum(map(self.__getitem__, self.pattern.findall(p))) for p in parts[::2])

    def starts(self, text: str) -> tuple[int, list[tuple[int, int]]]:
        at, n, out = 0, 0, []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append((at, n))
                n += 1
            else:
                for m in self.pattern.finditer(part):
                    out.append((at + m.start(), n))
                    n += self[m.group()]
            at += len(part)
        return n, out


def scanner(path: str, pattern: str | None) -> Callable:
    """Makes scan(body) -> (tokens, [(start of a pre-token, tokens before it)])."""

    def make():
        tok = load(path)
        if pattern:
            return PieceCounts(tok, pattern).starts

        def scan(body: str) -> tuple[int, list[tuple[int, int]]]:
            e = tok.encode(body, add_special_tokens=False)
            words, offsets, starts, before = e.word_ids, e.offsets, [], object()
            for k, (w, (a, _)) in enumerate(zip(words, offsets)):
                if w is None or w != before:
                    starts.append((a, k))
                before = w
            return len(words), starts

        return scan

    return make


def count_tokens(docs: DataFrame, path: str, pattern: str | None = None, huge: int = 16_384, chunk: int = 16_384, overlap: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens: a row for each row of docs (doc_id, text), repeated rows included.

    path: a tokenizer file of the tokenizers library. pattern: its pre-token pattern, if it is a byte-level one; each
    distinct pre-token is then encoded by the library once a task instead of with every text. No special tokens are added; special strings inside texts count
    as the library's default has them. Null text counts as empty (0 bytes, 0 tokens); null doc_ids stay. Empty docs
    give an empty result. Other columns are ignored.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long").alias("n_bytes")

    @F.pandas_udf("bigint")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = load(path)
        counts = PieceCounts(tok, pattern) if pattern else None
        for b in batches:
            if counts is not None:
                yield pd.Series([counts.count(t) for t in b], dtype="int64")
                continue
            yield pd.Series([len(e) for e in tok.encode_batch_fast(list(b), add_special_tokens=False)], dtype="int64")

    short = base.filter(F.length("text") <= huge).select("doc_id", size, whole("text").alias("n_tokens"))
    long = keyed(base.filter(F.length("text") > huge))
    owned = F.coalesce("to_seen", "n") - F.col("from_seen")
    counts = None
    for _, _, spans in resynchronise(long, scanner(path, pattern), chunk, overlap):
        one = spans.groupBy("key").agg(F.sum(owned).alias("n_tokens"))
        counts = one if counts is None else counts.unionByName(one)
    # repeated rows: each digest is counted once and joined to every row that has it
    spliced = long.select("key", "doc_id", size).join(counts, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(spliced)
