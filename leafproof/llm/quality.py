"""Quality rules: word and line statistics, then compression bands.

zstandard ratios (compressed over raw bytes) of the whole document and of fixed chunks must lie in the band for their
length. Below it text is repetitive, above it incompressible (random or encoded). Bands widen as text gets shorter,
where frame overhead and missing context raise ratios; texts under the least length have none. Alphabets of few signs
(hex, digits) compress like prose, so texts with many digits are also out of band where all their bytes are about
equally frequent.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD

SYMBOLS = "#*$%&|<>"
SEPARATORS = " \t\n\x0b\x0c\r"
WINDOW = 8


@dataclass(frozen=True)
class Bands:
    """limits: (least bytes, lowest ratio, highest ratio), ascending; chunk: bytes of a fixed chunk; share: the part of
    a document's chunked bytes that may lie in chunks outside their band; digits, even:
    from this share of ASCII digits on, the highest byte entropy over that of equally frequent bytes."""

    limits: tuple[tuple[int, float, float], ...] = (
        (128, 0.40, 0.95), (192, 0.40, 0.88), (256, 0.35, 0.84), (512, 0.32, 0.76), (1024, 0.28, 0.70), (2048, 0.25, 0.62), (8192, 0.22, 0.56), (32768, 0.20, 0.54),
    )
    digits: float = 0.25
    even: float = 0.92
    chunk: int = 4096
    share: float = 0.25
    level: int = 3

    def fits(self, n: int, ratio: float) -> bool:
        k = bisect.bisect_right([x[0] for x in self.limits], n) - 1
        return k < 0 or self.limits[k][1] <= ratio <= self.limits[k][2]

    def plain(self, raw: bytes) -> bool:
        n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        if len(raw) < self.limits[0][0] or n[48:58].sum() < self.digits * len(raw):
            return True
        share = n[n > 0] / len(raw)
        return len(share) == 1 or -float(share @ np.log2(share)) <= self.even * np.log2(len(share))

    def accepts(self, raw: bytes, ratio: float) -> bool:
        return self.fits(len(raw), ratio) and self.plain(raw)


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of WINDOW words found twice or more. Windows get exact ranks by doubling: pairs of
    ranks of length k are the ranks of length 2 k; memory is a few integers a word."""
    n = len(words)
    if n < WINDOW:
        return 0
    rank = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    step = 1
    while step < WINDOW:
        rank, distinct = pd.factorize(rank[:-step] * (n + 1) + rank[step:])
        rank = rank.astype(np.int64)
        if len(distinct) == len(rank):
            return 0  # no shorter window is found twice, so no longer one is
        step *= 2
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str, find=re.compile(WORD).findall) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = find(text)
    lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
    return (
        len(words),
        len(text) - sum(map(text.count, SEPARATORS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def compression(raw: bytes, bands: Bands, compress) -> tuple[float, float, bool]:
    """(ratio of the whole, share of chunked bytes outside their bands, whether the bands accept)."""
    if not raw:
        return 1.0, 0.0, True
    ratio = len(compress(raw)) / len(raw)
    out = total = 0
    if len(raw) > bands.chunk:
        for a in range(0, len(raw), bands.chunk):
            part = raw[a : a + bands.chunk]
            total += len(part)
            out += 0 if bands.accepts(part, len(compress(part)) / len(part)) else len(part)
    share = out / total if total else 0.0
    return ratio, share, bands.accepts(raw, ratio) and share <= bands.share


JUDGED = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, ratio double, chunk_share double, in_band boolean"


def judge(docs: DataFrame, bands: Bands = Bands(), out: str = "judged") -> DataFrame:
    """docs and a struct column `out` (replaced if there): the statistics of JUDGED, base_failed and kept.

    base_failed: fewer than 20 words, or more than 30 in 100 words in repeated windows. kept: neither failed nor
    outside the bands. Null text counts as empty: no words, so it fails. Nothing else is read: null or clashing other
    columns pass through, repeated rows are judged alike, an empty table stays empty.
    """

    @F.pandas_udf(JUDGED)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level).compress
        names = [x.split()[0] for x in JUDGED.split(", ")]
        for b in batches:
            texts = ["" if t is None else t for t in b]
            yield pd.DataFrame([(*statistics(t), *compression(t.encode(), bands, compress)) for t in texts], columns=names)

    m = lambda c: F.col(out)[c]
    failed = (m("n_words") < 20) | (100 * m("n_repeat_words") > 30 * m("n_words"))
    out_df = docs.withColumn(out, measure("text"))
    return out_df.withColumn(out, F.col(out).withField("base_failed", failed).withField("kept", ~failed & m("in_band")))
