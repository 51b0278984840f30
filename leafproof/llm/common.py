"""Shared plumbing: reading tables, durable intermediate tables, worker imports, bounded bitmaps."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafproof.sources.store import durable  # noqa: F401  operators take it from here

ROOT = str(Path(__file__).resolve().parents[2])

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)
#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: A helper column's name that no table has.
ROW = "__leafproof_row"
#: Text rows are long, so Arrow batches are kept short: memory follows rows * longest text.
BATCH_ROWS = "512"
BATCH_BYTES = "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and bound the rows of an Arrow batch."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), ROOT) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def row_key(id_column: str = "doc_id") -> Column:
    """A digest of id and text: what a document's row is known by. The id comes with its length, or is n if it is
    null, so no two pairs read alike."""
    name = F.col(id_column).cast("string")
    told = F.concat(F.coalesce(F.concat(F.octet_length(name).cast("string"), F.lit(":"), name), F.lit("n")), F.coalesce(F.col("text"), F.lit("")))
    return F.unhex(F.sha2(told.cast("binary"), 256))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64) over uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bits of the largest bitmap: 8 MB on each worker, whatever the input's size.
MAX_BITS = 26
#: Bits a key should have; with fewer than a quarter of them no bitmap is made.
BITS_A_KEY = 16


def bitmap(df: DataFrame, column: str) -> tuple[int | None, bytes]:
    """A two-probe Bloom bitmap of a 64-bit column as (log2 bits, bytes), or (None, nothing) if MAX_BITS are too few.

    It only thins out rows before an exact join, so it may err towards keeping, and a join does without it.
    """
    n = df.count()
    if n * BITS_A_KEY > 4 << MAX_BITS:
        return None, b""
    bits = int(min(MAX_BITS, max(13, np.ceil(np.log2(max(1, n) * BITS_A_KEY)))))
    mask = F.lit((1 << bits) - 1)
    probe = F.explode(F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(F.col(column), 32).bitwiseAND(mask)))
    words = (
        df.select(probe.alias("p"))
        .groupBy(F.shiftright("p", 5).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(31)).cast("int"))).alias("set"))
        .toPandas()
    )
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    out[words["word"].to_numpy(dtype=np.int64)] = words["set"].to_numpy(dtype=np.int64).astype(np.uint32)
    return bits, out.tobytes()


def in_bitmap(bits: int | None, words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (uint64) may be among the bitmap's; words: the bitmap's bytes as uint32; no bits: all may be."""
    if bits is None:
        return np.ones(len(keys), dtype=bool)
    mask = np.uint64((1 << bits) - 1)
    hit = np.ones(len(keys), dtype=bool)
    for p in (keys & mask, (keys >> np.uint64(32)) & mask):
        hit &= (words[(p >> np.uint64(5)).astype(np.int64)] >> (p & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
    return hit
