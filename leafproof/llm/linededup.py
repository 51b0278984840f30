"""Reversible line deduplication: exact reference counts behind sharded cuckoo filters.

A line's key is its text stripped of white space and with A-Z lower-cased; keys of at least LEAST_CHARS code points are
known by a 128-bit digest (hi, lo). The state of an index is three tables in the shared folder:

    refs     shard, hi, lo, doc_id   which documents hold a key, each pair once
    counts   shard, hi, lo, n, keeper   a key's number of documents and its largest doc_id
    filters  shard, buckets, table   a cuckoo filter a shard: the keys whose n reaches the limit

Inserting documents adds their pairs, deleting documents takes them out; only the counts of keys they hold change. A key
whose count reaches the limit gets a fingerprint in its shard's filter, one whose count falls below it loses one. That
is what cuckoo filters are for: a fingerprint can be taken out again, so an index that has taken documents in and out is
one that never saw them. A shard that is too full is built again, larger, from the exact counts.

What a document loses is decided on its keys: those the filters let through, which err only towards keeping a key in
question, are joined with the exact counts. Keys that hold over 1/HEAVY of these (fewer than HEAVY, whatever the
input) are joined by a broadcast, so that no task has to take all holders of one key. Filters travel to the tasks only if
they are at most FILTER_BYTES large; without them all keys go to the exact join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafproof.sources.store import shared_dir

from .common import ASCII_LOWER, ASCII_UPPER, ROW, mix64

#: What is stripped at both ends of a line.
SPACE = b" \t\n\v\f\r"
LEAST_CHARS, LEAST_DOCS = 20, 3
LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())
#: Fingerprints of a bucket, tries of an insertion, and keys of a shard when its filter is sized.
SLOTS, KICKS, SHARD_KEYS = 4, 500, 50_000
MOST_SHARDS = 4096
FILTER_BYTES = 64 << 20
HEAVY = 1000
FILTERS = "shard int, buckets int, table binary"


def keys_of(text: str | None) -> Iterator[bytes | None]:
    """The key of each line of a text as UTF-8, or null where it is too short to be told. No byte of a longer character
    is a line feed, white space or A-Z, so all is done on bytes."""
    for line in (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split(b"\n"):
        bare = line.strip(SPACE)
        long = len(bare) >= 4 * LEAST_CHARS or (len(bare) >= LEAST_CHARS and len(bare.decode("utf-8", "surrogatepass")) >= LEAST_CHARS)
        yield bare if long else None


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def digests(text: str | None) -> list[bytes]:
    """The digests of a text's distinct keys."""
    return [digest(k) for k in set(keys_of(text)) if k is not None]


def halves(raw: list[bytes]) -> np.ndarray:
    """(n, 2) of the digests' halves."""
    return np.frombuffer(b"".join(raw), dtype="<i8").reshape(-1, 2)


class Cuckoo:
    """A cuckoo filter of 64-bit keys: 16-bit fingerprints in buckets of SLOTS, two buckets a key."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(len(table) - 1)

    @classmethod
    def empty(cls, keys: int) -> Cuckoo:
        """One that `keys` keys fill to 80 in 100 at most."""
        buckets = 1 << max(0, int(np.ceil(np.log2(max(1.0, keys / (0.8 * SLOTS))))))
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> Cuckoo:
        """A filter with all of keys, doubled until they fit."""
        size = len(keys)
        while True:
            out = cls.empty(size)
            if all(out.insert(int(a), int(b), int(f)) for a, b, f in zip(*out.places(keys))):
                return out
            size *= 2

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first bucket, second bucket, fingerprint) of each key (int64)."""
        h = mix64(keys.view(np.uint64))
        mark = (h >> np.uint64(48)).astype(np.uint64)
        mark[mark == 0] = 1  # 0 is an empty slot
        first = h & self.mask
        return first.astype(np.int64), (first ^ (mix64(mark) & self.mask)).astype(np.int64), mark.astype(np.uint16)

    def other(self, at: int, mark: int) -> int:
        return at ^ int(mix64(np.array([mark], dtype=np.uint64))[0] & self.mask)

    def insert(self, a: int, b: int, mark: int) -> bool:
        """Put a fingerprint in; False (and the filter is to be built again) if there is no room."""
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        at = a
        for n in range(KICKS):
            slot = (mark + n) % SLOTS  # which one is put out does not depend on chance: a rerun task builds alike
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = self.other(at, mark)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def remove(self, a: int, b: int, mark: int) -> bool:
        """Take one copy of a fingerprint out; False if there is none."""
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == mark)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def has(self, keys: np.ndarray) -> np.ndarray:
        a, b, mark = self.places(keys)
        return (self.table[a] == mark[:, None]).any(axis=1) | (self.table[b] == mark[:, None]).any(axis=1)


@dataclass
class Index:
    """The tables of one state. Later states have tables of their own, so an earlier state stays as it is."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    least_docs: int = LEAST_DOCS


def _store(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/leafproof/lines-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shard(shards: int) -> Column:
    return F.pmod("hi", F.lit(shards)).cast("int").alias("shard")


def pairs_of(docs: DataFrame) -> DataFrame:
    """(hi, lo, doc_id): the keys of each document, each pair once."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [digests(t) for t in b["text"]]
            if any(raw):
                hi, lo = halves([d for r in raw for d in r]).T
                yield pd.DataFrame({"hi": hi, "lo": lo, "id": np.repeat(b["id"].to_numpy(dtype=object), [len(r) for r in raw])})

    told = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(keys, "hi bigint, lo bigint, id string")
    return told.select("hi", "lo", F.col("id").cast(kind).alias("doc_id")).distinct()


def counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("shard", "hi", "lo").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))


def build_filters(counts: DataFrame, least_docs: int) -> DataFrame:
    """A filter for each shard that has keys at the limit. A shard's keys are some SHARD_KEYS, its one group."""

    def fill(key, g: pd.DataFrame) -> pd.DataFrame:
        f = Cuckoo.of(np.sort(g["lo"].to_numpy(dtype=np.int64)))
        return pd.DataFrame({"shard": [key[0]], "buckets": [len(f.table)], "table": [f.table.tobytes()]})

    return counts.filter(F.col("n") >= least_docs).select("shard", "lo").groupBy("shard").applyInPandas(fill, FILTERS)


def build(docs: DataFrame, least_docs: int = LEAST_DOCS) -> Index:
    """The index of all documents (doc_id, text).

    A document is known by its id: rows that share one are one document, null ids are one too and less than any other.
    Null or empty texts have no keys. Empty docs give an empty index. Other columns are ignored.
    """
    pairs = _store(pairs_of(docs), "pairs")
    shards = int(min(MOST_SHARDS, 1 << max(0, int(np.ceil(np.log2(max(1, pairs.count()) / (least_docs * SHARD_KEYS)))))))
    refs = pairs.select(shard(shards), "hi", "lo", "doc_id")
    counts = _store(counted(refs), "counts")
    return Index(refs, counts, _store(build_filters(counts, least_docs), "filters"), shards, least_docs)


def _update(index: Index, refs: DataFrame, touched: DataFrame) -> Index:
    """The state with new refs: counts are made anew for the keys that were touched, and their filters follow."""
    keys = ["shard", "hi", "lo"]
    fresh = _store(counted(refs.join(touched, keys, "left_semi")), "fresh")
    counts = _store(index.counts.join(touched, keys, "left_anti").unionByName(fresh), "counts")
    at = lambda n: F.coalesce(F.col(n), F.lit(0)) >= index.least_docs
    both = touched.join(index.counts.select(*keys, F.col("n").alias("was")), keys, "left").join(fresh.select(*keys, F.col("n").alias("now")), keys, "left")
    crossed = both.filter(at("was") != at("now")).select("shard", "lo", at("now").alias("enters"))

    def edit(key, held: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
        f = Cuckoo(np.frombuffer(held["table"][0], dtype=np.uint16).reshape(-1, SLOTS).copy()) if len(held) else Cuckoo.empty(0)
        moves = moves.sort_values(["enters", "lo"])  # leaving keys first: they make room
        ok = True
        for a, b, m, enters in zip(*f.places(moves["lo"].to_numpy(dtype=np.int64)), moves["enters"]) if len(moves) else ():
            ok = ok and (f.insert(int(a), int(b), int(m)) if enters else f.remove(int(a), int(b), int(m)))
        return pd.DataFrame({"shard": [key[0]], "buckets": [len(f.table) if ok else -1], "table": [f.table.tobytes() if ok else b""]})

    edited = _store(index.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(edit, FILTERS), "edited")
    full = edited.filter("buckets < 0").select("shard")
    again = build_filters(counts.join(full, "shard", "left_semi"), index.least_docs)
    filters = _store(edited.filter("buckets >= 0").unionByName(again), "filters")
    return replace(index, refs=refs, counts=counts, filters=filters)


def insert(index: Index, docs: DataFrame) -> Index:
    """The state with more documents; pairs that are there already change nothing."""
    new = _store(pairs_of(docs).select(shard(index.shards), "hi", "lo", "doc_id"), "inserted")
    refs = _store(index.refs.unionByName(new).distinct(), "refs")
    return _update(index, refs, _store(new.select("shard", "hi", "lo").distinct(), "touched"))


def delete(index: Index, ids: DataFrame) -> Index:
    """The state without the documents of ids (doc_id); a null id means the null document, unknown ids nothing."""
    gone = ids.select(F.col("doc_id").alias("_gone")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_gone"))
    touched = _store(index.refs.join(gone, same, "left_semi").select("shard", "hi", "lo").distinct(), "touched")
    return _update(index, _store(index.refs.join(gone, same, "left_anti"), "refs"), touched)


def suspected(index: Index) -> Column:
    """Whether the filters let a key (hi, lo) through."""
    size = index.filters.agg(F.coalesce(F.sum(F.octet_length("table").cast("long")), F.lit(0))).first()[0]
    if size > FILTER_BYTES:
        return F.lit(True)
    held = {r.shard: r.table for r in index.filters.collect()}
    shared, shards = index.refs.sparkSession.sparkContext.broadcast(held), index.shards

    @F.pandas_udf("boolean")
    def through(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        filters = {k: Cuckoo(np.frombuffer(t, dtype=np.uint16).reshape(-1, SLOTS)) for k, t in shared.value.items()}
        for hi, lo in batches:
            own, keys, keep = hi.to_numpy() % shards, lo.to_numpy(dtype=np.int64), np.zeros(len(hi), dtype=bool)
            for s in np.unique(own):
                if s in filters:
                    here = np.flatnonzero(own == s)
                    keep[here] = filters[s].has(keys[here])
            yield pd.Series(keep)

    return through("hi", "lo")


def losses(index: Index, pairs: DataFrame | None = None) -> DataFrame:
    """(doc_id, hi, lo): the keys whose lines each document loses; pairs (hi, lo, doc_id): the documents' keys, by
    default those of the index's own documents."""
    suspects = _store((index.refs if pairs is None else pairs).select("doc_id", "hi", "lo").filter(suspected(index)), "suspects")
    known = index.counts.filter(F.col("n") >= index.least_docs).select("hi", "lo", "n", "keeper")
    total = suspects.count()
    # each of a key's holders is a suspect, so fewer than HEAVY keys can have over 1/HEAVY of them; pairs that are not
    # the index's may be fewer, so its own are counted then
    total = total if pairs is None else max(total, index.refs.count())
    heavy = known.filter(F.col("n") * HEAVY > total)
    lost = ~F.col("doc_id").eqNullSafe(F.col("keeper"))
    often = suspects.join(F.broadcast(heavy), ["hi", "lo"]).filter(lost)
    rest = suspects.join(F.broadcast(heavy.select("hi", "lo")), ["hi", "lo"], "left_anti").join(known.filter(F.col("n") * HEAVY <= total), ["hi", "lo"]).filter(lost)
    return often.select("doc_id", "hi", "lo").unionByName(rest.select("doc_id", "hi", "lo"))


def drop_lines(docs: DataFrame, index: Index, own: bool = True) -> DataFrame:
    """docs with two columns more, kept (the text without the lines lost) and counted (n_lines, n_dropped).

    own: docs are documents of the index, whose keys it knows; else their keys are made from their texts. A key at the
    limit loses its lines in all documents but the one with the largest doc_id that holds it. Other lines stay, joined by
    a line feed; a text without lines to lose stays as it is. A null text counts as one empty line and is kept as the
    empty text. Rows that share an id are one document and lose alike. Columns of these names are replaced.
    """
    lost = losses(index, None if own else pairs_of(docs)).groupBy(F.col("doc_id").alias(ROW)).agg(F.collect_set(F.struct("hi", "lo")).alias("_"))
    lost = lost.select(ROW, F.flatten(F.transform("_", lambda d: F.array(d["hi"], d["lo"]))).alias(f"{ROW}_lost"))

    @F.pandas_udf("kept string, n_lines bigint, n_dropped bigint")
    def left(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, gone in batches:
            rows = []
            for text, marks in zip(texts, gone):
                text = text or ""
                if marks is None:
                    rows.append((text, text.count("\n") + 1, 0))
                    continue
                out, lines = {d.tobytes() for d in np.asarray(marks, dtype="<i8").reshape(-1, 2)}, text.split("\n")
                keep = [x for x, k in zip(lines, keys_of(text)) if k is None or digest(k) not in out]
                rows.append(("\n".join(keep), len(lines), len(lines) - len(keep)))
            yield pd.DataFrame(rows, columns=["kept", "n_lines", "n_dropped"])

    names = [c for c in docs.columns if c not in ("kept", "counted")]
    met = docs.select(*names).join(lost, F.col("doc_id").eqNullSafe(F.col(ROW)), "left")
    judged = met.withColumn(f"{ROW}_out", left("text", f"{ROW}_lost"))
    out = F.col(f"{ROW}_out")
    return judged.select(*names, out["kept"].alias("kept"), F.struct(out["n_lines"].alias("n_lines"), out["n_dropped"].alias("n_dropped")).alias("counted"))
