"""Publishing as a snapshot commit: run-stamped page tables, and a pointer table that is replaced whole.

    root/pages/run=<run>           a run's pages, written once and never changed
    root/pointer/<version>-<run>   doc_id, revision, run, is_current, flags: what readers see, one folder a commit
    root/runs/run=<run>            the run's record, written last

A run is published in this order: its pages are staged, documents whose gates hold them back are left out, the others
are flipped, flagged, and what they replace is retired, all in one new pointer; then pages are counted and the run is
recorded. A folder appears by a rename that fails if its name is taken, so a version is there whole or not at all, and
of two runs that commit at once the second starts again from the first one's pointer.

Each step asks whether it is done: a run that was killed anywhere is published by running it again, and running it once
more changes nothing. Until the pointer is replaced no page of the run is seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafproof.sources import store

POINTER = "doc_id string, revision string, run string, is_current boolean, flags array<string>"
RECORD = "doc_id string, revision string, published boolean, pages_indexed bigint, deleted_stale bigint, superseded_demoted bigint, other_revision_kept bigint, published_at timestamp"
#: How often a commit starts again when others commit at the same time.
TRIES = 20


class Conflict(RuntimeError):
    """A commit was overtaken TRIES times."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, schema: str):
        """schema: of the pages, with page_id, doc_id and revision among them."""
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def versions(self) -> list[tuple[int, str]]:
        """(version, run) of every commit, in order."""
        names = [n for n in store.children(self.spark, f"{self.root}/pointer") if not n.startswith("_")]
        return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names)

    def pointer(self, version: int | None = None) -> DataFrame:
        """The pointer of a version, by default the last; empty before the first commit."""
        known = [(v, r) for v, r in self.versions() if version is None or v == version]
        if not known:
            return self.spark.createDataFrame([], POINTER)
        v, run = known[-1]
        return self.spark.read.schema(POINTER).parquet(f"{self.root}/pointer/{v:09d}-{run}")

    def pages_of(self, run: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/pages/run={run}")

    def pages(self, version: int | None = None) -> DataFrame:
        """All pages that the pointer names, with run, is_current and flags."""
        named = self.pointer(version)
        runs = sorted({r for _, r in self.versions()})
        out = self.spark.createDataFrame([], f"{self.schema}, run string")
        for r in runs:
            out = out.unionByName(self.pages_of(r).withColumn("run", F.lit(r)))
        return out.join(named, ["doc_id", "revision", "run"])

    def stage(self, run: str, pages: DataFrame) -> DataFrame:
        """Write a run's pages; a run that has some keeps them."""
        return store.written(self.spark, f"{self.root}/pages/run={run}", lambda: pages, self.schema)

    def commit(self, run: str, decisions: DataFrame) -> int:
        """Replace the pointer. decisions: doc_id, revision, publish, flags, of the run's documents. The version that the
        run made; a run that has committed is not committed again."""
        for _ in range(TRIES):
            done = self.versions()
            for v, r in done:
                if r == run:
                    return v
            at = (done[-1][0] if done else 0) + 1
            if store.put(self.spark, f"{self.root}/pointer/{at:09d}-{run}", self._next(run, decisions), taken=lambda at=at: any(v == at for v, _ in self.versions())):
                return at
        raise Conflict(run)

    def _next(self, run: str, decisions: DataFrame) -> DataFrame:
        """Flip, flag and retire: the run's revision is current with the run's pages alone, others of its document are kept
        and no longer current."""
        here = self.pages_of(run).select("doc_id", "revision").distinct()
        goes = decisions.filter("publish").join(here, ["doc_id", "revision"], "left_semi").select("doc_id", "revision", F.lit(run).alias("run"), F.lit(True).alias("is_current"), "flags")
        old = self.pointer().join(goes.select("doc_id", "revision"), ["doc_id", "revision"], "left_anti")
        moved = goes.select("doc_id", F.lit(True).alias("moved")).distinct()
        kept = old.join(moved, "doc_id", "left").select("doc_id", "revision", "run", (F.col("is_current") & F.col("moved").isNull()).alias("is_current"), "flags")
        return kept.unionByName(goes)

    def record(self, run: str, decisions: DataFrame) -> DataFrame:
        """Write the run's record: a row a document of the run, with what its commit retired. Counted from the pointers
        before and after, so it says the same whenever it is written."""
        version = dict((r, v) for v, r in self.versions())[run]

        def make() -> DataFrame:
            mine = self.pages_of(run).select("page_id", "doc_id", "revision")
            before = self.pages(version - 1).select("page_id", "doc_id", "revision", "run", "is_current")
            docs = mine.groupBy("doc_id", "revision").agg(F.count("*").alias("n")).join(decisions.select("doc_id", "revision", "publish"), ["doc_id", "revision"])
            out = docs.filter("publish")
            same = before.join(out.select("doc_id", "revision"), ["doc_id", "revision"])
            stale = same.join(mine.select("page_id"), "page_id", "left_anti").groupBy("doc_id", "revision").agg(F.count("*").alias("stale"))
            mark = out.select("doc_id", F.col("revision").alias("own"))
            other = before.join(mark, "doc_id").filter("revision != own").groupBy("doc_id", F.col("own").alias("revision")).agg(F.count_if("is_current").alias("demoted"), F.count("*").alias("kept"))
            full = docs.join(stale, ["doc_id", "revision"], "left").join(other, ["doc_id", "revision"], "left").fillna(0)
            return full.select(
                "doc_id", "revision", F.col("publish").alias("published"), F.when(F.col("publish"), F.col("n")).otherwise(0).alias("pages_indexed"),
                F.col("stale").alias("deleted_stale"), F.col("demoted").alias("superseded_demoted"), F.col("kept").alias("other_revision_kept"), F.current_timestamp().alias("published_at"),
            )

        return store.written(self.spark, f"{self.root}/runs/run={run}", make, RECORD)

    def publish(self, run: str, pages: DataFrame, decisions: DataFrame) -> DataFrame:
        """All steps in order; the run's record."""
        self.stage(run, pages)
        self.commit(run, decisions)
        return self.record(run, decisions)

    def stale_runs(self) -> list[str]:
        """Runs whose pages the last pointer no longer names: their folders may be cleared once no reader is left."""
        named = {r.run for r in self.pointer().select("run").distinct().collect()}
        return sorted({r for _, r in self.versions()} - named)
