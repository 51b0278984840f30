"""Name -> query over a corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafproof.sources.corpus import Corpus

QUERIES: dict[str, Callable[[Corpus], DataFrame]] = {}


def query(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from leafproof.plans import ingest, search  # noqa: F401  they fill the registry

    return {name: (lambda spark, sf_dir, f=f: f(Corpus(spark, sf_dir))) for name, f in QUERIES.items()}
