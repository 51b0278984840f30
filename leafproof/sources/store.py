"""Tables written once in the cluster's shared folder: durable intermediate results, and the page index.

The index is made of a corpus's tables when a query first asks for it, and read by all later queries. It is known by
the paths, sizes and times of the files it was made from, so other or changed tables get an index of their own.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of an Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = "512", "16m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, else its checkpoint folder.

    Only a session that names neither gets one made: in the warehouse, which a cluster shares, or a temporary one where
    there is but this machine (tests).
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        alone = spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
        named = "file://" + tempfile.mkdtemp(prefix="leafproof-") if alone else spark.conf.get("spark.sql.warehouse.dir") + "/leafproof-shared"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that texts travel in to Python: memory of a worker follows them, not the partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafproof/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, size, time of change) of the files under a path, in any store, empty ones included."""
    at, out = spark._jvm.org.apache.hadoop.fs.Path(path), []
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return out


def signature(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the paths, sizes and times of the files under paths."""
    return hashlib.sha256("\n".join(sorted(str(f) for p in paths for f in listed(spark, p))).encode()).hexdigest()[:24]


def put(spark: SparkSession, path: str, df: DataFrame, taken: Callable[[], bool] = lambda: False) -> bool:
    """Write a table so that it is at path whole or not at all; False if another one is there, or `taken` says so.

    It is written under a hidden name of its own and then renamed, which fails if the name is taken. What is left of a
    lost race is the cluster's to clear.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    parent, name = path.rsplit("/", 1)
    own = f"{parent}/_{name}-{uuid.uuid4().hex}"
    df.write.parquet(own)
    if taken():
        return False
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(jvm.org.apache.hadoop.fs.Path(own), at, options)
        return True
    except Py4JJavaError:
        if not at.getFileSystem(conf).exists(at):
            raise
        return False


def written(spark: SparkSession, path: str, make: Callable[[], DataFrame], schema: str) -> DataFrame:
    """The table at path, made first if there is none. Of two sessions that make one at once, the first to rename wins
    and the other reads that one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        put(spark, path, make().select(*spark_names(schema)))
    return spark.read.schema(schema).parquet(path)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in any store; none if there is no folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def spark_names(schema: str) -> list[str]:
    """The column names of a schema string."""
    return StructType.fromDDL(schema).names


def numbered(rows: DataFrame, keys: list[str], order: str | list[str], name: str) -> DataFrame:
    """rows (narrow, without texts) with `name`: 1, 2, ... within each key in the order of `order`, which
    holds no texts.

    No task sees a whole group. Rows are sorted over the cluster, written with their places, and each range's first
    number is the count of the group's rows in the ranges before it: a window over one row a group and range.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [*keys, *([order] if isinstance(order, str) else order)]
    at = durable(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "places")
    part = F.shiftright("_id", 33).alias("_part")
    at = at.select("*", part)
    per = at.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    group = ["_part", *keys]
    per = per.select("_n", "_first", F.coalesce(before, F.lit(0)).alias("_before"), *[F.col(k).alias(f"_of_{k}") for k in group])
    same = F.lit(True)
    for k in group:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return at.join(per, same).select(*rows.columns, (F.col("_id") - F.col("_first") + F.col("_before") + 1).cast("int").alias(name))
