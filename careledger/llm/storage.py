"""Reading tables, cutting lineage through written tables in the cluster's shared folder, and keeping Python workers small."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in an Arrow batch, about, whatever the size of a row.
BATCH_BYTES = 4 << 20
#: Whether Spark deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets a temporary one; a cluster has no
    folder that its machines are known to share, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="careledger-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/careledger/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages survive a lost executor and don't recompute it.

    Once the table is written the shuffle files that led to it are of no use, so Spark may delete them.
    """
    spark = df.sparkSession
    path = shared_path(spark, what)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete tables that materialize wrote, once no table still to be written reads them."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session in bytes, unless it has a smaller bound: a batch counted in rows may hold any number of long texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if not (now or "").isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def tidy(work: Callable, *caches: dict) -> Callable:
    """``work`` over the batches of a partition; at its end ``caches`` are cleared and Arrow's free memory goes back, since workers are reused."""

    @functools.wraps(work)
    def run(batches):
        import pyarrow

        try:
            yield from work(batches)
        finally:
            for cache in caches:
                cache.clear()
            pyarrow.default_memory_pool().release_unused()

    return run


def with_row_keys(docs: DataFrame, what: str, **columns) -> DataFrame:
    """``docs`` written once as row (a struct of all its columns), rid (a key of its own per row) and ``columns``.

    The caller's columns stay inside the struct, so no name of theirs can clash.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return materialize(docs.select(row, F.monotonically_increasing_id().alias("rid"), *[c.alias(k) for k, c in columns.items()]), what)
