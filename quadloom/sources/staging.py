"""Tables that cut lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where a local session names none (tests).

    On a cluster without the setting this is an error, as executors don't share temporary folders.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-quadloom-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """All tables that are staged within go when it ends; what is to stay must have been written elsewhere by then."""
    folder = f"{shared_dir(spark)}/quadloom-scratch-{uuid.uuid4().hex}"
    outer = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(outer)
        remove_folder(spark, folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; other tables are left alone."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("quadloom-"):
                remove_folder(spark, folder)


#: Rows of a few bytes that are sent to all tasks without further thought.
FEW = 500_000


def small(keys: DataFrame) -> DataFrame:
    """keys, stored, marked for broadcast when it has few rows; else as it is, for a shuffled join."""
    return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys


#: Tasks a core below which a scan may lie in fewer row groups than there are cores.
SCARCE = 4


def spread(rows: DataFrame) -> DataFrame:
    """rows, a scan, dealt out evenly where it has few tasks, before work that is costly by the row.

    A file of one row group is read by one task, however many the scan has. A scan of many tasks a core is left as it is,
    so what this shuffles is bounded by the cores' number and not by the table.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < SCARCE * cores else rows


#: Spark's setting that drops an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: short lineage, stable rows, survives lost executors.

    The shuffle files that made the table are no longer needed once it is written, so Spark may drop them then.
    """
    spark = df.sparkSession
    path = f"{_scratch.get() or shared_dir(spark)}/quadloom-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
