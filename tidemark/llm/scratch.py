"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.writers import shared_folder

#: Shuffle files of a finished write go at once, not when the driver's JVM happens to collect its garbage; what is read later is the table.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; in local mode, where that may be unset, a temporary folder. Elsewhere an unset one is an error."""
    return shared_folder(spark)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder is the cluster's scratch space
        pass


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)
    _written.clear()


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lost executors can't undo it, later jobs start here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove a table() that no later job reads."""
    for path in df.inputFiles()[:1]:
        for spark, root in list(_written):
            if root.rsplit("/", 1)[1] in path:
                _remove(spark, root)
                _written.remove((spark, root))
