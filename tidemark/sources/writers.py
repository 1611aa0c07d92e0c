"""Sinks: staged writes that become visible only after they have been verified."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.contracts import ContractError
from tidemark.operators.publish import manifest


def _fs(df: DataFrame, path: str):
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where that may be unset, a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ContractError("spark.checkpoint.dir is unset; a folder of one machine can't be shared")
    own = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stored(df: DataFrame, name: str, form: str = "parquet", **options) -> str:
    """Write a table to the shared folder under a new name that ends in `name`; its path."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.options(**options).format(form).save(path)
    return path


def staged(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None, form: str = "parquet", **options) -> DataFrame:
    """Write beside the target, read it again, check it, then swap it in; what was there stays until then."""
    fs, make = _fs(df, path)
    beside, old = f"{path.rstrip('/')}.staged", f"{path.rstrip('/')}.old"
    df.write.mode("overwrite").options(**options).format(form).save(beside)
    written = df.sparkSession.read.schema(df.schema).options(**options).format(form).load(beside)
    if check:
        try:
            check(written)
        except Exception:
            fs.delete(make(beside), True)
            raise
    fs.delete(make(old), True)
    if fs.exists(make(path)):
        fs.rename(make(path), make(old))
    if not fs.rename(make(beside), make(path)):
        raise ContractError(f"{path}: the staged table could not be moved")
    fs.delete(make(old), True)
    return df.sparkSession.read.schema(df.schema).options(**options).format(form).load(path)


def bundle(documents: DataFrame, key: str, path: str, forbidden: str | None = None) -> DataFrame:
    """Documents as JSON lines with a manifest of hash and size; both are read again and compared before the swap."""
    want = manifest(documents, key)

    def check(written: DataFrame) -> None:
        again = manifest(written, key)
        if not want.exceptAll(again).isEmpty() or not again.exceptAll(want).isEmpty():
            raise ContractError("what was written differs from what was to be written")
        if forbidden and not written.filter(F.col("document").rlike(forbidden)).isEmpty():
            raise ContractError("a document holds what must not be published")

    staged(documents.select(key, "document"), f"{path}/documents", check, "json")
    return staged(want, f"{path}/manifest")


def csv_with_header(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
