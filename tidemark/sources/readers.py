"""Scans: registries, snapshots, prices, surveys, documents. Everything is text first and typed by rules that say what failed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.contracts import ContractError, require_unique
from tidemark.semantics import blank_to_null


def csv_text(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """All columns as strings, quotes and line breaks inside them allowed. Other than UTF encodings need spark.sql.legacy.javaCharsets."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if encoding.upper() not in ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.schema(schema).options(header=True, encoding=encoding, multiLine=True, escape='"', enforceSchema=False, mode="FAILFAST")
    return reader.csv([paths] if isinstance(paths, str) else list(paths))


def replacement_counts(df: DataFrame) -> DataFrame:
    """For each text column, how many cells hold the replacement character that a bad byte leaves."""
    return df.agg(*[F.count_if(F.contains(F.col(f"`{c}`"), F.lit("�"))).alias(c) for c, t in df.dtypes if t == "string"])


def renamed(df: DataFrame, names: dict[str, Sequence[str]], tags: dict[str, str] | None = None) -> DataFrame:
    """Columns under their own names; of several names that a column may have, exactly one must be there. Blanks become null."""
    picked = []
    for name, options in names.items():
        there = [o for o in options if o in df.columns]
        if len(there) != 1:
            raise ContractError(f"{name}: {len(there)} of {list(options)} found")
        picked.append(blank_to_null(F.col(f"`{there[0]}`")).alias(name))
    return df.select(*picked, *[F.lit(v).alias(k) for k, v in (tags or {}).items()])


def store_ids(df: DataFrame, kind: str, number: str, prefixes: dict[str, str]) -> DataFrame:
    """store_id of a kind's prefix and a trimmed number; a kind without a prefix stops the run."""
    table = F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair])
    prefix = F.try_element_at(table, F.col(kind))
    known = F.when(prefix.isNull(), F.raise_error(F.concat(F.lit("unknown kind: "), F.coalesce(F.col(kind), F.lit("null"))))).otherwise(prefix)
    return df.withColumn("store_id", F.concat(known, F.lit("_"), F.trim(number)))


def snapshots(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], key: str, pattern: str = r"_(\d{6})\.csv", encoding: str = "UTF-8") -> DataFrame:
    """All files of a directory that is published again and again, with the month in each file's name; keys are unique in each."""
    df = csv_text(spark, paths, columns, encoding).withColumn("snapshot", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))
    return require_unique(df, ["snapshot", key], "snapshots")


def file_rows(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A number from 0 for each row of a scan in the order of the files' names and of the rows in them.

    Splits are told apart by file and offset; sizes of splits come first, then numbers inside them, so that no task has all rows.
    """
    from pyspark.sql import Window as W

    marked = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")).withColumn("_at", F.monotonically_increasing_id())
    sizes = marked.groupBy("_f", "_b").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_f").alias("_g"), F.col("_b").alias("_c"), (F.sum("_n").over(W.orderBy("_f", "_b")) - F.col("_n")).alias("_before"))
    joined = marked.join(F.broadcast(before), (F.col("_f") == F.col("_g")) & (F.col("_b") == F.col("_c")))
    place = F.row_number().over(W.partitionBy("_f", "_b").orderBy("_at"))
    return joined.withColumn(name, F.col("_before") + place - 1).drop("_at", "_f", "_b", "_g", "_c", "_before")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(records, lines that can't be read)"""
    full = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    whole = T.StructType([*full.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    read = lines.select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return read.filter("r._bad IS NULL").select(*[F.col(f"r.{f.name}") for f in full.fields]), read.filter("r._bad IS NOT NULL").select("r._bad")


def json_array(spark: SparkSession, path: str, schema: str, wrapper: str | None = None) -> DataFrame:
    """Items of a JSON array, or of the array under a name."""
    if wrapper:
        return spark.read.schema(f"{wrapper} array<struct<{schema}>>").json(path, multiLine=True).select(F.inline(wrapper))
    return spark.read.schema(", ".join(p.replace(":", " ", 1) for p in _fields(schema))).json(path, multiLine=True)


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def panel_columns(spark: SparkSession, path: str, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Named columns of a Parquet panel with unique keys; the scan reads no others."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"{path}: no {missing}")
    return require_unique(df.select(*columns), keys, path)
