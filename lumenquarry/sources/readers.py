"""Files as tables: Parquet, CSV and JSON, each with Spark's own readers, so pushdown and pruning reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """A file or folder as a table. kind: parquet, csv, json or jsonl (from the name's ending if not given). A CSV without a
    schema is all text and its literal NULL is null; a JSON array of objects and JSON lines both work."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        r = spark.read.option("header", True).option("nullValue", "NULL")
        return (r.schema(schema) if schema else r).csv(path)
    if kind in ("json", "jsonl"):
        r = spark.read.option("multiLine", kind == "json")
        return (r.schema(schema) if schema else r).json(path)
    raise ValueError(f"unknown kind of file: {kind}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as a schemaless table: one VARIANT column _doc."""
    return spark.read.option("singleVariantColumn", "_doc").json(path)
