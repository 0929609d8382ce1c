"""Versioned Parquet snapshots of a set of tables: write, list, read, diff against now, roll back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_snapshot(tables: dict[str, DataFrame], root: str, version: int) -> None:
    """All tables of a version, then its manifest; a version without a manifest doesn't count."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/v={version}/{name}")
        rows.append((version, name, spark.read.parquet(f"{root}/v={version}/{name}").count()))
    spark.createDataFrame(rows, "version long, name string, rows long").coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def versions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("version long, name string, rows long").parquet(f"{root}/manifest").orderBy("version", "name")


def read_snapshot(spark: SparkSession, root: str, version: int, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/v={version}/{name}")


def roll_back(spark: SparkSession, root: str, version: int) -> int:
    """A new version with the tables of an old one; history is kept."""
    have = versions(spark, root)
    new = have.agg(F.max("version")).first()[0] + 1
    names = [r.name for r in have.filter(F.col("version") == version).collect()]
    if not names:
        raise ValueError(f"no version {version}")
    write_snapshot({n: read_snapshot(spark, root, version, n) for n in names}, root, new)
    return new
