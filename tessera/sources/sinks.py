"""Sinks: partitioned JSON, JSON lines, quoted CSV, natural-key upserts, dry-run totals, key-value stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.quality import flattened
from tessera.operators.relational import new_rows


def partitioned_json(df: DataFrame, path: str, keys: list[str], text: str | None = None, shown: int = 500) -> None:
    """JSON by partition; a text column is cut for the consolidated copy (IO11)."""
    (df if text is None else df.withColumn(text, F.left(text, F.lit(shown)))).write.mode("overwrite").partitionBy(*keys).json(path)


def flat_csv(df: DataFrame, path: str) -> None:
    """RFC 4180 CSV of flattened columns with dotted names (IO12)."""
    flattened(df).write.mode("overwrite").option("header", "true").option("escape", '"').option("quoteAll", "true").csv(path)


def upsert(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends rows whose key isn't there; running it again adds nothing (IO9)."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    fresh = new_rows(spark.read.parquet(path), df, keys) if there else df.dropDuplicates(keys)
    fresh.write.mode("append").parquet(path)


def dry_run(df: DataFrame, keys: list[str], children: dict[str, str]) -> DataFrame:
    """What a write would hold: rows, different keys, and the sizes of array columns (IO10)."""
    return df.agg(F.count("*").alias("rows"), F.countDistinct(*keys).alias("keys"), *[F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(n) for n, c in children.items()])
