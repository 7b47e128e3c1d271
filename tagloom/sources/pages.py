"""Where HTML comes from: tables of pages, folders of files, bytes of doubtful encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.columns import repair_utf8


def read_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A Parquet table of pages. Small files come as few partitions; `partitions` spreads them before the parser."""
    df = spark.read.parquet(path)
    return df.repartition(partitions) if partitions else df


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """url, html of whole files, each ill-formed byte as U+FFFD."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("url"), repair_utf8("content").alias("html"))


def write_nodes(nodes: DataFrame, path: str) -> None:
    """The node relation as Parquet, for reuse by many queries."""
    nodes.write.parquet(path)
