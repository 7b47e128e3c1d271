"""Pages as a stream: every function is stateless by row, so batch code runs unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.columns import html_meta, html_to_text


def stream_pages(spark: SparkSession, folder: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, title, text of a batch or stream of pages."""
    return pages.withColumn("m", html_meta("html")).select("page_id", F.col("m.title").alias("title"), html_to_text("html").alias("text"))
