"""Tables of a directory as temporary views."""

from __future__ import annotations

from pyspark.sql import SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register(spark: SparkSession, sf_dir: str, tables=TABLES) -> None:
    """Each ``<dir>/<table>.parquet`` becomes the view ``<table>``; only Spark's reader touches the path."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
