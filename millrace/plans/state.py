"""What runs kept, as append-only Parquet tables: runs, items, hashes, simhashes, embeddings; one folder per run."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

TABLES = {"hashes": "string", "simhashes": "long", "embeddings": "array<double>"}


class State:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, table: str) -> str:
        return f"{self.path}/{table}"

    def read(self, table: str, key: str | None = None) -> DataFrame | None:
        """(key, value, item, run_id) rows, or None before the first run."""
        if not storage.path_exists(self.spark, self._at(table)):
            return None
        df = self.spark.read.parquet(self._at(table))
        return df if key is None else df.where(F.col("key") == key)

    def append(self, table: str, run_id: str, rows: DataFrame) -> None:
        rows.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(f"{self._at(table)}/run_id={run_id}")

    def append_run(self, run_id: str, status: str, started: float, items: DataFrame | None) -> None:
        row = [(run_id, status, started, time.time())]
        self.spark.createDataFrame(row, "run_id string, status string, started double, ended double").write.mode("append").parquet(self._at("runs"))
        if items is not None:
            items.select(F.lit(run_id).alias("run"), F.col("index").alias("iter_index")).write.mode("append").parquet(f"{self._at('items')}/run_id={run_id}")

    def delete_run(self, run_id: str) -> None:
        """A run and all that it kept; runs is rewritten without it."""
        for table in ("items", *TABLES):
            storage.remove(self.spark, f"{self._at(table)}/run_id={run_id}")
        runs = self.spark.read.parquet(self._at("runs"))
        rest = storage.stash(runs.where(F.col("run_id") != run_id), "runs")
        rest.write.mode("overwrite").parquet(self._at("runs"))
