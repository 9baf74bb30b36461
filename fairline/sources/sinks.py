"""Sinks (S12, S13): Parquet per stage, CSV and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_stage(df: DataFrame, path: str, partitions: tuple[str, ...] = ("league", "season"), sort: tuple[str, ...] = ("date",)) -> None:
    """Parquet by league and season, rows sorted within files, so folds and reference windows prune."""
    by = [c for c in partitions if c in df.columns]
    order = [c for c in (*by, *sort) if c in df.columns]
    (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """Report tables as CSV with a header, or as JSON lines."""
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if form == "csv" else w.json(path)
