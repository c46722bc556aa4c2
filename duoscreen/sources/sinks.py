"""Sinks of score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_scores(df: DataFrame, path: str, fmt: str = "csv", sep: str = ",", mode: str = "error") -> None:
    """Write a score table as CSV, TSV or parquet (S9). Many part files, written in parallel."""
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
        return
    df.write.mode(mode).option("header", True).option("sep", "\t" if fmt == "tsv" else sep).csv(path)
