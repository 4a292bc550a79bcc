"""Writing tables. Every format is written in parallel; ``single_file`` funnels through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.models import export_results
from . import arrow


def _shaped(df: DataFrame, single_file: bool) -> DataFrame:
    return df.coalesce(1) if single_file else df


def write_csv(df: DataFrame, path: str, sep: str = ",", single_file: bool = False, mode: str = "errorifexists") -> None:
    """Header, no index column, quotes doubled inside quoted cells."""
    _shaped(df, single_file).write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_tsv(df: DataFrame, path: str, **options) -> None:
    write_csv(df, path, sep="\t", **options)


def write_json(df: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists") -> None:
    _shaped(df, single_file).write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_feather(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Feather files, one for each partition that has rows; an empty table leaves one file with its schema.

    Tasks write under names of their own attempt; the files appear when the job commits, and those of
    failed or repeated attempts never do. Modes: errorifexists, overwrite, append, ignore.
    """
    if mode not in ("errorifexists", "error", "overwrite", "append", "ignore"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = df.sparkSession
    arrow.register(spark)
    place = arrow.qualified(spark, path)
    if mode in ("errorifexists", "error", "ignore") and arrow.exists(place):
        if mode == "ignore":
            return
        raise FileExistsError(path)
    df.write.format(arrow.FORMAT).mode("overwrite" if mode == "overwrite" else "append").save(place)


def write_model_results(results: DataFrame, path: str, **options) -> None:
    """One row per model; the error text is left out, so a failed model keeps an empty row."""
    write_csv(export_results(results), path, single_file=True, **options)
