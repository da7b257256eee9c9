"""Sinks. Order matters only here, where people read the files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.operators.score import assert_submission, fill_prior
from renewlens.session import stage
from renewlens.sources.schemas import KEY


def _write(df: DataFrame, path: str, fmt: str) -> None:
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format {fmt!r}: use 'csv' or 'parquet'")
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def write_offer_list(wide: DataFrame, path: str, fmt: str = "csv") -> None:
    """Offer list, best score first. The files sort by range, one task per range."""
    _write(wide.orderBy(F.col("p").desc(), F.col(KEY)), path, fmt)


def write_audit(audit: DataFrame, path: str, fmt: str = "csv") -> None:
    """Every candidate reason, by user and rank."""
    _write(audit.orderBy(KEY, "rank"), path, fmt)


def write_submission(
    requested: DataFrame, scored: DataFrame, prior: float, path: str, fmt: str = "csv"
) -> DataFrame:
    """All requested users with a probability, written after the hard checks pass."""
    out = stage(fill_prior(requested, scored, prior).select(KEY, "is_churn"), "submission")
    assert_submission(requested, out)
    _write(out.orderBy(KEY), path, fmt)
    return out


def write_metrics_report(
    spark: SparkSession, rows: Iterable[tuple[str, float]] | DataFrame | Mapping[str, Any], path: str
) -> None:
    """One JSON line per metric."""
    if isinstance(rows, DataFrame):
        df = rows
    else:
        pairs = rows.items() if isinstance(rows, Mapping) else rows
        df = spark.createDataFrame(
            [(str(k), float(v)) for k, v in pairs], "metric string, value double"
        )
    df.write.mode("overwrite").json(path)
