"""Readers. Schemas are always explicit; several paths are one scan (a union)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from renewlens.sources import schemas as S


def _scan(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV (with header) or parquet, decided by the file name."""
    files = [paths] if isinstance(paths, str) else list(paths)
    if not files:
        raise ValueError("no input path given")
    csv = [f.rstrip("/").endswith((".csv", ".csv.gz")) for f in files]
    if any(csv) and not all(csv):
        raise ValueError(f"mixed file formats in one source: {files}")
    reader = spark.read.schema(schema)
    if all(csv):
        # The column-order contract is enforced: a shuffled header must not load silently.
        return reader.option("header", True).option("enforceSchema", False).csv(files)
    return reader.parquet(*files)


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("msno", S.KEY)


def scan_transactions(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Union of the base and the increment file(s); the increment alone has no history."""
    return _keyed(_scan(spark, paths, S.TRANSACTIONS))


def scan_transactions_str(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The labeller's view: original characters, so concatenated keys sort as text."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in S.TRANSACTIONS.fields])
    return _keyed(_scan(spark, paths, text).select(*S.LABELLER_COLUMNS))


def read_labels(spark: SparkSession, path: str, *, labels_are_real: bool = True) -> DataFrame:
    """Label file; placeholder labels become null so no score can be computed on them."""
    df = _keyed(_scan(spark, path, S.LABELS))
    return df if labels_are_real else df.withColumn("is_churn", F.lit(None).cast("int"))


def check_members(df: DataFrame) -> DataFrame:
    """Refuse the older member snapshot, which carries a leaking expiry column."""
    if "expiration_date" in df.columns:
        raise ValueError("member snapshot has an 'expiration_date' column: it leaks the outcome")
    missing = [c for c in (S.KEY, *S.MEMBER_COLUMNS) if c not in df.columns]
    if missing:
        raise KeyError(f"member snapshot lacks columns: {missing}")
    return df


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """Member snapshot; the header is inspected before the schema is applied."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        header = spark.read.option("header", True).csv(path).columns
    else:
        header = spark.read.parquet(path).columns
    if "expiration_date" in header:
        raise ValueError("member snapshot has an 'expiration_date' column: it leaks the outcome")
    return check_members(_keyed(_scan(spark, path, S.MEMBERS)))


def scan_logs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Union of the daily-log files."""
    return _keyed(_scan(spark, paths, S.USER_LOGS))
