"""Table contracts and content fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.operators.guards import GuardViolation
from renewlens.sources.schemas import KEY


def data_contract(
    labels: Mapping[str, DataFrame], tx: DataFrame, members: DataFrame
) -> DataFrame:
    """Measured side of the contract, long form: table, check, value.

    Per label list: rows, duplicate users, non-binary labels, churners, stayers,
    users unknown to the member snapshot. Each source is aggregated once.
    """
    parts: list[DataFrame] = []

    def long(df: DataFrame, table: str, checks: Sequence[str]) -> DataFrame:
        pairs = F.array(
            *[
                F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("value"))
                for c in checks
            ]
        )
        return df.select(F.lit(table).alias("table"), F.explode(pairs).alias("c")).select(
            "table", "c.check", "c.value"
        )

    known = members.select(KEY).distinct().withColumn("known", F.lit(1))
    for name, df in labels.items():
        per_user = df.groupBy(KEY).agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("is_churn") == 1).alias("churn"),
            F.count_if(F.col("is_churn") == 0).alias("stay"),
        )
        stats = per_user.join(known, KEY, "left").agg(
            F.sum("n").alias("rows"),
            (F.sum("n") - F.count(F.lit(1))).alias("duplicate_rows"),
            (F.sum("n") - F.sum("churn") - F.sum("stay")).alias("bad_labels"),
            F.sum("churn").alias("churned"),
            F.sum("stay").alias("stayed"),
            F.count_if(F.col("known").isNull()).alias("not_in_members"),
        )
        parts.append(
            long(
                stats,
                f"labels_{name}",
                ("rows", "duplicate_rows", "bad_labels", "churned", "stayed", "not_in_members"),
            )
        )
    parts.append(
        long(
            tx.agg(F.count(F.lit(1)).alias("rows"), F.max("transaction_date").alias("data_end")),
            "transactions",
            ("rows", "data_end"),
        )
    )
    users = members.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    parts.append(
        long(
            users.agg(
                F.sum("n").alias("rows"), (F.sum("n") - F.count(F.lit(1))).alias("duplicate_rows")
            ),
            "members",
            ("rows", "duplicate_rows"),
        )
    )
    return reduce(DataFrame.unionByName, parts)


def assert_contract(measured: DataFrame, expected: Mapping[tuple[str, str], int]) -> None:
    """Compare with exact expectations; every mismatch is reported."""
    rows = {(r["table"], r["check"]): r["value"] for r in measured.collect()}
    wrong = {k: (rows.get(k), v) for k, v in expected.items() if rows.get(k) != v}
    if wrong:
        raise GuardViolation(f"data_contract: {wrong}")


def check_schema(df: DataFrame, expected: Sequence[str], what: str) -> None:
    if df.columns != list(expected):
        raise GuardViolation(f"{what} has columns {df.columns}, expected {list(expected)}")


def content_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free fingerprint of a table: same rows, same result, however partitioned.

    A multiset hash any engine can compute: the two halves of a row's md5, each summed modulo 2^64.
    Sums, unlike exclusive ors, do not lose a row that is repeated. A row is its columns by name,
    each as text after its length; null is a dash.
    """
    names = sorted(columns or df.columns)

    def cell(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    row = F.md5(F.concat(*map(cell, names)))
    # 28 digits: the sum has 38 and cannot overflow
    halves = [F.conv(F.substring("h", at, 16), 16, 10).cast("decimal(28,0)") for at in (1, 17)]
    size = F.lit(Decimal(1 << 64)).cast("decimal(20,0)")
    sums = [F.pmod(F.coalesce(F.sum(x), F.lit(Decimal(0)).cast("decimal(38,0)")), size).cast("decimal(20,0)") for x in halves]
    return df.select(row.alias("h")).agg(
        F.count(F.lit(1)).alias("n"), sums[0].cast("string").alias("sum_high"), sums[1].cast("string").alias("sum_low")
    )


def members_fingerprint(df: DataFrame) -> DataFrame:
    """Fingerprint of the set of users only."""
    return content_fingerprint(df.select(KEY).distinct(), [KEY])


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Two builds are equal when columns and fingerprints agree."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    return content_fingerprint(a).first() == content_fingerprint(b).first()
