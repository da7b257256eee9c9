"""Adapter from the commerce tables in the test-data folder to the domain tables.

orders become transactions, customer the member snapshot, events the daily
activity logs. The modulo expressions only derive columns (and decide which
customers the member snapshot lacks); no transaction, event or user is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.functions.dates import add_days, days_between_sql, ymd_sql
from renewlens.operators.cohort import CohortSpec, cutoff_by_expiry
from renewlens.sources.readers import check_members

# How the commerce tables map to the domain.
LOG_ANCHOR = "2000-09-30"
EVENTS_LAST_DAY = "2024-01-30"
CHURN_GAP_DAYS = 180
PLAN_DAYS = {"1": 7, "2": 30, "3": 90, "4": 180}

Q2 = CohortSpec("q2", 20000401, 20000630, labels="q2")
Q3 = CohortSpec("q3", 20000701, 20000930, labels="q3")
Q2_T7 = CohortSpec("q2_t7", 20000401, 20000630, labels="q2", lead_days=7)
Q3_T7 = CohortSpec("q3_t7", 20000701, 20000930, labels="q3", lead_days=7)
Q2_FIXED = CohortSpec("q2_fixed", 20000401, 20000630, labels="q2", score_date=20000331)
Q3_FIXED = CohortSpec("q3_fixed", 20000701, 20000930, labels="q3", score_date=20000630)
SPECS = {s.name: s for s in (Q2, Q3, Q2_T7, Q3_T7, Q2_FIXED, Q3_FIXED)}


# The columns read from each commerce table. Declaring them spares the footer-reading
# job of schema inference; column pruning drops whatever a query does not use.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = " ".join(
        f"when o_orderpriority like '{digit}%' then {days}" for digit, days in PLAN_DAYS.items()
    )
    raw = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as user_id",
        "o_orderkey",
        "cast(o_orderdate as date) as day",
        f"case {plans} else 30 end as plan",
        "cast(floor(o_totalprice / 1000) as int) as price",
        "o_orderstatus = 'F' and o_orderkey % 3 = 0 as cancel",
    )
    return raw.selectExpr(
        "user_id",
        "cast(o_orderkey % 33 as int) as payment_method_id",
        "plan as payment_plan_days",
        "price as plan_list_price",
        "case when o_orderkey % 11 = 0 then 0"
        " else greatest(price - cast(o_orderkey % 3 as int), 0) end as actual_amount_paid",
        "cast(cancel or o_orderkey % 4 <> 0 as int) as is_auto_renew",
        f"{ymd_sql('day')} as transaction_date",
        f"{ymd_sql('date_add(day, plan)')} as membership_expire_date",
        "cast(cancel as int) as is_cancel",
    )


TEXT_COLUMNS = (
    "payment_method_id",
    "payment_plan_days",
    "plan_list_price",
    "transaction_date",
    "membership_expire_date",
    "is_cancel",
)


def transactions_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as text, as the labeller reads them."""
    return as_text(transactions(spark, sf_dir))


def as_text(tx: DataFrame) -> DataFrame:
    return tx.selectExpr("user_id", *[f"cast({c} as string) as {c}" for c in TEXT_COLUMNS])


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    registered = "date_add(date'1995-01-01', cast((c_custkey * 37) % 2200 as int))"
    return check_members(
        table(spark, sf_dir, "customer")
        # Household accounts have no member record; every customer is read.
        .filter("c_mktsegment <> 'HOUSEHOLD'")
        .selectExpr(
            "c_custkey as user_id",
            "c_nationkey as city",
            "cast(floor(c_acctbal / 100) as int) as bd",
            "case c_mktsegment when 'BUILDING' then 'male' when 'MACHINERY' then 'female' end"
            " as gender",
            "cast(c_custkey % 18 as int) as registered_via",
            f"{ymd_sql(registered)} as registration_init_time",
        )
    )


EVENT_COLUMNS = {
    "view": "num_25",
    "click": "num_50",
    "signup": "num_75",
    "error": "num_985",
    "purchase": "num_100",
}


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day, stretched over the 300 days before the anchor."""
    back = f"10 * datediff(date'{EVENTS_LAST_DAY}', cast(ts as date)) + hour(ts) % 10"
    counts = [
        f"cast(count_if(event_type = '{kind}') as int) as {name}"
        for kind, name in EVENT_COLUMNS.items()
    ]
    # One flag per event kind counts the distinct kinds without a second shuffle.
    kinds = " + ".join(f"max(cast(event_type = '{kind}' as int))" for kind in EVENT_COLUMNS)
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "user_id * 10 + event_id % 10 as user_id",
            f"{ymd_sql(f"date_sub(date'{LOG_ANCHOR}', {back})")} as date",
            "event_type",
            "cast(round(value * 1000) as bigint) as millis",
        )
        .groupBy("user_id", "date")
        .agg(
            *[F.expr(c) for c in counts],
            F.expr(f"{kinds} as num_unq"),
            F.expr("cast(sum(millis) as double) / 1000 as total_secs"),
        )
    )


def labels(spark: SparkSession, sf_dir: str, spec: CohortSpec) -> DataFrame:
    """Label list of an expiry window: churn means no non-cancel transaction for 180 days.

    Both inputs are one row per user (or per user and day) before they meet.
    """
    tx = transactions(spark, sf_dir)
    expiry = cutoff_by_expiry(tx, spec)
    horizon = add_days(spec.expire_end, CHURN_GAP_DAYS)
    renewals = (
        tx.filter(
            f"transaction_date between {spec.expire_start} and {horizon} and is_cancel = 0"
        )
        .select("user_id", "transaction_date")
        .distinct()
    )
    gap = (
        "min(case when transaction_date > cutoff then "
        f"{days_between_sql('transaction_date', 'cutoff')} end)"
    )
    return (
        expiry.join(renewals, "user_id", "left")
        .groupBy("user_id")
        .agg(F.expr(f"{gap} as gap"))
        .selectExpr("user_id", f"cast(coalesce(gap, {CHURN_GAP_DAYS}) >= {CHURN_GAP_DAYS} as int) as is_churn")
    )
