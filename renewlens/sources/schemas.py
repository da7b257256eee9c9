"""Explicit source schemas, column roles and the encodings used downstream."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "user_id"


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


_INT, _STR, _DBL = T.IntegerType(), T.StringType(), T.DoubleType()

# The raw file layouts, in file order. ``msno`` is the raw user key.
LABELS = _schema(msno=_STR, is_churn=_INT)
TRANSACTIONS = _schema(
    msno=_STR,
    payment_method_id=_INT,
    payment_plan_days=_INT,
    plan_list_price=_INT,
    actual_amount_paid=_INT,
    is_auto_renew=_INT,
    transaction_date=_INT,
    membership_expire_date=_INT,
    is_cancel=_INT,
)
MEMBERS = _schema(
    msno=_STR, city=_INT, bd=_INT, gender=_STR, registered_via=_INT, registration_init_time=_INT
)
USER_LOGS = _schema(
    msno=_STR,
    date=_INT,
    num_25=_INT,
    num_50=_INT,
    num_75=_INT,
    num_985=_INT,
    num_100=_INT,
    num_unq=_INT,
    total_secs=_DBL,
)

# The seven columns the labeller reads, all as text.
LABELLER_COLUMNS = (
    "msno",
    "payment_method_id",
    "payment_plan_days",
    "plan_list_price",
    "transaction_date",
    "membership_expire_date",
    "is_cancel",
)

# Encodings and bounds that decide feature values.
EXPIRY_SENTINELS = (19700101, 20361015)
MISSING_CATEGORY = -1
GENDER_CODES = {"male": 0, "female": 1}
AGE_RANGE = (10, 100)
LOG_WINDOWS = (7, 14, 30, 90)
MAX_WINDOW = max(LOG_WINDOWS)
PLAY_COLUMNS = ("num_25", "num_50", "num_75", "num_985", "num_100")
NO_RENEWAL_GAP = 9999

# Attributes read off the last transaction day.
LAST_COLUMNS = (
    "is_cancel",
    "is_auto_renew",
    "actual_amount_paid",
    "plan_list_price",
    "payment_plan_days",
    "payment_method_id",
)
MEMBER_COLUMNS = ("city", "bd", "gender", "registered_via", "registration_init_time")
CATEGORICAL = ("city", "registered_via", "last_payment_method_id", "gender_code")

COHORT_COLUMNS = (
    KEY,
    "is_churn",
    "cutoff",
    "n_tx",
    "first_tx",
    "last_tx",
    "n_cancel_hist",
    "mean_paid",
    *[f"last_{c}" for c in LAST_COLUMNS],
    "last_day_n_tx",
    "last_day_has_conflict",
    *MEMBER_COLUMNS,
    "in_members",
)
