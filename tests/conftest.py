from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from renewlens.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "renewlens-tests",
        master="local[8]",
        conf={
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


COHORT_SCHEMA = (
    "user_id string, is_churn int, cutoff int, n_tx bigint, first_tx int, last_tx int,"
    " n_cancel_hist bigint, mean_paid double, last_is_cancel int, last_is_auto_renew int,"
    " last_actual_amount_paid int, last_plan_list_price int, last_payment_plan_days int,"
    " last_payment_method_id int, city int, bd int, gender string, registered_via int,"
    " registration_init_time int, in_members boolean"
)

# Eight users, one edge case each: month-crossing dates, a transaction after the cutoff,
# zero-day plans, free plans, nothing collected, odd ages, late registration.
COHORT_ROWS = [
    ("u0", 0, 20170228, 13, 20160216, 20170216, 1, 99.0, 1, 1, 99, 99, 30, 41, 1, 0, "male", 7, 20160216, True),
    ("u1", 1, 20170301, 1, 20170228, 20170301, 0, 0.0, 0, 0, 0, 0, 7, 38, 13, 25, None, 9, 20170101, True),
    ("u2", 0, 20170216, 17, 20151018, 20170218, 0, 99.0, 0, 1, 99, 99, 30, 41, 5, -7168, "female", 7, 20140310, True),
    ("u3", 1, 20170228, 2, 20170101, 20170228, 2, 149.0, 1, 1, 0, 149, 30, 40, None, None, None, None, None, False),
    ("u4", 0, 20170101, 25, 20150101, 20170101, 0, 180.0, 0, 1, 180, 180, 90, 39, 1, 34, "male", 3, 20040326, True),
    ("u5", 1, 20170228, 1, 20170220, 20170228, 1, 0.0, 1, 0, 0, 0, 0, 41, 22, 2016, None, 4, 20170330, True),
    ("u6", 0, 20170215, 8, 20160801, 20170215, 0, 149.0, 0, 1, 149, 149, 30, 37, 4, 45, "female", 7, 20150612, True),
    ("u7", 1, 20170228, 3, 20170115, 20170228, 0, 99.0, 0, 0, 99, 99, 30, 36, None, None, None, None, None, False),
]


@pytest.fixture(scope="session")
def cohort(spark):
    return spark.createDataFrame(COHORT_ROWS, COHORT_SCHEMA)


TX_SCHEMA = (
    "user_id string, payment_method_id int, payment_plan_days int, plan_list_price int,"
    " actual_amount_paid int, is_auto_renew int, transaction_date int,"
    " membership_expire_date int, is_cancel int"
)


@pytest.fixture(scope="session")
def make_tx(spark):
    def make(*groups):
        return spark.createDataFrame([r for g in groups for r in g], TX_SCHEMA)

    return make


@pytest.fixture(scope="session")
def two_cohorts(spark):
    """150 shared users plus 50 only in each part; shared labels cycle (0,0) (0,1) (1,1)."""
    pairs = [(0, 0), (0, 1), (1, 1)]
    a = [(f"s{i:04d}", pairs[i % 3][0]) for i in range(150)]
    a += [(f"a{i:04d}", i % 2) for i in range(50)]
    b = [(f"s{i:04d}", pairs[i % 3][1]) for i in range(150)]
    b += [(f"b{i:04d}", i % 2) for i in range(50)]

    def build(rows):
        full = []
        for user, y in rows:
            i = int(user[1:])
            full.append((user, y, 1 + i % 17, round(3.3 + (i % 7) * 0.1, 2), 36 + i % 5))
        return spark.createDataFrame(
            full,
            "user_id string, is_churn int, n_tx int, price_per_day double,"
            " last_payment_method_id int",
        )

    return {"feb": build(a), "mar": build(b)}


@pytest.fixture(scope="session")
def scores(spark):
    """300 users, deterministic labels and scores with many ties and one very hot score."""
    rows = []
    for i in range(300):
        p = 0.5 if i % 3 == 0 else round(((i * 37) % 100 + 0.5) / 100, 3)
        rows.append((i, int((i * 7919) % 11 < 4), p, "new" if i % 4 == 0 else "repeat"))
    return spark.createDataFrame(rows, "user_id bigint, is_churn int, p double, segment string")
