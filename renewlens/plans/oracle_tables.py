"""ANSI SQL building blocks for the side-by-side check.

Each block is a common table expression written independently of the Spark
plans (window functions and self-joins where Spark uses aggregates), plus the
names of the blocks it reads.
"""

from __future__ import annotations

from renewlens.operators.attribution import LinearScorer
from renewlens.operators.cohort import CohortSpec
from renewlens.operators.logs import TRENDS, window_bounds
from renewlens.plans.compose import DEMO_PARAMS, FIXED_SCORER
from renewlens.sources import demo
from renewlens.sources.schemas import LAST_COLUMNS, LOG_WINDOWS, MEMBER_COLUMNS

BLOCKS: dict[str, tuple[str, tuple[str, ...]]] = {}


def block(name: str, sql: str, *needs: str) -> str:
    BLOCKS[name] = (sql, needs)
    return name


def query(select: str, *needs: str) -> str:
    """``WITH`` the needed blocks (and what they need) in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in BLOCKS[name][1]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return select
    parts = ",\n".join(f"{n} AS ({BLOCKS[n][0]})" for n in order)
    return f"WITH {parts}\n{select}"


def day(x: str) -> str:
    """yyyymmdd integer -> DATE."""
    return f"CAST(strptime(CAST({x} AS VARCHAR), '%Y%m%d') AS DATE)"


def ymd(x: str) -> str:
    """DATE -> yyyymmdd integer."""
    return f"CAST(strftime({x}, '%Y%m%d') AS INTEGER)"


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def r6(x: str, name: str, digits: int = 6) -> str:
    """Rounded output column; adding zero turns -0.0 into 0.0."""
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0 AS {name}"


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"


def log_loss(y: str = "is_churn", p: str = "p") -> str:
    q = f"least(greatest({p}, 1e-15), 1.0::DOUBLE - 1e-15)"
    return f"-(CASE WHEN {y} = 1 THEN ln({q}) ELSE ln(1.0::DOUBLE - {q}) END)"


block(
    "tx0",
    """SELECT o_custkey AS user_id, CAST(o_orderkey % 33 AS INTEGER) AS payment_method_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 7 WHEN '2' THEN 30 WHEN '3' THEN 90
    WHEN '4' THEN 180 ELSE 30 END AS payment_plan_days,
  CAST(floor(o_totalprice / 1000) AS INTEGER) AS plan_list_price,
  CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE
    greatest(CAST(floor(o_totalprice / 1000) AS INTEGER) - CAST(o_orderkey % 3 AS INTEGER), 0)
    END AS actual_amount_paid,
  CAST(o_orderdate AS DATE) AS d,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS is_cancel,
  o_orderkey % 4 <> 0 AS renew_key
FROM orders""",
)
block(
    "tx",
    f"""SELECT user_id, payment_method_id, payment_plan_days, plan_list_price, actual_amount_paid,
  CASE WHEN is_cancel = 1 OR renew_key THEN 1 ELSE 0 END AS is_auto_renew,
  {ymd('d')} AS transaction_date, {ymd('d + payment_plan_days')} AS membership_expire_date,
  is_cancel
FROM tx0""",
    "tx0",
)
block(
    "members",
    f"""SELECT c_custkey AS user_id, c_nationkey AS city, CAST(floor(c_acctbal / 100) AS INTEGER) AS bd,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'male' WHEN 'MACHINERY' THEN 'female' END AS gender,
  CAST(c_custkey % 18 AS INTEGER) AS registered_via,
  {ymd("DATE '1995-01-01' + CAST((c_custkey * 37) % 2200 AS INTEGER)")} AS registration_init_time
FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'""",
)
block(
    "logs",
    f"""SELECT user_id, date, CAST(sum(CAST(event_type = 'view' AS INTEGER)) AS INTEGER) AS num_25,
  CAST(sum(CAST(event_type = 'click' AS INTEGER)) AS INTEGER) AS num_50,
  CAST(sum(CAST(event_type = 'signup' AS INTEGER)) AS INTEGER) AS num_75,
  CAST(sum(CAST(event_type = 'error' AS INTEGER)) AS INTEGER) AS num_985,
  CAST(sum(CAST(event_type = 'purchase' AS INTEGER)) AS INTEGER) AS num_100,
  CAST(count(DISTINCT event_type) AS INTEGER) AS num_unq,
  CAST(sum(millis) AS BIGINT) / 1000.0::DOUBLE AS total_secs
FROM (SELECT user_id * 10 + event_id % 10 AS user_id, event_type,
    CAST(round(value * 1000) AS BIGINT) AS millis,
    {ymd("DATE '2000-09-30' - CAST(10 * date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') + hour(ts) % 10 AS INTEGER)")} AS date
  FROM events) e
GROUP BY user_id, date""",
)


def _window_name(spec: CohortSpec) -> str:
    return f"{spec.expire_start}_{spec.expire_end}"


def expiry_block(spec: CohortSpec) -> str:
    return block(
        f"expiry_{_window_name(spec)}",
        f"""SELECT user_id, max(membership_expire_date) AS cutoff FROM tx
WHERE membership_expire_date BETWEEN {spec.expire_start} AND {spec.expire_end}
  AND transaction_date <= membership_expire_date GROUP BY user_id""",
        "tx",
    )


def labels_block(spec: CohortSpec) -> str:
    expiry = expiry_block(spec)
    return block(
        f"labels_{_window_name(spec)}",
        f"""SELECT e.user_id, CASE WHEN max(CASE WHEN t.is_cancel = 0
    AND t.transaction_date > e.cutoff
    AND date_diff('day', {day('e.cutoff')}, {day('t.transaction_date')}) < {demo.CHURN_GAP_DAYS}
    THEN 1 ELSE 0 END) = 1 THEN 0 ELSE 1 END AS is_churn
FROM {expiry} e LEFT JOIN tx t ON t.user_id = e.user_id GROUP BY e.user_id""",
        expiry,
        "tx",
    )


def declared_block(spec: CohortSpec) -> str:
    return block(
        f"declared_{spec.score_date}",
        f"""SELECT user_id, CASE WHEN count(DISTINCT e) = 1 THEN max(e) END AS expire_date
FROM (SELECT user_id, transaction_date,
    CASE WHEN membership_expire_date NOT IN (19700101, 20361015)
      THEN membership_expire_date END AS e,
    max(transaction_date) OVER (PARTITION BY user_id) AS last_day
  FROM tx WHERE transaction_date <= {spec.score_date}) v
WHERE transaction_date = last_day GROUP BY user_id""",
        "tx",
    )


def cutoffs_block(spec: CohortSpec) -> str:
    """User, label, cutoff (and declared expiry) of a cohort."""
    labels = labels_block(spec)
    if spec.fixed_score_date:
        declared = declared_block(spec)
        return block(
            f"cutoffs_{spec.name}",
            f"""SELECT l.user_id, l.is_churn, {spec.score_date} AS cutoff, d.expire_date
FROM {labels} l LEFT JOIN {declared} d ON d.user_id = l.user_id
WHERE d.expire_date IS NULL
  OR d.expire_date BETWEEN {spec.expire_start} AND {spec.expire_end}""",
            labels,
            declared,
        )
    expiry = expiry_block(spec)
    moved = "e.cutoff" if not spec.lead_days else ymd(f"{day('e.cutoff')} - {spec.lead_days}")
    return block(
        f"cutoffs_{spec.name}",
        f"""SELECT l.user_id, l.is_churn, {moved} AS cutoff
FROM {labels} l JOIN {expiry} e ON e.user_id = l.user_id""",
        labels,
        expiry,
    )


def asof_block(spec: CohortSpec) -> str:
    cutoffs = cutoffs_block(spec)
    carry = ", expire_date" if spec.fixed_score_date else ""
    last = ",\n  ".join(
        f"CASE WHEN count(DISTINCT CASE WHEN on_last THEN {c} END) = 1"
        f" THEN max(CASE WHEN on_last THEN {c} END) END AS last_{c}"
        for c in LAST_COLUMNS
    )
    conflict = " OR ".join(
        f"count(DISTINCT CASE WHEN on_last THEN {c} END) > 1" for c in LAST_COLUMNS
    )
    return block(
        f"asof_{spec.name}",
        f"""SELECT user_id, is_churn, cutoff{carry}, count(*) AS n_tx,
  min(transaction_date) AS first_tx, max(transaction_date) AS last_tx,
  CAST(sum(is_cancel) AS BIGINT) AS n_cancel_hist,
  CAST(sum(actual_amount_paid) AS DOUBLE) / count(actual_amount_paid) AS mean_paid,
  {last},
  CAST(sum(CAST(on_last AS INTEGER)) AS BIGINT) AS last_day_n_tx,
  ({conflict}) AS last_day_has_conflict
FROM (SELECT t.*, c.is_churn, c.cutoff{', c.expire_date' if carry else ''},
    t.transaction_date = max(t.transaction_date) OVER (PARTITION BY t.user_id) AS on_last
  FROM tx t JOIN {cutoffs} c ON c.user_id = t.user_id
  WHERE t.transaction_date <= c.cutoff) j
GROUP BY user_id, is_churn, cutoff{carry}""",
        "tx",
        cutoffs,
    )


def cohort_block(spec: CohortSpec) -> str:
    asof = asof_block(spec)
    members = ", ".join(f"m.{c}" for c in MEMBER_COLUMNS)
    return block(
        f"cohort_{spec.name}",
        f"""SELECT a.*, {members}, m.city IS NOT NULL AS in_members
FROM {asof} a LEFT JOIN members m ON m.user_id = a.user_id""",
        asof,
        "members",
    )


def log_rows_block(spec: CohortSpec) -> str:
    cutoffs = cutoffs_block(spec)
    return block(
        f"logrows_{spec.name}",
        f"""SELECT l.user_id, c.cutoff, l.date, date_diff('day', {day('l.date')}, {day('c.cutoff')}) AS days_before,
  l.num_25 + l.num_50 + l.num_75 + l.num_985 + l.num_100 AS plays, l.num_100 AS completed,
  l.num_unq AS unq, CAST(round(l.total_secs * 1000) AS BIGINT) AS millis
FROM logs l JOIN {cutoffs} c ON c.user_id = l.user_id
WHERE date_diff('day', {day('l.date')}, {day('c.cutoff')}) BETWEEN 0 AND 89""",
        "logs",
        cutoffs,
    )


def log_block(spec: CohortSpec) -> str:
    rows = log_rows_block(spec)
    sums = []
    for w in LOG_WINDOWS:
        inside = f"FILTER (WHERE days_before < {w})"
        sums += [
            f"CAST(count(*) {inside} AS BIGINT) AS log{w}_active_days",
            f"CAST(coalesce(sum(millis) {inside}, 0) AS BIGINT) / 1000.0::DOUBLE AS log{w}_secs",
            f"CAST(coalesce(sum(plays) {inside}, 0) AS BIGINT) AS log{w}_plays",
            f"CAST(coalesce(sum(completed) {inside}, 0) AS BIGINT) AS log{w}_completed",
            f"CAST(coalesce(sum(unq) {inside}, 0) AS BIGINT) AS log{w}_unq",
        ]
    base = block(
        f"logsums_{spec.name}",
        f"""SELECT user_id, cutoff, min(days_before) AS log_min_days_before,
  max(days_before) AS log_max_days_before, {', '.join(sums)}
FROM {rows} GROUP BY user_id, cutoff""",
        rows,
    )
    derived = []
    for w in LOG_WINDOWS:
        derived += [
            f"{ratio(f'log{w}_completed', f'log{w}_plays')} AS log{w}_completion",
            f"CAST(log{w}_active_days AS DOUBLE) / {w} AS log{w}_active_ratio",
            f"{ratio(f'log{w}_secs', f'log{w}_active_days')} AS log{w}_secs_per_active_day",
        ]
    for name, (measure, short, long) in TRENDS.items():
        num = f"(CAST(log{short}_{measure} AS DOUBLE) / {short})"
        den = f"(CAST(log{long}_{measure} AS DOUBLE) / {long})"
        derived.append(f"{ratio(num, den)} AS {name}")
    return block(
        f"logf_{spec.name}",
        f"SELECT *, {', '.join(derived)}, 1.0::DOUBLE AS log_has_logs FROM {base}",
        base,
    )


def log_feature_names() -> list[str]:
    from renewlens.operators.logs import log_columns

    return log_columns()


TX_FEATURES = (
    "tenure_days days_since_last_tx days_since_registration n_tx n_cancel_hist cancel_rate "
    "mean_paid last_is_cancel last_is_auto_renew last_paid last_price last_plan_days "
    "discount_amount price_per_day is_free_plan zero_collected in_members bd_clean bd_valid "
    "city registered_via last_payment_method_id gender_code"
).split()
INT_FEATURES = {
    "tenure_days",
    "days_since_last_tx",
    "days_since_registration",
    "city",
    "registered_via",
    "last_payment_method_id",
    "gender_code",
}


def _tx_feature_sql(source: str, extra: str = "") -> str:
    def back(c: str) -> str:
        n = f"date_diff('day', {day(c)}, {day('cutoff')})"
        return f"CASE WHEN {n} >= 0 THEN {n} END"

    def flag(cond: str) -> str:
        return f"CAST(({cond}) AS DOUBLE)"

    paid, price, plan = (
        "last_actual_amount_paid",
        "last_plan_list_price",
        "last_payment_plan_days",
    )
    return f"""SELECT user_id, is_churn, {back('first_tx')} AS tenure_days,
  {back('last_tx')} AS days_since_last_tx,
  {back('v_registration_init_time')} AS days_since_registration,
  CAST(n_tx AS DOUBLE) AS n_tx, CAST(n_cancel_hist AS DOUBLE) AS n_cancel_hist,
  CAST(n_cancel_hist AS DOUBLE) / n_tx AS cancel_rate, mean_paid,
  CAST(last_is_cancel AS DOUBLE) AS last_is_cancel,
  CAST(last_is_auto_renew AS DOUBLE) AS last_is_auto_renew,
  CAST({paid} AS DOUBLE) AS last_paid, CAST({price} AS DOUBLE) AS last_price,
  CAST({plan} AS DOUBLE) AS last_plan_days,
  CAST({price} - {paid} AS DOUBLE) AS discount_amount,
  {ratio(paid, plan)} AS price_per_day, {flag(f'{price} = 0')} AS is_free_plan,
  {flag(f'{paid} = 0 AND {price} > 0')} AS zero_collected,
  {flag('NOT hidden AND in_members')} AS in_members,
  CASE WHEN v_bd BETWEEN 10 AND 100 THEN CAST(v_bd AS DOUBLE) END AS bd_clean,
  coalesce({flag('v_bd BETWEEN 10 AND 100')}, 0.0) AS bd_valid,
  coalesce(v_city, -1) AS city, coalesce(v_registered_via, -1) AS registered_via,
  coalesce(last_payment_method_id, -1) AS last_payment_method_id,
  CASE v_gender WHEN 'male' THEN 0 WHEN 'female' THEN 1 ELSE -1 END AS gender_code{extra}
FROM (SELECT *, {', '.join(f'CASE WHEN NOT hidden THEN {c} END AS v_{c}' for c in MEMBER_COLUMNS)}
  FROM (SELECT *, coalesce(registration_init_time > cutoff, false) AS hidden FROM {source}) h) m"""


def tx_features_block(spec: CohortSpec) -> str:
    cohort = cohort_block(spec)
    extra = ""
    if spec.fixed_score_date:
        n = f"date_diff('day', {day('cutoff')}, {day('expire_date')})"
        extra = f", CAST({n} AS DOUBLE) AS days_to_expire"
    return block(f"txf_{spec.name}", _tx_feature_sql(cohort, extra), cohort)


def features_block(spec: CohortSpec) -> str:
    tx, logs = tx_features_block(spec), log_block(spec)
    names = [c for c in log_feature_names() if c != "log_has_logs"]
    return block(
        f"feat_{spec.name}",
        f"""SELECT t.*, {', '.join(f'l.{c}' for c in names)},
  coalesce(l.log_has_logs, 0.0) AS log_has_logs
FROM {tx} t LEFT JOIN {logs} l ON l.user_id = t.user_id""",
        tx,
        logs,
    )


def feature_columns(spec: CohortSpec) -> list[str]:
    extra = ["days_to_expire"] if spec.fixed_score_date else []
    return [*TX_FEATURES, *extra, *log_feature_names()]


def contribution(scorer: LinearScorer, f: str) -> str:
    known = f"(CAST({f} AS DOUBLE) - {dbl(scorer.means.get(f, 0.0))}) * {dbl(scorer.weights[f])}"
    return f"(CASE WHEN {f} IS NULL THEN {dbl(scorer.missing.get(f, 0.0))} ELSE {known} END)"


def log_odds(scorer: LinearScorer) -> str:
    return " + ".join([dbl(scorer.base), *[contribution(scorer, f) for f in scorer.features]])


SIGMOID = "CASE WHEN z >= 0 THEN 1.0 / (1.0 + exp(-abs(z))) ELSE exp(-abs(z)) / (1.0 + exp(-abs(z))) END"


def scored_block(
    spec: CohortSpec,
    previous: CohortSpec | None = None,
    scorer: LinearScorer = FIXED_SCORER,
    name: str | None = None,
) -> str:
    """Features with score ``p`` (and segment against the previous cohort)."""
    features = features_block(spec)
    title = name or f"scored_{spec.name}"
    inner = f"SELECT *, {log_odds(scorer)} AS z FROM {features}"
    if previous is None:
        return block(title, f"SELECT *, round({SIGMOID}, 12) AS p FROM ({inner}) s", features)
    before = cutoffs_block(previous)
    return block(
        title,
        f"""SELECT s.*, round({SIGMOID}, 12) AS p,
  CASE WHEN s.user_id IN (SELECT user_id FROM {before}) THEN 'repeat' ELSE 'new' END AS segment
FROM ({inner}) s""",
        features,
        before,
    )


def assumptions_block(spec: CohortSpec, previous: CohortSpec) -> str:
    features, before = tx_features_block(spec), cutoffs_block(previous)
    arpu = (
        "CAST(sum(CAST(round(price_per_day * 1000000) AS BIGINT)) AS BIGINT)::DOUBLE"
        f" / count(price_per_day) / 1000000.0::DOUBLE * {dbl(DEMO_PARAMS.days_per_month)}"
    )
    return block(
        "assumptions",
        f"""SELECT *, c_offer / (r_save * ltv_saved) AS p_star FROM (
  SELECT *, monthly_arpu * expected_months AS ltv_saved,
    {dbl(DEMO_PARAMS.r_save)} AS r_save, {dbl(DEMO_PARAMS.c_offer)} AS c_offer FROM (
    SELECT a.monthly_arpu, b.rate AS prior_churn_rate, 1.0::DOUBLE / b.rate AS expected_months
    FROM (SELECT {arpu} AS monthly_arpu FROM {features}) a,
      (SELECT avg(is_churn) AS rate FROM {before}) b) x) y""",
        features,
        before,
    )


def ranked_block(source: str, name: str = "ranked", by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    order = f"{part}ORDER BY p DESC, md5(concat_ws(':', 'tie', CAST(user_id AS VARCHAR))), user_id"
    running = f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return block(
        name,
        f"""SELECT *, row_number() OVER ({order}) AS rank,
  CAST(sum(CAST(round(p * 1000000) AS BIGINT)) {running} AS BIGINT) AS cum_p_units,
  CAST(sum(is_churn) {running} AS BIGINT) AS cum_is_churn,
  count(*) OVER ({f'PARTITION BY {by}' if by else ''}) AS n_total
FROM {source}""",
        source,
    )


def hash_rank_sql(source: str, seed: int | str, strata: str, keys: str = "user_id") -> str:
    """Rank in hash order inside a stratum, as the split operators define it."""
    cols = ", ".join(f"CAST({k.strip()} AS VARCHAR)" for k in keys.split(","))
    part = f"PARTITION BY {strata}" if strata else ""
    return (
        f"SELECT *, row_number() OVER ({part} ORDER BY md5(concat_ws(':', '{seed}', {cols})), {keys})"
        f" AS hash_rank, count(*) OVER ({part}) AS stratum_n FROM {source}"
    )


def merged_block(specs: tuple[CohortSpec, ...]) -> str:
    blocks = [cutoffs_block(s) for s in specs]
    body = " UNION ALL ".join(
        f"SELECT user_id, is_churn, '{s.name}' AS cohort FROM {b}"
        for s, b in zip(specs, blocks, strict=True)
    )
    return block("merged", body, *blocks)


def merged_features_block(specs: tuple[CohortSpec, ...]) -> str:
    blocks = [tx_features_block(s) for s in specs]
    body = " UNION ALL ".join(
        f"SELECT *, '{s.name}' AS cohort FROM {b}" for s, b in zip(specs, blocks, strict=True)
    )
    return block("merged_features", body, *blocks)


def strata_block(source: str = "merged") -> str:
    return block(
        "strata",
        f"""SELECT user_id, count(*) AS n, CAST(sum(is_churn) AS BIGINT) AS k,
  concat_ws('-', count(*), CAST(sum(is_churn) AS BIGINT)) AS stratum FROM {source} GROUP BY user_id""",
        source,
    )




def log_bounds(*specs: CohortSpec) -> tuple[int, int]:
    return window_bounds(list(specs))
