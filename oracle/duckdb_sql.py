"""The same queries as SQL for DuckDB over the same tables."""

from __future__ import annotations

# -- pieces ---------------------------------------------------------------------

ORDERS = """SELECT o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS transaction_date,
    CAST(o_totalprice AS DECIMAL(20,2)) AS amount_cop, o_orderstatus AS transaction_type
    FROM orders"""
SHIPMENTS = """SELECT l_partkey AS customer_id, CAST(l_shipdate AS DATE) AS transaction_date,
    CAST(l_extendedprice AS DECIMAL(20,2)) AS amount_cop, l_returnflag AS transaction_type
    FROM lineitem"""
EVENTS = """SELECT user_id AS customer_id, CAST(ts AS DATE) AS transaction_date,
    CAST(value AS DECIMAL(20,2)) AS amount_cop, event_type AS transaction_type
    FROM events"""
DISTINCT_SHIPMENTS = f"""SELECT DISTINCT customer_id, transaction_date, transaction_type
    FROM ({SHIPMENTS})"""
ORDERING = "SELECT c_custkey AS customer_id FROM customer WHERE c_acctbal > 0"
SHIPPED = "SELECT p_partkey AS customer_id FROM part WHERE p_size <= 40"


def percent(numerator: str, denominator: str) -> str:
    """Percentage with two decimals in whole numbers, ties to the even digit."""
    scaled = f"(CAST({numerator} AS HUGEINT) * 10000)"
    whole = f"({scaled} // {denominator})"
    rest = f"({scaled} % {denominator})"
    up = f"(2 * {rest} > {denominator} OR (2 * {rest} = {denominator} AND {whole} % 2 = 1))"
    return f"""CASE WHEN {denominator} = 0 THEN CAST(0 AS DOUBLE)
        ELSE CAST({whole} + CASE WHEN {up} THEN 1 ELSE 0 END AS DOUBLE) / 100 END"""


def working(ledger: str, eligible: str, analysis: str) -> str:
    """The working relation with windows of 90 days."""
    return f"""SELECT customer_id,
        min(transaction_date) AS first_transaction_date,
        max(transaction_date) AS last_transaction_date,
        CAST(date_diff('day', min(transaction_date), DATE '{analysis}') + 1 AS BIGINT)
            AS observed_days,
        CAST(date_diff('day', max(transaction_date), DATE '{analysis}') AS BIGINT)
            AS recency_days,
        count(*) AS transactions_full_period,
        count(*) FILTER (WHERE transaction_date
            BETWEEN DATE '{analysis}' - 89 AND DATE '{analysis}') AS transactions_recent_90d,
        count(*) FILTER (WHERE transaction_date
            BETWEEN DATE '{analysis}' - 179 AND DATE '{analysis}' - 90) AS transactions_prior_90d,
        count(DISTINCT date_trunc('month', transaction_date)) AS active_months,
        min(transaction_date) <= DATE '{analysis}' - 179 AS sufficient_prior_history
    FROM ({ledger}) AS ledger
    WHERE customer_id IN ({eligible})
    GROUP BY customer_id"""


CANONICAL = working(ORDERS, ORDERING, "2001-08-01")
SHIPPED_CANONICAL = working(SHIPMENTS, SHIPPED, "2001-11-04")
SHIPPED_COLLAPSED = working(DISTINCT_SHIPMENTS, SHIPPED, "2001-11-04")
VARIANTS = f"""SELECT 'canonical' AS data_variant, * FROM ({SHIPPED_CANONICAL})
    UNION ALL BY NAME
    SELECT 'exact_groups_collapsed' AS data_variant, * FROM ({SHIPPED_COLLAPSED})"""


def measures(population: str, *, counts: bool) -> str:
    """Summary measures of a group of customers, as aggregates over rows of ``w``."""
    n = "count(w.customer_id)"
    zero = "count(*) FILTER (WHERE transactions_prior_90d = 0)"
    lacking = "count(*) FILTER (WHERE NOT sufficient_prior_history)"
    zero_count = f"{zero} AS zero_prior_90d_customers," if counts else ""
    lacking_count = f"{lacking} AS insufficient_prior_history_customers," if counts else ""
    quantile = "round(quantile_cont({}, {}), 2)".format
    return f"""{n} AS customer_count,
        {percent(n, population)} AS eligible_population_pct,
        {quantile("transactions_prior_90d", 0.25)} AS transactions_prior_90d_q1,
        {quantile("transactions_prior_90d", 0.5)} AS transactions_prior_90d_median,
        {quantile("transactions_prior_90d", 0.75)} AS transactions_prior_90d_q3,
        {zero_count}
        {percent(zero, n)} AS zero_prior_90d_pct,
        {quantile("transactions_full_period", 0.5)} AS transactions_full_period_median,
        {quantile("active_months", 0.5)} AS active_months_median,
        {lacking_count}
        {percent(lacking, n)} AS insufficient_prior_history_pct"""


SCENARIOS = f"""WITH variants AS ({VARIANTS}),
    population AS (SELECT data_variant, count(*) AS people FROM variants GROUP BY data_variant),
    frame AS (
        SELECT data_variant, people, t AS threshold_days
        FROM population CROSS JOIN (VALUES (30), (60), (90)) AS thresholds(t)
    )
    SELECT f.data_variant, 'More than ' || threshold_days || ' days' AS scenario,
        CAST(threshold_days AS INTEGER) AS threshold_days,
        {measures("any_value(people)", counts=True)}
    FROM frame f LEFT JOIN variants w
        ON w.data_variant = f.data_variant AND w.recency_days > f.threshold_days
    GROUP BY f.data_variant, threshold_days"""

SCENARIO_CHANGE = f"""WITH summary AS ({SCENARIOS})
    SELECT s.*,
        s.customer_count - r.customer_count AS customer_count_change_vs_canonical,
        round(s.transactions_prior_90d_median - r.transactions_prior_90d_median, 2)
            AS prior_median_change_vs_canonical
    FROM summary s LEFT JOIN summary r
        ON r.data_variant = 'canonical' AND r.threshold_days = s.threshold_days"""

SCENARIO_DOUBLES = [
    "eligible_population_pct",
    "transactions_prior_90d_q1",
    "transactions_prior_90d_median",
    "transactions_prior_90d_q3",
    "zero_prior_90d_pct",
    "transactions_full_period_median",
    "active_months_median",
    "insufficient_prior_history_pct",
    "prior_median_change_vs_canonical",
]

BANDS = """CASE WHEN recency_days <= 30 THEN 0 WHEN recency_days <= 60 THEN 1
    WHEN recency_days <= 90 THEN 2 ELSE 3 END"""

# -- engagement -------------------------------------------------------------------

COARSE_EVENTS = """SELECT user_id AS customer_id, CAST(ts AS DATE) AS transaction_date,
    CAST(floor(value / 50) * 50 AS DECIMAL(20,2)) AS amount_cop, event_type AS transaction_type
    FROM events"""


def recent_windows(ledger: str, eligible: str, analysis: str, windows: tuple[int, ...]) -> str:
    def counts(days: int) -> str:
        return f"""count(*) FILTER (WHERE transaction_date
            BETWEEN DATE '{analysis}' - {days - 1} AND DATE '{analysis}') AS transactions_recent_{days}d,
        count(*) FILTER (WHERE transaction_date
            BETWEEN DATE '{analysis}' - {2 * days - 1} AND DATE '{analysis}' - {days})
            AS transactions_prior_{days}d,
        min(transaction_date) <= DATE '{analysis}' - {2 * days - 1} AS sufficient_history_{days}d"""

    return f"""SELECT customer_id, count(*) AS transactions_full_period,
        {", ".join(counts(days) for days in windows)}
    FROM ({ledger}) WHERE customer_id IN ({eligible}) GROUP BY customer_id"""


def values(ledger: str, eligible: str, analysis: str, days: int, variant: str) -> str:
    recent = f"transaction_date BETWEEN DATE '{analysis}' - {days - 1} AND DATE '{analysis}'"
    prior = f"transaction_date BETWEEN DATE '{analysis}' - {2 * days - 1} AND DATE '{analysis}' - {days}"

    def total(condition: str) -> str:
        return f"CAST(coalesce(sum(amount_cop) FILTER (WHERE {condition}), 0) AS DECIMAL(38,2))"

    return f"""SELECT '{variant}' AS data_variant, *,
        CAST(amount_recent_{days}d - amount_prior_{days}d AS DECIMAL(38,2)) AS amount_change,
        CAST(amount_full_period AS DOUBLE) / transactions_full_period AS mean_amount_full_period,
        CAST(amount_recent_{days}d AS DOUBLE) / nullif(transactions_recent_{days}d, 0)
            AS mean_amount_recent_{days}d
    FROM (
        SELECT customer_id, count(*) AS transactions_full_period,
            count(*) FILTER (WHERE {recent}) AS transactions_recent_{days}d,
            count(*) FILTER (WHERE {prior}) AS transactions_prior_{days}d,
            {total("true")} AS amount_full_period,
            {total(recent)} AS amount_recent_{days}d,
            {total(prior)} AS amount_prior_{days}d
        FROM ({ledger}) WHERE customer_id IN ({eligible}) GROUP BY customer_id
    )"""


def mix(ledger: str, eligible: str, kinds: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{kind}'" for kind in kinds)
    shares = {kind.lower(): f"transaction_type = '{kind}'" for kind in kinds}
    shares["other"] = f"transaction_type IS NULL OR transaction_type NOT IN ({listed})"
    columns = ", ".join(
        f"""coalesce(sum(n) FILTER (WHERE {condition}), 0)::BIGINT AS transactions_{name},
        {percent(f"coalesce(sum(n) FILTER (WHERE {condition}), 0)", "sum(n)")} AS {name}_pct"""
        for name, condition in shares.items()
    )
    return f"""WITH counted AS (
        SELECT customer_id, transaction_type, count(*) AS n
        FROM ({ledger}) WHERE customer_id IN ({eligible}) GROUP BY ALL
    ), tops AS (
        SELECT DISTINCT ON (customer_id) customer_id, transaction_type AS top_type, n AS top_n
        FROM counted ORDER BY customer_id, transaction_type IS NULL, n DESC, transaction_type
    )
    SELECT customer_id, sum(n)::BIGINT AS transactions, {columns}, count(*) AS types,
        any_value(top_type) AS top_type, any_value(top_n) AS top_type_transactions,
        {percent("any_value(top_n)", "sum(n)")} AS top_type_pct,
        abs(round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6)) AS entropy_bits
    FROM counted JOIN tops USING (customer_id) GROUP BY customer_id"""


def score(value: str) -> str:
    """1 to 5 by the rows that come before, ties sharing the first one's place."""
    return f"CAST(1 + 5 * (rank() OVER (ORDER BY {value}) - 1) // count(*) OVER () AS INTEGER)"


SEGMENTS = f"""WITH activity AS (
        SELECT customer_id,
            CAST(date_diff('day', max(transaction_date), DATE '2001-08-01') AS BIGINT) AS recency_days,
            count(*) AS transactions_full_period,
            CAST(sum(amount_cop) AS DECIMAL(38,2)) AS amount_full_period
        FROM ({ORDERS}) WHERE customer_id IN ({ORDERING}) GROUP BY customer_id
    ), scored AS (
        SELECT *, {score("recency_days DESC")} AS recency_score,
            {score("transactions_full_period")} AS frequency_score,
            {score("amount_full_period")} AS value_score
        FROM activity
    )
    SELECT *, CASE
        WHEN recency_score >= 4 AND frequency_score >= 4 THEN 'Highly engaged'
        WHEN recency_score <= 2 AND frequency_score >= 4 THEN 'Lapsing regulars'
        WHEN recency_score >= 4 AND frequency_score <= 2 THEN 'Recent but infrequent'
        WHEN recency_score <= 2 AND frequency_score <= 3 AND value_score >= 4 THEN 'Dormant, of value'
        WHEN recency_score <= 2 AND frequency_score <= 3 THEN 'Dormant'
        ELSE 'Moderately engaged' END AS segment
    FROM scored"""

ROOT = "CAST(0.8660254037844386 AS DOUBLE)"

# -- raw text ---------------------------------------------------------------------

FAULTY_LEDGER = """SELECT
        CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'C-' || o_custkey
            ELSE CAST(o_custkey AS VARCHAR) END AS customer_id,
        CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P'
                THEN replace(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '-', '/')
            WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN '  '
            ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS "date",
        CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN ''
            WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F'
                THEN 'USD ' || CAST(o_totalprice AS DECIMAL(20,2))
            WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O'
                THEN '-' || CAST(o_totalprice AS DECIMAL(20,2))
            ELSE CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR) END AS amount,
        CASE WHEN o_orderpriority = '5-LOW' THEN ' ' || o_orderstatus || ' '
            ELSE o_orderstatus END AS "type"
    FROM orders"""

CUSTOMER_TEXT = f"""WITH per_customer AS (
        SELECT customer_id, count(*) AS n, CAST(sum(amount_cop) AS DECIMAL(20,2)) AS total,
            min(transaction_date) AS first, max(transaction_date) AS last
        FROM ({ORDERS}) GROUP BY customer_id
    ), listed AS (
        SELECT CASE WHEN c_acctbal <= 9900 THEN CAST(c_custkey AS VARCHAR) END AS customer_id,
            c_name AS name,
            CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'N' || c_nationkey
                ELSE CAST(c_nationkey AS VARCHAR) END AS nation,
            CAST(c_acctbal AS VARCHAR) AS balance,
            c_mktsegment AS segment,
            CASE WHEN c_acctbal > 0 THEN 'True' WHEN c_acctbal > -900 THEN 'False'
                ELSE '' END AS has_credit,
            CAST(n AS VARCHAR) AS tx_count,
            CAST(CAST(CASE WHEN c_mktsegment = 'MACHINERY' THEN total + 1 ELSE total END
                AS DECIMAL(20,2)) AS VARCHAR) AS total_volume,
            CAST(first AS VARCHAR) AS first_tx,
            CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN last + 1 ELSE last END
                AS VARCHAR) AS last_tx
        FROM customer LEFT JOIN per_customer ON c_custkey = customer_id
    )
    SELECT * FROM listed
    UNION ALL SELECT * FROM listed WHERE CAST(balance AS DOUBLE) < -900"""

TYPES = {
    "customer_id": "BIGINT",
    "date": "DATE",
    "amount": "DECIMAL(20,2)",
    "nation": "INTEGER",
    "balance": "DOUBLE",
    "tx_count": "BIGINT",
    "total_volume": "DECIMAL(20,2)",
    "first_tx": "DATE",
    "last_tx": "DATE",
}
LEDGER_TEXT = ["customer_id", "date", "amount", "type"]
CUSTOMER_TYPED = ["customer_id", "nation", "balance", "tx_count", "total_volume"]
CUSTOMER_TYPED += ["first_tx", "last_tx"]


def text(name: str) -> str:
    return f"""nullif(trim("{name}"), '')"""


def lenient(name: str) -> str:
    cast = f"try_cast({text(name)} AS {TYPES[name]})"
    if TYPES[name] == "DATE":
        iso = f"regexp_matches({text(name)}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')"
        return f"CASE WHEN {iso} THEN {cast} END"
    return cast


def long(source: str, aggregates: dict[str, str], name: str, value: str) -> str:
    """One aggregate per row."""
    rows = [
        f"SELECT '{key}' AS {name}, CAST({aggregate} AS BIGINT) AS {value} FROM t"
        for key, aggregate in aggregates.items()
    ]
    return f"WITH t AS ({source}) " + " UNION ALL ".join(rows)


def failures(names: list[str]) -> dict[str, str]:
    return {
        name: f"count(*) FILTER (WHERE {text(name)} IS NOT NULL AND {lenient(name)} IS NULL)" for name in names
    }


LENIENT_ORDERS = f"""SELECT {lenient("customer_id")} AS customer_id,
        {lenient("date")} AS transaction_date, {lenient("amount")} AS amount_cop,
        {text("type")} AS transaction_type
    FROM ({FAULTY_LEDGER})"""

CATEGORIES = f"""WITH t AS ({CUSTOMER_TEXT}), pairs AS (
        SELECT 'segment' AS column_name, segment AS value FROM t
        UNION ALL SELECT 'has_credit', has_credit FROM t
    )
    SELECT column_name, coalesce(nullif(trim(value), ''), '<NULL>') AS value,
        count(*) AS row_count
    FROM pairs GROUP BY ALL"""

LEDGER_PROFILE = f"""SELECT count(*) AS row_count,
        min(transaction_date) AS minimum_date, max(transaction_date) AS maximum_date,
        min(amount_cop) AS minimum_amount, max(amount_cop) AS maximum_amount,
        CAST(sum(amount_cop) AS DECIMAL(38,2)) AS total_amount,
        count(*) FILTER (WHERE amount_cop = 0) AS zero_amount_rows,
        count(*) FILTER (WHERE amount_cop < 0) AS negative_amount_rows,
        count(*) FILTER (WHERE transaction_date NOT BETWEEN DATE '1996-01-01' AND DATE '2000-12-31')
            AS dates_outside_observation_window
    FROM ({LENIENT_ORDERS})"""

DISTRIBUTION = f"""WITH counts AS (
        SELECT customer_id, count(*) AS n FROM ({ORDERS}) GROUP BY customer_id
    )
    SELECT count(*) AS customers_with_rows, min(n) AS minimum, round(avg(n), 4) AS mean,
        round(median(n), 2) AS median, round(quantile_cont(n, 0.95), 2) AS p95,
        max(n) AS maximum
    FROM counts"""


def groups(ledger: str) -> str:
    return f"""SELECT count(*) FILTER (WHERE n > 1) AS duplicate_groups,
        CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS excess_duplicate_rows,
        CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_in_duplicate_groups
    FROM (SELECT count(*) AS n FROM ({ledger})
        GROUP BY customer_id, transaction_date, transaction_type)"""


def flagged(ledger: str) -> str:
    return f"""SELECT *, count(*) OVER (
            PARTITION BY customer_id, transaction_date, transaction_type) > 1
            AS is_duplicate_looking
        FROM ({ledger})"""


def row_text(columns: list[tuple[str, bool]]) -> str:
    """Rows as text; the flag tells which columns are text and need escapes."""
    parts = []
    for name, is_text in columns:
        value = f'CAST("{name}" AS VARCHAR)'
        if is_text:
            value = rf"replace(replace({value}, '\', '\\'), '|', '\|')"
        parts.append(rf"coalesce({value}, '\N')")
    return " || '|' || ".join(parts)


def fingerprint(source: str, columns: list[tuple[str, bool]]) -> str:
    return f"""WITH hashed AS (
        SELECT CAST('0x' || substr(md5({row_text(columns)}), 1, 15) AS BIGINT) AS h
        FROM ({source})
    )
    SELECT count(*) AS row_count, bit_xor(h) AS hash_xor,
        CAST(sum(CAST(h AS HUGEINT)) AS DECIMAL(38,0)) AS hash_sum FROM hashed"""


LEDGER_FIELDS = [
    ("customer_id", False),
    ("transaction_date", False),
    ("amount_cop", False),
    ("transaction_type", True),
]
CUSTOMER_FIELDS = [
    (name, True)
    for name in (
        "customer_id",
        "name",
        "nation",
        "balance",
        "segment",
        "has_credit",
        "tx_count",
        "total_volume",
        "first_tx",
        "last_tx",
    )
]

PLAIN_CUSTOMERS = """SELECT c_custkey AS customer_id, c_name AS name, c_nationkey AS nation,
    c_acctbal AS balance, c_mktsegment AS segment FROM customer"""
PUBLISHED = f"""SELECT row_number() OVER (ORDER BY o_orderkey) AS transaction_row_id,
        customer_id, transaction_date, amount_cop, transaction_type,
        count(*) OVER (PARTITION BY customer_id, transaction_date, amount_cop,
            transaction_type) > 1 AS is_duplicate_looking
    FROM (SELECT o_orderkey, o_custkey AS customer_id,
        CAST(o_orderdate AS DATE) AS transaction_date,
        CAST(o_totalprice AS DECIMAL(20,2)) AS amount_cop, o_orderstatus AS transaction_type
        FROM orders)"""

# Lines of the raw files with their headers, blocks of 4096 of them, and the digest of all blocks.
SOURCE_IDENTITY = f"""WITH lines AS (
        SELECT 'customers' AS source_key, 0 AS line, 'customer_id,name,nation,balance,segment' AS value
        UNION ALL SELECT 'transactions', 0, 'customer_id,date,amount,type'
        UNION ALL SELECT 'customers', row_number() OVER (ORDER BY customer_id),
            customer_id || ',' || name || ',' || nation || ',' || balance || ',' || segment
        FROM ({PLAIN_CUSTOMERS})
        UNION ALL SELECT 'transactions', transaction_row_id,
            customer_id || ',' || transaction_date || ',' || amount_cop || ',' || transaction_type
        FROM ({PUBLISHED})
    ), marks AS (
        SELECT *, CAST('0x' || substr(md5({row_text([("value", True)])}), 1, 15) AS BIGINT) AS h FROM lines
    ), blocks AS (
        SELECT source_key, line // 4096 AS place, md5(string_agg(CAST(h AS VARCHAR), ',' ORDER BY line)) AS h,
            sum(strlen(value) + 1) AS bytes, count(*) AS n
        FROM marks GROUP BY source_key, line // 4096
    )
    SELECT source_key, CAST(sum(bytes) AS BIGINT) AS byte_size, CAST(sum(n) AS BIGINT) AS line_count,
        CASE WHEN count(*) = 1 THEN any_value(h) ELSE md5(string_agg(h, ',' ORDER BY place)) END
            AS ordered_digest
    FROM blocks GROUP BY source_key"""

STORED_CHECKS = f"""WITH t AS ({PUBLISHED}), groups AS (
        SELECT count(*) AS n FROM t GROUP BY customer_id, transaction_date, amount_cop, transaction_type
    ), m AS (
        SELECT (SELECT count(*) FROM customer) AS customers, count(*) AS rows, sum(amount_cop) AS total,
            min(transaction_date) AS first, max(transaction_date) AS last,
            count(*) FILTER (WHERE is_duplicate_looking) AS flagged,
            (SELECT count(*) FILTER (WHERE n > 1) FROM groups) AS repeated,
            (SELECT coalesce(sum(n - 1), 0) FROM groups) AS excess
        FROM t
    )
    SELECT check_code, 'pass' AS status, metrics FROM m, LATERAL (VALUES
        ('database.schemas', '{{"missing":[]}}'),
        ('database.table_definitions',
            '{{"customers_columns":5,"different":[],"transactions_columns":6}}'),
        ('database.row_counts', '{{"expected_customers":' || customers || ',"expected_transactions":' || rows
            || ',"loaded_customers":' || customers || ',"loaded_transactions":' || rows || '}}'),
        ('database.customer_primary_key', '{{"duplicate_id_rows":0,"null_ids":0}}'),
        ('database.transaction_surrogate_key', '{{"duplicate_id_rows":0,"maximum_id":' || rows
            || ',"minimum_id":1,"null_ids":0}}'),
        ('database.transaction_required_values', '{{"amount_cop_nulls":0,"customer_id_nulls":0,'
            || '"is_duplicate_looking_nulls":0,"transaction_date_nulls":0,"transaction_type_nulls":0}}'),
        ('database.transaction_customers', '{{"orphan_transaction_rows":0}}'),
        ('database.transaction_ledger', '{{"expected_maximum_date":"' || last || '","expected_minimum_date":"' || first
            || '","expected_total_amount_cop":"' || total || '","loaded_maximum_date":"' || last
            || '","loaded_minimum_date":"' || first || '","loaded_total_amount_cop":"' || total || '"}}'),
        ('database.duplicate_looking_flags', '{{"duplicate_groups":' || repeated || ',"excess_duplicate_rows":'
            || excess || ',"expected_duplicate_groups":' || repeated || ',"expected_excess_duplicate_rows":'
            || excess || ',"flagged_rows":' || flagged || ',"rows_in_duplicate_groups":' || flagged || '}}')
    ) AS found(check_code, metrics)"""

SENSITIVITY = f"""WITH a AS ({SHIPPED_CANONICAL}), b AS ({SHIPPED_COLLAPSED}), m AS (
        SELECT a.transactions_full_period - b.transactions_full_period AS f,
            a.transactions_recent_90d - b.transactions_recent_90d AS r,
            a.transactions_prior_90d - b.transactions_prior_90d AS p
        FROM a JOIN b USING (customer_id)
    ), changes AS (
        SELECT abs((SELECT count(*) FROM b WHERE recency_days > t)
            - (SELECT count(*) FROM a WHERE recency_days > t)) AS change
        FROM (VALUES (30), (60), (90)) AS thresholds(t)
    )
    SELECT CAST(coalesce(sum(f), 0) AS BIGINT) AS excess_rows_collapsed,
        count(*) FILTER (WHERE f > 0) AS affected_customers,
        max(f) AS maximum_rows_collapsed_for_one_customer,
        CAST(coalesce(sum(r), 0) AS BIGINT) AS recent_90d_rows_collapsed,
        CAST(coalesce(sum(p), 0) AS BIGINT) AS prior_90d_rows_collapsed,
        (SELECT max(change) FROM changes) AS maximum_absolute_scenario_count_change
    FROM m"""

# Statuses of the check report, each from the condition the check stands for.
CHECKS = f"""WITH c AS ({CUSTOMER_TEXT}), l AS ({FAULTY_LEDGER}), lenient AS ({LENIENT_ORDERS}),
    ids AS (SELECT DISTINCT {lenient("customer_id")} AS id FROM c),
    per_customer AS (
        SELECT customer_id, count(*) AS n, sum(amount_cop) AS total,
            min(transaction_date) AS first, max(transaction_date) AS last
        FROM lenient GROUP BY customer_id
    ),
    found(check_ordinal, check_code, breach, broken) AS (
        SELECT 1, 'customers.schema_parseability', 'fail',
            ({" + ".join(failures(CUSTOMER_TYPED).values())}) > 0 FROM c
        UNION ALL SELECT 2, 'customers.primary_key', 'fail',
            count(*) <> count(DISTINCT {lenient("customer_id")}) FROM c
        UNION ALL SELECT 3, 'customers.categories', 'warning', count(*) > 0 FROM ({CATEGORIES})
            WHERE value <> '<NULL>' AND value NOT IN
                ('BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'False', 'True')
        UNION ALL SELECT 4, 'customers.business_ranges', 'warning',
            count(*) FILTER (WHERE {lenient("nation")} NOT BETWEEN 0 AND 20 OR {lenient("balance")} < 0
                OR {lenient("balance")} > 9000) > 0 FROM c
        UNION ALL SELECT 5, 'transactions.schema_parseability', 'fail',
            ({" + ".join(failures(["customer_id", "date", "amount"]).values())}) > 0 FROM l
        UNION ALL SELECT 6, 'transactions.required_values', 'fail',
            ({" + ".join(f"count(*) FILTER (WHERE {text(name)} IS NULL)" for name in LEDGER_TEXT)}) > 0 FROM l
        UNION ALL SELECT 7, 'transactions.categories', 'warning',
            count(*) FILTER (WHERE transaction_type NOT IN ('F', 'O')) > 0 FROM lenient
        UNION ALL SELECT 8, 'transactions.ranges', 'warning',
            zero_amount_rows + negative_amount_rows + dates_outside_observation_window > 0
            FROM ({LEDGER_PROFILE})
        UNION ALL SELECT 9, 'transactions.duplicate_looking_rows', 'warning', count(*) > 0 FROM (
            SELECT 1 FROM lenient
            GROUP BY customer_id, transaction_date, amount_cop, transaction_type
            HAVING count(*) > 1)
        UNION ALL SELECT 10, 'relationships.transaction_customers', 'fail',
            count(*) FILTER (WHERE id IS NULL) > 0 FROM lenient LEFT JOIN ids ON customer_id = id
        UNION ALL SELECT 11, 'relationships.customers_without_transactions', 'warning',
            count(*) FILTER (WHERE n IS NULL) > 0
            FROM (SELECT {lenient("customer_id")} AS id FROM c)
            LEFT JOIN per_customer ON id = customer_id
        UNION ALL SELECT 12, 'relationships.transaction_count_concentration', 'warning',
            max(n) / nullif(quantile_cont(n, 0.95), 0) > 10 FROM per_customer
        UNION ALL SELECT 13, 'relationships.publisher_derived_aggregates', 'warning',
            count(*) FILTER (WHERE claimed_n IS DISTINCT FROM n OR claimed_total IS DISTINCT FROM total
                OR claimed_first IS DISTINCT FROM first OR claimed_last IS DISTINCT FROM last) > 0
            FROM (SELECT {lenient("customer_id")} AS id, {lenient("tx_count")} AS claimed_n,
                {lenient("total_volume")} AS claimed_total, {lenient("first_tx")} AS claimed_first,
                {lenient("last_tx")} AS claimed_last FROM c)
            JOIN per_customer ON id = customer_id
    )
    SELECT check_ordinal, check_code, CASE WHEN broken THEN breach ELSE 'pass' END AS status
    FROM found"""

# -- the queries --------------------------------------------------------------------

SQL: dict[str, str] = {
    "recency_canonical": CANONICAL,
    "recency_collapsed": SHIPPED_COLLAPSED,
    "recency_shipments": SHIPPED_CANONICAL,
    "recency_pair": VARIANTS,
    "distinct_events": f"""SELECT DISTINCT customer_id, transaction_date, transaction_type
        FROM ({EVENTS})""",
    "recency_contract": f"""WITH w AS ({CANONICAL})
        SELECT 'population' AS rule, abs(count(*) - 1000) AS violations FROM w
        UNION ALL SELECT 'scenario_count_30', abs(count(*) FILTER (WHERE recency_days > 30) - 900) FROM w
        UNION ALL SELECT 'scenario_count_60', abs(count(*) FILTER (WHERE recency_days > 60) - 800) FROM w
        UNION ALL SELECT 'scenario_count_90', abs(count(*) FILTER (WHERE recency_days > 90) - 700) FROM w
        UNION ALL SELECT 'null_customer_id', count(*) FILTER (WHERE customer_id IS NULL) FROM w
        UNION ALL SELECT 'duplicate_customer_id',
            count(customer_id) - count(DISTINCT customer_id) FROM w
        UNION ALL SELECT 'null_required_value', count(*) FILTER (WHERE first_transaction_date IS NULL
            OR last_transaction_date IS NULL OR customer_id IS NULL) FROM w
        UNION ALL SELECT 'date_order', count(*) FILTER (WHERE first_transaction_date > last_transaction_date
            OR last_transaction_date > DATE '2001-08-01') FROM w
        UNION ALL SELECT 'observed_days_mismatch', count(*) FILTER (WHERE observed_days
            <> DATE '2001-08-01' - first_transaction_date + 1) FROM w
        UNION ALL SELECT 'recency_days_mismatch', count(*) FILTER (WHERE recency_days
            <> DATE '2001-08-01' - last_transaction_date) FROM w
        UNION ALL SELECT 'negative_value', count(*) FILTER (WHERE observed_days < 0 OR recency_days < 0) FROM w
        UNION ALL SELECT 'recent_exceeds_full',
            count(*) FILTER (WHERE transactions_recent_90d > transactions_full_period) FROM w
        UNION ALL SELECT 'prior_exceeds_full',
            count(*) FILTER (WHERE transactions_prior_90d > transactions_full_period) FROM w
        UNION ALL SELECT 'windows_exceed_full', count(*) FILTER (WHERE transactions_recent_90d
            + transactions_prior_90d > transactions_full_period) FROM w""",
    "variant_grain_diff": f"""WITH a AS ({CANONICAL}), b AS ({working(
        f"SELECT * FROM ({ORDERS}) WHERE transaction_type <> 'P'", ORDERING, "2001-08-01")})
        SELECT count(*) FILTER (WHERE b.customer_id IS NULL) AS only_canonical,
            count(*) FILTER (WHERE a.customer_id IS NULL) AS only_collapsed,
            count(*) FILTER (WHERE a.recency_days <> b.recency_days) AS recency_differs
        FROM a FULL JOIN b ON a.customer_id = b.customer_id""",
    "scenario_summary": SCENARIOS,
    "scenario_change": SCENARIO_CHANGE,
    "analysis_scenarios": SCENARIO_CHANGE,
    "scenario_table_text": f"""SELECT * REPLACE ({", ".join(
        f"printf('%.2f', {name}) AS {name}" for name in SCENARIO_DOUBLES)})
        FROM ({SCENARIO_CHANGE})""",
    "band_summary": f"""WITH working AS ({SHIPPED_CANONICAL}),
        banded AS (SELECT *, {BANDS} AS band FROM working),
        frame(band_ordinal, recency_band) AS (VALUES (0, '0–30 days'), (1, '31–60 days'),
            (2, '61–90 days'), (3, 'More than 90 days')),
        population AS (SELECT count(*) AS people FROM working)
        SELECT band_ordinal, recency_band, {measures("any_value(people)", counts=False)}
        FROM frame CROSS JOIN population LEFT JOIN banded w ON w.band = band_ordinal
        GROUP BY band_ordinal, recency_band""",
    "recency_stats": f"""SELECT count(*) AS customer_count, min(recency_days) AS minimum,
            {", ".join(f"round(quantile_cont(recency_days, {p}), 2) AS {name}" for name, p in (
                ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("p90", 0.9), ("p95", 0.95)))},
            max(recency_days) AS maximum
        FROM ({CANONICAL})""",
    "recency_ecdf": f"""WITH counts AS (
            SELECT recency_days, count(*) AS customers FROM ({CANONICAL}) GROUP BY recency_days
        ), running AS (
            SELECT *, CAST(sum(customers) OVER (ORDER BY recency_days) AS BIGINT) AS at_or_below,
                CAST(sum(customers) OVER () AS BIGINT) AS people FROM counts
        )
        SELECT recency_days, customers, at_or_below,
            {percent("at_or_below", "people")} AS at_or_below_pct FROM running""",
    "trajectory_stats": f"""WITH w AS ({SHIPPED_CANONICAL}), s AS (
            SELECT *, transactions_recent_90d - transactions_prior_90d AS change
            FROM w WHERE sufficient_prior_history
        ), counted AS (
            SELECT count(*) AS n, (SELECT count(*) FROM w) - count(*) AS excluded,
                round(median(transactions_prior_90d), 2) AS prior,
                round(median(transactions_recent_90d), 2) AS recent,
                round(median(change), 2) AS middle, count(*) FILTER (WHERE change < 0) AS lower_count,
                count(*) FILTER (WHERE change = 0) AS equal_count, count(*) FILTER (WHERE change > 0) AS higher_count
            FROM s
        )
        SELECT n AS customer_count, excluded AS excluded_for_limited_history,
            prior AS prior_90d_median, recent AS recent_90d_median,
            middle AS absolute_change_median, lower_count, equal_count, higher_count,
            {percent("lower_count", "n")} AS lower_pct, {percent("equal_count", "n")} AS equal_pct,
            {percent("higher_count", "n")} AS higher_pct
        FROM counted""",
    "activity_grid": f"""WITH s AS (
            SELECT * FROM ({SHIPPED_CANONICAL}) WHERE sufficient_prior_history
        ), cap AS (
            SELECT CAST(ceil(greatest(quantile_cont(transactions_prior_90d, 0.99),
                quantile_cont(transactions_recent_90d, 0.99))) AS BIGINT) AS axis_cap,
                count(*) AS people FROM s
        ), inside AS (
            SELECT * FROM s CROSS JOIN cap
            WHERE transactions_prior_90d <= axis_cap AND transactions_recent_90d <= axis_cap
        )
        SELECT coalesce(least(transactions_prior_90d * 42 // nullif(axis_cap, 0), 41), 0)
                AS prior_cell,
            coalesce(least(transactions_recent_90d * 42 // nullif(axis_cap, 0), 41), 0)
                AS recent_cell,
            count(*) AS customers, any_value(axis_cap) AS axis_cap,
            {percent("any_value((SELECT count(*) FROM inside))", "any_value(people)")} AS kept_pct
        FROM inside GROUP BY 1, 2""",
    "scenario_change_percent": f"""SELECT data_variant, scenario, threshold_days,
            round(100 * customer_count_change_vs_canonical
                / nullif(CAST(customer_count - customer_count_change_vs_canonical AS DOUBLE), 0), 4)
                AS customer_count_change_pct,
            round(100 * prior_median_change_vs_canonical
                / nullif(round(transactions_prior_90d_median - prior_median_change_vs_canonical, 2), 0), 4)
                AS prior_median_change_pct
        FROM ({SCENARIO_CHANGE})""",
    "activity_hexagons": f"""WITH s AS (
            SELECT * FROM ({SHIPPED_CANONICAL}) WHERE sufficient_prior_history
        ), cap AS (
            SELECT CAST(ceil(greatest(quantile_cont(transactions_prior_90d, 0.99),
                quantile_cont(transactions_recent_90d, 0.99))) AS BIGINT) AS axis_cap,
                count(*) AS people FROM s
        ), inside AS (
            SELECT transactions_prior_90d AS p, transactions_recent_90d AS r, axis_cap, people,
                CAST(coalesce(nullif(axis_cap, 0), 1) AS DOUBLE) / 42 AS width
            FROM s CROSS JOIN cap
            WHERE transactions_prior_90d <= axis_cap AND transactions_recent_90d <= axis_cap
        ), axial AS (
            SELECT *, p::DOUBLE / width - r::DOUBLE / width / {ROOT} / 2 AS x,
                r::DOUBLE / width / {ROOT} AS z FROM inside
        ), rounded AS (
            SELECT *, floor(x + 0.5)::BIGINT AS rx, floor(-x - z + 0.5)::BIGINT AS ry,
                floor(z + 0.5)::BIGINT AS rz FROM axial
        ), apart AS (
            SELECT *, abs(rx - x) AS dx, abs(ry - (-x - z)) AS dy, abs(rz - z) AS dz FROM rounded
        ), placed AS (
            SELECT *, CASE WHEN dx > dy AND dx > dz THEN -ry - rz ELSE rx END AS "column",
                CASE WHEN dx > dy AND dx > dz THEN rz WHEN dy > dz THEN rz ELSE -rx - ry END AS "row"
            FROM apart
        )
        SELECT "column", "row",
            round(("column" + "row"::DOUBLE / 2) * any_value(width), 6) AS prior_centre,
            round("row" * {ROOT} * any_value(width), 6) AS recent_centre,
            count(*) AS customers, any_value(axis_cap) AS axis_cap,
            {percent("any_value((SELECT count(*) FROM inside))", "any_value(people)")} AS kept_pct
        FROM placed GROUP BY "column", "row" """,
    "recency_windows": recent_windows(ORDERS, ORDERING, "2001-08-01", (30, 60, 90)),
    "value_measures": values(COARSE_EVENTS, ORDERING, "2024-01-30", 7, "canonical")
    + " UNION ALL "
    + values(
        f"SELECT DISTINCT * FROM ({COARSE_EVENTS})", ORDERING, "2024-01-30", 7, "exact_groups_collapsed"
    ),
    "transaction_mix": mix(ORDERS, ORDERING, ("F", "O")),
    "transaction_mix_events": mix(EVENTS, ORDERING, ("purchase", "signup", "click")),
    "engagement_segments": SEGMENTS,
    "segment_summary": f"""SELECT segment, count(*) AS customers,
            {percent("count(*)", f"(SELECT count(*) FROM ({SEGMENTS}))")} AS customers_pct,
            min(recency_days) AS least_recency_days, max(recency_days) AS most_recency_days,
            sum(transactions_full_period)::BIGINT AS transactions,
            {percent("sum(transactions_full_period)",
                     f"(SELECT sum(transactions_full_period) FROM ({SEGMENTS}))")} AS transactions_pct,
            CAST(sum(amount_full_period) AS DECIMAL(38,2)) AS amount
        FROM ({SEGMENTS}) GROUP BY segment""",
    "segment_profile": f"""WITH described AS (
            SELECT segment, unnest([
                {{'characteristic': 'market', 'value': c_mktsegment}},
                {{'characteristic': 'nation', 'value': CAST(c_nationkey AS VARCHAR)}}
            ], recursive := true)
            FROM ({SEGMENTS}) AS s JOIN customer ON c_custkey = s.customer_id
        ), counted AS (
            SELECT segment, characteristic, value, count(*) AS customers,
                CAST(sum(count(*)) OVER (PARTITION BY segment, characteristic) AS BIGINT) AS people
            FROM described GROUP BY segment, characteristic, value
        )
        SELECT segment, characteristic, value, customers, {percent("customers", "people")} AS customers_pct
        FROM counted""",
    "amount_quantiles": f"""SELECT CAST(q AS DOUBLE) AS share,
            (SELECT quantile_cont(CAST(amount_cop AS DOUBLE), [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0])
                FROM ({SHIPMENTS}))[i] AS quantile
        FROM (SELECT unnest([0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]) AS q,
            unnest(range(1, 9)) AS i)""",
    "population_summary": f"""WITH w AS ({CANONICAL})
        SELECT 'Eligible customers' AS measure, count(*) AS value FROM w
        UNION ALL SELECT 'Unique customer IDs', count(DISTINCT customer_id) FROM w
        UNION ALL SELECT 'Minimum recency (days)', min(recency_days) FROM w
        UNION ALL SELECT 'Maximum recency (days)', max(recency_days) FROM w
        UNION ALL SELECT 'Insufficient prior history',
            count(*) FILTER (WHERE NOT sufficient_prior_history) FROM w""",
    "repeat_sensitivity": SENSITIVITY,
    "repeat_sensitivity_merged": SENSITIVITY,
    "null_profile": long(
        FAULTY_LEDGER,
        {name: f"count(*) FILTER (WHERE {text(name)} IS NULL)" for name in LEDGER_TEXT},
        "column_name",
        "null_count",
    ),
    "parse_profile": long(
        FAULTY_LEDGER,
        failures(["customer_id", "date", "amount"]),
        "column_name",
        "parse_failures",
    ),
    "customer_parse_profile": long(
        CUSTOMER_TEXT, failures(CUSTOMER_TYPED), "column_name", "parse_failures"
    ),
    "category_profile": CATEGORIES,
    "unexpected_categories": f"""SELECT * FROM ({CATEGORIES}) WHERE value <> '<NULL>' AND NOT (
        (column_name = 'segment'
            AND value IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))
        OR (column_name = 'has_credit' AND value IN ('False', 'True')))""",
    "flag_holders": f"""SELECT count(*) FILTER (WHERE has_credit = 'True') AS flag_holders
        FROM ({CUSTOMER_TEXT})""",
    "event_categories": """WITH pairs AS (
            SELECT 'event_type' AS column_name, event_type AS value FROM events
            UNION ALL SELECT 'props', props FROM events
        )
        SELECT column_name, coalesce(nullif(trim(value), ''), '<NULL>') AS value,
            count(*) AS row_count FROM pairs GROUP BY ALL""",
    "key_profile": f"""SELECT count(*) AS row_count,
            count(*) FILTER (WHERE {text("customer_id")} IS NULL) AS null_ids,
            count(DISTINCT {lenient("customer_id")}) AS distinct_ids,
            count(*) - count(*) FILTER (WHERE {text("customer_id")} IS NULL)
                - count(DISTINCT {lenient("customer_id")}) AS duplicate_id_rows
        FROM ({CUSTOMER_TEXT})""",
    "range_profile": long(
        CUSTOMER_TEXT,
        {
            "nation_outside_range": f"count(*) FILTER (WHERE {lenient('nation')} NOT BETWEEN 0 AND 20)",
            "negative_balance": f"count(*) FILTER (WHERE {lenient('balance')} < 0)",
            "balance_above_limit": f"count(*) FILTER (WHERE {lenient('balance')} > 9000)",
        },
        "rule",
        "violations",
    ),
    "lenient_cast": LENIENT_ORDERS,
    "required_nulls": long(
        LENIENT_ORDERS,
        {name: f'count(*) FILTER (WHERE "{name}" IS NULL)' for name, _ in LEDGER_FIELDS},
        "column_name",
        "null_count",
    ),
    "ledger_profile": LEDGER_PROFILE,
    "ledger_per_customer": f"""SELECT customer_id, count(*) AS ledger_count,
            CAST(sum(amount_cop) AS DECIMAL(38,2)) AS ledger_total,
            min(transaction_date) AS ledger_first, max(transaction_date) AS ledger_last
        FROM ({ORDERS}) GROUP BY customer_id""",
    "orphans": f"""SELECT count(*) AS orphan_rows, count(DISTINCT customer_id) AS orphan_ids
        FROM ({ORDERS}) WHERE customer_id NOT IN
            (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""",
    "childless": """SELECT count(*) AS customers_without_rows FROM customer
        WHERE c_custkey NOT IN (SELECT user_id FROM events)""",
    "count_distribution": DISTRIBUTION,
    "concentration": f"""SELECT maximum, p95,
            round(maximum / nullif(p95, 0), 2) AS maximum_to_p95_ratio,
            coalesce(round(maximum / nullif(p95, 0), 2) > 1.5, false) AS concentrated
        FROM ({DISTRIBUTION})""",
    "reconcile": f"""WITH c AS ({CUSTOMER_TEXT}), per_customer AS (
            SELECT customer_id, count(*) AS n, sum(amount_cop) AS total,
                min(transaction_date) AS first, max(transaction_date) AS last
            FROM ({ORDERS}) GROUP BY customer_id
        ), claimed AS (
            SELECT {lenient("customer_id")} AS id, {lenient("tx_count")} AS claimed_n,
                {lenient("total_volume")} AS claimed_total, {lenient("first_tx")} AS claimed_first,
                {lenient("last_tx")} AS claimed_last FROM c
        )
        SELECT count(*) AS customers_compared,
            count(*) FILTER (WHERE claimed_n IS DISTINCT FROM n) AS tx_count_mismatches,
            count(*) FILTER (WHERE claimed_total IS DISTINCT FROM total) AS total_volume_mismatches,
            count(*) FILTER (WHERE claimed_first IS DISTINCT FROM first) AS first_tx_mismatches,
            count(*) FILTER (WHERE claimed_last IS DISTINCT FROM last) AS last_tx_mismatches
        FROM claimed JOIN per_customer ON id = customer_id""",
    "repeat_groups": groups(EVENTS),
    "repeat_flag": flagged(EVENTS),
    "repeat_flag_long_list": flagged(SHIPMENTS),
    "flag_integrity": f"""SELECT g.*, f.flagged_rows FROM ({groups(EVENTS)}) g CROSS JOIN (
        SELECT count(*) FILTER (WHERE is_duplicate_looking) AS flagged_rows FROM ({flagged(EVENTS)})) f""",
    "flagged_rows": f"""SELECT count(*) FILTER (WHERE is_duplicate_looking) AS flagged_rows
        FROM ({flagged(EVENTS)})""",
    "sequential_key": """SELECT row_number() OVER (ORDER BY o_orderkey) AS transaction_row_id,
        o_orderkey, o_custkey FROM orders""",
    "sequential_key_by": """SELECT row_number() OVER (
            ORDER BY l_shipdate, l_partkey, l_orderkey, l_linenumber) AS transaction_row_id,
        l_shipdate, l_partkey, l_orderkey, l_linenumber FROM lineitem""",
    "row_key_integrity": """SELECT count(*) AS row_count,
            count(*) FILTER (WHERE l_orderkey IS NULL) AS null_ids,
            count(*) - count(DISTINCT l_orderkey) AS duplicate_id_rows,
            min(l_orderkey) AS minimum_id, max(l_orderkey) AS maximum_id,
            count(*) = count(DISTINCT l_orderkey) AND min(l_orderkey) = 1
                AND max(l_orderkey) = count(*) AS sequential
        FROM lineitem""",
    "fingerprint_orders": fingerprint(ORDERS, LEDGER_FIELDS),
    "fingerprint_customers": fingerprint(CUSTOMER_TEXT, CUSTOMER_FIELDS),
    "check_report": CHECKS,
    "check_status_counts": f"""WITH found AS ({CHECKS})
        SELECT s.status, count(f.status) AS checks
        FROM (VALUES ('pass'), ('warning'), ('fail')) AS s(status)
        LEFT JOIN found f ON f.status = s.status GROUP BY s.status""",
    "report_values": f"""SELECT * REPLACE (CAST(minimum_date AS VARCHAR) AS minimum_date,
            CAST(maximum_date AS VARCHAR) AS maximum_date,
            CAST(minimum_amount AS VARCHAR) AS minimum_amount,
            CAST(maximum_amount AS VARCHAR) AS maximum_amount,
            CAST(total_amount AS VARCHAR) AS total_amount)
        FROM ({LEDGER_PROFILE})""",
    "text_scan": f"""SELECT CAST(customer_id AS VARCHAR) AS customer_id,
            CAST(transaction_date AS VARCHAR) AS "date", CAST(amount_cop AS VARCHAR) AS amount,
            transaction_type AS "type" FROM ({ORDERS})""",
    "manifest": """SELECT 'customers' AS source_key, 'customer_data.csv' AS source_filename,
            count(*) AS data_rows, count(*) > 0 AS present FROM customer
        UNION ALL SELECT 'transactions', 'transactions_data.csv', count(*), count(*) > 0
        FROM orders""",
    "source_identity": SOURCE_IDENTITY,
    "build_audit": """SELECT 'customers' AS source_key, 'customer_data.csv' AS source_filename,
            count(*) AS source_row_count, 'customers' AS loaded_table, count(*) AS loaded_row_count,
            CAST(NULL AS DATE) AS minimum_date, CAST(NULL AS DATE) AS maximum_date FROM customer
        UNION ALL SELECT 'transactions', 'transactions_data.csv', count(*), 'transactions', count(*),
            CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE) FROM orders""",
    "stored_checks": STORED_CHECKS,
    "persisted_failures": f"SELECT * FROM ({CHECKS}) WHERE status <> 'pass'",
    "header_contract": """SELECT 'transactions' AS source_key, CAST(5 AS BIGINT)
            AS expected_columns, CAST(4 AS BIGINT) AS observed_columns,
            'note' AS missing_columns, '' AS unexpected_columns, false AS order_matches""",
    "scanned_counts": """SELECT 'customers' AS source_key, count(*) AS expected_rows,
            count(*) AS scanned_rows, CAST(0 AS BIGINT) AS malformed_rows, true AS matches
        FROM customer
        UNION ALL SELECT 'transactions', count(*), count(*), CAST(0 AS BIGINT), true
        FROM orders""",
    "published_ledger": PUBLISHED,
    "published_customers": PLAIN_CUSTOMERS,
    "published_health": f"""SELECT *, 'customers' AS table_name, false AS failed
            FROM ({fingerprint(PLAIN_CUSTOMERS, [("customer_id", False), ("name", True),
                ("nation", False), ("balance", False), ("segment", True)])})
        UNION ALL BY NAME
        SELECT *, 'transactions' AS table_name, false AS failed
            FROM ({fingerprint(PUBLISHED, [("transaction_row_id", False), *LEDGER_FIELDS,
                ("is_duplicate_looking", False)])})""",
}
