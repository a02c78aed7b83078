"""Queries over the validated ledger: rules, duplicates, continuity policies, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.model import LEDGER_ORDER, MONEY, TOTAL
from ledgerspark.operators import continuity as C
from ledgerspark.operators import validate as V
from ledgerspark.operators.ordered import lag, last_upto, rownum, running_sum, with_ordered
from ledgerspark.plans.registry import cte, query
from ledgerspark.sources.bridge import Ledger

W = "PARTITION BY source_file_id ORDER BY transaction_date, created_at, seq, id"
PREV = f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

cte(
    "ordered_rows",
    f"""SELECT *, row_number() OVER ({W}) row_no, lag(balance) OVER ({W}) prev_balance,
 last_value(balance IGNORE NULLS) OVER ({W} {PREV}) carry_balance,
 CASE WHEN debit > 0 THEN debit ELSE 0 END dpos, CASE WHEN credit > 0 THEN credit ELSE 0 END cpos,
 coalesce(credit, 0) - coalesce(debit, 0) net FROM ledger""",
)
cte(
    "dup_rows",
    """SELECT *, count(*) OVER (PARTITION BY source_file_id, strftime(transaction_date, '%Y-%m-%d'),
 upper(trim(coalesce(description, ''))), amount,
 upper(trim(coalesce(transaction_type, CASE WHEN debit IS NOT NULL THEN 'DEBIT' ELSE 'CREDIT' END))),
 upper(trim(coalesce(reference, ''))), balance) > 1 is_duplicate FROM ordered_rows""",
)
cte(
    "checked_rows",
    """SELECT d.* EXCLUDE (value_date), a.value_date, coalesce(a.correction_count, 0) correction_count,
 coalesce(a.correction_count, 0) > 0 is_corrected,
 CASE WHEN prev_balance IS NULL OR balance IS NULL THEN 'NOT_CHECKABLE'
  WHEN abs(prev_balance - dpos + cpos - balance) <= 0.01 THEN 'BALANCED' ELSE 'MISMATCH' END balance_status,
 amount = 0 AND balance IS NOT NULL AND bank_code IN (4, 5, 8) memo,
 coalesce(debit > 0, false) hd, coalesce(credit > 0, false) hc,
 coalesce(debit < 0, true) bd, coalesce(credit < 0, true) bc
 FROM dup_rows d LEFT JOIN audit a ON a.transaction_id = d.id""",
)
cte(
    "coded_rows",
    """SELECT *, concat_ws(',', CASE WHEN transaction_date > TIMESTAMP '2001-06-02' THEN 'DATE_FUTURE' END,
 CASE WHEN trim(coalesce(description, '')) = '' THEN 'DESCRIPTION_BLANK' END,
 CASE WHEN amount < 0 THEN 'AMOUNT_NEGATIVE' END, CASE WHEN amount = 0 AND NOT memo THEN 'AMOUNT_ZERO' END,
 CASE WHEN upper(trim(coalesce(transaction_type, ''))) NOT IN ('DEBIT', 'CREDIT') THEN 'TYPE_INVALID' END,
 CASE WHEN hd AND hc THEN 'BOTH_SIDES' WHEN memo THEN NULL WHEN bd AND bc THEN 'NO_SIDE'
  WHEN NOT hd AND NOT hc THEN 'NO_POSITIVE_SIDE' END,
 CASE WHEN debit < 0 OR credit < 0 THEN 'SIDE_NEGATIVE' END,
 CASE WHEN debit > 0 AND abs(debit - amount) > 0.01 THEN 'DEBIT_DIFFERS' END,
 CASE WHEN credit > 0 AND abs(credit - amount) > 0.01 THEN 'CREDIT_DIFFERS' END) errors,
 concat_ws(',', CASE WHEN length(trim(coalesce(description, ''))) = 1 THEN 'DESCRIPTION_SHORT' END,
 CASE WHEN memo THEN 'ZERO_MEMO' END,
 CASE WHEN date_diff('day', transaction_date, value_date) < -30 THEN 'VALUE_DATE_EARLY'
  WHEN date_diff('day', transaction_date, value_date) > 30 THEN 'VALUE_DATE_LATE' END,
 CASE WHEN memo AND NOT (hd AND hc) THEN 'ZERO_VALUE' END,
 CASE WHEN balance_status = 'MISMATCH' THEN 'BALANCE_MISMATCH' END,
 CASE WHEN is_duplicate THEN 'DUPLICATE' END) warnings FROM checked_rows""",
)
cte(
    "validated",
    """SELECT *, CASE WHEN errors <> '' THEN 'INVALID' WHEN is_corrected THEN 'CORRECTED'
 WHEN warnings <> '' THEN 'REVIEW' ELSE 'VALID' END status,
 CASE WHEN errors <> '' THEN 'ERROR' WHEN warnings <> '' THEN 'WARNING' ELSE 'INFO' END severity,
 errors = '' is_ready FROM coded_rows""",
)
cte(
    "file_summary",
    """SELECT source_file_id, count(*) total_transactions,
 count(*) FILTER (status = 'VALID') valid_count, count(*) FILTER (status = 'REVIEW') review_count,
 count(*) FILTER (status = 'INVALID') invalid_count, count(*) FILTER (status = 'CORRECTED') corrected_count,
 count(*) FILTER (hd) debit_count, count(*) FILTER (hc AND NOT hd) credit_count,
 CAST(coalesce(sum(debit) FILTER (hd), 0) AS DECIMAL(38,2)) total_debits,
 CAST(coalesce(sum(credit) FILTER (hc AND NOT hd), 0) AS DECIMAL(38,2)) total_credits,
 count(*) FILTER (balance_status <> 'NOT_CHECKABLE') checkable_count,
 count(*) FILTER (balance_status = 'BALANCED') matched_count,
 count(*) FILTER (balance_status = 'MISMATCH') mismatched_count,
 count(*) FILTER (is_duplicate) duplicate_count,
 CAST(coalesce(sum(credit) FILTER (hc AND NOT hd), 0) - coalesce(sum(debit) FILTER (hd), 0) AS DECIMAL(38,2))
  net_movement, count(*) FILTER (status = 'INVALID') = 0 is_ready FROM validated GROUP BY source_file_id""",
)


def validated(led: Ledger) -> DataFrame:
    return V.validate(led.ledger, led.audit, hot=led.hot)


@query(
    "txn_validate",
    """SELECT id, source_file_id, errors AS error_codes, warnings AS warning_codes, status, severity, balance_status,
 is_duplicate, is_ready FROM validated""",
)
def txn_validate(led: Ledger) -> DataFrame:
    return validated(led).select(
        "id",
        "source_file_id",
        F.array_join("error_codes", ",").alias("error_codes"),
        F.array_join("warning_codes", ",").alias("warning_codes"),
        "status",
        "severity",
        "balance_status",
        "is_duplicate",
        "is_ready",
    )


@query("validation_summary", "SELECT * FROM file_summary")
def validation_summary(led: Ledger) -> DataFrame:
    return V.summarize(validated(led))


@query(
    "txn_fingerprint",
    """SELECT id, sha256(concat(strftime(transaction_date, '%Y-%m-%d'), '|', upper(trim(coalesce(description, ''))), '|',
 CAST(amount AS VARCHAR), '|',
 upper(trim(coalesce(transaction_type, CASE WHEN debit IS NOT NULL THEN 'DEBIT' ELSE 'CREDIT' END))), '|',
 upper(trim(coalesce(reference, ''))), '|', coalesce(CAST(balance AS VARCHAR), ''))) AS fingerprint FROM ledger""",
)
def txn_fingerprint(led: Ledger) -> DataFrame:
    return led.ledger.select("id", F.sha2(V.fingerprint(), 256).alias("fingerprint"))


@query("duplicate_flag", "SELECT id, source_file_id, is_duplicate FROM dup_rows")
def duplicate_flag(led: Ledger) -> DataFrame:
    return V.flag_duplicates(led.ledger, led.hot).select("id", "source_file_id", "is_duplicate")


CONTINUITY = """SELECT id, source_file_id, CAST({prev} AS DECIMAL(18,2)) AS prev_balance,
 CASE WHEN {prev} IS NULL OR balance IS NULL THEN 'NOT_CHECKABLE'
 WHEN abs({expected} - balance) <= {tol}{extra} THEN 'BALANCED' ELSE 'MISMATCH' END AS balance_status
 FROM {source}"""
NET = "{prev} - coalesce(debit, 0) + coalesce(credit, 0)"
SEED = "coalesce(carry_balance, CASE WHEN row_no = 1 THEN balance END, 0)"
DEBIT_WINS = "{prev} + CASE WHEN debit IS NOT NULL THEN -debit ELSE coalesce(credit, 0) END"


def _continuity_sql(prev: str, expected: str, tol: str, extra: str = "", source: str = "ordered_rows") -> str:
    return CONTINUITY.format(prev=prev, expected=expected.format(prev=prev), tol=tol, extra=extra, source=source)


INFERRED = f"""(SELECT * REPLACE (
 CASE WHEN debit IS NULL AND credit IS NULL AND balance < {SEED} THEN {SEED} - balance ELSE debit END AS debit,
 CASE WHEN debit IS NULL AND credit IS NULL AND balance > {SEED} THEN balance - {SEED} ELSE credit END AS credit)
 FROM ordered_rows)"""
IMPLIED = """coalesce(carry_balance,
 CASE WHEN row_no = 1 THEN balance + coalesce(debit, 0) - coalesce(credit, 0) END, 0)"""
FILLED = f"""(SELECT *, coalesce(last_value(balance - run IGNORE NULLS) OVER ({W} {PREV}), 0) + run - net filled_prev
 FROM (SELECT *, sum(net) OVER ({W} ROWS UNBOUNDED PRECEDING) run FROM ordered_rows))"""

POLICY_SQL = {
    "validate": _continuity_sql("prev_balance", "{prev} - dpos + cpos", "0.01"),
    "financial": _continuity_sql(
        "CASE WHEN row_no = 1 THEN 10000.00 ELSE prev_balance END", NET, "0.05"
    ),
    "hdfc": _continuity_sql("carry_balance", NET, "0.01"),
    "yes": _continuity_sql("prev_balance", NET, "0.01", " OR (balance = 0 AND description LIKE '%SWEEP-IN%')"),
    "axis": _continuity_sql("carry_balance", DEBIT_WINS, "0.05"),
    "central": _continuity_sql("carry_balance", NET, "0.01"),
    "icici_v1": _continuity_sql(SEED, DEBIT_WINS, "0.001"),
    "icici_v2": _continuity_sql(IMPLIED, NET, "0.01"),
    "sbi": _continuity_sql(SEED, DEBIT_WINS, "0.01", source=INFERRED),
    "boi": _continuity_sql(SEED, NET, "0.01", source=INFERRED),
}
FILL_SQL = f"""SELECT id, source_file_id, CAST(filled_prev AS DECIMAL(18,2)) AS prev_balance,
 CASE WHEN balance IS NULL OR row_no = 1 THEN 'NOT_CHECKABLE' WHEN abs(filled_prev + net - balance) <= 0.05
 THEN 'BALANCED' ELSE 'MISMATCH' END AS balance_status FROM {FILLED}"""
for _bank in ("kotak", "pnb", "bob"):
    POLICY_SQL[_bank] = FILL_SQL


def _register_policy(name: str) -> None:
    @query(f"continuity_{name}", POLICY_SQL[name])
    def run(led: Ledger) -> DataFrame:
        opening = F.lit("10000.00").cast(MONEY) if name == "financial" else None
        rows = C.continuity(led.ledger, name, opening=opening, hot=led.hot)
        return rows.select("id", "source_file_id", "prev_balance", "balance_status")


for _name in POLICY_SQL:
    _register_policy(_name)


@query("balance_continuity", POLICY_SQL["validate"])
def balance_continuity(led: Ledger) -> DataFrame:
    rows = C.continuity(led.ledger, "validate", hot=led.hot)
    return rows.select("id", "source_file_id", "prev_balance", "balance_status")


@query(
    "continuity_carry",
    """SELECT *, CASE balance_status WHEN 'BALANCED' THEN 1.0 WHEN 'MISMATCH' THEN 0.6
 ELSE CASE WHEN has_balance THEN 0.98 ELSE 0.85 END END::DOUBLE AS confidence
 FROM (SELECT id, source_file_id, balance IS NOT NULL has_balance, CASE WHEN carry_balance IS NULL OR balance IS NULL
 THEN 'NOT_CHECKABLE' WHEN abs(carry_balance + net - balance) <= 0.01 THEN 'BALANCED' ELSE 'MISMATCH' END
 AS balance_status FROM ordered_rows)""",
)
def continuity_carry(led: Ledger) -> DataFrame:
    rows = C.continuity(led.ledger, "hdfc", hot=led.hot)
    confidence = C.carry_confidence(F.lit(0.85), F.col("balance_status"), F.col("balance"))
    return rows.select(
        "id",
        "source_file_id",
        F.col("balance").isNotNull().alias("has_balance"),
        "balance_status",
        F.round(confidence, 4).alias("confidence"),
    )


@query("continuity_sweep", POLICY_SQL["yes"].replace("'%SWEEP-IN%'", "'%RED%'").replace("description", "upper(description)"))
def continuity_sweep(led: Ledger) -> DataFrame:
    """The sweep rule over the ledger; narrations with RED stand in for sweep entries of other data."""
    rows = led.ledger.withColumn(
        "description",
        F.when(F.upper("description").contains("RED"), F.concat("description", F.lit(" SWEEP-IN"))).otherwise(
            F.col("description")
        ),
    )
    rows = C.continuity(rows, "yes", hot=led.hot)
    return rows.select("id", "source_file_id", "prev_balance", "balance_status")


@query(
    "reconcile_opening",
    _continuity_sql("CASE WHEN row_no = 1 THEN 10000.00 ELSE prev_balance END", NET, "0.05"),
)
def reconcile_opening(led: Ledger) -> DataFrame:
    rows = C.continuity(led.ledger, "financial", opening=F.lit("10000.00").cast(MONEY), hot=led.hot)
    return rows.select("id", "source_file_id", "prev_balance", "balance_status")


@query(
    "implied_opening",
    """SELECT source_file_id, CAST(arg_min(balance + CASE WHEN debit > 0 THEN debit WHEN credit > 0 THEN -credit
 ELSE 0 END, row_no) AS DECIMAL(18,2)) AS opening_balance FROM ordered_rows WHERE balance IS NOT NULL
 GROUP BY source_file_id""",
)
def implied_opening(led: Ledger) -> DataFrame:
    rows = led.ledger.filter("balance is not null")
    return rows.groupBy("source_file_id").agg(opening_from_first().alias("opening_balance"))


def row_position() -> Column:
    return F.struct(*[F.col(c) for c in LEDGER_ORDER])


def opening_from_first() -> Column:
    """Balance before the first row that has one; map-side ``min_by`` instead of a sort."""
    back = F.when(F.col("debit") > 0, F.col("debit")).when(F.col("credit") > 0, -F.col("credit")).otherwise(C.zero())
    has = F.when(F.col("balance").isNotNull(), row_position())
    return F.min_by((F.col("balance") + back).cast(MONEY), has)


def closing_balance_of() -> Column:
    has = F.when(F.col("balance").isNotNull(), row_position())
    return F.max_by("balance", has)


@query(
    "closing_balance",
    """SELECT source_file_id, arg_max(balance, row_no) FILTER (balance IS NOT NULL) AS closing_balance,
 any_value(CASE WHEN last THEN balance END) AS last_row_balance FROM
 (SELECT *, row_no = max(row_no) OVER (PARTITION BY source_file_id) AS last FROM ordered_rows) GROUP BY source_file_id""",
)
def closing_balance(led: Ledger) -> DataFrame:
    return led.ledger.groupBy("source_file_id").agg(
        closing_balance_of().alias("closing_balance"),
        F.max_by("balance", row_position()).alias("last_row_balance"),
    )


@query(
    "balance_fill",
    f"""SELECT id, source_file_id, CAST(coalesce(balance, filled_prev + net) AS DECIMAL(18,2)) AS filled_balance,
 balance IS NULL AS was_missing FROM {FILLED}""",
)
def balance_fill(led: Ledger) -> DataFrame:
    rows = C.continuity(led.ledger, "kotak", hot=led.hot)
    return rows.select("id", "source_file_id", "filled_balance", F.col("balance").isNull().alias("was_missing"))


@query(
    "infer_side",
    f"SELECT id, source_file_id, CAST(debit AS DECIMAL(18,2)) debit, CAST(credit AS DECIMAL(18,2)) credit FROM {INFERRED}",
)
def infer_side(led: Ledger) -> DataFrame:
    rows = C.continuity(led.ledger, "boi", hot=led.hot)
    return rows.select("id", "source_file_id", "debit", "credit")


@query(
    "infer_signed_side",
    """WITH r AS (SELECT *, CASE WHEN bank_code = 1 THEN -amount ELSE amount END raw,
 CASE WHEN bank_code = 2 THEN upper(left(transaction_type, 1)) || 'r' END ind,
 balance - coalesce(carry_balance, 10000) delta FROM ordered_rows),
 s AS (SELECT *, CASE WHEN upper(coalesce(ind, '')) LIKE '%DR%' THEN 'D' WHEN upper(coalesce(ind, '')) LIKE '%CR%' THEN 'C'
 WHEN raw < 0 THEN 'D' WHEN abs(delta - abs(raw)) <= 0.05 THEN 'C' WHEN abs(delta + abs(raw)) <= 0.05 THEN 'D' END side
 FROM r) SELECT id, source_file_id, CASE WHEN side = 'D' THEN abs(raw) END AS debit,
 CASE WHEN side = 'C' THEN abs(raw) END AS credit FROM s""",
)
def infer_signed_side(led: Ledger) -> DataFrame:
    rows = led.ledger.withColumns(
        {
            "raw_amount": F.when(F.col("bank_code") == 1, -F.col("amount")).otherwise(F.col("amount")),
            "indicator": F.when(F.col("bank_code") == 2, F.concat(F.upper(F.left("transaction_type", F.lit(1))), F.lit("r"))),
        }
    )
    opening = F.lit("10000.00").cast(MONEY)
    rows = C.infer_signed_side(rows, "source_file_id", LEDGER_ORDER, opening, led.hot)
    return rows.select("id", "source_file_id", "debit", "credit")


@query(
    "dedupe_page_boundary",
    f"""SELECT id, source_file_id FROM (SELECT *, CAST(floor(seq / 10) AS INT) AS page FROM ledger)
 QUALIFY NOT coalesce(lag(true) OVER ({W}) AND transaction_date = lag(transaction_date) OVER ({W})
 AND amount IS NOT DISTINCT FROM lag(amount) OVER ({W}) AND balance IS NOT DISTINCT FROM lag(balance) OVER ({W})
 AND description IS NOT DISTINCT FROM lag(description) OVER ({W})
 AND reference IS NOT DISTINCT FROM lag(reference) OVER ({W}) AND page <> lag(page) OVER ({W}), false)""",
)
def dedupe_page_boundary(led: Ledger) -> DataFrame:
    rows = led.ledger.withColumn("page", F.floor(F.col("seq") / 10).cast("int"))
    return drop_page_repeats(rows, "source_file_id", LEDGER_ORDER, led.hot).select("id", "source_file_id")


def drop_page_repeats(rows: DataFrame, key: str, order: list[str], hot=None) -> DataFrame:
    """Drop a row equal to the one before it when a page break lies between them."""
    same = ["transaction_date", "amount", "balance", "description", "reference"]
    rows = with_ordered(rows, [key], order, {"_before": lag(F.struct(*same, "page"))}, hot)
    equal = F.col("_before").isNotNull() & (F.col("_before")["page"] != F.col("page"))
    for name in same:
        equal = equal & F.col("_before")[name].eqNullSafe(F.col(name))
    return rows.filter(~equal).drop("_before")


@query(
    "row_numbers",
    "SELECT id, source_file_id, CAST(row_no AS BIGINT) AS sr_no FROM ordered_rows",
)
def row_numbers(led: Ledger) -> DataFrame:
    rows = with_ordered(led.ledger, ["source_file_id"], LEDGER_ORDER, {"sr_no": rownum()}, led.hot)
    return rows.select("id", "source_file_id", F.col("sr_no").cast("long").alias("sr_no"))


@query(
    "continuity_rate",
    """SELECT source_file_id, round(CASE WHEN count(*) > 1 THEN count(*) FILTER (abs(prev_balance + net - balance) <= 0.05)
 / (count(*) - 1)::DOUBLE ELSE 0.6 END, 6) AS continuity_rate FROM ordered_rows GROUP BY source_file_id""",
)
def continuity_rate(led: Ledger) -> DataFrame:
    rows = C.continuity(led.ledger, "financial", hot=led.hot)
    n, good = F.count(F.lit(1)), F.count_if(F.col("balance_status") == C.BALANCED)
    return rows.groupBy("source_file_id").agg(
        F.round(F.when(n > 1, good / (n - 1)).otherwise(F.lit(0.6)), 6).alias("continuity_rate")
    )


def financial_rows(led: Ledger) -> DataFrame:
    """Rows judged against the opening balance, with a running count of discrepancies."""
    return C.judge_rows(led.ledger, "source_file_id", F.lit("10000.00").cast(MONEY), hot=led.hot)


FIN = """(SELECT *, prev IS NOT NULL AND balance IS NOT NULL AS checkable, abs(prev + net - balance) <= 0.05 ok,
 dpos = 0 AND cpos = 0 missing FROM (SELECT *, CASE WHEN row_no = 1 THEN 10000.00 ELSE prev_balance END prev
 FROM ordered_rows))"""


@query(
    "financial_validation",
    f"""SELECT source_file_id, count(*) AS total_rows, count(*) FILTER (checkable AND ok) AS reconciled_rows,
 count(*) FILTER (checkable AND NOT ok) AS failed_rows, count(*) FILTER (balance IS NULL) AS missing_balance,
 count(*) FILTER (missing) AS missing_amount, CAST(sum(dpos) AS DECIMAL(38,2)) AS total_debits,
 CAST(sum(cpos) AS DECIMAL(38,2)) AS total_credits,
 CAST(10000 + sum(cpos) - sum(dpos) AS DECIMAL(38,2)) AS calculated_closing,
 count(*) FILTER (checkable AND ok) = count(*) AND count(*) FILTER (missing) = 0
  AND (arg_max(balance, row_no) IS NULL OR abs(10000 + sum(cpos) - sum(dpos) - arg_max(balance, row_no)) <= 0.05)
  AS fully_reconciled,
 CASE WHEN count(balance) > 0 THEN round_even(count(*) FILTER (checkable AND ok) / count(balance)::DOUBLE, 4)
  ELSE 0.0 END AS reconciliation_rate, 10000.00::DECIMAL(18,2) AS opening_balance, arg_max(balance, row_no) AS closing_balance,
 count(*) FILTER (missing) + count(*) FILTER (checkable AND NOT ok)
  + CASE WHEN abs(10000 + sum(cpos) - sum(dpos) - arg_max(balance, row_no)) > 0.05 THEN 1 ELSE 0 END
  AS discrepancy_count
 FROM {FIN} GROUP BY source_file_id""",
)
def financial_validation(led: Ledger) -> DataFrame:
    return C.judge_files(financial_rows(led), "source_file_id")


@query(
    "top_discrepancies",
    f"""WITH d AS (SELECT source_file_id, row_no, code, row_number() OVER (PARTITION BY source_file_id ORDER BY row_no, k) n
 FROM (SELECT *, 1 k, 'MISSING_AMOUNT' code FROM {FIN} WHERE missing UNION ALL
 SELECT *, 2 k, 'BALANCE' code FROM {FIN} WHERE checkable AND NOT ok))
 SELECT source_file_id, string_agg(code || '@' || row_no, ',' ORDER BY n) AS first_two FROM d WHERE n <= 2
 GROUP BY source_file_id""",
)
def top_discrepancies(led: Ledger) -> DataFrame:
    return C.first_discrepancies(financial_rows(led), "source_file_id", 2, led.hot)


@query(
    "ledger_totals",
    """SELECT source_file_id, CAST(sum(debit) AS DECIMAL(38,2)) AS total_debits,
 CAST(sum(credit) AS DECIMAL(38,2)) AS total_credits FROM ledger GROUP BY source_file_id""",
)
def ledger_totals(led: Ledger) -> DataFrame:
    return led.ledger.groupBy("source_file_id").agg(
        F.sum("debit").cast(TOTAL).alias("total_debits"), F.sum("credit").cast(TOTAL).alias("total_credits")
    )
