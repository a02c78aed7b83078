"""Queries over sheets, vouchers, exports, corrections and ledger maintenance."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.model import LEDGER_ORDER, MONEY
from ledgerspark.operators import audit as A
from ledgerspark.operators import export as X
from ledgerspark.operators import sheets as S
from ledgerspark.operators.ordered import rownum, with_ordered
from ledgerspark.plans.ledger import validated
from ledgerspark.plans.listing import BANK_SQL, PARSER_SQL
from ledgerspark.plans.registry import cte, query
from ledgerspark.sources.bridge import Ledger

RAW_MONEY = "CASE seq % 3 WHEN 0 THEN CAST({c} AS VARCHAR) || ' Dr' WHEN 1 THEN '₹' || CAST({c} AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
cte(
    "sheet_rows",
    f"""SELECT source_file_id batch_id, seq + 1 row_number, defect, seq, transaction_date, value_date,
 CASE WHEN defect = 9 THEN '[sample] ' || description ELSE description END narration, reference,
 CASE WHEN defect = 14 THEN 'abc' WHEN defect = 15 THEN '-5.00' ELSE {RAW_MONEY.format(c='debit')} END raw_dr,
 {RAW_MONEY.format(c='credit')} raw_cr, debit, credit,
 CASE WHEN defect = 11 THEN '' ELSE regexp_extract(description, '^(\\S+ \\S+)', 1) END ledger_name,
 CASE WHEN defect = 17 THEN '' ELSE {BANK_SQL.format(c='bank_code', e="'Unknown Bank'")} END bank_name
 FROM ledger""",
)
cte(
    "sheet_typed",
    """SELECT *, CASE WHEN defect <> 12 THEN CAST(transaction_date AS DATE) END AS d,
 CASE WHEN defect <> 13 THEN CAST(value_date AS DATE) END AS vd,
 CASE WHEN defect IN (14, 15) THEN NULL ELSE debit END AS dr, credit AS cr,
 CASE WHEN defect IN (14, 15) THEN false ELSE coalesce(debit > 0, false) END hdr, coalesce(credit > 0, false) hcr
 FROM sheet_rows WHERE defect NOT IN (9, 10)""",
)
cte(
    "sheet_checked",
    """SELECT *, concat_ws(',', CASE WHEN d IS NULL THEN 'Date' END, CASE WHEN vd IS NULL THEN 'Value Date' END,
 CASE WHEN defect IN (14, 15) THEN 'Dr Amount' END, CASE WHEN hdr AND hcr THEN 'Amount' END,
 CASE WHEN defect NOT IN (14, 15) AND NOT hdr AND NOT hcr THEN 'Amount' END,
 CASE WHEN defect = 16 THEN 'Closing Balance' END, CASE WHEN ledger_name = '' THEN 'Ledger Name' END,
 CASE WHEN bank_name = '' THEN 'Bank Name' END) fatal,
 CASE WHEN d IS NOT NULL AND (hdr OR hcr) THEN nullif(min(row_number) OVER (PARTITION BY batch_id, d, hdr,
  CASE WHEN hdr THEN dr ELSE cr END, coalesce(upper(reference), ''), coalesce(upper(trim(narration)), ''),
  d IS NOT NULL AND (hdr OR hcr)), row_number) END first_row FROM sheet_typed""",
)
cte(
    "sheet_status",
    """SELECT *, CASE WHEN fatal <> '' THEN 'Invalid' WHEN first_row IS NOT NULL THEN 'Warning' ELSE 'Valid' END status
 FROM sheet_checked""",
)


def sheet(led: Ledger) -> DataFrame:
    return S.validate_sheet(led.sheet_rows, "batch_id", led.hot)


@query("sheet_blank_rows", "SELECT batch_id, count(*) FILTER (defect = 10) AS blank_rows FROM sheet_rows GROUP BY batch_id")
def sheet_blank_rows(led: Ledger) -> DataFrame:
    return led.sheet_rows.groupBy("batch_id").agg(F.count_if(S.is_blank_row()).alias("blank_rows"))


@query("sheet_sample_rows", "SELECT batch_id, row_number FROM sheet_rows WHERE defect = 9")
def sheet_sample_rows(led: Ledger) -> DataFrame:
    return led.sheet_rows.filter(S.is_sample_row()).select("batch_id", "row_number")


@query(
    "sheet_validate",
    """SELECT batch_id, row_number, d AS date, vd AS value_date, dr AS dr_amount, cr AS cr_amount,
 concat_ws(',', nullif(fatal, ''), CASE WHEN first_row IS NOT NULL THEN 'Duplicate' END) AS issue_columns, status
 FROM sheet_status""",
)
def sheet_validate(led: Ledger) -> DataFrame:
    columns = F.transform("issues", lambda i: i["column"])
    return sheet(led).select(
        "batch_id", "row_number", "date", "value_date", "dr_amount", "cr_amount",
        F.array_join(columns, ",").alias("issue_columns"), "status",
    )


@query("sheet_duplicates", "SELECT batch_id, row_number, first_row FROM sheet_checked WHERE first_row IS NOT NULL")
def sheet_duplicates(led: Ledger) -> DataFrame:
    rows = S.flag_repeats(S.parse_rows(led.sheet_rows), "batch_id", led.hot)
    return rows.filter("first_row is not null").select("batch_id", "row_number", "first_row")


@query(
    "sheet_issues",
    """SELECT batch_id, row_number, unnest(string_split(fatal, ',')) AS "column", 2 AS severity FROM sheet_checked
 WHERE fatal <> '' UNION ALL SELECT batch_id, row_number, 'Duplicate', 1 FROM sheet_checked WHERE first_row IS NOT NULL""",
)
def sheet_issues(led: Ledger) -> DataFrame:
    return S.sheet_messages(sheet(led)).drop("message")


@query(
    "sheet_summary",
    """SELECT r.batch_id, r.samples AS samples_skipped, r.blanks AS blank_skipped, coalesce(s.n, 0) AS total_rows,
 coalesce(s.v, 0) AS valid_rows, coalesce(s.w, 0) AS warning_rows, coalesce(s.i, 0) AS invalid_rows,
 coalesce(s.n, 0) > 0 AND coalesce(s.i, 0) = 0 AS is_ready FROM
 (SELECT batch_id, count(*) FILTER (defect = 9) samples, count(*) FILTER (defect = 10) blanks FROM sheet_rows GROUP BY 1) r
 LEFT JOIN (SELECT batch_id, count(*) n, count(*) FILTER (status = 'Valid') v, count(*) FILTER (status = 'Warning') w,
 count(*) FILTER (status = 'Invalid') i FROM sheet_status GROUP BY 1) s ON s.batch_id = r.batch_id""",
)
def sheet_summary(led: Ledger) -> DataFrame:
    return S.summarize_sheet(led.sheet_rows, sheet(led))


@query(
    "sheet_filter",
    """SELECT batch_id, row_number FROM sheet_status WHERE status = 'Valid' AND (lower(narration) LIKE '%blue%'
 OR lower(ledger_name) LIKE '%blue%' OR lower(bank_name) LIKE '%blue%' OR lower(reference) LIKE '%blue%')""",
)
def sheet_filter(led: Ledger) -> DataFrame:
    return S.filter_sheet(sheet(led), "VALID", "blue").select("batch_id", "row_number")


HEADER_CELLS = """SELECT d.doc_id batch_id, p.pos AS position, p.header FROM documents d,
 (SELECT unnest(range(0, 12)) pos) q,
 LATERAL (SELECT q.pos, (['Txn Date', 'Particulars', 'Chq / Ref No', 'VALUE DT', 'Debit', 'Credit', 'Closing Bal.',
 'Party Name', 'Bank', 'Date', 'Other', 'Narration'])[1 + CAST((q.pos + d.n_chars) % 12 AS INT)] header) p
 WHERE (d.n_chars + q.pos) % 7 <> 0"""
CANON_SQL = """CASE header WHEN 'Txn Date' THEN 'Date' WHEN 'Date' THEN 'Date' WHEN 'Particulars' THEN 'Narration'
 WHEN 'Narration' THEN 'Narration' WHEN 'Chq / Ref No' THEN 'Cheque / Ref No.' WHEN 'VALUE DT' THEN 'Value Date'
 WHEN 'Debit' THEN 'Dr Amount' WHEN 'Credit' THEN 'Cr Amount' WHEN 'Closing Bal.' THEN 'Closing Balance'
 WHEN 'Party Name' THEN 'Ledger Name' WHEN 'Bank' THEN 'Bank Name' END"""


def header_cells(led: Ledger) -> DataFrame:
    """Header rows of sheets with varied spellings, order and gaps, one sheet per document."""
    names = F.array(
        *[
            F.lit(h)
            for h in [
                "Txn Date", "Particulars", "Chq / Ref No", "VALUE DT", "Debit", "Credit", "Closing Bal.",
                "Party Name", "Bank", "Date", "Other", "Narration",
            ]
        ]
    )
    cells = led.table("documents").select(
        F.col("doc_id").alias("batch_id"), "n_chars", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("position")
    )
    cells = cells.filter((F.col("n_chars") + F.col("position")) % 7 != 0)
    pick = ((F.col("position") + F.col("n_chars")) % 12).cast("int")
    return cells.select("batch_id", "position", F.get(names, pick).alias("header"))


@query(
    "sheet_header_map",
    f"""WITH cells AS ({HEADER_CELLS}) SELECT batch_id, canonical, min(position) AS position,
 arg_min(header, position) AS header FROM (SELECT *, {CANON_SQL} canonical FROM cells) WHERE canonical IS NOT NULL
 GROUP BY 1, 2""",
)
def sheet_header_map(led: Ledger) -> DataFrame:
    mapping, _ = S.map_headers(header_cells(led))
    return mapping


@query(
    "sheet_missing_headers",
    f"""WITH cells AS ({HEADER_CELLS}), found AS (SELECT batch_id, list(DISTINCT {CANON_SQL}) f FROM cells GROUP BY 1)
 SELECT batch_id, array_to_string(list_filter(['Date', 'Narration', 'Cheque / Ref No.', 'Value Date', 'Dr Amount',
 'Cr Amount', 'Closing Balance', 'Ledger Name', 'Bank Name'], lambda x: NOT list_contains(f, x)), ',') AS missing
 FROM found""",
)
def sheet_missing_headers(led: Ledger) -> DataFrame:
    _, missing = S.map_headers(header_cells(led))
    return missing.select("batch_id", F.array_join("missing", ",").alias("missing"))


@query("voucher_eligible", "SELECT batch_id, row_number FROM sheet_status WHERE status <> 'Invalid'")
def voucher_eligible(led: Ledger) -> DataFrame:
    return S.eligible(sheet(led)).select("batch_id", "row_number")


@query(
    "voucher_revalidate",
    """SELECT batch_id, min(row_number) AS row_number, arg_min(reason, row_number) AS reason FROM (SELECT batch_id,
 row_number, CASE WHEN d IS NULL THEN 'Date is required and must be valid.' WHEN hdr AND hcr THEN
 'Dr Amount and Cr Amount cannot both be populated.' WHEN NOT hdr AND NOT hcr THEN
 'Either Dr Amount or Cr Amount must be greater than zero.' WHEN ledger_name = '' THEN 'Ledger Name cannot be empty.'
 WHEN bank_name = '' THEN 'Bank Name cannot be empty.' WHEN vd IS NULL THEN 'Invalid Value Date format: ''31/02/1999''.'
 WHEN defect = 14 THEN 'Dr Amount is not numeric: ''abc''.' WHEN defect = 15 THEN 'Dr Amount cannot be negative.'
 WHEN defect = 16 THEN 'Closing Balance must be a valid numeric amount: ''x1''.' END reason FROM sheet_status)
 WHERE reason IS NOT NULL GROUP BY batch_id""",
)
def voucher_revalidate(led: Ledger) -> DataFrame:
    return S.revalidate(sheet(led))


cte(
    "voucher_rows",
    """SELECT batch_id, row_number, CASE WHEN hdr THEN 'Payment' ELSE 'Receipt' END voucher_type,
 strftime(d, '%Y%m%d') date, strftime(coalesce(vd, d), '%Y%m%d') effective_date, reference, trim(narration) narration,
 CASE WHEN hdr THEN dr ELSE cr END amount, ledger_name, bank_name FROM sheet_status WHERE status <> 'Invalid'""",
)


@query("vouchers", "SELECT * FROM voucher_rows")
def vouchers(led: Ledger) -> DataFrame:
    return S.vouchers(sheet(led))


@query(
    "voucher_entries",
    """SELECT batch_id, row_number, 1 AS line_no, CASE WHEN voucher_type = 'Payment' THEN ledger_name ELSE bank_name END
 AS ledger, 'Yes' AS is_deemed_positive, -amount AS amount FROM voucher_rows UNION ALL
 SELECT batch_id, row_number, 2, CASE WHEN voucher_type = 'Payment' THEN bank_name ELSE ledger_name END, 'No', amount
 FROM voucher_rows""",
)
def voucher_entries(led: Ledger) -> DataFrame:
    return S.voucher_entries(S.vouchers(sheet(led)))


ENTRY_SQL = """'<ALLLEDGERENTRIES.LIST><LEDGERNAME>' || {l} || '</LEDGERNAME><ISDEEMEDPOSITIVE>' || '{p}' ||
 '</ISDEEMEDPOSITIVE><AMOUNT>' || CAST({a} AS VARCHAR) || '</AMOUNT></ALLLEDGERENTRIES.LIST>'"""


@query(
    "voucher_xml",
    f"""SELECT batch_id, row_number, '<TALLYMESSAGE xmlns:UDF="TallyUDF"><VOUCHER VCHTYPE="' || voucher_type ||
 '" ACTION="Create"><DATE>' || date || '</DATE><EFFECTIVEDATE>' || effective_date || '</EFFECTIVEDATE><VOUCHERTYPENAME>'
 || voucher_type || '</VOUCHERTYPENAME>' || coalesce('<REFERENCE>' || reference || '</REFERENCE>', '') ||
 coalesce('<NARRATION>' || nullif(narration, '') || '</NARRATION>', '') ||
 {ENTRY_SQL.format(l="CASE WHEN voucher_type = 'Payment' THEN ledger_name ELSE bank_name END", p='Yes', a='-amount')} ||
 {ENTRY_SQL.format(l="CASE WHEN voucher_type = 'Payment' THEN bank_name ELSE ledger_name END", p='No', a='amount')}
 || '</VOUCHER></TALLYMESSAGE>' AS xml FROM voucher_rows""",
)
def voucher_xml(led: Ledger) -> DataFrame:
    return S.voucher_xml(S.vouchers(sheet(led)))


# ---------------------------------------------------------------- exports


@query(
    "export_gate",
    """SELECT id, source_file_id, status FROM validated WHERE source_file_id IN
 (SELECT source_file_id FROM file_summary WHERE invalid_count = 0)""",
)
def export_gate(led: Ledger) -> DataFrame:
    return X.export_gate(validated(led)).select("id", "source_file_id", "status")


cte(
    "messages",
    """SELECT id, concat_ws('; ',
 CASE WHEN transaction_date > TIMESTAMP '2001-06-02' THEN 'Transaction date cannot be in the future.' END,
 CASE WHEN trim(coalesce(description, '')) = '' THEN 'Description/narration is required.' END,
 CASE WHEN amount < 0 THEN 'Transaction amount cannot be negative.' END,
 CASE WHEN amount = 0 AND NOT memo THEN 'Transaction amount must be greater than zero.' END,
 CASE WHEN upper(trim(coalesce(transaction_type, ''))) NOT IN ('DEBIT', 'CREDIT')
  THEN 'Transaction type must be Debit or Credit.' END,
 CASE WHEN hd AND hc THEN 'Both Debit and Credit amounts are populated.' WHEN memo THEN NULL
  WHEN bd AND bc THEN 'Either Debit or Credit must be populated.' END,
 CASE WHEN memo THEN 'Zero amount transaction recorded in bank statement (e.g. cheque return or memo entry).' END,
 CASE WHEN date_diff('day', transaction_date, value_date) < -30
  THEN 'Value date precedes transaction date by more than 30 days.'
  WHEN date_diff('day', transaction_date, value_date) > 30
  THEN 'Value date exceeds transaction date by more than 30 days.' END,
 CASE WHEN memo AND NOT (hd AND hc) THEN 'Zero monetary value recorded in statement.' END,
 CASE WHEN balance_status = 'MISMATCH' THEN '#' END,
 CASE WHEN is_duplicate THEN 'Potential duplicate transaction detected with identical business values.' END) notes
 FROM validated""",
)


@query(
    "export_transactions_sheet",
    f"""SELECT v.source_file_id, v.row_no AS "Sr No", CAST(v.transaction_date AS DATE) AS "Transaction Date",
 CAST(v.value_date AS DATE) AS "Value Date", v.description AS "Particulars / Narration",
 coalesce(v.reference, '') AS "Cheque / Reference", coalesce(v.utr, '') AS "UTR", v.debit AS "Debit (-)",
 v.credit AS "Credit (+)", v.amount AS "Amount", v.balance AS "Balance",
 coalesce(v.transaction_type, CASE WHEN v.debit IS NOT NULL THEN 'Debit' ELSE 'Credit' END) AS "Transaction Type",
 {BANK_SQL.format(c='v.bank_code', e="'Unknown Bank'")} AS "Bank", coalesce(v.account, '') AS "Account",
 v.status AS "Validation Status", m.notes AS "Review Notes" FROM validated v JOIN messages m ON m.id = v.id""",
)
def export_transactions_sheet(led: Ledger) -> DataFrame:
    out = X.transactions_sheet(validated(led), led.hot)
    # The numbers inside the mismatch message are checked in the unit tests.
    short = F.regexp_replace("Review Notes", r"Running balance mismatch: [^;]*\(diff: [^)]*\)\.", "#")
    return out.withColumn("Review Notes", short)


@query(
    "export_csv",
    """SELECT v.source_file_id, v.row_no AS "Sr No", strftime(v.transaction_date, '%d/%m/%Y') AS "Transaction Date",
 coalesce(strftime(v.value_date, '%d/%m/%Y'), '') AS "Value Date", v.description AS "Particulars / Description",
 coalesce(v.reference, v.utr, '') AS "Cheque / Ref", coalesce(CAST(v.debit AS VARCHAR), '') AS "Debit (INR)",
 coalesce(CAST(v.credit AS VARCHAR), '') AS "Credit (INR)", coalesce(CAST(v.balance AS VARCHAR), '') AS "Balance (INR)",
 v.status AS "Validation Status" FROM validated v""",
)
def export_csv(led: Ledger) -> DataFrame:
    return X.ledger_csv(validated(led), led.hot)


cte(
    "file_facts",
    """SELECT source_file_id, arg_min(bank_code, row_no) bank_code, arg_min(account, row_no) FILTER (account <> '') account,
 arg_min(balance + CASE WHEN debit > 0 THEN debit WHEN credit > 0 THEN -credit ELSE 0 END, row_no)
  FILTER (balance IS NOT NULL) opening, arg_max(balance, row_no) FILTER (balance IS NOT NULL) closing
 FROM validated GROUP BY source_file_id""",
)


@query(
    "export_statement_info",
    f"""SELECT s.source_file_id, l.line_no, l.label, l.value FROM file_summary s JOIN file_facts f
 ON f.source_file_id = s.source_file_id JOIN file_records r ON r.id = s.source_file_id, LATERAL (VALUES
 (1, 'Bank Name', {BANK_SQL.format(c='f.bank_code', e="'Unknown Bank'")}),
 (2, 'Parser Version', {PARSER_SQL.format(c='f.bank_code')}),
 (3, 'Account Number', coalesce(f.account, 'N/A')), (4, 'Source Statement File', r.original_file_name),
 (5, 'Statement File ID', CAST(s.source_file_id AS VARCHAR)),
 (6, 'Ingestion Date (UTC)', strftime(r.uploaded_at, '%Y-%m-%d %H:%M:%S UTC')),
 (7, 'Export Timestamp (UTC)', '2001-06-01 00:00:00 UTC'),
 (8, 'Total Transactions', CAST(s.total_transactions AS VARCHAR)), (9, 'Valid Transactions', CAST(valid_count AS VARCHAR)),
 (10, 'Needs Review Transactions', CAST(review_count AS VARCHAR)),
 (11, 'Invalid Transactions', CAST(invalid_count AS VARCHAR)),
 (12, 'Corrected Transactions', CAST(corrected_count AS VARCHAR)),
 (13, 'Total Outflow (Debits)', CAST(total_debits AS VARCHAR)),
 (14, 'Total Inflow (Credits)', CAST(total_credits AS VARCHAR)),
 (15, 'Net Balance Movement', CAST(net_movement AS VARCHAR)),
 (16, 'Balance Continuity Status', CASE WHEN mismatched_count = 0 THEN 'BALANCED' ELSE 'MISMATCH' END))
 l(line_no, label, value)""",
)
def export_statement_info(led: Ledger) -> DataFrame:
    return X.statement_info(validated(led), led.file_records, dt.datetime(2001, 6, 1))


@query(
    "export_financial_summary",
    """SELECT s.source_file_id, l.line_no, l.metric, l.value, l.note FROM file_summary s JOIN file_facts f
 ON f.source_file_id = s.source_file_id, LATERAL (VALUES
 (1, 'Opening Balance', coalesce(CAST(f.opening AS VARCHAR), '-'), 'Derived balance before first transaction'),
 (2, 'Total Inflow (Credits +)', CAST(total_credits AS VARCHAR), credit_count || ' transaction(s)'),
 (3, 'Total Outflow (Debits -)', CAST(total_debits AS VARCHAR), debit_count || ' transaction(s)'),
 (4, 'Net Financial Movement', CAST(net_movement AS VARCHAR),
  CASE WHEN net_movement >= 0 THEN 'Net Positive Inflow' ELSE 'Net Outflow' END),
 (5, 'Closing Balance', coalesce(CAST(f.closing AS VARCHAR), '-'), 'Final balance recorded in statement period'),
 (6, 'Running Balance Continuity', CASE WHEN mismatched_count = 0 THEN 'BALANCED' ELSE 'MISMATCH DETECTED' END,
  CASE WHEN mismatched_count = 0 THEN 'Zero discrepancies across all sequential rows'
  ELSE mismatched_count || ' continuity mismatch(es) flagged' END),
 (7, 'Valid Records Ready', CAST(valid_count AS VARCHAR), 'No review flags or errors'),
 (8, 'Reviewed / Corrected', CAST(corrected_count AS VARCHAR), 'User-corrected records verified'),
 (9, 'Pending Review', CAST(review_count AS VARCHAR), CASE WHEN review_count = 0 THEN 'Clean'
  ELSE 'Needs manual confirmation' END),
 (10, 'Invalid Records', CAST(invalid_count AS VARCHAR), CASE WHEN invalid_count = 0 THEN 'Zero errors'
  ELSE 'Critical discrepancies present' END)) l(line_no, metric, value, note)""",
)
def export_financial_summary(led: Ledger) -> DataFrame:
    return X.financial_summary(validated(led))


# ---------------------------------------------------------------- corrections

cte(
    "correction_requests",
    """SELECT id transaction_id, n request_no, created_at + to_hours(n) ts, client_id % 25 user_id,
 CASE WHEN defect = 14 THEN ' ' ELSE 'fix ' || CAST(defect AS VARCHAR) END reason, transaction_date,
 description || CASE defect WHEN 12 THEN ' fixed' WHEN 9 THEN ' x' ELSE '' END description,
 CASE WHEN defect = 15 THEN -5.00 ELSE debit END debit, CASE WHEN defect = 15 THEN NULL ELSE credit END credit, amount,
 CASE WHEN defect = 3 THEN balance - 1 ELSE balance END balance,
 CASE WHEN defect = 12 AND n = 2 THEN 'FIX' || CAST(id AS VARCHAR) WHEN defect = 16 THEN '  ' ELSE reference END reference,
 transaction_type, defect FROM ledger, (VALUES (1), (2)) t(n)
 WHERE defect IN (1, 2, 3, 4, 9, 12, 13, 14, 15, 16) AND (n = 1 OR defect = 12)""",
)
cte(
    "request_checks",
    """SELECT *, CASE WHEN trim(reason) = '' THEN 'REASON_MISSING' WHEN trim(description) = '' THEN 'DESCRIPTION_BLANK'
 WHEN amount <= 0 THEN 'AMOUNT_NOT_POSITIVE' WHEN debit > 0 AND credit > 0 THEN 'BOTH_SIDES'
 WHEN NOT coalesce(debit > 0, false) AND NOT coalesce(credit > 0, false) THEN 'NO_POSITIVE_SIDE' END problem
 FROM correction_requests""",
)
cte(
    "accepted_requests",
    """SELECT transaction_id, request_no, ts, user_id, reason, transaction_date, trim(description) description, debit, credit,
 CASE WHEN debit > 0 THEN debit ELSE credit END amount, balance, nullif(trim(coalesce(reference, '')), '') reference,
 CASE WHEN debit > 0 THEN 'Debit' ELSE 'Credit' END transaction_type FROM request_checks
 WHERE problem IS NULL AND defect <> 9""",
)
FIELD_DIFFS = [
    ("TransactionDate", "strftime({r}.transaction_date, '%Y-%m-%d')"),
    ("Description", "{r}.description"),
    ("Debit", "CAST({r}.debit AS VARCHAR)"),
    ("Credit", "CAST({r}.credit AS VARCHAR)"),
    ("Amount", "CAST({r}.amount AS VARCHAR)"),
    ("Balance", "CAST({r}.balance AS VARCHAR)"),
    ("Reference", "{r}.reference"),
    ("TransactionType", "{r}.transaction_type"),
]


def _same(name: str, old: str, new: str) -> str:
    if name in A.TRIMMED:
        return f"trim(coalesce({old}, '')) = trim(coalesce({new}, ''))"
    return f"{old} IS NOT DISTINCT FROM {new}"


cte(
    "before_requests",
    """SELECT n.transaction_id, n.request_no, l.transaction_date,
 CASE WHEN n.request_no = 2 THEN p.description ELSE l.description END description, l.debit, l.credit, l.amount,
 CASE WHEN n.request_no = 2 THEN p.balance ELSE l.balance END balance,
 CASE WHEN n.request_no = 2 THEN p.reference ELSE l.reference END reference,
 CASE WHEN n.request_no = 2 THEN p.transaction_type ELSE l.transaction_type END transaction_type
 FROM accepted_requests n JOIN ledger l ON l.id = n.transaction_id LEFT JOIN accepted_requests p
 ON p.transaction_id = n.transaction_id AND p.request_no = n.request_no - 1""",
)


_FIELD_STRUCTS = ", ".join(
    f"""{{'field_order': {i}, 'field_name': '{name}', 'old_value': {expr.format(r="o")}, 'new_value': {expr.format(r="n")},
 'same': {_same(name, expr.format(r="o"), expr.format(r="n"))}}}"""
    for i, (name, expr) in enumerate(FIELD_DIFFS)
)
cte(
    "request_changes",
    f"""SELECT transaction_id, request_no, u.field_order, u.field_name, u.old_value, u.new_value FROM (SELECT n.transaction_id,
 n.request_no, unnest([{_FIELD_STRUCTS}]) AS u FROM accepted_requests n JOIN before_requests o
 ON o.transaction_id = n.transaction_id AND o.request_no = n.request_no) WHERE NOT u.same""",
)


def snapshots(led: Ledger) -> DataFrame:
    return led.audit_records.select("transaction_id", "source_file_id", "original_values.*")


@query(
    "correction_validate",
    "SELECT transaction_id, request_no, problem FROM request_checks",
)
def correction_validate(led: Ledger) -> DataFrame:
    return led.correction_requests.select("transaction_id", "request_no", A.request_problem().alias("problem"))


@query(
    "correction_normalize",
    """SELECT transaction_id, request_no, CASE WHEN debit > 0 THEN debit WHEN credit > 0 THEN credit ELSE amount END AS amount,
 CASE WHEN debit > 0 THEN 'Debit' WHEN credit > 0 THEN 'Credit' ELSE transaction_type END AS transaction_type,
 CASE WHEN NOT coalesce(debit > 0, false) AND credit > 0 THEN NULL ELSE debit END AS debit,
 CASE WHEN debit > 0 THEN NULL ELSE credit END AS credit FROM correction_requests""",
)
def correction_normalize(led: Ledger) -> DataFrame:
    return A.normalize_request(led.correction_requests).select(
        "transaction_id", "request_no", "amount", "transaction_type", "debit", "credit"
    )


def log_of(led: Ledger) -> DataFrame:
    return A.correction_log(led.correction_requests, led.ledger, led.audit_records)


@query("correction_diff", "SELECT * EXCLUDE (field_order) FROM request_changes")
def correction_diff(led: Ledger) -> DataFrame:
    return log_of(led).select("transaction_id", "request_no", F.inline("changes"))


@query(
    "correction_log",
    """SELECT a.transaction_id, a.request_no, a.user_id, a.reason, d.fields AS changed_fields
 FROM accepted_requests a JOIN (SELECT transaction_id, request_no, string_agg(field_name, ',' ORDER BY field_order) fields
 FROM request_changes GROUP BY 1, 2) d ON d.transaction_id = a.transaction_id AND d.request_no = a.request_no""",
)
def correction_log(led: Ledger) -> DataFrame:
    names = F.transform("changes", lambda c: c["field_name"])
    return log_of(led).select(
        "transaction_id", "request_no", "user_id", "reason", F.array_join(names, ",").alias("changed_fields")
    )


@query(
    "correction_counts",
    "SELECT transaction_id, count(DISTINCT request_no) AS corrections FROM request_changes GROUP BY transaction_id",
)
def correction_counts(led: Ledger) -> DataFrame:
    return log_of(led).groupBy("transaction_id").agg(F.count(F.lit(1)).alias("corrections"))


@query(
    "correction_apply",
    """WITH latest AS MATERIALIZED (SELECT * FROM accepted_requests QUALIFY row_number() OVER (PARTITION BY transaction_id
 ORDER BY ts DESC) = 1), j AS MATERIALIZED (SELECT l.id, a.transaction_id IS NOT NULL AND (trim(l.description) <> a.description
 OR l.balance IS DISTINCT FROM a.balance OR coalesce(l.reference, '') <> coalesce(a.reference, '')
 OR coalesce(l.transaction_type, '') <> a.transaction_type) is_changed, l.description od, a.description nd, l.balance ob,
 a.balance nb, l.reference orf, a.reference nrf, l.utr, l.processing_warning FROM ledger l LEFT JOIN latest a
 ON a.transaction_id = l.id) SELECT id, is_changed, CASE WHEN is_changed THEN nd ELSE od END AS description,
 CASE WHEN is_changed THEN nb ELSE ob END AS balance, CASE WHEN is_changed THEN nrf ELSE orf END AS reference, utr,
 processing_warning FROM j""",
)
def correction_apply(led: Ledger) -> DataFrame:
    out = A.apply_corrections(led.ledger, led.correction_requests, led.audit_records)
    return out.select("id", "is_changed", "description", "balance", "reference", "utr", "processing_warning")


@query(
    "original_vs_current",
    """SELECT id, description AS original_description, balance AS original_balance, description AS current_description,
 CASE WHEN defect = 3 THEN balance - 1 ELSE balance END AS current_balance FROM ledger WHERE defect <> 9 AND defect <> 12
 UNION ALL SELECT id, description, balance, description || ' fixed', balance FROM ledger WHERE defect = 12
 UNION ALL SELECT id, NULL, NULL, description, balance FROM ledger WHERE defect = 9""",
)
def original_vs_current(led: Ledger) -> DataFrame:
    current = A.apply_corrections(led.ledger, led.correction_requests, led.audit_records)
    was = snapshots(led).select(
        F.col("transaction_id").alias("id"),
        F.col("description").alias("original_description"),
        F.col("balance").alias("original_balance"),
    )
    return current.join(was, "id", "left").select(
        "id",
        "original_description",
        "original_balance",
        F.col("description").alias("current_description"),
        F.col("balance").alias("current_balance"),
    )


@query(
    "audit_flatten",
    """SELECT id AS transaction_id, source_file_id, n AS entry_no, CASE WHEN defect = 3 THEN 'Balance'
 WHEN n = 0 THEN 'Description' ELSE f END AS field_name FROM ledger, (VALUES (0, 'Reference'), (1, 'Reference'),
 (1, 'Balance')) t(n, f) WHERE (defect = 3 AND n = 0) OR defect = 12""",
)
def audit_flatten(led: Ledger) -> DataFrame:
    """Write the records as JSON documents of at most 100 positions, read them back, and flatten the changes."""
    part = F.floor(F.col("original_values.source_line_index") / 100)
    entry = F.struct(
        F.col("transaction_id").cast("string").alias("key"), F.struct("original_values", "history").alias("value")
    )
    docs = (
        led.audit_records.groupBy("source_file_id", part.alias("part"))
        .agg(F.map_from_entries(F.collect_list(entry)).alias("records"))
        .select(F.to_json(F.struct("source_file_id", "records")).alias("doc"))
    )
    documents, _ = A.parse_audit_documents(docs)
    _, corrections, changes = A.flatten_audit(documents)
    where = corrections.select("transaction_id", "source_file_id").distinct()
    return changes.join(where, "transaction_id").select("transaction_id", "source_file_id", "entry_no", "field_name")


@query(
    "snapshot_init",
    """SELECT id AS transaction_id, source_file_id, row_no AS position, 1 AS source_page_number,
 row_no AS source_line_index, description, balance FROM ordered_rows""",
)
def snapshot_init(led: Ledger) -> DataFrame:
    rows = with_ordered(led.ledger, ["source_file_id"], LEDGER_ORDER, {"position": rownum()}, led.hot)
    parsed = rows.select(
        "source_file_id",
        "position",
        F.lit(None).cast("int").alias("source_page_number"),
        F.lit(None).cast("int").alias("source_line_index"),
        "description",
        "balance",
    )
    return A.init_snapshots(parsed, rows.select("source_file_id", "position", "id"))


# ---------------------------------------------------------------- ledger maintenance


@query(
    "ledger_replace",
    """SELECT l.id + CASE WHEN f.processing_status = 6 AND l.clean > 0 THEN 1000000000000 ELSE 0 END AS id, l.source_file_id, l.balance
 FROM (SELECT *, count(*) FILTER (defect > 6) OVER (PARTITION BY source_file_id) clean FROM ledger) l
 JOIN file_records f ON f.id = l.source_file_id WHERE f.processing_status <> 6 OR l.defect > 6 OR l.clean = 0""",
)
def ledger_replace(led: Ledger) -> DataFrame:
    """Files waiting for review are imported again with their clean rows; all others stay."""
    waiting = led.file_records.filter("processing_status = 6").select(F.col("id").alias("source_file_id"))
    rows = led.ledger.select("id", "source_file_id", "balance", "defect")
    incoming = rows.filter("defect > 6").join(waiting, "source_file_id", "left_semi")
    incoming = incoming.withColumn("id", F.col("id") + F.lit(1000000000000)).select(rows.columns)
    return A.replace_files(rows, incoming).drop("defect")


@query(
    "import_result_upsert",
    """SELECT source_file_id, CASE WHEN processed_count > 3 THEN 'Reimported' ELSE status END AS status,
 CASE WHEN processed_count > 3 THEN processed_count + 1 ELSE processed_count END AS processed_count,
 CAST(started_at AS DATE) AS started_on FROM import_results""",
)
def import_result_upsert(led: Ledger) -> DataFrame:
    current = led.import_results
    incoming = current.filter("processed_count > 3").withColumns(
        {
            "status": F.lit("Reimported"),
            "processed_count": F.col("processed_count") + 1,
            "started_at": F.expr("started_at + interval 30 days"),
        }
    )
    out = A.upsert_import_results(current, incoming)
    return out.select("source_file_id", "status", "processed_count", F.to_date("started_at").alias("started_on"))


@query(
    "statement_cascade_delete",
    """WITH keep AS (SELECT id FROM file_records WHERE processing_status <> 4)
 SELECT 'transactions' AS table_name, count(*) AS row_count FROM ledger WHERE source_file_id IN (SELECT id FROM keep)
 UNION ALL SELECT 'import_results', count(*) FROM import_results WHERE source_file_id IN (SELECT id FROM keep)
 UNION ALL SELECT 'audit', count(*) FROM ledger WHERE defect <> 9 AND source_file_id IN (SELECT id FROM keep)
 UNION ALL SELECT 'file_records', count(*) FROM keep""",
)
def statement_cascade_delete(led: Ledger) -> DataFrame:
    gone = led.file_records.filter("processing_status = 4").select("id")
    left = A.cascade_delete(
        {
            "transactions": (led.ledger, "source_file_id"),
            "import_results": (led.import_results, "source_file_id"),
            "audit": (led.audit_records, "source_file_id"),
            "file_records": (led.file_records, "id"),
        },
        gone,
    )
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        for n, df in left.items()
    ]
    return reduce(DataFrame.unionByName, counts)
