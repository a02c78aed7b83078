"""Registry of named queries and the SQL text each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.sources.bridge import Ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with the shared CTEs it mentions, dependencies first."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in wanted and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in wanted:
                    wanted.append(name)

    visit(sql)
    if not wanted:
        return sql
    head = "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in wanted)
    body = sql.strip()
    return head + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)


def query(key: str, sql: str | None = None):
    """Register ``fn(ledger) -> DataFrame`` under ``key``."""

    def add(fn: Callable[[Ledger], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: fn(Ledger(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = with_ctes(sql)
        return fn

    return add


cte("users", "SELECT CAST(n_nationkey AS BIGINT) id, lower(n_name) || '@example.test' email FROM nation")
cte(
    "clients",
    "SELECT c_custkey id, CAST(c_nationkey AS BIGINT) user_id, c_name AS name, c_mktsegment business_type FROM customer",
)
cte(
    "file_records",
    """SELECT o_orderkey id, o_custkey client_id,
 CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END AS INT) fy_start_year,
 'stmt_' || CAST(o_orderkey % 97 AS VARCHAR) || '.pdf' original_file_name,
 CAST(ROUND(o_totalprice * 1000) AS BIGINT) size_bytes, o_orderdate uploaded_at,
 CAST(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN o_orderkey % 2 ELSE 3 + o_orderkey % 4 END AS INT)
   processing_status
 FROM orders""",
)
cte(
    "financial_years",
    """SELECT DISTINCT client_id * 10000 + fy_start_year id, client_id,
 CAST(fy_start_year AS VARCHAR) || '-' || lpad(CAST((fy_start_year + 1) % 100 AS VARCHAR), 2, '0') display_name,
 make_date(fy_start_year, 4, 1) start_date, make_date(fy_start_year + 1, 3, 31) end_date FROM file_records""",
)
cte(
    "bridge_base",
    """SELECT l.*, o.o_custkey, o.o_orderdate, p.p_name,
   CAST(ROUND(l.l_extendedprice,2) AS DECIMAL(18,2)) amt, (l.l_returnflag='R') is_cr,
   (l.l_partkey*7 + l.l_suppkey*3 + l.l_linenumber) % 50 AS m,
   ROW_NUMBER() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_shipdate, l.l_linenumber, l.l_partkey, l.l_suppkey,
                      l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax) AS seq
 FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN part p ON l.l_partkey=p.p_partkey""",
)
cte(
    "bridge_run",
    """SELECT *, CAST(CAST(10000 AS DECIMAL(18,2)) + SUM(CASE WHEN is_cr THEN amt ELSE -amt END)
   OVER (PARTITION BY l_orderkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) bal
 FROM bridge_base""",
)
cte(
    "transactions",
    """SELECT CAST(l_orderkey*100+seq AS BIGINT) id, CAST(l_shipdate AS TIMESTAMP) transaction_date,
 CASE WHEN m=2 THEN '  ' ELSE CONCAT(p_name,' ',l_returnflag,CAST(l_linenumber AS VARCHAR(10))) END description,
 CASE WHEN m=4 OR m=6 THEN NULL WHEN is_cr AND m<>1 THEN NULL ELSE amt END debit,
 CASE WHEN m=4 OR m=6 THEN NULL WHEN NOT is_cr AND m<>1 THEN NULL ELSE amt END credit,
 CASE WHEN m=4 THEN CAST(-amt AS DECIMAL(18,2)) WHEN m=6 THEN CAST(0 AS DECIMAL(18,2)) ELSE amt END amount,
 CASE WHEN m=0 THEN NULL WHEN m=3 THEN CAST(bal+1 AS DECIMAL(18,2)) ELSE bal END balance,
 CASE WHEN seq % 4 <> 0 THEN 'REF' || CAST(l_suppkey * 1000 + seq AS VARCHAR) END reference,
 CASE WHEN seq % 5 = 0 THEN 'UTRN0' || CAST(l_partkey AS VARCHAR) END utr,
 CASE WHEN m=5 THEN NULL WHEN is_cr THEN 'Credit' ELSE 'Debit' END transaction_type,
 CAST(CASE WHEN o_custkey%11=0 THEN 99 ELSE o_custkey%11 END AS INT) bank_code,
 CASE WHEN o_custkey % 7 <> 0 THEN 'AC' || CAST(o_custkey AS VARCHAR) END account,
 l_orderkey source_file_id, o_custkey client_id, o_orderdate created_at, CAST(seq AS INT) seq,
 l_shipdate + to_days(CAST(l_suppkey % 71 - 35 AS INT)) value_date,
 CASE WHEN m IN (3, 9) THEN 'Balance check needed' END processing_warning, CAST(m AS INT) defect
FROM bridge_run""",
)
cte(
    "ledger",
    """SELECT * FROM transactions UNION ALL
 SELECT * REPLACE (id + 50 AS id, CAST(seq + 50 AS INT) AS seq) FROM transactions WHERE defect = 8""",
)
cte(
    "import_results",
    """SELECT t.source_file_id, max(t.bank_code) detected_bank, count(*) total_detected, count(*) processed_count,
 CAST(0 AS BIGINT) rejected_count, count(t.processing_warning) warnings_count, 'Completed' status,
 f.uploaded_at started_at, f.uploaded_at + INTERVAL 5 MINUTE completed_at
 FROM ledger t JOIN file_records f ON f.id = t.source_file_id WHERE f.processing_status = 2
 GROUP BY t.source_file_id, f.uploaded_at""",
)
cte(
    "snapshots",
    """SELECT id transaction_id, source_file_id, transaction_date, value_date, description, debit, credit, amount,
 balance, reference, utr, transaction_type, bank_code, account, CAST(floor(seq / 10) + 1 AS INT) source_page_number,
 seq source_line_index, processing_warning FROM ledger WHERE defect <> 9""",
)
cte(
    "audit",
    """SELECT id transaction_id, value_date, CAST(floor(seq / 10) + 1 AS INT) source_page_number,
 seq source_line_index, CAST(CASE defect WHEN 3 THEN 1 WHEN 12 THEN 2 ELSE 0 END AS BIGINT) correction_count
 FROM ledger WHERE defect <> 9""",
)
cte(
    "job_events",
    """SELECT event_id, user_id job_id, ts, CASE event_type WHEN 'signup' THEN 'Queued' WHEN 'view' THEN 'Extracting'
 WHEN 'click' THEN 'DetectingBank' WHEN 'purchase' THEN 'Completed' ELSE 'Failed' END stage FROM events""",
)
