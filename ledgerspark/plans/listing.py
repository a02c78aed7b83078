"""Queries over users, clients, files and filtered ledger rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.model import bank_name, parser_version, status_name
from ledgerspark.operators import listing as L
from ledgerspark.operators import validate as V
from ledgerspark.operators.continuity import BALANCED, MISMATCH, NOT_CHECKABLE
from ledgerspark.operators.ordered import with_group
from ledgerspark.plans.ledger import validated
from ledgerspark.plans.registry import cte, query
from ledgerspark.sources.bridge import Ledger

BANK_SQL = """CASE {c} WHEN 1 THEN 'HDFC Bank' WHEN 2 THEN 'YES BANK' WHEN 3 THEN 'Axis Bank'
 WHEN 4 THEN 'Central Bank of India' WHEN 5 THEN 'ICICI Bank' WHEN 6 THEN 'State Bank of India' WHEN 7 THEN 'Bank of India'
 WHEN 8 THEN 'Kotak Mahindra Bank' WHEN 9 THEN 'Punjab National Bank' WHEN 10 THEN 'Bank of Baroda' ELSE {e} END"""
PARSER_SQL = """CASE {c} WHEN 1 THEN 'HDFC-v1' WHEN 2 THEN 'YES-v1' WHEN 3 THEN 'AXIS-v1' WHEN 4 THEN 'CENTRAL-v1'
 WHEN 5 THEN 'ICICI-v1' WHEN 6 THEN 'SBI-v1' WHEN 7 THEN 'BOI-v1' WHEN 8 THEN 'KOTAK-v1' WHEN 9 THEN 'PNB-v1'
 WHEN 10 THEN 'BOB-v1' ELSE 'v1' END"""
STATUS_SQL = """CASE processing_status WHEN 0 THEN 'ReadyForProcessing' WHEN 1 THEN 'Processing' WHEN 2 THEN 'Completed'
 WHEN 3 THEN 'Failed' ELSE 'Unknown' END"""
SIZE_SQL = """CASE WHEN size_bytes < 1024 THEN CAST(size_bytes AS VARCHAR) || ' B'
 WHEN size_bytes < 1048576 THEN printf('%.2f KB', size_bytes / 1024.0::DOUBLE)
 WHEN size_bytes < 1073741824 THEN printf('%.2f MB', size_bytes / 1048576.0::DOUBLE)
 ELSE printf('%.2f GB', size_bytes / 1073741824.0::DOUBLE) END"""

cte(
    "listed_files",
    f"""SELECT f.*, c.name client_name, c.user_id, y.display_name financial_year_name, {STATUS_SQL} status,
 {SIZE_SQL} size_text FROM file_records f JOIN clients c ON c.id = f.client_id
 JOIN financial_years y ON y.client_id = f.client_id AND year(y.start_date) = f.fy_start_year""",
)


def listed(led: Ledger) -> DataFrame:
    return L.list_statements(led.file_records, led.clients, led.financial_years)


TABLES = ["clients", "file_records", "financial_years", "transactions", "import_results"]


@query(
    "scan_ledger",
    """SELECT 'users' AS table_name, count(*) AS row_count, CAST(sum(id) AS BIGINT) AS id_sum FROM users UNION ALL
 SELECT 'clients', count(*), CAST(sum(id) AS BIGINT) FROM clients UNION ALL
 SELECT 'financial_years', count(*), CAST(sum(id) AS BIGINT) FROM financial_years UNION ALL
 SELECT 'file_records', count(*), CAST(sum(id) AS BIGINT) FROM file_records UNION ALL
 SELECT 'transactions', count(*), CAST(sum(id) AS BIGINT) FROM ledger UNION ALL
 SELECT 'transaction_import_results', count(*), CAST(sum(source_file_id) AS BIGINT) FROM import_results UNION ALL
 SELECT 'pdf_processing_results', count(*), CAST(sum(id) AS BIGINT) FROM file_records WHERE processing_status = 2""",
)
def scan_ledger(led: Ledger) -> DataFrame:
    tables = [
        ("users", led.users, "id"),
        ("clients", led.clients, "id"),
        ("financial_years", led.financial_years, "id"),
        ("file_records", led.file_records, "id"),
        ("transactions", led.ledger, "id"),
        ("transaction_import_results", led.import_results, "source_file_id"),
        ("pdf_processing_results", led.file_records.filter("processing_status = 2"), "id"),
    ]
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(c).cast("long").alias("id_sum")).select(
            F.lit(name).alias("table_name"), "row_count", "id_sum"
        )
        for name, df, c in tables
    ]
    return reduce(DataFrame.unionByName, counts)


@query(
    "table_counts",
    """SELECT 'users' AS table_name, count(*) AS row_count FROM users UNION ALL
 SELECT 'clients', count(*) FROM clients UNION ALL SELECT 'file_records', count(*) FROM file_records UNION ALL
 SELECT 'transactions', count(*) FROM ledger UNION ALL
 SELECT 'transaction_import_results', count(*) FROM import_results""",
)
def table_counts(led: Ledger) -> DataFrame:
    tables = {
        "users": led.users,
        "clients": led.clients,
        "file_records": led.file_records,
        "transactions": led.ledger,
        "transaction_import_results": led.import_results,
    }
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        for n, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query(
    "tenant_scope",
    """SELECT 'clients' AS table_name, user_id, count(*) AS row_count FROM clients GROUP BY user_id UNION ALL
 SELECT 'file_records', c.user_id, count(*) FROM file_records f JOIN clients c ON c.id = f.client_id GROUP BY 2 UNION ALL
 SELECT 'financial_years', c.user_id, count(*) FROM financial_years f JOIN clients c ON c.id = f.client_id GROUP BY 2
 UNION ALL SELECT 'pdf_processing_results', c.user_id, count(*) FROM file_records f JOIN clients c
 ON c.id = f.client_id WHERE f.processing_status = 2 GROUP BY 2
 UNION ALL SELECT 'transactions', c.user_id, count(*) FROM ledger f JOIN clients c ON c.id = f.client_id GROUP BY 2
 UNION ALL SELECT 'import_results', c.user_id, count(*) FROM import_results i JOIN file_records f
 ON f.id = i.source_file_id JOIN clients c ON c.id = f.client_id GROUP BY 2""",
)
def tenant_scope(led: Ledger) -> DataFrame:
    """Rows visible to each user in every tenant table; facts are counted per client before the join."""
    files = led.file_records
    imports = led.import_results.select(F.col("source_file_id").alias("id")).join(files.select("id", "client_id"), "id")
    tables = {
        "clients": led.clients.select(F.col("id").alias("client_id")),
        "file_records": files,
        "financial_years": led.financial_years,
        "pdf_processing_results": files.filter("processing_status = 2"),
        "transactions": led.ledger,
        "import_results": imports,
    }
    counts = [
        df.groupBy("client_id").agg(F.count(F.lit(1)).alias("n")).withColumn("table_name", F.lit(name))
        for name, df in tables.items()
    ]
    union = reduce(DataFrame.unionByName, counts)
    return (
        union.join(L.authorized_clients(led.clients), "client_id")
        .groupBy("table_name", "user_id")
        .agg(F.sum("n").alias("row_count"))
    )


#: The user whose rows are asked for.
SCOPED_USER = 3


@query(
    "tenant_rows_all_tables",
    f"""WITH own AS (SELECT id FROM clients WHERE user_id = {SCOPED_USER}), f AS (SELECT * FROM file_records WHERE client_id IN (SELECT id FROM own))
 SELECT 'clients' AS table_name, id FROM own UNION ALL SELECT 'file_records', id FROM f
 UNION ALL SELECT 'financial_years', id FROM financial_years WHERE client_id IN (SELECT id FROM own)
 UNION ALL SELECT 'pdf_processing_results', id FROM f WHERE processing_status = 2
 UNION ALL SELECT 'transactions', id FROM ledger WHERE client_id IN (SELECT id FROM own)
 UNION ALL SELECT 'import_results', source_file_id FROM import_results WHERE source_file_id IN (SELECT id FROM f)""",
)
def tenant_rows_all_tables(led: Ledger) -> DataFrame:
    """What one user sees of each of the six tenant tables, row by row."""
    results = led.file_records.where("processing_status = 2").select("id", F.col("id").alias("source_file_id"))
    tables = {
        "clients": (led.clients, "id"),
        "file_records": (led.file_records, "client_id"),
        "financial_years": (led.financial_years, "client_id"),
        "pdf_processing_results": (results, "source_file_id"),
        "transactions": (led.ledger, "client_id"),
        "import_results": (led.import_results.select(F.col("source_file_id").alias("id"), "source_file_id"), "source_file_id"),
    }
    seen = L.scope_all(tables, led.file_records, led.clients, SCOPED_USER)
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table_name"), "id") for name, df in seen.items()])


@query("authorized_clients", "SELECT user_id, id AS client_id FROM clients")
def authorized_clients(led: Ledger) -> DataFrame:
    return L.authorized_clients(led.clients)


@query(
    "tenant_rows",
    """SELECT id, client_id FROM ledger WHERE client_id IN (SELECT id FROM clients WHERE user_id = 3)""",
)
def tenant_rows(led: Ledger) -> DataFrame:
    """Ledger rows that one user may see."""
    return L.tenant_scope(led.ledger, led.clients, 3).select("id", "client_id")


@query(
    "tenant_rows_unscoped",
    "SELECT client_id, count(*) AS row_count FROM ledger GROUP BY client_id",
)
def tenant_rows_unscoped(led: Ledger) -> DataFrame:
    """Without a user nothing is filtered."""
    return L.tenant_scope(led.ledger, led.clients, None).groupBy("client_id").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "access_answers",
    """SELECT f.id AS file_id, f.id % 25 AS user_id, f.client_id, c.id IS NOT NULL AS allowed FROM file_records f
 LEFT JOIN clients c ON c.id = f.client_id AND c.user_id = f.id % 25""",
)
def access_answers(led: Ledger) -> DataFrame:
    """Whether a user, here the file number modulo 25, may open each file."""
    asked = led.file_records.select(F.col("id").alias("file_id"), (F.col("id") % 25).alias("user_id"), "client_id")
    return L.has_access(led.clients, asked).select("file_id", "user_id", "client_id", "allowed")


@query(
    "tenant_semi",
    "SELECT id, source_file_id FROM ledger WHERE source_file_id IN (SELECT id FROM file_records WHERE processing_status = 2)",
)
def tenant_semi(led: Ledger) -> DataFrame:
    done = led.file_records.filter("processing_status = 2")
    return L.of_files(led.ledger, done).select("id", "source_file_id")


@query("txn_filter_status", "SELECT id, source_file_id, status FROM validated WHERE status = 'REVIEW'")
def txn_filter_status(led: Ledger) -> DataFrame:
    return L.filter_status(validated(led), "review").select("id", "source_file_id", "status")


@query("txn_filter_type", "SELECT id, source_file_id, debit FROM ledger WHERE debit > 0")
def txn_filter_type(led: Ledger) -> DataFrame:
    return L.filter_side(led.ledger, "debit").select("id", "source_file_id", "debit")


@query(
    "txn_search",
    """SELECT id, description FROM ledger WHERE upper(description) LIKE '%RED%' OR upper(reference) LIKE '%RED%'
 OR upper(utr) LIKE '%RED%' OR CAST(amount AS VARCHAR) LIKE '%RED%'
 OR strftime(transaction_date, '%d/%m/%Y') LIKE '%RED%'""",
)
def txn_search(led: Ledger) -> DataFrame:
    return L.search(led.ledger, "red").select("id", "description")


@query(
    "txn_sort",
    """SELECT id, source_file_id, row_number() OVER (PARTITION BY source_file_id ORDER BY coalesce(balance, 0) DESC,
 transaction_date, created_at, seq, id) AS by_balance, row_number() OVER (PARTITION BY source_file_id ORDER BY
 description DESC, transaction_date, created_at, seq, id) AS by_description FROM ledger""",
)
def txn_sort(led: Ledger) -> DataFrame:
    rows = L.with_position(led.ledger, "source_file_id", "balance", True, led.hot)
    rows = rows.withColumnRenamed("position", "by_balance")
    rows = L.with_position(rows, "source_file_id", "description", True, led.hot)
    return rows.select("id", "source_file_id", "by_balance", F.col("position").alias("by_description"))


@query(
    "ledger_sorted",
    """SELECT id, source_file_id, row_number() OVER (PARTITION BY source_file_id ORDER BY transaction_date, created_at,
 seq, id) AS position FROM ledger""",
)
def ledger_sorted(led: Ledger) -> DataFrame:
    return L.with_position(led.ledger, "source_file_id", "date", hot=led.hot).select("id", "source_file_id", "position")


@query(
    "txn_page",
    """SELECT id, source_file_id, position, total_count FROM (SELECT id, source_file_id, row_number() OVER (PARTITION BY
 source_file_id ORDER BY transaction_date, created_at, seq, id) AS position,
 count(*) OVER (PARTITION BY source_file_id) AS total_count FROM validated WHERE status = 'VALID')
 WHERE position BETWEEN 4 AND 6""",
)
def txn_page(led: Ledger) -> DataFrame:
    """Second page of three rows in every file, with the filtered total."""
    rows = L.filter_status(validated(led), "VALID")
    rows = L.with_position(rows, "source_file_id", "date", hot=led.hot)
    rows = with_group(rows, ["source_file_id"], {"total_count": F.count(F.lit(1))}, led.hot)
    return L.page_of(rows, 2, 3).select("id", "source_file_id", "position", "total_count")


@query(
    "txn_with_audit",
    """SELECT l.id, a.transaction_id IS NOT NULL AS has_audit, coalesce(a.correction_count, 0) AS correction_count,
 coalesce(a.source_page_number, 1) AS source_page_number FROM ledger l LEFT JOIN audit a ON a.transaction_id = l.id""",
)
def txn_with_audit(led: Ledger) -> DataFrame:
    audit = led.audit.withColumnRenamed("transaction_id", "id").drop("value_date", "source_file_id").withColumn("seen", F.lit(True))
    return led.ledger.select("id").join(audit, "id", "left").select(
        "id",
        F.coalesce("seen", F.lit(False)).alias("has_audit"),
        F.coalesce("correction_count", F.lit(0)).alias("correction_count"),
        F.coalesce("source_page_number", F.lit(1)).alias("source_page_number"),
    )


cte(
    "asof_groups",
    """SELECT source_file_id, transaction_date, created_at, lag(last_id) OVER w prev_id, lag(last_balance) OVER w prev_bal
 FROM (SELECT source_file_id, transaction_date, created_at, arg_max(id, seq * 100000000000 + id) last_id,
 arg_max_null(balance, seq * 100000000000 + id) last_balance FROM ledger GROUP BY ALL)
 WINDOW w AS (PARTITION BY source_file_id ORDER BY transaction_date, created_at)""",
)


@query(
    "txn_prev_asof",
    """SELECT l.id, g.prev_id, g.prev_bal AS prev_balance FROM ledger l JOIN asof_groups g
 ON g.source_file_id = l.source_file_id AND g.transaction_date = l.transaction_date AND g.created_at = l.created_at""",
)
def txn_prev_asof(led: Ledger) -> DataFrame:
    return L.previous_asof(led.ledger, "source_file_id", led.hot).select("id", "prev_id", "prev_balance")


@query(
    "txn_detail",
    f"""SELECT v.id, {BANK_SQL.format(c='v.bank_code', e="'Unknown Bank'")} AS bank_name,
 coalesce(v.transaction_type, CASE WHEN v.debit IS NOT NULL THEN 'Debit' ELSE 'Credit' END) AS transaction_type,
 v.correction_count, s.bs AS balance_status, CASE WHEN v.errors <> '' THEN 'INVALID' WHEN v.is_corrected THEN 'CORRECTED'
 WHEN s.bs = 'MISMATCH' OR replace(replace(v.warnings, 'BALANCE_MISMATCH', ''), 'DUPLICATE', '') NOT IN ('', ',')
 THEN 'REVIEW' ELSE 'VALID' END AS status FROM validated v JOIN
 (SELECT l.id, CASE WHEN g.prev_bal IS NULL OR l.balance IS NULL THEN 'NOT_CHECKABLE'
 WHEN abs(g.prev_bal - l.dpos + l.cpos - l.balance) <= 0.01 THEN 'BALANCED' ELSE 'MISMATCH' END bs
 FROM ordered_rows l JOIN asof_groups g ON g.source_file_id = l.source_file_id
 AND g.transaction_date = l.transaction_date AND g.created_at = l.created_at) s ON s.id = v.id""",
)
def txn_detail(led: Ledger) -> DataFrame:
    """Single-row view of every transaction: as-of predecessor, and no duplicate check."""
    rows = L.previous_asof(led.ledger.drop("value_date"), "source_file_id", led.hot)
    d = F.when(F.col("debit") > 0, F.col("debit")).otherwise(0)
    c = F.when(F.col("credit") > 0, F.col("credit")).otherwise(0)
    expected = F.col("prev_balance") - d + c
    known = F.col("prev_balance").isNotNull() & F.col("balance").isNotNull()
    close = F.abs(expected - F.col("balance")) <= F.lit("0.01").cast("decimal(18,2)")
    rows = rows.withColumns(
        {
            "expected_balance": expected,
            "balance_status": F.when(known, F.when(close, BALANCED).otherwise(MISMATCH)).otherwise(NOT_CHECKABLE),
            "is_duplicate": F.lit(False),
        }
    )
    rows = V.enrich(V.apply_rules(V.with_audit(rows, led.audit)))
    return rows.select("id", "bank_name", "transaction_type", "correction_count", "balance_status", "status")


@query(
    "txn_type_default",
    """SELECT id, coalesce(transaction_type, CASE WHEN debit IS NOT NULL THEN 'Debit' ELSE 'Credit' END)
 AS transaction_type FROM ledger""",
)
def txn_type_default(led: Ledger) -> DataFrame:
    kind = V.default_type(F.col("transaction_type"), F.col("debit"))
    return led.ledger.select("id", kind.alias("transaction_type"))


@query(
    "bank_dim",
    f"""SELECT id, {BANK_SQL.format(c='bank_code', e="'Unknown Bank'")} AS bank_name,
 {PARSER_SQL.format(c='bank_code')} AS parser_version FROM ledger""",
)
def bank_dim(led: Ledger) -> DataFrame:
    code = F.col("bank_code")
    return led.ledger.select("id", bank_name(code).alias("bank_name"), parser_version(code).alias("parser_version"))


@query(
    "ledger_readback",
    f"""SELECT l.source_file_id, {BANK_SQL.format(c='coalesce(max(i.detected_bank), max(l.bank_code))', e="'Unknown'")}
 AS bank_name, coalesce(max(i.total_detected), count(*)) AS total_detected,
 coalesce(max(i.processed_count), count(*)) AS processed_count, coalesce(max(i.rejected_count), 0) AS rejected_count,
 coalesce(max(i.warnings_count), count(l.processing_warning)) AS warnings_count,
 round(avg(CASE WHEN l.processing_warning IS NULL THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END), 6) AS overall_confidence
 FROM ledger l LEFT JOIN import_results i ON i.source_file_id = l.source_file_id GROUP BY l.source_file_id""",
)
def ledger_readback(led: Ledger) -> DataFrame:
    warned = F.coalesce("processing_warning", F.lit("")) != ""
    per_file = led.ledger.groupBy("source_file_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("bank_code").alias("bank_code"),
        F.count_if(warned).alias("warned"),
        F.avg(F.when(warned, 0.75).otherwise(1.0)).alias("confidence"),
    )
    out = per_file.join(led.import_results, "source_file_id", "left")
    return out.select(
        "source_file_id",
        bank_name(F.coalesce("detected_bank", "bank_code"), "Unknown").alias("bank_name"),
        F.coalesce("total_detected", "n").alias("total_detected"),
        F.coalesce("processed_count", "n").alias("processed_count"),
        F.coalesce("rejected_count", F.lit(0)).alias("rejected_count"),
        F.coalesce("warnings_count", "warned").alias("warnings_count"),
        F.round("confidence", 6).alias("overall_confidence"),
    )


@query("status_names", f"SELECT id, {STATUS_SQL} AS status FROM file_records")
def status_names(led: Ledger) -> DataFrame:
    return led.file_records.select("id", status_name(F.col("processing_status")).alias("status"))


@query("format_bytes", f"SELECT id, {SIZE_SQL} AS size_text FROM file_records")
def format_bytes(led: Ledger) -> DataFrame:
    return led.file_records.select("id", L.format_bytes(F.col("size_bytes")).alias("size_text"))


@query(
    "statement_listing",
    """SELECT id, user_id, client_name, financial_year_name, original_file_name, status, size_text,
 CAST(uploaded_at AS DATE) AS uploaded_on FROM listed_files""",
)
def statement_listing(led: Ledger) -> DataFrame:
    return (
        listed(led)
        .select(
            "id",
            "user_id",
            "client_name",
            "financial_year_name",
            "original_file_name",
            "status",
            "size_text",
            F.to_date("uploaded_at").alias("uploaded_on"),
        )
        .orderBy(F.col("uploaded_on").desc(), "id")
    )


@query(
    "files_filter",
    """SELECT id, original_file_name, financial_year_name FROM listed_files
 WHERE processing_status = 2 AND (lower(original_file_name) LIKE '%_1%' OR lower(client_name) LIKE '%_1%'
 OR lower(financial_year_name) LIKE '%_1%' OR lower(status) LIKE '%_1%' OR CAST(id AS VARCHAR) LIKE '%_1%')""".replace(
        "'%_1%'", "'%\\_1%' ESCAPE '\\'"
    ),
)
def files_filter(led: Ledger) -> DataFrame:
    out = L.filter_files(listed(led), text=" _1 ", status="COMPLETED")
    return out.select("id", "original_file_name", "financial_year_name")


@query(
    "files_sort",
    """SELECT id, original_file_name, size_bytes FROM file_records ORDER BY size_bytes DESC, id""",
)
def files_sort(led: Ledger) -> DataFrame:
    return led.file_records.orderBy(*L.file_order("size")).select("id", "original_file_name", "size_bytes")


@query(
    "files_facets",
    """SELECT DISTINCT 'client' AS facet, client_name AS value FROM listed_files UNION ALL
 SELECT DISTINCT 'financial_year', financial_year_name FROM listed_files""",
)
def files_facets(led: Ledger) -> DataFrame:
    names = F.array(
        F.struct(F.lit("client").alias("facet"), L.client_label(F.col("client_name")).alias("value")),
        F.struct(F.lit("financial_year").alias("facet"), F.col("financial_year_name").alias("value")),
    )
    rows = listed(led).select(F.inline(names)).filter("value is not null")
    return rows.distinct()


COUNTS_SQL = """count(*) AS total, count(*) FILTER (processing_status = 2) AS completed,
 count(*) FILTER (processing_status IN (0, 1)) AS processing,
 count(*) FILTER (processing_status = 3 OR processing_status < 0) AS failed"""


@query("files_kpi", f"SELECT {COUNTS_SQL} FROM file_records")
def files_kpi(led: Ledger) -> DataFrame:
    return led.file_records.agg(*L.status_counts())


@query(
    "dashboard_summary",
    f"""SELECT u.id AS user_id, greatest(coalesce(c.n, 0), 1) AS clients, coalesce(f.total, 0) AS total,
 coalesce(f.completed, 0) AS completed, coalesce(f.processing, 0) AS processing, coalesce(f.failed, 0) AS failed,
 coalesce(t.n, 0) AS transactions FROM users u
 LEFT JOIN (SELECT user_id, count(*) n FROM clients GROUP BY 1) c ON c.user_id = u.id
 LEFT JOIN (SELECT c.user_id, {COUNTS_SQL} FROM file_records f JOIN clients c ON c.id = f.client_id GROUP BY 1) f
  ON f.user_id = u.id
 LEFT JOIN (SELECT c.user_id, count(*) n FROM ledger l JOIN clients c ON c.id = l.client_id GROUP BY 1) t
  ON t.user_id = u.id""",
)
def dashboard_summary(led: Ledger) -> DataFrame:
    return L.dashboard(led.users, led.clients, led.file_records, led.ledger)


RECENT = """SELECT f.*, c.user_id, row_number() OVER (PARTITION BY c.user_id ORDER BY f.uploaded_at DESC, f.id DESC) recency
 FROM file_records f JOIN clients c ON c.id = f.client_id QUALIFY recency <= 10"""


@query("recent_top10", f"SELECT user_id, id, recency FROM ({RECENT})")
def recent_top10(led: Ledger) -> DataFrame:
    return L.recent_files(led.file_records, led.clients).select("user_id", "id", "recency")


@query(
    "recent_statements",
    f"""SELECT r.user_id, r.recency, r.id, r.original_file_name,
 {BANK_SQL.format(c='i.detected_bank', e="CASE WHEN r.processing_status = 2 THEN 'Detected' ELSE 'Pending' END")}
 AS bank_name, {STATUS_SQL} AS status, coalesce(i.processed_count, n.n, 0) AS transaction_count,
 {SIZE_SQL} AS size_text FROM ({RECENT}) r LEFT JOIN import_results i ON i.source_file_id = r.id
 LEFT JOIN (SELECT source_file_id, count(*) n FROM ledger GROUP BY 1) n ON n.source_file_id = r.id""",
)
def recent_statements(led: Ledger) -> DataFrame:
    return L.recent_statements(led.file_records, led.clients, led.import_results, led.ledger)


@query(
    "files_without_transactions",
    "SELECT id, client_id FROM file_records WHERE id NOT IN (SELECT source_file_id FROM ledger)",
)
def files_without_transactions(led: Ledger) -> DataFrame:
    ids = led.ledger.select(F.col("source_file_id").alias("id"))
    return led.file_records.join(ids, "id", "left_anti").select("id", "client_id")


@query(
    "upload_duplicates",
    """WITH f AS (SELECT id, client_id, original_file_name, CAST(round(size_bytes / 100000000.0) AS BIGINT) size_bytes,
 uploaded_at FROM file_records)
 SELECT id, first_id, CAST(first_at AS DATE) AS first_uploaded_on FROM (SELECT id,
 first_value(id) OVER w AS first_id, first_value(uploaded_at) OVER w AS first_at FROM f
 WINDOW w AS (PARTITION BY client_id, original_file_name, size_bytes ORDER BY uploaded_at, id)) WHERE id <> first_id""",
)
def upload_duplicates(led: Ledger) -> DataFrame:
    """Sizes are compared in units of 100 MB here, because no two generated files share an exact size."""
    files = led.file_records.withColumn("size_bytes", F.round(F.col("size_bytes") / 100000000.0).cast("long"))
    out = L.upload_repeats(files)
    return out.select("id", "first_id", F.to_date("first_uploaded_at").alias("first_uploaded_on"))


@query(
    "tenant_layout",
    """SELECT f.id, 'tenants/' || c.user_id || '/clients/' || f.client_id || '/statements/' ||
 coalesce(year(y.start_date), year(f.uploaded_at)) AS path FROM file_records f JOIN clients c ON c.id = f.client_id
 LEFT JOIN financial_years y ON y.client_id = f.client_id AND year(y.start_date) = f.fy_start_year""",
)
def tenant_layout(led: Ledger) -> DataFrame:
    years = led.financial_years.select("client_id", F.year("start_date").alias("fy_start_year"))
    years = years.withColumn("start_year", F.col("fy_start_year"))
    files = led.file_records.join(L.authorized_clients(led.clients), "client_id")
    out = files.join(years, ["client_id", "fy_start_year"], "left")
    year = F.coalesce("start_year", F.year("uploaded_at")).cast("string")
    parts = ["tenants", F.col("user_id"), "clients", F.col("client_id"), "statements", year]
    path = F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return out.select("id", path.alias("path"))


@query(
    "content_hash",
    "SELECT doc_id, sha256(text) AS content_hash FROM documents",
)
def content_hash(led: Ledger) -> DataFrame:
    return led.table("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
