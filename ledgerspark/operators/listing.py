"""Tenant scope, filters, search, sorting, paging and file lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.text import contains_ci, strip
from ledgerspark.model import BANKS, MONEY, code_case, status_name
from ledgerspark.operators.ordered import Hot, Spec, last_upto, lag, rownum, with_ordered

DEFAULT_CLIENT = "Default Workspace"


def authorized_clients(clients: DataFrame, user_id: int | None = None) -> DataFrame:
    """(user, client) pairs; one user's pairs when ``user_id`` is given."""
    pairs = clients.select("user_id", F.col("id").alias("client_id"))
    return pairs if user_id is None else pairs.filter(F.col("user_id") == user_id)


def has_access(clients: DataFrame, requests: DataFrame) -> DataFrame:
    """Answer (user_id, client_id) requests with a flag."""
    allowed = authorized_clients(clients).withColumn("allowed", F.lit(True))
    out = requests.join(allowed, ["user_id", "client_id"], "left")
    return out.withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def tenant_scope(df: DataFrame, clients: DataFrame, user_id: int | None, client_col: str = "client_id") -> DataFrame:
    """Rows of one user; no user means no filter."""
    if user_id is None:
        return df
    return df.join(authorized_clients(clients, user_id).select(F.col("client_id").alias(client_col)), client_col, "left_semi")


def scope_all(tables: dict[str, tuple[DataFrame, str]], files: DataFrame, clients: DataFrame, user_id: int | None) -> dict[str, DataFrame]:
    """Every tenant table with the rows of one user; no user means no filter.

    ``tables`` maps a name to its rows and the column that ties them: ``id`` for the clients themselves, ``client_id``, or ``source_file_id``, whose
    rows are those of the user's files.
    """
    own = tenant_scope(files, clients, user_id)
    out = {}
    for name, (df, column) in tables.items():
        by_file = column == "source_file_id"
        out[name] = df if user_id is None else of_files(df, own, column) if by_file else tenant_scope(df, clients, user_id, column)
    return out


def of_files(df: DataFrame, files: DataFrame, file_col: str = "source_file_id") -> DataFrame:
    """Rows whose file exists in ``files``."""
    return df.join(files.select(F.col("id").alias(file_col)), file_col, "left_semi")


def filter_status(df: DataFrame, status: str | None, column: str = "status") -> DataFrame:
    wanted = (status or "").strip().upper()
    return df if wanted in ("", "ALL") else df.filter(F.upper(column) == wanted)


def filter_side(df: DataFrame, side: str | None) -> DataFrame:
    wanted = (side or "").strip().lower()
    return df.filter(F.col(wanted) > 0) if wanted in ("debit", "credit") else df


def search(df: DataFrame, text: str | None) -> DataFrame:
    """Substring match, ignoring case, over text fields, amount with two places and dd/MM/yyyy date."""
    q = (text or "").strip()
    if not q:
        return df
    return df.filter(
        contains_ci("description", q)
        | contains_ci("reference", q)
        | contains_ci("utr", q)
        | contains_ci(F.col("amount").cast(MONEY).cast("string"), q)
        | contains_ci(F.date_format("transaction_date", "dd/MM/yyyy"), q)
    )


def with_position(
    df: DataFrame, key: str, sort_by: str = "date", descending: bool = False, hot: Hot | None = None
) -> DataFrame:
    """Number rows of each file in the asked order; equal values keep ledger order."""
    value = {
        "description": F.col("description"),
        "amount": F.col("amount"),
        "balance": F.coalesce("balance", F.lit(0).cast(MONEY)),
        "status": F.col("status") if "status" in df.columns else F.lit(None).cast("string"),
    }.get(sort_by.lower(), F.col("transaction_date"))
    ties = ["transaction_date", "created_at", "seq", "id"]
    if not descending:
        out = df.withColumn("_v", value)
        return with_ordered(out, [key], ["_v", *ties], {"position": rownum()}, hot).drop("_v")
    if sort_by.lower() in ("amount", "balance"):
        out = df.withColumn("_v", -value)
        return with_ordered(out, [key], ["_v", *ties], {"position": rownum()}, hot).drop("_v")
    if sort_by.lower() not in ("description", "status"):
        out = df.withColumn("_v", F.coalesce(-F.unix_micros(value.cast("timestamp")), F.lit((1 << 63) - 1)))
        return with_ordered(out, [key], ["_v", *ties], {"position": rownum()}, hot).drop("_v")
    # Text have no negation: rank the values downwards, then number inside equal values.
    ranks = df.groupBy(key, value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy(key).orderBy(F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranks.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0))).drop("_n")
    out = df.withColumn("_v", value)
    out = with_ordered(out, [key, "_v"], ties, {"_in": rownum()}, hot)
    same = (F.col(f"r.{key}") == F.col(f"l.{key}")) & F.col("r._v").eqNullSafe(F.col("l._v"))
    out = out.alias("l").join(ranks.alias("r"), same).select("l.*", "r._above")
    return out.withColumn("position", F.col("_above") + F.col("_in")).drop("_above", "_in", "_v")


def page_bounds(page: int, size: int) -> tuple[int, int]:
    page = max(page, 1)
    size = 50 if size < 1 else min(size, 500)
    return (page - 1) * size + 1, page * size


def page_of(positioned: DataFrame, page: int, size: int) -> DataFrame:
    low, high = page_bounds(page, size)
    return positioned.filter(F.col("position").between(low, high))


def previous_asof(df: DataFrame, key: str, hot: Hot | None = None) -> DataFrame:
    """Attach the latest row strictly earlier in (transaction_date, created_at), as ``prev_id``/``prev_balance``."""
    order = ["transaction_date", "created_at", "seq", "id"]
    moment = F.struct("transaction_date", "created_at")
    seen = F.struct(moment.alias("moment"), F.col("id").alias("id"), F.col("balance").alias("balance"))
    out = with_ordered(df, [key], order, {"_prev": lag(seen)}, hot)
    opens = F.col("_prev").isNull() | (F.col("_prev")["moment"] != moment)
    out = out.withColumn("_open", F.when(opens, F.struct(F.col("_prev").alias("row"))))
    out = with_ordered(out, [key], order, {"_asof": last_upto(F.col("_open"))}, hot)
    found = F.col("_asof")["row"]
    return out.withColumns({"prev_id": found["id"], "prev_balance": found["balance"]}).drop("_prev", "_open", "_asof")


def format_bytes(size: Column) -> Column:
    """Byte count as text with a 1024 base; what lies just between two hundredths goes to the even one."""
    def in_units(power: int, unit: str) -> Column:
        # A quotient by a power of two is exact, so its ties are true ones.
        return F.format_string(f"%.2f {unit}", F.bround(size / F.lit(float(1024**power)), 2))

    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, in_units(1, "KB"))
        .when(size < 1024**3, in_units(2, "MB"))
        .otherwise(in_units(3, "GB"))
    )


def list_statements(files: DataFrame, clients: DataFrame, years: DataFrame) -> DataFrame:
    """Files with client and financial year, ready for display."""
    who = clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"), "user_id")
    when = years.select(
        "client_id", F.year("start_date").alias("fy_start_year"), F.col("display_name").alias("financial_year_name")
    )
    out = files.join(who, "client_id").join(when, ["client_id", "fy_start_year"])
    return out.withColumns(
        {"status": status_name(F.col("processing_status")), "size_text": format_bytes(F.col("size_bytes"))}
    )


def status_group(code: Column) -> Column:
    """Completed, processing or failed; other codes belong to no group."""
    return F.when(code == 2, "COMPLETED").when(code.isin(0, 1), "PROCESSING").when((code == 3) | (code < 0), "FAILED")


def filter_files(
    listed: DataFrame,
    text: str = "",
    client: str = "ALL",
    year: str = "ALL",
    status: str = "ALL",
) -> DataFrame:
    out = listed
    if text.strip():
        q = text.strip()
        fields = ["original_file_name", "client_name", "financial_year_name", "status", F.col("id").cast("string")]
        hit = contains_ci(fields[0], q)
        for field in fields[1:]:
            hit = hit | contains_ci(field, q)
        out = out.filter(hit)
    if client != "ALL":
        out = out.filter(client_label(F.col("client_name")) == client)
    if year != "ALL":
        out = out.filter(F.col("financial_year_name") == year)
    if status != "ALL":
        out = out.filter(status_group(F.col("processing_status")) == status)
    return out


def client_label(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", DEFAULT_CLIENT).otherwise(name)


def file_order(sort_by: str) -> list[Column]:
    return {
        "oldest": [F.col("uploaded_at").asc(), F.col("id").asc()],
        "name": [F.col("original_file_name").asc(), F.col("id").asc()],
        "size": [F.col("size_bytes").desc(), F.col("id").asc()],
    }.get(sort_by, [F.col("uploaded_at").desc(), F.col("id").asc()])


def status_counts() -> list[Column]:
    group = status_group(F.col("processing_status"))
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(group == "COMPLETED").alias("completed"),
        F.count_if(group == "PROCESSING").alias("processing"),
        F.count_if(group == "FAILED").alias("failed"),
    ]


def dashboard(users: DataFrame, clients: DataFrame, files: DataFrame, transactions: DataFrame) -> DataFrame:
    """Counters per user. Facts shrink to one row per client before they meet the client table."""
    per_client = files.groupBy("client_id").agg(*status_counts())
    rows = transactions.groupBy("client_id").agg(F.count(F.lit(1)).alias("transactions"))
    who = clients.select(F.col("id").alias("client_id"), "user_id")
    both = who.join(per_client, "client_id", "left").join(rows, "client_id", "left")
    measures = ["total", "completed", "processing", "failed", "transactions"]
    sums = [F.sum(m).alias(m) for m in measures]
    by_user = both.groupBy("user_id").agg(F.count(F.lit(1)).alias("clients"), *sums)
    out = users.select(F.col("id").alias("user_id")).join(by_user, "user_id", "left")
    zeroed = {m: F.coalesce(m, F.lit(0)).cast("long") for m in measures}
    return out.withColumns(zeroed | {"clients": F.greatest(F.coalesce("clients", F.lit(0)), F.lit(1)).cast("long")})


def recent_files(files: DataFrame, clients: DataFrame, limit: int = 10) -> DataFrame:
    """Newest files per user. Each task keeps at most ``limit`` rows per user before the exchange."""
    who = clients.select(F.col("id").alias("client_id"), "user_id")
    newest = Window.partitionBy("user_id").orderBy(F.col("uploaded_at").desc(), F.col("id").desc())
    out = files.join(who, "client_id").withColumn("recency", F.row_number().over(newest))
    return out.filter(F.col("recency") <= limit)


def recent_statements(
    files: DataFrame, clients: DataFrame, imports: DataFrame, transactions: DataFrame, limit: int = 10
) -> DataFrame:
    """Recent files with bank and row count. Rows are counted only for files that made the list."""
    top = recent_files(files, clients, limit)
    ids = top.select(F.col("id").alias("source_file_id"))
    counts = (
        transactions.select("source_file_id")
        .join(ids, "source_file_id", "left_semi")
        .groupBy("source_file_id")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    imports = imports.select("source_file_id", "detected_bank", "processed_count")
    out = top.withColumn("source_file_id", F.col("id")).join(imports, "source_file_id", "left")
    out = out.join(counts, "source_file_id", "left")
    bank = F.col("detected_bank")
    known = code_case(bank, {c: n for c, n, _ in BANKS}, None)
    fallback = F.when(F.col("processing_status") == 2, "Detected").otherwise("Pending")
    return out.select(
        "user_id",
        "recency",
        "id",
        "original_file_name",
        F.coalesce(known, fallback).alias("bank_name"),
        status_name(F.col("processing_status")).alias("status"),
        F.coalesce("processed_count", "rows", F.lit(0)).cast("long").alias("transaction_count"),
        format_bytes(F.col("size_bytes")).alias("size_text"),
    )


def upload_repeats(files: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Files whose (client, name, size) was uploaded before, with the first upload.

    The first upload is a map-side ``min_by`` per key, so repeated uploads of one file never gather in one task.
    """
    at = F.struct("uploaded_at", "id")
    keys = ["client_id", "original_file_name", "size_bytes"]
    first = files.groupBy(*keys).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = files.join(first, keys)
    return out.filter(F.col("first")["id"] != F.col("id")).select(
        "id", F.col("first")["id"].alias("first_id"), F.col("first")["uploaded_at"].alias("first_uploaded_at")
    )


# Job status names, stages and default progress by code.
JOB_STATES = [
    (0, "Queued", "Queued", 10),
    (1, "Processing", "Processing", 50),
    (2, "Completed", "Completed", 100),
    (3, "Failed", "Failed", 0),
    (4, "Cancelled", "Cancelled", 0),
    (5, "RequiresPassword", "RequiresPassword", 25),
    (6, "ReviewRequired", "ReviewRequired", 90),
]
# Codes whose live stage replaces the default one.
LIVE_STATES = (0, 1, 6)


def job_state(code: Column, live_stage: Column | None = None, live_progress: Column | None = None) -> dict[str, Column]:
    """Display name, stage, progress and password flag for a status code."""
    stage = code_case(code, {c: s for c, _, s, _ in JOB_STATES}, "Unknown")
    progress = F.coalesce(
        code_case(code, {c: str(p) for c, _, _, p in JOB_STATES}, None).cast("int"), F.lit(0)
    )
    if live_stage is not None:
        stage = F.when(code.isin(*LIVE_STATES), F.coalesce(live_stage, stage)).otherwise(stage)
    if live_progress is not None:
        progress = F.when(code.isin(*LIVE_STATES), F.coalesce(live_progress, progress)).otherwise(progress)
    return {
        "status_name": code_case(code, {c: n for c, n, _, _ in JOB_STATES}, "Unknown"),
        "stage": stage,
        "progress": progress,
        "requires_password": code == 5,
    }


def tenant_folders(files: DataFrame, clients: DataFrame, years: DataFrame) -> DataFrame:
    """``files`` with ``user_id``, ``client_id`` and ``year`` of their folder: the start of the financial year, else the upload year."""
    starts = years.select("client_id", F.year("start_date").alias("fy_start_year"), F.year("start_date").alias("_start"))
    out = files.join(clients.select(F.col("id").alias("client_id"), "user_id"), "client_id")
    out = out.join(starts, ["client_id", "fy_start_year"], "left")
    return out.withColumn("year", F.coalesce("_start", F.year("uploaded_at"))).drop("_start")


TENANT = ["user_id", "client_id", "year"]


def write_tenants(rows: DataFrame, path: str, order: list[str]) -> None:
    """Write ``rows`` below ``user_id=/client_id=/year=``; folders that get rows are replaced, all others stay as they are.

    Rows are dealt out in ranges of folder and ``order``: a tenant with very many rows is spread over several tasks and numbered files, and
    a small one is a single file, so the number of files follows the rows and not tasks times folders.
    """
    # A number of its own, as tasks that are merged for their few bytes would write many folders one after the other.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, *TENANT, *order).sortWithinPartitions(*TENANT, *order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*TENANT).parquet(path)


def read_tenant(spark: SparkSession, path: str, user_id: int | None = None) -> DataFrame:
    """Rows of one user, read from that user's folders only; of all users without one."""
    rows = spark.read.parquet(path)
    return rows if user_id is None else rows.where(F.col("user_id") == user_id)
