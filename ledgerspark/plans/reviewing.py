"""Queries over review candidates built from parsed statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.model import MONEY
from ledgerspark.operators import review as R
from ledgerspark.plans.parsing import parse
from ledgerspark.plans.registry import cte, query
from ledgerspark.sources.bridge import Ledger

cte(
    "review_rows",
    """SELECT source_file_id file_id, row_number() OVER (PARTITION BY source_file_id ORDER BY transaction_date, created_at,
 seq, id) row_number, CASE WHEN defect = 12 THEN NULL ELSE CAST(transaction_date AS DATE) END date, description, debit, credit,
 amount, balance, reference, defect, CASE WHEN debit > 0 THEN 'Debit' WHEN credit > 0 THEN 'Credit' ELSE 'Unknown' END direction,
 (debit IS NULL AND credit IS NULL) OR coalesce(debit > 0 AND credit > 0, false) has_error FROM ledger""",
)


def ledger_candidates(led: Ledger) -> DataFrame:
    """Every ledger row as a review row, faults included; rows with defect 12 have lost their date."""
    from ledgerspark.model import LEDGER_ORDER
    from ledgerspark.operators.ordered import rownum, with_ordered

    rows = with_ordered(led.ledger, ["source_file_id"], LEDGER_ORDER, {"row_index": rownum()}, led.hot)
    day = F.when(F.col("defect") != 12, F.to_date("transaction_date"))
    rows = rows.withColumns({"transaction_date": day, "value_date": F.to_date("value_date"), "page": F.lit(1)})
    return R.candidates(rows.withColumnRenamed("source_file_id", "file_id"))


@query(
    "review_candidates",
    """SELECT file_id, row_number, direction, date IS NULL AS is_date_ambiguous, debit IS NULL AND credit IS NULL
 AS is_direction_ambiguous, CAST(has_error AS INT) AS error_count, CAST(date IS NULL AS INT) AS warning_count,
 CAST(balance AS VARCHAR) AS original_balance FROM review_rows""",
)
def review_candidates(led: Ledger) -> DataFrame:
    return ledger_candidates(led).select(
        "file_id",
        "row_number",
        "direction",
        "is_date_ambiguous",
        "is_direction_ambiguous",
        F.size("errors").alias("error_count"),
        F.size("warnings").alias("warning_count"),
        F.col("original_values")["balance"].alias("original_balance"),
    )


@query("review_attention", "SELECT file_id, row_number FROM review_rows WHERE has_error OR date IS NULL")
def review_attention(led: Ledger) -> DataFrame:
    return R.attention_rows(ledger_candidates(led))


@query(
    "review_conversion_gate",
    """SELECT file_id, bool_and(NOT has_error AND date IS NOT NULL AND amount > 0) AS is_conversion_allowed FROM review_rows
 GROUP BY file_id""",
)
def review_conversion_gate(led: Ledger) -> DataFrame:
    return R.conversion_gate(ledger_candidates(led))


@query(
    "review_blockers",
    """SELECT file_id, count(*) AS blocked_rows, string_agg(CASE WHEN n <= 5 THEN CAST(row_number AS VARCHAR) END, ','
 ORDER BY row_number) AS first_rows FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_number) n
 FROM review_rows WHERE has_error OR date IS NULL OR amount <= 0) GROUP BY file_id""",
)
def review_blockers(led: Ledger) -> DataFrame:
    out = R.blockers(ledger_candidates(led), led.hot)
    return out.select("file_id", "blocked_rows", F.array_join("first_rows", ",").alias("first_rows"))


def edits(led: Ledger) -> DataFrame:
    """Users fix blank narrations and lost dates, and send some edits that must be refused."""
    rows = led.ledger.select("source_file_id", "id", "defect", "transaction_date")
    keyed = ledger_candidates(led)
    no_side = F.col("is_direction_ambiguous")
    blank = F.trim("description") == ""
    lost = F.col("is_date_ambiguous")
    del rows
    return keyed.filter(no_side | blank | lost).select(
        "file_id",
        "row_number",
        F.coalesce("date", F.make_date(F.lit(1999), F.lit(1), F.lit(1))).alias("date"),
        F.lit(None).cast("date").alias("value_date"),
        F.when(blank, "Fixed by user").otherwise(F.col("description")).alias("description"),
        "reference",
        "debit",
        "credit",
        "balance",
    )


@query(
    "review_edit",
    """WITH e AS (SELECT *, date IS NULL OR trim(description) = '' asked FROM review_rows), f AS (SELECT *,
 asked AND NOT (debit IS NULL AND credit IS NULL) AND NOT coalesce(debit > 0 AND credit > 0, false) fixed FROM e)
 SELECT file_id, row_number, fixed AS is_user_edited, CASE WHEN fixed AND date IS NULL THEN DATE '1999-01-01' ELSE date END AS date,
 CASE WHEN fixed AND trim(description) = '' THEN 'Fixed by user' WHEN fixed THEN trim(description) ELSE description END
 AS description, CAST(has_error AND NOT fixed AS INT) + CAST(date IS NULL AND NOT fixed AS INT) AS open_points FROM f""",
)
def review_edit(led: Ledger) -> DataFrame:
    out = R.apply_edits(ledger_candidates(led), edits(led))
    return out.select(
        "file_id",
        "row_number",
        "is_user_edited",
        "date",
        "description",
        (F.size("errors") + F.size("warnings")).alias("open_points"),
    )


@query(
    "review_revalidate",
    """SELECT file_id, count(*) AS total_rows, count(*) FILTER (ok) AS reconciled_rows, count(*) FILTER (NOT ok) AS failed_rows,
 count(*) FILTER (missing) AS missing_amount, count(*) > 1 AND count(*) FILTER (ok) = count(*) - 1
 AND count(*) FILTER (missing) = 0 AS fully_reconciled FROM (SELECT file_id, NOT coalesce(debit > 0, false)
 AND NOT coalesce(credit > 0, false) missing, abs(lag(balance) OVER (PARTITION BY file_id ORDER BY row_number)
 + coalesce(credit, 0) - coalesce(debit, 0) - balance) <= 0.05 ok FROM review_rows) GROUP BY file_id""",
)
def review_revalidate(led: Ledger) -> DataFrame:
    return R.revalidate(ledger_candidates(led), led.hot).select(
        "file_id", "total_rows", "reconciled_rows", "failed_rows", "missing_amount", "fully_reconciled"
    )


@query(
    "review_reprocess",
    """SELECT source_file_id AS file_id, row_no AS row_number, CAST(transaction_date AS DATE) AS date, description, debit, credit,
 balance FROM clean_rows""",
)
def review_reprocess(led: Ledger) -> DataFrame:
    """The narration column is widened by hand and every statement read again."""
    run = parse(led)
    wider = F.transform(
        "columns",
        lambda c: c.withField(
            "left_x", F.when(c["column_type"] == "Description", c["left_x"] - 5.0).otherwise(c["left_x"])
        ),
    )
    out = R.reprocess(run.segmented.withColumn("columns", wider))
    return out.select("file_id", "row_number", "date", "description", "debit", "credit", "balance")


@query(
    "review_approve",
    """SELECT file_id AS source_file_id, row_number AS seq, direction AS transaction_type, amount FROM review_rows
 WHERE file_id NOT IN (SELECT file_id FROM review_rows WHERE has_error OR date IS NULL OR amount <= 0)
 AND file_id NOT IN (SELECT id FROM file_records WHERE processing_status = 2)""",
)
def review_approve(led: Ledger) -> DataFrame:
    done = led.file_records.filter("processing_status = 2").select(F.col("id").alias("source_file_id"))
    added, _ = R.approve(ledger_candidates(led), done, led.hot)
    return added.select("source_file_id", "seq", "transaction_type", "amount")


@query(
    "review_flatten",
    "SELECT file_id, row_number, description, balance, CAST(has_error AS INT) AS error_count FROM review_rows",
)
def review_flatten(led: Ledger) -> DataFrame:
    """Sessions as JSON documents of at most 100 rows, read back and flattened."""
    names = [f.name for f in R.CANDIDATE.fields]
    rows = ledger_candidates(led).withColumn("_part", F.floor(F.col("row_number") / 100))
    docs = rows.groupBy("file_id", "_part").agg(F.collect_list(F.struct(*names)).alias("candidates"))
    text = docs.select(F.to_json(F.struct("file_id", "candidates")).alias("doc"))
    back = R.flatten_sessions(text.select(F.from_json("doc", R.SESSION).alias("d")).select("d.*"))
    return back.select(
        "file_id", "row_number", "description", F.col("balance").cast(MONEY).alias("balance"),
        F.size("errors").alias("error_count"),
    )
