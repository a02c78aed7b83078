"""Export tables: transactions sheet, statement info, financial summary and ledger CSV."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.text import is_blank
from ledgerspark.model import LEDGER_ORDER, MONEY, bank_name, parser_version
from ledgerspark.operators.ordered import Hot, rownum, with_ordered
from ledgerspark.operators.validate import KEY, enrich, summarize

# Column titles of the two row exports.
SHEET_TITLES = [
    "Sr No",
    "Transaction Date",
    "Value Date",
    "Particulars / Narration",
    "Cheque / Reference",
    "UTR",
    "Debit (-)",
    "Credit (+)",
    "Amount",
    "Balance",
    "Transaction Type",
    "Bank",
    "Account",
    "Validation Status",
    "Review Notes",
]
CSV_TITLES = [
    "Sr No",
    "Transaction Date",
    "Value Date",
    "Particulars / Description",
    "Cheque / Ref",
    "Debit (INR)",
    "Credit (INR)",
    "Balance (INR)",
    "Validation Status",
]


def export_gate(validated: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Rows of statements without a single invalid row."""
    summary = summarize(validated) if summary is None else summary
    open_files = summary.filter("invalid_count = 0").select(KEY)
    return validated.join(open_files, KEY, "left_semi")


def _text(name: str) -> Column:
    return F.coalesce(name, F.lit(""))


def transactions_sheet(validated: DataFrame, hot: Hot | None = None) -> DataFrame:
    rows = with_ordered(validated, [KEY], LEDGER_ORDER, {"sr_no": rownum()}, hot)
    rows = enrich(rows)
    values = [
        F.col("sr_no"),
        F.to_date("transaction_date"),
        F.to_date("value_date"),
        _text("description"),
        _text("reference"),
        _text("utr"),
        F.col("debit"),
        F.col("credit"),
        F.col("amount"),
        F.col("balance"),
        _text("transaction_type"),
        F.col("bank_name"),
        _text("account"),
        F.coalesce("status", F.lit("VALID")),
        F.array_join(F.concat("errors", "warnings"), "; "),
    ]
    return rows.select(KEY, *[v.alias(t) for v, t in zip(values, SHEET_TITLES)])


def ledger_csv(validated: DataFrame, hot: Hot | None = None) -> DataFrame:
    rows = with_ordered(validated, [KEY], LEDGER_ORDER, {"sr_no": rownum()}, hot)

    def money(name: str) -> Column:
        return F.coalesce(F.col(name).cast(MONEY).cast("string"), F.lit(""))

    def day(name: str) -> Column:
        return F.coalesce(F.date_format(name, "dd/MM/yyyy"), F.lit(""))

    reference = F.coalesce(F.nullif("reference", F.lit("")), F.nullif("utr", F.lit("")), F.lit(""))
    values = [
        F.col("sr_no"),
        day("transaction_date"),
        day("value_date"),
        _text("description"),
        reference,
        money("debit"),
        money("credit"),
        money("balance"),
        F.coalesce("status", F.lit("VALID")),
    ]
    return rows.select(KEY, *[v.alias(t) for v, t in zip(values, CSV_TITLES)])


def write_ledger_csv(validated: DataFrame, path: str, hot: Hot | None = None, buckets: int = 64) -> None:
    """``buckets`` folders, each with its statements in order of file and serial number over its part files in order of name.

    Rows are dealt out in ranges, so a bucket or statement with very many rows becomes several parts and a small bucket is one file.
    """
    out = ledger_csv(validated, hot).withColumn("bucket", F.pmod(F.xxhash64(KEY), F.lit(buckets)))
    order = ["bucket", KEY, "Sr No"]
    dealt = out.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").partitionBy("bucket").csv(path, header=True, quote='"', escape='"', quoteAll=False)


def position() -> Column:
    return F.struct(*[F.col(c) for c in LEDGER_ORDER])


def fact_columns() -> list[Column]:
    """Bank, account, opening and closing balance of a statement, all as map-side ``min_by``/``max_by``."""
    known = F.when(F.col("balance").isNotNull(), position())
    back = F.when(F.col("debit") > 0, F.col("debit")).when(F.col("credit") > 0, -F.col("credit")).otherwise(0)
    named = F.when(~is_blank(F.col("account")), position())
    return [
        F.min_by("bank_code", position()).alias("bank_code"),
        F.min_by("account", named).alias("account"),
        F.min_by((F.col("balance") + back).cast(MONEY), known).alias("opening_balance"),
        F.max_by("balance", known).alias("closing_balance"),
    ]


def _pairs(items: list[tuple], names: list[str]) -> Column:
    rows = []
    for no, item in enumerate(items, start=1):
        cells = [F.lit(no).alias("line_no")]
        for value, name in zip(item, names):
            cell = value if isinstance(value, Column) else F.lit(value)
            cells.append(cell.cast("string").alias(name))
        rows.append(F.struct(*cells))
    return F.inline(F.array(*rows))


def statement_info(validated: DataFrame, files: DataFrame, exported_at: dt.datetime) -> DataFrame:
    """Sixteen label and value lines per statement."""
    facts = summarize(validated, *fact_columns()).join(files.select(F.col("id").alias(KEY), "original_file_name", "uploaded_at"), KEY)
    stamp = "yyyy-MM-dd HH:mm:ss 'UTC'"
    items = [
        ("Bank Name", bank_name(F.col("bank_code"))),
        ("Parser Version", parser_version(F.col("bank_code"))),
        ("Account Number", F.coalesce("account", F.lit("N/A"))),
        ("Source Statement File", F.col("original_file_name")),
        ("Statement File ID", F.col(KEY)),
        ("Ingestion Date (UTC)", F.date_format("uploaded_at", stamp)),
        ("Export Timestamp (UTC)", F.lit(exported_at.strftime("%Y-%m-%d %H:%M:%S UTC"))),
        ("Total Transactions", F.col("total_transactions")),
        ("Valid Transactions", F.col("valid_count")),
        ("Needs Review Transactions", F.col("review_count")),
        ("Invalid Transactions", F.col("invalid_count")),
        ("Corrected Transactions", F.col("corrected_count")),
        ("Total Outflow (Debits)", F.col("total_debits")),
        ("Total Inflow (Credits)", F.col("total_credits")),
        ("Net Balance Movement", F.col("net_movement")),
        ("Balance Continuity Status", F.when(F.col("mismatched_count") == 0, "BALANCED").otherwise("MISMATCH")),
    ]
    return facts.select(KEY, _pairs(items, ["label", "value"]))


def financial_summary(validated: DataFrame) -> DataFrame:
    """Ten metric, value and note lines per statement."""
    facts = summarize(validated, *fact_columns())
    bad = F.col("mismatched_count")

    def counted(name: str, suffix: str) -> Column:
        return F.concat(F.col(name).cast("string"), F.lit(suffix))

    def if_none(name: str, yes: str, no: str) -> Column:
        return F.when(F.col(name) == 0, yes).otherwise(no)

    items = [
        ("Opening Balance", F.coalesce(F.col("opening_balance").cast("string"), F.lit("-")),
         "Derived balance before first transaction"),
        ("Total Inflow (Credits +)", F.col("total_credits"), counted("credit_count", " transaction(s)")),
        ("Total Outflow (Debits -)", F.col("total_debits"), counted("debit_count", " transaction(s)")),
        ("Net Financial Movement", F.col("net_movement"),
         F.when(F.col("net_movement") >= 0, "Net Positive Inflow").otherwise("Net Outflow")),
        ("Closing Balance", F.coalesce(F.col("closing_balance").cast("string"), F.lit("-")),
         "Final balance recorded in statement period"),
        ("Running Balance Continuity", F.when(bad == 0, "BALANCED").otherwise("MISMATCH DETECTED"),
         F.when(bad == 0, "Zero discrepancies across all sequential rows").otherwise(
             counted("mismatched_count", " continuity mismatch(es) flagged"))),
        ("Valid Records Ready", F.col("valid_count"), "No review flags or errors"),
        ("Reviewed / Corrected", F.col("corrected_count"), "User-corrected records verified"),
        ("Pending Review", F.col("review_count"), if_none("review_count", "Clean", "Needs manual confirmation")),
        ("Invalid Records", F.col("invalid_count"),
         if_none("invalid_count", "Zero errors", "Critical discrepancies present")),
    ]
    return facts.select(KEY, _pairs(items, ["metric", "value", "note"]))
