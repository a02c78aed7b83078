"""Transaction rules, duplicate flags and the per-statement summary."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.text import flag_list, is_blank, strip
from ledgerspark.model import AS_OF, MONEY, TOTAL, ZERO_AMOUNT_BANKS, bank_name, parser_version
from ledgerspark.operators.continuity import BALANCED, MISMATCH, continuity
from ledgerspark.operators.ordered import Hot, with_group

KEY = "source_file_id"


def default_type(kind: Column, debit: Column) -> Column:
    return F.coalesce(kind, F.when(debit.isNotNull(), "Debit").otherwise("Credit"))


def fingerprint() -> Column:
    """Business identity of a row: date, text, amount, type, reference and balance, ignoring case."""
    blank = F.lit("")
    return F.concat_ws(
        "|",
        F.coalesce(F.date_format("transaction_date", "yyyy-MM-dd"), blank),
        F.upper(strip(F.coalesce("description", blank))),
        F.col("amount").cast(MONEY).cast("string"),
        F.upper(strip(default_type(F.col("transaction_type"), F.col("debit")))),
        F.upper(strip(F.coalesce("reference", blank))),
        F.coalesce(F.col("balance").cast(MONEY).cast("string"), blank),
    )


def flag_duplicates(df: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Flag every member of a group of equal fingerprints inside one file.

    Partitioning by file already satisfies the ``(file, fingerprint)`` window, so no exchange is added.
    """
    out = with_group(
        df.withColumn("_fp", fingerprint()), [KEY, "_fp"], {"_copies": F.count(F.lit(1))}, hot
    )
    return out.withColumn("is_duplicate", F.col("_copies") > 1).drop("_fp", "_copies")


def _money(c: Column) -> Column:
    return c.cast(MONEY).cast("string")


def rules(as_of: dt.date) -> tuple[list, list]:
    """(errors, warnings); each item is (code, condition, message)."""
    date, desc = F.col("transaction_date"), F.coalesce("description", F.lit(""))
    amount, balance = F.col("amount"), F.col("balance")
    debit, credit = F.col("debit"), F.col("credit")
    kind = F.upper(strip(F.coalesce("transaction_type", F.lit(""))))
    latest = F.lit(as_of + dt.timedelta(days=1)).cast("timestamp")
    days = F.datediff("value_date", "transaction_date")

    memo = (amount == 0) & balance.isNotNull() & F.col("bank_code").isin(*ZERO_AMOUNT_BANKS)
    memo = F.coalesce(memo, F.lit(False))
    has_d, has_c = F.coalesce(debit > 0, F.lit(False)), F.coalesce(credit > 0, F.lit(False))
    below_d, below_c = F.coalesce(debit < 0, F.lit(True)), F.coalesce(credit < 0, F.lit(True))
    both = has_d & has_c
    none = ~both & ~memo & below_d & below_c
    no_positive = ~both & ~memo & ~(below_d & below_c) & ~has_d & ~has_c
    cent = F.lit("0.01").cast(MONEY)

    def differs(side: Column) -> Column:
        return (side > 0) & (F.abs(side - amount) > cent)

    def mismatch_text(name: str, side: Column) -> Column:
        return F.concat(
            F.lit("Amount ("), _money(amount), F.lit(f") does not match {name} value ("), _money(side), F.lit(").")
        )

    errors = [
        ("DATE_MISSING", date.isNull(), F.lit("Missing or invalid transaction date.")),
        ("DATE_FUTURE", date > latest, F.lit("Transaction date cannot be in the future.")),
        ("DESCRIPTION_BLANK", is_blank(desc), F.lit("Description/narration is required.")),
        ("AMOUNT_NEGATIVE", amount < 0, F.lit("Transaction amount cannot be negative.")),
        ("AMOUNT_ZERO", (amount == 0) & ~memo, F.lit("Transaction amount must be greater than zero.")),
        ("TYPE_INVALID", ~kind.isin("DEBIT", "CREDIT"), F.lit("Transaction type must be Debit or Credit.")),
        ("BOTH_SIDES", both, F.lit("Both Debit and Credit amounts are populated.")),
        ("NO_SIDE", none, F.lit("Either Debit or Credit must be populated.")),
        (
            "NO_POSITIVE_SIDE",
            no_positive,
            F.lit("Either Debit or Credit must be populated with a positive amount."),
        ),
        ("SIDE_NEGATIVE", (debit < 0) | (credit < 0), F.lit("Monetary values cannot be negative.")),
        ("DEBIT_DIFFERS", differs(debit), mismatch_text("Debit", debit)),
        ("CREDIT_DIFFERS", differs(credit), mismatch_text("Credit", credit)),
    ]
    expected = F.col("expected_balance")
    warnings = [
        ("DESCRIPTION_SHORT", ~is_blank(desc) & (F.length(strip(desc)) < 2), F.lit("Description is unusually short.")),
        (
            "ZERO_MEMO",
            memo,
            F.lit("Zero amount transaction recorded in bank statement (e.g. cheque return or memo entry)."),
        ),
        (
            "VALUE_DATE_EARLY",
            days < -30,
            F.lit("Value date precedes transaction date by more than 30 days."),
        ),
        ("VALUE_DATE_LATE", days > 30, F.lit("Value date exceeds transaction date by more than 30 days.")),
        ("ZERO_VALUE", memo & ~both, F.lit("Zero monetary value recorded in statement.")),
        (
            "BALANCE_MISMATCH",
            F.col("balance_status") == MISMATCH,
            F.concat(
                F.lit("Running balance mismatch: expected "),
                F.format_number(expected, 2),
                F.lit(", actual "),
                F.format_number(balance, 2),
                F.lit(" (diff: "),
                F.format_number(F.abs(expected - balance), 2),
                F.lit(")."),
            ),
        ),
        (
            "DUPLICATE",
            F.col("is_duplicate"),
            F.lit("Potential duplicate transaction detected with identical business values."),
        ),
    ]
    return errors, warnings


def apply_rules(df: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """Add codes, messages, status and severity. Needs balance_status, is_duplicate, value_date and is_corrected."""
    errors, warnings = rules(as_of)
    out = df.withColumns(
        {
            "error_codes": flag_list([(code, cond) for code, cond, _ in errors]),
            "warning_codes": flag_list([(code, cond) for code, cond, _ in warnings]),
            "errors": F.array_compact(F.array(*[F.when(cond, text) for _, cond, text in errors])),
            "warnings": F.array_compact(F.array(*[F.when(cond, text) for _, cond, text in warnings])),
        }
    )
    bad, warned = F.size("error_codes") > 0, F.size("warning_codes") > 0
    fixed = F.col("is_corrected")
    return out.withColumns(
        {
            "status": F.when(bad, "INVALID")
            .when(fixed, "CORRECTED")
            .when(warned, "REVIEW")
            .otherwise("VALID"),
            "severity": F.when(bad, "ERROR").when(warned, "WARNING").otherwise("INFO"),
            "is_ready": ~bad,
        }
    )


def with_audit(df: DataFrame, audit: DataFrame | None) -> DataFrame:
    """Attach value date and correction state; ``df`` must not carry those columns itself."""
    if audit is None:
        return df.withColumns(
            {
                "value_date": F.lit(None).cast("timestamp"),
                "source_page_number": F.lit(1),
                "source_line_index": F.lit(0),
                "correction_count": F.lit(0).cast("long"),
                "is_corrected": F.lit(False),
            }
        )
    # With the file in the key the join keeps the partitioning that the ordered work left.
    keys = [KEY, "id"] if KEY in audit.columns else ["id"]
    picked = audit.select(
        *keys[:-1],
        F.col("transaction_id").alias("id"),
        "value_date",
        "source_page_number",
        "source_line_index",
        "correction_count",
    )
    return df.join(picked, keys, "left").withColumns(
        {
            "source_page_number": F.coalesce("source_page_number", F.lit(1)),
            "source_line_index": F.coalesce("source_line_index", F.lit(0)),
            "correction_count": F.coalesce("correction_count", F.lit(0)),
            "is_corrected": F.coalesce(F.col("correction_count") > 0, F.lit(False)),
        }
    )


def validate(
    transactions: DataFrame,
    audit: DataFrame | None = None,
    as_of: dt.date = AS_OF,
    hot: Hot | None = None,
) -> DataFrame:
    """Validate every statement at once.

    The ordered work runs first on the file partitioning, and an audit that names the file joins on it too, so the ledger
    is exchanged by file once.
    """
    rows = continuity(transactions.drop("value_date"), "validate", hot=hot)
    rows = with_audit(flag_duplicates(rows, hot), audit)
    return apply_rules(rows, as_of)


def enrich(df: DataFrame) -> DataFrame:
    """Display columns of a validated row."""
    return df.withColumns(
        {
            "transaction_type": default_type(F.col("transaction_type"), F.col("debit")),
            "bank_name": bank_name(F.col("bank_code")),
            "parser_version": parser_version(F.col("bank_code")),
        }
    )


def summarize(validated: DataFrame, *more: Column) -> DataFrame:
    """One row per statement, with ``more`` aggregates beside. A row with a positive debit never counts as a credit."""
    status, bal = F.col("status"), F.col("balance_status")
    is_d = F.coalesce(F.col("debit") > 0, F.lit(False))
    is_c = ~is_d & F.coalesce(F.col("credit") > 0, F.lit(False))

    def n(cond: Column) -> Column:
        return F.count_if(cond)

    def total(cond: Column, value: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0)).cast(TOTAL)

    out = validated.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        n(status == "VALID").alias("valid_count"),
        n(status == "REVIEW").alias("review_count"),
        n(status == "INVALID").alias("invalid_count"),
        n(status == "CORRECTED").alias("corrected_count"),
        n(is_d).alias("debit_count"),
        n(is_c).alias("credit_count"),
        total(is_d, "debit").alias("total_debits"),
        total(is_c, "credit").alias("total_credits"),
        n(bal.isin(BALANCED, MISMATCH)).alias("checkable_count"),
        n(bal == BALANCED).alias("matched_count"),
        n(bal == MISMATCH).alias("mismatched_count"),
        n(F.col("is_duplicate")).alias("duplicate_count"),
        *more,
    )
    return out.withColumns(
        {
            "net_movement": (F.col("total_credits") - F.col("total_debits")).cast(TOTAL),
            "is_ready": F.col("invalid_count") == 0,
        }
    )
