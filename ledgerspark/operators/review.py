"""Review of candidate rows: build, edit, reprocess with edited columns, approve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.parse import parse_amount_sheet, parse_date_multi
from ledgerspark.functions.text import is_blank, strip
from ledgerspark.model import MONEY
from ledgerspark.operators import audit as A
from ledgerspark.operators import universal as U
from ledgerspark.operators.ordered import Hot, running_sum, with_ordered

CANDIDATE = T.StructType(
    [
        T.StructField("row_number", T.LongType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("date", T.DateType()),
        T.StructField("description", T.StringType()),
        T.StructField("debit", MONEY),
        T.StructField("credit", MONEY),
        T.StructField("amount", MONEY),
        T.StructField("balance", MONEY),
        T.StructField("direction", T.StringType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
        T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("original_values", T.MapType(T.StringType(), T.StringType())),
    ]
)
SESSION = T.StructType(
    [T.StructField("file_id", T.LongType()), T.StructField("candidates", T.ArrayType(CANDIDATE))]
)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return flatten_sessions(spark.read.schema(SESSION).json(path))


def flatten_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.select("file_id", F.inline_outer("candidates"))


def write_sessions(candidates: DataFrame, path: str, rows_per_document: int = 5000) -> None:
    """One JSON line per file and block of rows, so a huge statement does not become one huge line."""
    block = F.floor((F.col("row_number") - 1) / rows_per_document)
    names = [f.name for f in CANDIDATE.fields]
    docs = candidates.groupBy("file_id", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(*names[:-1], F.to_json("original_values").alias("original_json")))).alias("c")
    )
    rebuilt = F.transform(
        "c",
        lambda r: F.struct(
            *[r[n].alias(n) for n in names[:-1]],
            F.from_json(r["original_json"], "map<string,string>").alias("original_values"),
        ),
    )
    docs.select("file_id", rebuilt.alias("candidates")).write.mode("overwrite").json(path)


def candidates(transactions: DataFrame) -> DataFrame:
    """Review rows with direction, doubts and the values as first read (keys in lower case)."""
    d, c = F.col("debit"), F.col("credit")
    direction = F.when(d > 0, "Debit").when(c > 0, "Credit").otherwise("Unknown")
    no_date, no_side = F.col("transaction_date").isNull(), d.isNull() & c.isNull()

    def money(name: str) -> Column:
        return F.col(name).cast(MONEY).cast("string")

    first_read = {
        "date": F.date_format("transaction_date", "yyyy-MM-dd"),
        "valuedate": F.date_format("value_date", "yyyy-MM-dd"),
        "description": F.col("description"),
        "reference": F.col("reference"),
        "debit": money("debit"),
        "credit": money("credit"),
        "amount": money("amount"),
        "balance": money("balance"),
    }
    return transactions.select(
        "file_id",
        F.col("row_index").alias("row_number"),
        "page",
        F.col("transaction_date").alias("date"),
        "value_date",
        "description",
        "reference",
        "debit",
        "credit",
        "amount",
        "balance",
        direction.alias("direction"),
        no_date.alias("is_date_ambiguous"),
        no_side.alias("is_direction_ambiguous"),
        F.array_compact(
            F.array(
                F.when(no_side, "Debit/Credit direction is uncertain."),
                F.when((d > 0) & (c > 0), "Both Debit and Credit contain non-zero values."),
            )
        ).alias("errors"),
        F.array_compact(
            F.array(F.when(no_date, "Transaction date could not be confidently determined."))
        ).alias("warnings"),
        F.create_map(*[x for k, v in first_read.items() for x in (F.lit(k), v)]).alias("original_values"),
        F.lit(False).alias("is_user_edited"),
    )


def attention_rows(rows: DataFrame) -> DataFrame:
    """Rows with errors, warnings or a balance mismatch, as rows rather than one list per file."""
    return rows.filter((F.size("errors") > 0) | (F.size("warnings") > 0)).select("file_id", "row_number")


def conversion_gate(rows: DataFrame) -> DataFrame:
    good = (F.size("errors") == 0) & F.col("date").isNotNull() & F.coalesce(F.col("amount") > 0, F.lit(False))
    return rows.groupBy("file_id").agg(F.bool_and(good).alias("is_conversion_allowed"))


def is_blocked() -> Column:
    both = F.coalesce((F.col("debit") > 0) & (F.col("credit") > 0), F.lit(False))
    no_amount = F.coalesce(F.col("amount") <= 0, F.lit(True))
    return F.col("date").isNull() | no_amount | both | (F.size("errors") > 0)


def blockers(rows: DataFrame, hot: Hot | None = None, show: int = 5) -> DataFrame:
    """Blocked files with the number of blocked rows and the first few row numbers."""
    bad = rows.filter(is_blocked())
    bad = with_ordered(bad, ["file_id"], ["row_number"], {"_n": running_sum(F.lit(1))}, hot)
    few = F.sort_array(F.collect_list(F.when(F.col("_n") <= show, F.col("row_number"))))
    return bad.groupBy("file_id").agg(F.count(F.lit(1)).alias("blocked_rows"), few.alias("first_rows"))


def edit_problem() -> Column:
    """First failed check of a candidate edit."""
    d, c = F.col("debit"), F.col("credit")
    has_d, has_c = F.coalesce(d > 0, F.lit(False)), F.coalesce(c > 0, F.lit(False))
    year = F.year("date")
    return (
        F.when(is_blank(F.col("description")), "DESCRIPTION_BLANK")
        .when(F.coalesce(~year.between(1990, 2100), F.lit(True)), "DATE_OUT_OF_RANGE")
        .when(has_d & has_c, "BOTH_SIDES")
        .when(~has_d & ~has_c, "NO_POSITIVE_SIDE")
        .when(F.coalesce((d < 0) | (c < 0), F.lit(False)), "SIDE_NEGATIVE")
    )


def apply_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows with valid edits applied; an edited row loses its errors and warnings."""
    good = edits.filter(edit_problem().isNull())
    fix = good.select(
        "file_id",
        "row_number",
        F.struct(
            "date",
            F.coalesce("value_date", "date").alias("value_date"),
            strip("description").alias("description"),
            F.nullif(strip(F.coalesce("reference", F.lit(""))), F.lit("")).alias("reference"),
            F.when(F.col("debit") > 0, F.col("debit")).alias("debit"),
            F.when(F.col("credit") > 0, F.col("credit")).alias("credit"),
            "balance",
        ).alias("fix"),
    )
    out = rows.join(fix, ["file_id", "row_number"], "left")
    edited = F.col("fix").isNotNull()
    fields = ["date", "value_date", "description", "reference", "debit", "credit", "balance"]
    values = {f: F.when(edited, F.col(f"fix.{f}")).otherwise(F.col(f)) for f in fields}
    amount = F.coalesce(F.col("fix.debit"), F.col("fix.credit"))
    side = F.when(F.col("fix.debit").isNotNull(), "Debit").otherwise("Credit")
    none = F.slice("errors", 1, 0)
    values |= {
        "amount": F.when(edited, amount).otherwise(F.col("amount")),
        "direction": F.when(edited, side).otherwise(F.col("direction")),
        "errors": F.when(edited, none).otherwise(F.col("errors")),
        "warnings": F.when(edited, F.slice("warnings", 1, 0)).otherwise(F.col("warnings")),
        "is_date_ambiguous": ~edited & F.col("is_date_ambiguous"),
        "is_direction_ambiguous": ~edited & F.col("is_direction_ambiguous"),
        "is_user_edited": edited | F.col("is_user_edited"),
    }
    return out.withColumns(values).drop("fix")


def revalidate(rows: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Financial verdict of review rows, without a stated opening or closing balance."""
    from ledgerspark.operators import continuity as C

    none = F.lit(None).cast(MONEY)
    judged = C.judge_rows(rows, "file_id", none, ["row_number"], hot)
    return C.judge_files(judged, "file_id", F.max(none))


def reprocess(segmented: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """Candidate rows under edited column layouts; words outside every column are dropped.

    Without ``layouts`` the ``columns`` of the segmented lines are the edited ones, and the statements are read once.
    """
    rows = segmented if layouts is None else segmented.drop("columns").join(layouts.select("file_id", "columns"), "file_id")
    words = U.words_in_columns(rows, edited=True)
    items = ["Date", "Description", "Reference", "Debit", "Credit", "Balance"]
    joined = {
        n: F.array_join(
            F.array_sort(F.collect_list(F.when(F.col("column_type") == n, F.struct("y", "x", "text"))))["text"], " "
        ).alias(n.lower() + "_text")
        for n in items
    }
    cells = words.groupBy("file_id", "row_index").agg(F.first("row_page").alias("page"), *joined.values())
    day = parse_date_multi(F.col("date_text"))
    d, c = parse_amount_sheet(F.col("debit_text")), parse_amount_sheet(F.col("credit_text"))
    return cells.select(
        "file_id",
        F.col("row_index").alias("row_number"),
        "page",
        day.alias("date"),
        day.alias("value_date"),
        F.col("description_text").alias("description"),
        F.nullif("reference_text", F.lit("")).alias("reference"),
        d.alias("debit"),
        c.alias("credit"),
        F.coalesce(d, c, F.lit(0)).cast(MONEY).alias("amount"),
        parse_amount_sheet(F.col("balance_text")).alias("balance"),
        F.when(d.isNotNull(), "Debit").when(c.isNotNull(), "Credit").otherwise("Unknown").alias("direction"),
        F.array_compact(
            F.array(F.when(d.isNull() & c.isNull(), "Debit/Credit direction is uncertain."))
        ).alias("errors"),
        F.array_compact(F.array(F.when(day.isNull(), "Date could not be determined."))).alias("warnings"),
    )


def keep_reprocessed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Reprocessed rows replace a file's candidates only where there are any."""
    names = [c for c in after.columns if c in before.columns]
    return A.replace_files(before.select(*names), after.select(*names), "file_id")


def approve(rows: DataFrame, existing: DataFrame, hot: Hot | None = None) -> tuple[DataFrame, DataFrame]:
    """(ledger rows to add, import results). Blocked files add nothing; files already in the ledger are left alone."""
    blocked = blockers(rows, hot).select("file_id")
    have = existing.select(F.col("source_file_id").alias("file_id")).distinct()
    good = rows.join(blocked, "file_id", "left_anti").join(have, "file_id", "left_anti")
    added = good.select(
        F.col("file_id").alias("source_file_id"),
        F.col("row_number").cast("int").alias("seq"),
        F.col("date").cast("timestamp").alias("transaction_date"),
        "description",
        "debit",
        "credit",
        "amount",
        "balance",
        "reference",
        F.col("direction").alias("transaction_type"),
        F.lit(99).alias("bank_code"),
    )
    results = added.groupBy("source_file_id").agg(
        F.lit(99).alias("detected_bank"),
        F.count(F.lit(1)).alias("total_detected"),
        F.count(F.lit(1)).alias("processed_count"),
        F.lit(0).cast("long").alias("rejected_count"),
        F.lit("Completed").alias("status"),
    )
    return added, results
