"""Snapshots, corrections and their history, ledger replacement and deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.text import is_blank, strip
from ledgerspark.model import MONEY
from ledgerspark.operators.ordered import Hot, lag, with_ordered

CHANGE = T.StructType(
    [
        T.StructField("field_name", T.StringType()),
        T.StructField("old_value", T.StringType()),
        T.StructField("new_value", T.StringType()),
    ]
)
ENTRY = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("reason", T.StringType()),
        T.StructField("changes", T.ArrayType(CHANGE)),
    ]
)
ORIGINAL = T.StructType(
    [
        T.StructField("transaction_date", T.TimestampType()),
        T.StructField("value_date", T.TimestampType()),
        T.StructField("description", T.StringType()),
        T.StructField("debit", MONEY),
        T.StructField("credit", MONEY),
        T.StructField("amount", MONEY),
        T.StructField("balance", MONEY),
        T.StructField("reference", T.StringType()),
        T.StructField("utr", T.StringType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("bank_code", T.IntegerType()),
        T.StructField("account", T.StringType()),
        T.StructField("source_page_number", T.IntegerType()),
        T.StructField("source_line_index", T.IntegerType()),
        T.StructField("processing_warning", T.StringType()),
    ]
)
RECORD = T.StructType([T.StructField("original_values", ORIGINAL), T.StructField("history", T.ArrayType(ENTRY))])
DOCUMENT = T.StructType(
    [
        T.StructField("source_file_id", T.LongType()),
        T.StructField("records", T.MapType(T.StringType(), RECORD)),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def read_audit_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON audit documents, one per file, as text rows."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "doc")


def parse_audit_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected). A malformed document is set aside, never rebuilt."""
    parsed = docs.withColumn(
        "d", F.from_json("doc", DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    broken = F.col("d").isNull() | F.col("d._corrupt").isNotNull() | F.col("d.records").isNull()
    return parsed.filter(~broken).select("d.source_file_id", "d.records"), parsed.filter(broken).select("doc")


def flatten_audit(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshots, corrections, field_changes) from parsed documents."""
    records = documents.select("source_file_id", F.explode("records").alias("transaction_id", "r"))
    records = records.withColumn("transaction_id", F.col("transaction_id").cast("long"))
    snapshots = records.select("transaction_id", "source_file_id", "r.original_values.*")
    corrections = records.select(
        "transaction_id", "source_file_id", F.posexplode("r.history").alias("entry_no", "h")
    ).select("transaction_id", "source_file_id", "entry_no", "h.ts", "h.user_id", "h.reason", "h.changes")
    changes = corrections.select("transaction_id", "entry_no", F.inline("changes"))
    return snapshots, corrections, changes


def init_snapshots(parsed: DataFrame, persisted: DataFrame) -> DataFrame:
    """Freeze parsed values under the persisted ids, matched by (file, position)."""
    ids = persisted.select("source_file_id", "position", F.col("id").alias("transaction_id"))
    out = parsed.join(ids, ["source_file_id", "position"])
    return out.withColumns(
        {
            "source_page_number": F.coalesce("source_page_number", F.lit(1)),
            "source_line_index": F.coalesce("source_line_index", F.col("position")).cast("int"),
        }
    )


def request_problem() -> Column:
    """First failed check of a correction request; null when it may be applied."""
    debit, credit = F.col("debit"), F.col("credit")
    has_d, has_c = F.coalesce(debit > 0, F.lit(False)), F.coalesce(credit > 0, F.lit(False))
    return (
        F.when(is_blank(F.col("reason")), "REASON_MISSING")
        .when(is_blank(F.col("description")), "DESCRIPTION_BLANK")
        .when(F.col("transaction_date").isNull(), "DATE_MISSING")
        .when(F.coalesce(F.col("amount") <= 0, F.lit(True)), "AMOUNT_NOT_POSITIVE")
        .when(has_d & has_c, "BOTH_SIDES")
        .when(~has_d & ~has_c, "NO_POSITIVE_SIDE")
        .when(F.coalesce(debit < 0, F.lit(False)) | F.coalesce(credit < 0, F.lit(False)), "SIDE_NEGATIVE")
    )


def normalize_request(df: DataFrame) -> DataFrame:
    """Amount and type follow the positive side; the other side is cleared."""
    d, c = F.col("debit"), F.col("credit")
    side = F.when(d > 0, "Debit").when(c > 0, "Credit")
    return df.withColumn("_side", side).withColumns(
        {
            "amount": F.when(F.col("_side") == "Debit", d).when(F.col("_side") == "Credit", c).otherwise(F.col("amount")),
            "transaction_type": F.coalesce("_side", "transaction_type"),
            "debit": F.when(F.col("_side") == "Credit", None).otherwise(d),
            "credit": F.when(F.col("_side") == "Debit", None).otherwise(c),
            "description": strip("description"),
            "reference": F.nullif(strip(F.coalesce("reference", F.lit(""))), F.lit("")),
        }
    ).drop("_side")


def _texts(row: Column) -> list[tuple[str, Column]]:
    """Compared fields of a row as text, in reporting order."""
    def money(name: str) -> Column:
        return row[name].cast(MONEY).cast("string")

    return [
        ("TransactionDate", F.date_format(row["transaction_date"], "yyyy-MM-dd")),
        ("Description", row["description"]),
        ("Debit", money("debit")),
        ("Credit", money("credit")),
        ("Amount", money("amount")),
        ("Balance", money("balance")),
        ("Reference", row["reference"]),
        ("TransactionType", row["transaction_type"]),
    ]


# Text fields compared after trimming, with a missing value equal to an empty one.
TRIMMED = {"Description", "Reference", "TransactionType"}


def diff(old: Column, new: Column) -> Column:
    """Array of changed fields between two row structs."""
    items = []
    for (name, before), (_, after) in zip(_texts(old), _texts(new)):
        if name in TRIMMED:
            same = strip(F.coalesce(before, F.lit(""))) == strip(F.coalesce(after, F.lit("")))
        else:
            same = before.eqNullSafe(after)
        items.append(
            F.when(
                ~same,
                F.struct(F.lit(name).alias("field_name"), before.alias("old_value"), after.alias("new_value")),
            )
        )
    return F.array_compact(F.array(*items))


FIELDS = [
    "transaction_date",
    "description",
    "debit",
    "credit",
    "amount",
    "balance",
    "reference",
    "transaction_type",
]


def _row(prefix: str | None = None) -> Column:
    return F.struct(*[F.col(f"{prefix}.{f}" if prefix else f).alias(f) for f in FIELDS])


def accepted(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Valid, normalised requests for rows that have a snapshot."""
    good = normalize_request(requests.filter(request_problem().isNull()))
    return good.join(snapshots.select("transaction_id"), "transaction_id", "left_semi")


def logged(requests: DataFrame, ledger: DataFrame, snapshots: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Accepted requests with their ``changes`` against the state before them and the ``new`` state; empty ones are dropped."""
    asked = accepted(requests, snapshots).withColumn("new", _row())
    asked = with_ordered(asked, ["transaction_id"], ["ts", "request_no"], {"before": lag(F.col("new"))}, hot)
    current = ledger.select(F.col("id").alias("transaction_id"), _row().alias("current"))
    out = asked.join(current, "transaction_id")
    changes = diff(F.coalesce(F.col("before"), F.col("current")), F.col("new"))
    return out.withColumn("changes", changes).filter(F.size("changes") > 0)


def correction_log(
    requests: DataFrame, ledger: DataFrame, snapshots: DataFrame, hot: Hot | None = None
) -> DataFrame:
    """History entries in time order, each with its changes against the state before it; empty ones are dropped."""
    out = logged(requests, ledger, snapshots, hot)
    return out.select("transaction_id", "ts", "request_no", "user_id", "reason", "changes")


def apply_corrections(ledger: DataFrame, requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """New ledger version: the latest accepted request per row wins; warning and UTR stay as they are."""
    latest = (
        accepted(requests, snapshots)
        .groupBy("transaction_id")
        .agg(F.max_by(_row(), F.struct("ts", "request_no")).alias("fix"))
        .withColumnRenamed("transaction_id", "id")
    )
    out = ledger.join(latest, "id", "left")
    fixed = F.col("fix").isNotNull()
    changed = F.size(diff(_row(), F.col("fix"))) > 0
    out = out.withColumn("is_changed", fixed & F.coalesce(changed, F.lit(False)))
    return out.withColumns(
        {f: F.when(F.col("is_changed"), F.col(f"fix.{f}")).otherwise(F.col(f)) for f in FIELDS}
    ).drop("fix")


def replace_files(current: DataFrame, incoming: DataFrame, key: str = "source_file_id") -> DataFrame:
    """Ledger after a re-import: files with incoming rows lose their old rows; the rest stay untouched."""
    files = incoming.select(key).distinct()
    return current.join(files, key, "left_anti").unionByName(incoming)


def upsert_import_results(current: DataFrame, incoming: DataFrame, key: str = "source_file_id") -> DataFrame:
    """New values win, the first start time stays."""
    joined = current.alias("c").join(incoming.alias("n"), key, "full_outer")
    kept = {"started_at"}
    picks = []
    for name in current.columns:
        if name == key:
            continue
        old, new = F.col(f"c.{name}"), F.col(f"n.{name}")
        picks.append((F.coalesce(old, new) if name in kept else F.coalesce(new, old)).alias(name))
    return joined.select(key, *picks)


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], deleted: DataFrame) -> dict[str, DataFrame]:
    """Every child table without the deleted file ids; ``tables`` maps a name to (rows, file id column)."""
    ids = deleted.select(F.col(deleted.columns[0]).alias("_gone"))
    return {
        name: df.join(ids, F.col(column) == F.col("_gone"), "left_anti") for name, (df, column) in tables.items()
    }
