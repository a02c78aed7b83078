"""Accounting sheets: header mapping, row rules, duplicates and vouchers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.parse import parse_amount_sheet, parse_date_sheet
from ledgerspark.functions.text import contains_ci, is_blank, strip
from ledgerspark.model import MONEY
from ledgerspark.operators.ordered import Hot, with_group

# Raw column, canonical header, and the cleaned spellings that map to it.
HEADERS = [
    ("raw_date", "Date", "date txndate transactiondate"),
    ("raw_narration", "Narration", "narration description particulars details"),
    ("raw_cheque_ref_no", "Cheque / Ref No.", "chequerefno chqrefno chequenumber refno referenceno utr chequeno"),
    ("raw_value_date", "Value Date", "valuedate valuedt"),
    ("raw_dr_amount", "Dr Amount", "dramount debitamount debit dr"),
    ("raw_cr_amount", "Cr Amount", "cramount creditamount credit cr"),
    ("raw_closing_balance", "Closing Balance", "closingbalance balance bal closingbal"),
    ("raw_ledger_name", "Ledger Name", "ledgername ledger accounthead partyname"),
    ("raw_bank_name", "Bank Name", "bankname bank bankaccount"),
]
CANONICAL = [h for _, h, _ in HEADERS]
RAW_COLUMNS = [c for c, _, _ in HEADERS]
ALIASES = {alias: header for _, header, names in HEADERS for alias in names.split()}


def clean_header(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9]", "")


def canonical_header(c: Column) -> Column:
    """Canonical name of a header cell; null when unknown. A literal map, so no join is planned."""
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.try_element_at(names, clean_header(c))


def map_headers(cells: DataFrame, key: str = "batch_id") -> tuple[DataFrame, DataFrame]:
    """(mapping, missing) for header cells (key, position, header); the first cell of a canonical name wins."""
    named = cells.withColumn("canonical", canonical_header(F.col("header"))).filter("canonical is not null")
    mapping = named.groupBy(key, "canonical").agg(F.min(F.struct("position", "header")).alias("m"))
    mapping = mapping.select(key, "canonical", "m.position", "m.header")
    # At most nine names per sheet are gathered.
    found = cells.groupBy(key).agg(F.collect_set(canonical_header(F.col("header"))).alias("found"))
    missing = found.select(
        key, F.array_except(F.array(*[F.lit(c) for c in CANONICAL]), F.col("found")).alias("missing")
    )
    return mapping, missing


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Read a CSV sheet as text, rename known headers, and fail when a canonical header is absent."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    picked: dict[str, str] = {}
    for name in raw.columns:
        cleaned = "".join(ch for ch in name.strip().lower() if ch.isascii() and ch.isalnum())
        header = ALIASES.get(cleaned)
        if header and header not in picked:
            picked[header] = name
    missing = [h for h in CANONICAL if h not in picked]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return raw.select(*[F.col(f"`{picked[h]}`").alias(c) for c, h, _ in HEADERS])


def is_blank_row() -> Column:
    """All nine raw cells blank."""
    out = is_blank(F.col(RAW_COLUMNS[0]))
    for name in RAW_COLUMNS[1:]:
        out = out & is_blank(F.col(name))
    return out


def is_sample_row() -> Column:
    text = strip(F.coalesce("raw_narration", F.lit("")))
    return text.rlike(r"(?i)^(\[SAMPLE\]|SAMPLE:|\[EXAMPLE\])|^SAMPLE$")


def held(rows: DataFrame, *names: str) -> DataFrame:
    """The same rows, with the named columns computed once: through a generator, no later filter or column repeats what they are made of."""
    rest = [c for c in rows.columns if c not in names]
    return rows.select(*rest, F.inline(F.array(F.struct(*names))))


def parse_rows(rows: DataFrame) -> DataFrame:
    """Typed columns beside the raw ones; blank and sample rows removed."""
    def given(name: str) -> Column:
        return ~is_blank(F.col(name))

    dr, cr = parse_amount_sheet(F.col("raw_dr_amount")), parse_amount_sheet(F.col("raw_cr_amount"))
    rows = held(rows, *RAW_COLUMNS).filter(~is_blank_row() & ~is_sample_row())
    typed = rows.withColumns(
        {
            "date": parse_date_sheet(F.col("raw_date")),
            "value_date": parse_date_sheet(F.col("raw_value_date")),
            "_dr": dr,
            "_cr": cr,
            "closing_balance": parse_amount_sheet(F.col("raw_closing_balance")),
            "narration": strip("raw_narration"),
            "cheque_ref_no": strip("raw_cheque_ref_no"),
            "ledger_name": strip("raw_ledger_name"),
            "bank_name": strip("raw_bank_name"),
            "dr_given": given("raw_dr_amount"),
            "cr_given": given("raw_cr_amount"),
        }
    )
    return held(typed, *[c for c in typed.columns if c not in rows.columns]).withColumns(
        {
            "dr_amount": F.when(F.col("_dr") >= 0, F.col("_dr")),
            "cr_amount": F.when(F.col("_cr") >= 0, F.col("_cr")),
        }
    )


def signature() -> Column:
    """Identity of a sheet row, ignoring case; null when the row has no date or no positive side."""
    has_dr = F.coalesce(F.col("dr_amount") > 0, F.lit(False))
    has_cr = F.coalesce(F.col("cr_amount") > 0, F.lit(False))
    amount = F.when(has_dr, F.col("dr_amount")).otherwise(F.col("cr_amount"))
    blank = F.lit("")
    text = F.concat_ws(
        "_",
        F.date_format("date", "yyyyMMdd"),
        F.when(has_dr, "DR").otherwise("CR"),
        amount.cast(MONEY).cast("string"),
        F.coalesce("cheque_ref_no", blank),
        F.coalesce("narration", blank),
    )
    return F.when(F.col("date").isNotNull() & (has_dr | has_cr), F.upper(text))


def flag_repeats(rows: DataFrame, key: str = "batch_id", hot: Hot | None = None) -> DataFrame:
    """``first_row``: the row number an earlier equal row has in the batch; null for firsts.

    Small batches use a window that shares the batch exchange; hot batches aggregate first.
    """
    rows = rows.withColumn("_sig", F.coalesce(signature(), F.concat(F.lit("#"), F.col("row_number").cast("string"))))
    out = with_group(rows, [key, "_sig"], {"_first": F.min("row_number")}, hot)
    return out.withColumn(
        "first_row", F.when(F.col("_first") < F.col("row_number"), F.col("_first"))
    ).drop("_first", "_sig")


FATAL, WARNING = 2, 1


def issue_list() -> Column:
    """Issues of one row in rule order."""
    dr, cr = F.col("_dr"), F.col("_cr")
    dr_given, cr_given = F.col("dr_given"), F.col("cr_given")
    dr_ok = ~dr_given | F.coalesce(dr >= 0, F.lit(False))
    cr_ok = ~cr_given | F.coalesce(cr >= 0, F.lit(False))
    has_dr = F.coalesce(F.col("dr_amount") > 0, F.lit(False))
    has_cr = F.coalesce(F.col("cr_amount") > 0, F.lit(False))
    no_date = is_blank(F.col("raw_date"))
    amount = F.when(has_dr, F.col("dr_amount")).otherwise(F.col("cr_amount"))

    def quoted(before: str, name: str, after: str = "'.") -> Column:
        return F.concat(F.lit(before), F.coalesce(name, F.lit("")), F.lit(after))

    items = [
        (no_date, "Date", FATAL, F.lit("Date is required and cannot be empty.")),
        (
            ~no_date & F.col("date").isNull(),
            "Date",
            FATAL,
            quoted("Invalid Date format: '", "raw_date", "'. Expected format like dd/MM/yyyy or dd-MMM-yyyy."),
        ),
        (
            ~is_blank(F.col("raw_value_date")) & F.col("value_date").isNull(),
            "Value Date",
            FATAL,
            quoted("Invalid Value Date format: '", "raw_value_date"),
        ),
        (dr_given & (dr < 0), "Dr Amount", FATAL, F.lit("Dr Amount cannot be negative.")),
        (dr_given & dr.isNull(), "Dr Amount", FATAL, quoted("Dr Amount is not numeric: '", "raw_dr_amount")),
        (cr_given & (cr < 0), "Cr Amount", FATAL, F.lit("Cr Amount cannot be negative.")),
        (cr_given & cr.isNull(), "Cr Amount", FATAL, quoted("Cr Amount is not numeric: '", "raw_cr_amount")),
        (has_dr & has_cr, "Amount", FATAL, F.lit("Dr Amount and Cr Amount cannot both be populated.")),
        (
            dr_ok & cr_ok & ~has_dr & ~has_cr,
            "Amount",
            FATAL,
            F.lit("Transaction must have either a Dr Amount or a Cr Amount populated."),
        ),
        (
            ~is_blank(F.col("raw_closing_balance")) & F.col("closing_balance").isNull(),
            "Closing Balance",
            FATAL,
            quoted("Closing Balance must be a valid numeric amount: '", "raw_closing_balance"),
        ),
        (is_blank(F.col("ledger_name")), "Ledger Name", FATAL, F.lit("Ledger Name cannot be empty.")),
        (is_blank(F.col("bank_name")), "Bank Name", FATAL, F.lit("Bank Name cannot be empty.")),
        (
            F.col("first_row").isNotNull(),
            "Duplicate",
            WARNING,
            F.concat(
                F.lit("Potential duplicate transaction matching Row "),
                F.col("first_row").cast("string"),
                F.lit(" (Date: "),
                F.date_format("date", "dd/MM/yyyy"),
                F.lit(", Amount: "),
                F.format_number(amount, 2),
                F.lit(", Ref: '"),
                F.coalesce("cheque_ref_no", F.lit("")),
                F.lit("')."),
            ),
        ),
    ]
    return F.array_compact(
        F.array(
            *[
                F.when(
                    cond,
                    F.struct(F.lit(column).alias("column"), F.lit(sev).alias("severity"), text.alias("message")),
                )
                for cond, column, sev, text in items
            ]
        )
    )


def validate_sheet(rows: DataFrame, key: str = "batch_id", hot: Hot | None = None) -> DataFrame:
    """Typed rows with ``issues`` and ``status`` (Invalid, Warning or Valid)."""
    out = held(flag_repeats(parse_rows(rows), key, hot).withColumn("issues", issue_list()), "issues")
    fatal = F.exists("issues", lambda i: i["severity"] == FATAL)
    status = F.when(fatal, "Invalid").when(F.size("issues") > 0, "Warning").otherwise("Valid")
    return out.withColumn("status", status).drop("_dr", "_cr")


def sheet_messages(validated: DataFrame, key: str = "batch_id") -> DataFrame:
    rows = validated.select(key, "row_number", F.explode("issues").alias("i"))
    text = F.concat(F.lit("Row "), F.col("row_number").cast("string"), F.lit(": "), F.col("i")["message"])
    return rows.select(key, "row_number", F.col("i")["column"].alias("column"), F.col("i")["severity"].alias("severity"), text.alias("message"))


def summarize_sheet(rows: DataFrame, validated: DataFrame, key: str = "batch_id") -> DataFrame:
    """Counts per batch; skipped rows come from the raw rows."""
    status = F.col("status")
    skipped = rows.groupBy(key).agg(
        F.count_if(~is_blank_row() & is_sample_row()).alias("samples_skipped"),
        F.count_if(is_blank_row()).alias("blank_skipped"),
    )
    counts = validated.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(status == "Valid").alias("valid_rows"),
        F.count_if(status == "Warning").alias("warning_rows"),
        F.count_if(status == "Invalid").alias("invalid_rows"),
    )
    out = skipped.join(counts, key, "left")
    zeroed = {c: F.coalesce(c, F.lit(0)) for c in ("total_rows", "valid_rows", "warning_rows", "invalid_rows")}
    ready = (F.col("total_rows") > 0) & (F.col("invalid_rows") == 0)
    return out.withColumns(zeroed).withColumn("is_ready", ready)


def filter_sheet(validated: DataFrame, status: str = "ALL", text: str = "") -> DataFrame:
    out = validated if status.upper() == "ALL" else validated.filter(F.upper("status") == status.upper())
    if text.strip():
        fields = ["narration", "ledger_name", "bank_name", "cheque_ref_no"]
        hit = contains_ci(fields[0], text)
        for field in fields[1:]:
            hit = hit | contains_ci(field, text)
        out = out.filter(hit)
    return out


def eligible(validated: DataFrame) -> DataFrame:
    """Rows that may become vouchers."""
    fatal = F.exists("issues", lambda i: i["severity"] == FATAL)
    return validated.filter((F.col("status") != "Invalid") & ~fatal)


def blocking_reason() -> Column:
    """First reason a row blocks voucher generation, in fixed order; null when it does not."""
    dr, cr = F.col("dr_amount"), F.col("cr_amount")
    has_dr, has_cr = F.coalesce(dr > 0, F.lit(False)), F.coalesce(cr > 0, F.lit(False))
    fatal = F.get(F.filter("issues", lambda i: i["severity"] == FATAL), F.lit(0))
    return (
        F.when(F.col("date").isNull(), "Date is required and must be valid.")
        .when(dr < 0, "Dr Amount cannot be negative.")
        .when(cr < 0, "Cr Amount cannot be negative.")
        .when(has_dr & has_cr, "Dr Amount and Cr Amount cannot both be populated.")
        .when(~has_dr & ~has_cr, "Either Dr Amount or Cr Amount must be greater than zero.")
        .when(is_blank(F.col("ledger_name")), "Ledger Name cannot be empty.")
        .when(is_blank(F.col("bank_name")), "Bank Name cannot be empty.")
        .when(fatal.isNotNull(), fatal["message"])
    )


def revalidate(validated: DataFrame, key: str = "batch_id") -> DataFrame:
    """First blocked row per batch with its reason; map-side ``min_by``."""
    rows = validated.withColumn("reason", blocking_reason()).filter("reason is not null")
    first = rows.groupBy(key).agg(F.min(F.struct("row_number", "reason")).alias("f"))
    return first.select(key, F.col("f.row_number").alias("row_number"), F.col("f.reason").alias("reason"))


def vouchers(validated: DataFrame, key: str = "batch_id") -> DataFrame:
    """One voucher per eligible row: Payment for a debit, Receipt for a credit."""
    is_dr = F.coalesce(F.col("dr_amount") > 0, F.lit(False))
    day = F.date_format("date", "yyyyMMdd")
    effective = F.date_format(F.coalesce("value_date", "date"), "yyyyMMdd")
    return eligible(validated).select(
        key,
        "row_number",
        F.when(is_dr, "Payment").otherwise("Receipt").alias("voucher_type"),
        day.alias("date"),
        effective.alias("effective_date"),
        F.when(~is_blank(F.col("cheque_ref_no")), F.col("cheque_ref_no")).alias("reference"),
        F.when(~is_blank(F.col("narration")), F.col("narration")).alias("narration"),
        F.when(is_dr, F.col("dr_amount")).otherwise(F.col("cr_amount")).alias("amount"),
        "ledger_name",
        "bank_name",
    )


def voucher_lines() -> Column:
    """Two opposite entries: the debited side first with a negative amount."""
    pays = F.col("voucher_type") == "Payment"
    first = F.when(pays, F.col("ledger_name")).otherwise(F.col("bank_name"))
    second = F.when(pays, F.col("bank_name")).otherwise(F.col("ledger_name"))

    def line(no: int, name: Column, positive: str, amount: Column) -> Column:
        return F.struct(
            F.lit(no).alias("line_no"),
            name.alias("ledger"),
            F.lit(positive).alias("is_deemed_positive"),
            amount.cast(MONEY).alias("amount"),
        )

    return F.array(line(1, first, "Yes", -F.col("amount")), line(2, second, "No", F.col("amount")))


def voucher_entries(headers: DataFrame, key: str = "batch_id") -> DataFrame:
    return headers.select(key, "row_number", F.inline(voucher_lines()))


def voucher_xml(headers: DataFrame, key: str = "batch_id") -> DataFrame:
    """One import message per voucher as text."""
    lines = F.transform(
        voucher_lines(),
        lambda e: F.struct(
            e["ledger"].alias("LEDGERNAME"),
            e["is_deemed_positive"].alias("ISDEEMEDPOSITIVE"),
            e["amount"].cast("string").alias("AMOUNT"),
        ),
    )
    voucher = F.struct(
        F.col("voucher_type").alias("_VCHTYPE"),
        F.lit("Create").alias("_ACTION"),
        F.col("date").alias("DATE"),
        F.col("effective_date").alias("EFFECTIVEDATE"),
        F.col("voucher_type").alias("VOUCHERTYPENAME"),
        F.col("reference").alias("REFERENCE"),
        F.col("narration").alias("NARRATION"),
        lines.alias("ALLLEDGERENTRIES.LIST"),
    )
    xml = F.regexp_replace(F.to_xml(voucher, {"rowTag": "VOUCHER"}), r">\s+<", "><")
    message = F.concat(F.lit('<TALLYMESSAGE xmlns:UDF="TallyUDF">'), xml, F.lit("</TALLYMESSAGE>"))
    return headers.select(key, "row_number", message.alias("xml"))


# The document around the messages.
ENVELOPE_HEAD = (
    "<ENVELOPE><HEADER><TALLYREQUEST>Import Data</TALLYREQUEST></HEADER><BODY><IMPORTDATA><REQUESTDESC>"
    "<REPORTNAME>Vouchers</REPORTNAME><STATICVARIABLES><SVCURRENTCOMPANY>{company}</SVCURRENTCOMPANY>"
    "</STATICVARIABLES></REQUESTDESC><REQUESTDATA>"
)
ENVELOPE_TAIL = "</REQUESTDATA></IMPORTDATA></BODY></ENVELOPE>"


def voucher_documents(headers: DataFrame, company: str | Column = "Company", key: str = "batch_id") -> DataFrame:
    """``(key, part, row_number, value)``: the lines of each batch's own import document; ``company`` may differ by batch."""
    name = F.coalesce(company if isinstance(company, Column) else F.lit(company), F.lit(""))
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        name = F.replace(name, F.lit(mark), F.lit(entity))
    before, after = ENVELOPE_HEAD.split("{company}")
    head = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>' + before), F.min(name), F.lit(after))
    edges = headers.groupBy(key).agg(head.alias("head")).select(
        key,
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("part"), F.col("head").alias("value")),
                F.struct(F.lit(2).alias("part"), F.lit(ENVELOPE_TAIL).alias("value")),
            )
        ),
    )
    body = voucher_xml(headers, key).select(key, F.lit(1).alias("part"), "row_number", F.col("xml").alias("value"))
    return body.unionByName(edges.withColumn("row_number", F.lit(0))).select(key, "part", "row_number", "value")


def write_voucher_files(headers: DataFrame, path: str, company: str | Column = "Company", key: str = "batch_id") -> None:
    """One folder per batch; its part files in order of name are one complete import document.

    Lines are dealt out in ranges of batch, part and row, so a batch with very many vouchers becomes several numbered parts in as many tasks.
    """
    order = [key, "part", "row_number"]
    lines = voucher_documents(headers, company, key).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select(key, "value").write.mode("overwrite").partitionBy(key).text(path)
