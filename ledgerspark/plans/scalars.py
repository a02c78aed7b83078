"""Queries over the scalar functions, on text written out from the ledger and on whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import parse as P
from ledgerspark.functions import text as X
from ledgerspark.functions.sql import register_functions
from ledgerspark.model import MONEY, bank_name
from ledgerspark.plans.listing import BANK_SQL
from ledgerspark.plans.registry import query
from ledgerspark.sources.bridge import Ledger


def pick(by: str, *options: Column) -> Column:
    """One of the options by ``by`` modulo their number."""
    n = len(options)
    out = F.when(F.col(by) % n == 0, options[0])
    for i, option in enumerate(options[1:], start=1):
        out = out.when(F.col(by) % n == i, option)
    return out


def txt(name: str = "amount") -> Column:
    return F.col(name).cast("string")


@query(
    "parse_amount_universal",
    """SELECT id, CASE seq % 6 WHEN 2 THEN -abs(amount) WHEN 4 THEN NULL ELSE amount END AS amount FROM ledger""",
)
def parse_amount_universal(led: Ledger) -> DataFrame:
    raw = pick(
        "seq",
        F.concat(F.lit("₹ "), txt()),
        F.concat(txt(), F.lit(" Cr.")),
        F.concat(F.lit("("), F.abs("amount").cast("string"), F.lit(")")),
        F.concat(F.lit(" INR "), txt()),
        F.lit("12345678901"),
        F.concat(F.lit("Rs."), txt(), F.lit("Dr")),
    )
    return led.ledger.select("id", P.parse_amount_universal(raw).alias("amount"))


@query(
    "parse_amount_drcr",
    """SELECT id, CASE seq % 3 WHEN 0 THEN -abs(amount) WHEN 1 THEN abs(amount) ELSE amount END AS kept,
 CASE seq % 3 WHEN 0 THEN -abs(amount) ELSE abs(amount) END AS sized FROM ledger""",
)
def parse_amount_drcr(led: Ledger) -> DataFrame:
    raw = pick("seq", F.concat(txt(), F.lit(" DR")), F.concat(txt(), F.lit("Cr")), txt())
    return led.ledger.select(
        "id", P.parse_amount_drcr(raw, True).alias("kept"), P.parse_amount_drcr(raw).alias("sized")
    )


@query(
    "parse_amount_sheet",
    "SELECT id, CASE seq % 4 WHEN 3 THEN NULL ELSE amount END AS amount FROM ledger",
)
def parse_amount_sheet(led: Ledger) -> DataFrame:
    raw = pick("seq", F.concat(F.lit("$"), txt()), F.concat(txt(), F.lit(" dr")), txt(), F.concat(txt(), F.lit("x")))
    return led.ledger.select("id", P.parse_amount_sheet(raw).alias("amount"))


@query(
    "parse_balance_signed",
    "SELECT id, CASE seq % 2 WHEN 0 THEN -balance ELSE balance END AS balance FROM ledger",
)
def parse_balance_signed(led: Ledger) -> DataFrame:
    raw = pick("seq", F.concat(txt("balance"), F.lit(" Dr")), F.concat(txt("balance"), F.lit("Cr")))
    return led.ledger.select("id", P.parse_balance_signed(raw).alias("balance"))


@query(
    "parse_date_multi",
    "SELECT id, CASE seq % 8 WHEN 7 THEN NULL ELSE CAST(transaction_date AS DATE) END AS day FROM ledger",
)
def parse_date_multi(led: Ledger) -> DataFrame:
    day = F.col("transaction_date")
    formats = ["dd/MM/yyyy", "d.M.yy", "dd MMM yyyy", "d-MMM-yyyy", "dd MMMM yyyy", "yyyy/MM/dd", "d-M-yy"]
    raw = pick("seq", *[F.date_format(day, f) for f in formats], F.lit("31/02/1999"))
    return led.ledger.select("id", P.parse_date_multi(F.upper(raw)).alias("day"))


@query(
    "parse_date_sheet",
    """SELECT id, CASE seq % 6 WHEN 5 THEN NULL WHEN 4 THEN CASE WHEN day(transaction_date) <= 12
 THEN make_date(year(transaction_date), day(transaction_date), month(transaction_date))
 ELSE CAST(transaction_date AS DATE) END ELSE CAST(transaction_date AS DATE) END AS day FROM ledger""",
)
def parse_date_sheet(led: Ledger) -> DataFrame:
    day = F.col("transaction_date")
    formats = ["dd/MM/yyyy", "d-MMM-yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy"]
    raw = pick("seq", *[F.date_format(day, f) for f in formats], F.lit("1999-02-30"))
    return led.ledger.select("id", P.parse_date_sheet(raw).alias("day"))


@query(
    "token_tests",
    """SELECT id, seq % 3 = 0 AS is_date, seq % 3 = 1 AS is_amount FROM ledger""",
)
def token_tests(led: Ledger) -> DataFrame:
    raw = pick("seq", F.date_format("transaction_date", "dd/MM/yyyy"), F.concat(txt(), F.lit(" Cr")), F.lit("NEFT-1"))
    return led.ledger.select("id", P.is_date_token(raw).alias("is_date"), P.is_amount_token(raw).alias("is_amount"))


@query(
    "extract_identifiers",
    """SELECT id, CASE seq % 6 WHEN 0 THEN 'ABCD' || k14 WHEN 1 THEN k12 WHEN 2 THEN k12 WHEN 3 THEN k12
 WHEN 4 THEN 'abcdefgh' || k12 END AS reference, CASE seq % 6 WHEN 0 THEN 'ABCD' || k14 WHEN 1 THEN k12 WHEN 3 THEN k12 END
 AS utr FROM (SELECT *, lpad(CAST(id AS VARCHAR), 14, '0') k14, lpad(CAST(id AS VARCHAR), 12, '0') k12 FROM ledger)""",
)
def extract_identifiers(led: Ledger) -> DataFrame:
    k14, k12 = F.lpad(txt("id"), 14, "0"), F.lpad(txt("id"), 12, "0")
    raw = pick(
        "seq",
        F.concat(F.lit("NEFT-ABCD"), k14, F.lit(" to shop")),
        F.concat(F.lit("MMT/IMPS/"), k12, F.lit("/rent")),
        F.concat(F.lit("NFS/CASH WDL/"), k12),
        F.concat(F.lit("UPI/"), k12, F.lit("/tea")),
        F.concat(F.lit("BIL/UPIabcdefgh"), k12),
        F.col("description"),
    )
    return led.ledger.select("id", F.inline(F.array(P.extract_identifiers(raw))))


@query(
    "extract_utr_prefixed",
    """SELECT id, coalesce(nullif(reference, ''), u) AS reference, u AS utr FROM (SELECT id, reference, CASE seq % 3
 WHEN 0 THEN 'BARB0' || CAST(id AS VARCHAR) WHEN 1 THEN 'UPI/' || CAST(id AS VARCHAR) || '/x' END u FROM ledger)""",
)
def extract_utr_prefixed(led: Ledger) -> DataFrame:
    raw = pick(
        "seq",
        F.concat(F.lit("TO BARB0"), txt("id"), F.lit(" OK")),
        F.concat(F.lit("BY UPI/"), txt("id"), F.lit("/x end")),
        F.lit("cash"),
    )
    return led.ledger.select("id", F.inline(F.array(P.extract_utr_prefixed(raw, F.col("reference"), 10))))


@query(
    "normalize_ws",
    r"SELECT doc_id, regexp_replace(regexp_replace(text, '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') AS text FROM documents",
)
def normalize_ws(led: Ledger) -> DataFrame:
    return led.table("documents").select("doc_id", X.normalize_ws("text").alias("text"))


@query("mask_digits", r"SELECT id, regexp_replace(description || ' 12 a1', '\b\d+\b', '#', 'g') AS text FROM ledger")
def mask_digits(led: Ledger) -> DataFrame:
    return led.ledger.select("id", X.mask_digits(F.concat("description", F.lit(" 12 a1"))).alias("text"))


CLASS_WORDS = [
    ("Value Dt", "ValueDate"),
    ("Post Date", "Date"),
    ("S.No", "SerialNumber"),
    ("Chq / Ref", "Reference"),
    ("Debit/Credit", "Debit"),
    ("Deposit Amount", "Credit"),
    ("Closing", "Balance"),
    ("Transaction Details", "Description"),
    ("D/C", "Indicator"),
    ("Txn Amount", "SignedAmount"),
    ("Branch Name", "Branch"),
    ("Other", "Unknown"),
]


@query(
    "classify_column",
    "SELECT id, (["
    + ", ".join(f"'{t}'" for _, t in CLASS_WORDS)
    + f"])[1 + seq % {len(CLASS_WORDS)}] AS column_type FROM ledger",
)
def classify_column(led: Ledger) -> DataFrame:
    raw = F.get(F.array(*[F.lit(w) for w, _ in CLASS_WORDS]), F.col("seq") % len(CLASS_WORDS))
    return led.ledger.select("id", P.classify_column(raw).alias("column_type"))


_SCORE = " + ".join(
    f"CAST(regexp_matches(text, '{p}') AS INT)" for p in [q.replace("(?i)", "(?i)") for q in P.HEADER_CLASSES]
)


@query("header_keyword_score", f"SELECT doc_id, {_SCORE} AS score FROM documents")
def header_keyword_score(led: Ledger) -> DataFrame:
    return led.table("documents").select("doc_id", P.header_keyword_score(F.col("text")).alias("score"))


_HEADING = " + ".join(f"CAST(regexp_matches(lower(text), '{p}') AS INT)" for p in P.HEADING_GROUPS)


@query(
    "line_predicates",
    f"""SELECT doc_id, regexp_matches(lower(text), '{P.SUMMARY_PHRASES}') AS is_summary,
 regexp_matches(lower(text), '{P.FOOTER_PHRASES}') AS is_footer, {_HEADING} >= 2 AS is_heading FROM documents""",
)
def line_predicates(led: Ledger) -> DataFrame:
    text = F.col("text")
    return led.table("documents").select(
        "doc_id",
        P.is_summary_line(text).alias("is_summary"),
        P.is_footer_line(text).alias("is_footer"),
        P.is_column_header_line(text).alias("is_heading"),
    )


@query(
    "safe_export_name",
    f"""SELECT id, 'Ledger_' || left(replace({BANK_SQL.format(c='o', e="'Unknown Bank'")}, ' ', '_'), 20) || '_' ||
 regexp_replace(original_file_name, '[.][^.]*$', '') || '_' || strftime(uploaded_at, '%Y%m%d') || '.xlsx' AS name
 FROM (SELECT *, id % 12 o FROM file_records)""",
)
def safe_export_name(led: Ledger) -> DataFrame:
    bank = bank_name((F.col("id") % 12).cast("int"))
    return led.file_records.select(
        "id", P.safe_export_name(F.col("original_file_name"), bank, F.col("uploaded_at")).alias("name")
    )


@query(
    "reversal_side",
    """SELECT id, CASE WHEN seq % 4 = 1 THEN credit ELSE CASE WHEN seq % 4 = 0 THEN NULL ELSE debit END END AS debit,
 CASE WHEN seq % 4 = 0 THEN debit WHEN seq % 4 = 1 THEN NULL ELSE credit END AS credit FROM ledger
 WHERE (debit IS NULL OR credit IS NULL)""".replace(
        "CASE WHEN seq % 4 = 1 THEN credit ELSE CASE WHEN seq % 4 = 0 THEN NULL ELSE debit END END",
        "CASE WHEN seq % 4 = 0 AND debit IS NOT NULL THEN NULL WHEN seq % 4 = 1 AND credit IS NOT NULL THEN credit ELSE debit END",
    ).replace(
        "CASE WHEN seq % 4 = 0 THEN debit WHEN seq % 4 = 1 THEN NULL ELSE credit END",
        "CASE WHEN seq % 4 = 0 AND debit IS NOT NULL THEN debit WHEN seq % 4 = 1 AND credit IS NOT NULL THEN NULL ELSE credit END",
    ),
)
def reversal_side(led: Ledger) -> DataFrame:
    """One-sided rows with the sign of some withdrawals and deposits turned round."""
    rows = led.ledger.filter("debit is null or credit is null")
    withdrawal = F.when(F.col("seq") % 4 == 0, -F.col("debit")).otherwise(F.col("debit"))
    deposit = F.when(F.col("seq") % 4 == 1, -F.col("credit")).otherwise(F.col("credit"))
    sides = P.reversal_sides(withdrawal, deposit)
    return rows.select("id", sides["debit"].alias("debit"), sides["credit"].alias("credit"))


@query(
    "canonical_amount",
    """SELECT id, CASE WHEN debit > 0 THEN debit WHEN credit > 0 THEN credit ELSE 0 END AS amount,
 CASE WHEN debit > 0 THEN 'Debit' WHEN credit > 0 THEN 'Credit' ELSE 'Unknown' END AS transaction_type FROM ledger""",
)
def canonical_amount(led: Ledger) -> DataFrame:
    return led.ledger.select("id", F.inline(F.array(P.canonical_amount(F.col("debit"), F.col("credit")))))


@query("repair_decimal_separator", "SELECT id, CAST(amount AS VARCHAR) AS repaired FROM ledger")
def repair_decimal_separator(led: Ledger) -> DataFrame:
    broken = F.regexp_replace(txt(), r"\.", ",")
    return led.ledger.select("id", P.repair_decimal_separator(broken).alias("repaired"))


@query(
    "period_from_dates",
    """SELECT id, strftime(a, '%d-%m-%Y') AS period_from, CASE WHEN a <> b THEN strftime(b, '%d-%m-%Y') END AS period_to
 FROM (SELECT id, transaction_date a, value_date b FROM ledger)""",
)
def period_from_dates(led: Ledger) -> DataFrame:
    a, b = F.date_format("transaction_date", "dd-MM-yyyy"), F.date_format("value_date", "dd-MM-yyyy")
    text = F.concat_ws(" ", F.lit("from"), a, F.lit("and"), a, F.lit("to"), b)
    return led.ledger.select("id", F.inline(F.array(P.period_from_dates(text))))


@query(
    "distinct_tokens",
    """SELECT id, array_to_string(list_transform(list_sort(list_distinct(string_split(description || ' ' || description, ' '))),
 lambda x: x), ',') AS tokens FROM ledger""",
)
def distinct_tokens(led: Ledger) -> DataFrame:
    twice = F.split(F.concat_ws(" ", "description", "description"), " ")
    return led.ledger.select("id", F.array_join(F.array_sort(F.array_distinct(twice)), ",").alias("tokens"))


@query(
    "dedupe_serial",
    """SELECT source_file_id, CAST(seq % 50 AS INT) AS serial, min(seq) AS kept_seq FROM ledger
 GROUP BY source_file_id, seq % 50""",
)
def dedupe_serial(led: Ledger) -> DataFrame:
    """The first row of every serial number wins; a map-side ``min_by`` instead of a sort per file."""
    rows = led.ledger.withColumn("serial", (F.col("seq") % 50).cast("int"))
    first = rows.groupBy("source_file_id", "serial").agg(F.min_by(F.struct("id", "seq"), "seq").alias("r"))
    return first.select("source_file_id", "serial", F.col("r.seq").alias("kept_seq"))


@query(
    "parse_summary",
    """SELECT source_file_id, count(*) AS detected, count(*) FILTER (amount > 0) AS processed,
 count(*) FILTER (amount <= 0) AS rejected, count(processing_warning) AS warnings,
 round_even(avg(CASE WHEN processing_warning IS NULL THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END), 2) AS confidence FROM ledger
 GROUP BY source_file_id""",
)
def parse_summary(led: Ledger) -> DataFrame:
    warned = F.col("processing_warning").isNotNull()
    good = F.col("amount") > 0
    return led.ledger.groupBy("source_file_id").agg(
        F.count(F.lit(1)).alias("detected"),
        F.count_if(good).alias("processed"),
        F.count_if(~good).alias("rejected"),
        F.count_if(warned).alias("warnings"),
        F.bround(F.avg(F.when(warned, 0.75).otherwise(1.0)), 2).alias("confidence"),
    )


@query(
    "sql_functions",
    """SELECT id, trim(description) AS stripped, amount, -balance AS overdrawn,
 coalesce(transaction_type, CASE WHEN debit IS NOT NULL THEN 'Debit' ELSE 'Credit' END) AS kind FROM ledger""",
)
def sql_functions(led: Ledger) -> DataFrame:
    """The same helpers through SQL."""
    register_functions(led.spark)
    return led.ledger.selectExpr(
        "id",
        "ledger_strip(description) AS stripped",
        "ledger_amount_sheet(concat('₹', cast(amount AS string), ' Cr')) AS amount",
        "cast(ledger_balance_signed(concat(cast(balance AS string), ' Dr')) AS decimal(18,2)) AS overdrawn",
        "ledger_default_type(transaction_type, debit) AS kind",
    )


@query(
    "sql_dates",
    """SELECT id, CAST(transaction_date AS DATE) AS day, CAST(value_date AS DATE) AS named_day, CAST(transaction_date AS DATE) AS sheet_day,
 -amount AS overdrawn, true AS is_date, false AS is_amount FROM ledger""",
)
def sql_dates(led: Ledger) -> DataFrame:
    """Dates, tokens and marked amounts through SQL."""
    register_functions(led.spark)
    return led.ledger.selectExpr(
        "id",
        "ledger_date(date_format(transaction_date, 'dd/MM/yyyy')) AS day",
        "ledger_date(upper(date_format(value_date, 'dd MMM yyyy'))) AS named_day",
        "ledger_date_sheet(date_format(transaction_date, 'd-M-yyyy')) AS sheet_day",
        "CAST(ledger_amount_drcr(concat(CAST(abs(amount) AS STRING), CASE WHEN amount < 0 THEN ' Cr' ELSE ' Dr' END)) AS DECIMAL(18,2)) AS overdrawn",
        "ledger_is_date(date_format(transaction_date, 'dd/MM/yyyy')) AS is_date",
        "ledger_is_amount(date_format(transaction_date, 'dd/MM/yyyy')) AS is_amount",
    )


@query(
    "sql_table_functions",
    """SELECT id, CASE WHEN id % 2 = 0 THEN lpad(CAST(id AS VARCHAR), 16, '0') ELSE lpad(CAST(id AS VARCHAR), 12, '0') END AS reference,
 CASE WHEN id % 2 = 0 THEN lpad(CAST(id AS VARCHAR), 16, '0') END AS utr, CAST(transaction_date AS DATE) AS start, CAST(value_date AS DATE) AS end
 FROM ledger""",
)
def sql_table_functions(led: Ledger) -> DataFrame:
    """Identifiers and statement periods as table functions in a lateral join."""
    register_functions(led.spark)
    led.ledger.selectExpr(
        "id",
        "CASE WHEN id % 2 = 0 THEN concat('NEFT-', lpad(CAST(id AS STRING), 16, '0')) ELSE concat('NFS/', lpad(CAST(id AS STRING), 12, '0')) END AS said",
        "concat('Statement From : ', date_format(transaction_date, 'dd/MM/yyyy'), ' To : ', date_format(value_date, 'dd/MM/yyyy')) AS head",
    ).createOrReplaceTempView("ledger_said")
    return led.spark.sql(
        "SELECT id, i.reference, i.utr, p.start, p.end FROM ledger_said, LATERAL ledger_identifiers(said) i, LATERAL ledger_period_hdfc(head) p"
    )


@query(
    "row_confidence",
    """SELECT id, round(greatest(0.1, least(1.0, 0.95 - CASE WHEN amount <= 0 THEN 0.3 ELSE 0 END
 - CASE WHEN transaction_type IS NULL THEN 0.25 ELSE 0 END - CASE WHEN balance IS NULL THEN 0.2 ELSE 0 END
 - CASE WHEN trim(description) = '' THEN 0.15 ELSE 0 END - CASE WHEN carry_balance IS NOT NULL AND balance IS NOT NULL
 AND (debit IS NOT NULL OR credit IS NOT NULL) AND abs(carry_balance + CASE WHEN debit IS NOT NULL THEN -debit
 ELSE coalesce(credit, 0) END - balance) > 0.05 THEN 0.1 ELSE 0 END)), 4) AS axis,
 CASE WHEN debit IS NULL AND credit IS NULL THEN 0.5 WHEN debit IS NOT NULL AND credit IS NOT NULL THEN 0.6 ELSE 0.95 END AS yes
 FROM ordered_rows""",
)
def row_confidence(led: Ledger) -> DataFrame:
    from ledgerspark.operators import continuity as C

    rows = C.continuity(led.ledger, "axis", hot=led.hot)
    return rows.select(
        "id",
        F.round(C.penalty_confidence(F.lit(True)), 4).alias("axis"),
        C.capped_confidence(F.lit(0.95), F.lit(True)).alias("yes"),
    )
