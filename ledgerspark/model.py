"""Schemas, code tables and shared constants of the ledger model."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
TOTAL = T.DecimalType(38, 2)
LEDGER_ORDER = ["transaction_date", "created_at", "seq", "id"]
AS_OF = dt.date(2001, 6, 1)

# Bank code, bank name, parser version.
BANKS = [
    (1, "HDFC Bank", "HDFC-v1"),
    (2, "YES BANK", "YES-v1"),
    (3, "Axis Bank", "AXIS-v1"),
    (4, "Central Bank of India", "CENTRAL-v1"),
    (5, "ICICI Bank", "ICICI-v1"),
    (6, "State Bank of India", "SBI-v1"),
    (7, "Bank of India", "BOI-v1"),
    (8, "Kotak Mahindra Bank", "KOTAK-v1"),
    (9, "Punjab National Bank", "PNB-v1"),
    (10, "Bank of Baroda", "BOB-v1"),
]
UNKNOWN_BANK = "Unknown Bank"
UNKNOWN_PARSER = "v1"
OTHER_BANK_CODE = 99
ZERO_AMOUNT_BANKS = (4, 5, 8)

# Processing status names; every other code reads Unknown.
STATUS_NAMES = {0: "ReadyForProcessing", 1: "Processing", 2: "Completed", 3: "Failed"}

TRANSACTION = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("transaction_date", T.TimestampType()),
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
        T.StructField("source_file_id", T.LongType()),
        T.StructField("client_id", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("value_date", T.TimestampType()),
        T.StructField("processing_warning", T.StringType()),
        T.StructField("defect", T.IntegerType()),
    ]
)

WORD = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("page_width", T.DoubleType()),
        T.StructField("page_height", T.DoubleType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("width", T.DoubleType()),
        T.StructField("height", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)


def code_case(code: Column, values: dict[int, str], default: str | None) -> Column:
    """A small fixed lookup as a ``CASE`` expression, so no join is planned."""
    items = iter(values.items())
    first_code, first_value = next(items)
    out = F.when(code == first_code, first_value)
    for key, value in items:
        out = out.when(code == key, value)
    return out.otherwise(F.lit(default))


def bank_name(code: Column, default: str = UNKNOWN_BANK) -> Column:
    return code_case(code, {c: n for c, n, _ in BANKS}, default)


def parser_version(code: Column) -> Column:
    return code_case(code, {c: v for c, _, v in BANKS}, UNKNOWN_PARSER)


def status_name(code: Column) -> Column:
    return code_case(code, STATUS_NAMES, "Unknown")
