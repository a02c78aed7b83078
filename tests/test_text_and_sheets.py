import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import parse as P
from ledgerspark.functions.text import strip
from ledgerspark.operators import sheets as S
from ledgerspark.operators.listing import format_bytes


def ask(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.v for r in df.select("i", fn(F.col("s")).alias("v")).orderBy("i").collect()]


def test_amounts(spark):
    got = ask(spark, ["₹ 1,23,456.78", "(500.00)", "INR 10", "1,000.50 Dr.", "123456789012", "-5", "5-", "x"], P.parse_amount_universal)
    assert got == [D("123456.78"), D("-500.00"), D("10.00"), D("1000.50"), None, D("-5.00"), D("-5.00"), None]
    assert ask(spark, ["100 Dr", "-100Cr", "-7"], lambda c: P.parse_amount_drcr(c, True)) == [D(-100), D(100), D(-7)]
    assert ask(spark, ["1,000.00Dr", "1,000.00 Cr"], P.parse_balance_signed) == [D(-1000), D(1000)]


def test_dates(spark):
    got = ask(spark, ["01/02/2024", "1.2.49", "1-2-50", "5 Mar 2024", "5 march 2024", "2024/12/31", "31/02/2024"], P.parse_date_multi)
    assert got == [
        dt.date(2024, 2, 1), dt.date(2049, 2, 1), dt.date(1950, 2, 1), dt.date(2024, 3, 5), dt.date(2024, 3, 5),
        dt.date(2024, 12, 31), None,
    ]
    got = ask(spark, ["03/04/2024", "12/31/2024", "2024-01-05", "soon"], P.parse_date_sheet)
    assert got == [dt.date(2024, 4, 3), dt.date(2024, 12, 31), dt.date(2024, 1, 5), None]


def test_strip_handles_unicode_space(spark):
    assert ask(spark, [" a b "], strip) == ["a b"]


@pytest.mark.parametrize(
    "phrase, kind",
    [("Value Date", "ValueDate"), ("Txn Date", "Date"), ("Debit/Credit", "Debit"), ("D/C", "Indicator"), ("Cr", "Credit"), ("Amount (INR)", "SignedAmount")],
)
def test_column_phrases(spark, phrase, kind):
    assert ask(spark, [phrase], P.classify_column) == [kind]


RAW = "batch_id long, row_number int, " + ", ".join(f"{c} string" for c in S.RAW_COLUMNS)


def sheet(spark, *rows):
    base = ["15/05/2024", "Rent", "REF1", None, "100.00", None, "900.00", "Rent A/c", "HDFC Bank"]
    out = []
    for i, changes in enumerate(rows, start=2):
        row = list(base)
        for name, value in changes.items():
            row[S.RAW_COLUMNS.index(name)] = value
        out.append((1, i, *row))
    return spark.createDataFrame(out, RAW)


def test_sheet_rules(spark):
    df = sheet(
        spark,
        {},
        {},
        {"raw_date": "soon"},
        {"raw_dr_amount": "-5"},
        {"raw_cr_amount": "7"},
        {"raw_dr_amount": None},
        {"raw_ledger_name": " "},
        {"raw_narration": "[Sample] row"},
        {n: None for n in S.RAW_COLUMNS},
    )
    rows = S.validate_sheet(df).orderBy("row_number").collect()
    assert [r.status for r in rows] == ["Valid", "Warning"] + ["Invalid"] * 5
    assert rows[1].issues[0].message.startswith("Potential duplicate transaction matching Row 2 (Date: 15/05/2024")
    summary = S.summarize_sheet(df, S.validate_sheet(df)).first()
    assert (summary.total_rows, summary.samples_skipped, summary.blank_skipped, summary.is_ready) == (7, 1, 1, False)


def test_vouchers_balance_and_escape(spark, tmp_path):
    df = sheet(spark, {"raw_narration": "A & B <x>"}, {"raw_dr_amount": None, "raw_cr_amount": "50", "raw_cheque_ref_no": None})
    heads = S.vouchers(S.validate_sheet(df))
    lines = S.voucher_entries(heads)
    assert lines.groupBy("row_number").agg(F.sum("amount").alias("t")).filter("t <> 0").count() == 0
    xml = [r.xml for r in S.voucher_xml(heads).orderBy("row_number").collect()]
    assert "<NARRATION>A &amp; B &lt;x></NARRATION>" in xml[0] or "A &amp; B &lt;x&gt;" in xml[0]
    assert "REFERENCE" not in xml[1] and 'VCHTYPE="Receipt"' in xml[1]
    two = heads.unionByName(heads.withColumn("batch_id", F.lit(77).cast(heads.schema["batch_id"].dataType)))
    S.write_voucher_files(two, str(tmp_path / "xml"), "Shop & Co")
    files = list((tmp_path / "xml").rglob("part-*"))
    assert len(files) == 2  # a batch is one whole document
    for text in (p.read_text() for p in files):
        assert text.startswith("<?xml") and text.count("<TALLYMESSAGE") == 2 and "Shop &amp; Co" in text
        assert text.count("<ENVELOPE>") == 1 and text.strip().endswith("</ENVELOPE>")


def test_read_sheet_needs_all_headers(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("Txn Date,Particulars,Chq/Ref No,Value Dt,Debit,Credit,Balance,Ledger,Bank\n1/1/2024,a,b,,1,,2,c,d\n")
    assert S.read_sheet(spark, str(good)).first().raw_narration == "a"
    bad = tmp_path / "bad.csv"
    bad.write_text("Date,Narration\n1,2\n")
    with pytest.raises(ValueError, match="Cr Amount"):
        S.read_sheet(spark, str(bad))


def test_sizes_half_way_go_to_the_even_hundredth(spark):
    sizes = [1023, 128 * 1024 + 128, 128 * 1024 + 384, 2**20 + 2**17, 2**20 + 3 * 2**17, 2**30 + 2**27, 2**30 + 3 * 2**27]
    rows = spark.createDataFrame([(s,) for s in sizes], "size long").select(format_bytes(F.col("size"))).collect()
    assert [r[0] for r in rows] == ["1023 B", "128.12 KB", "128.38 KB", "1.12 MB", "1.38 MB", "1.12 GB", "1.38 GB"]
