import datetime as dt

import pytest

from ledgerspark.operators.validate import summarize, validate


def one(df):
    return validate(df).orderBy("seq").collect()


def test_valid_credit(make):
    row = one(make({"amount": "50000.00", "credit": "50000.00", "balance": "150000.00"}))[0]
    assert (row.status, row.severity, row.is_ready) == ("VALID", "INFO", True)
    assert row.balance_status == "NOT_CHECKABLE"


@pytest.mark.parametrize(
    "fault, code",
    [
        ({"transaction_date": None}, "DATE_MISSING"),
        ({"transaction_date": dt.datetime(2002, 1, 1)}, "DATE_FUTURE"),
        ({"description": "  "}, "DESCRIPTION_BLANK"),
        ({"amount": "-1.00"}, "AMOUNT_NEGATIVE"),
        ({"amount": "0.00", "credit": None}, "AMOUNT_ZERO"),
        ({"debit": "100.00"}, "BOTH_SIDES"),
        ({"credit": None}, "NO_SIDE"),
        ({"credit": "0.00"}, "NO_POSITIVE_SIDE"),
        ({"credit": "-5.00"}, "SIDE_NEGATIVE"),
        ({"amount": "99.00"}, "CREDIT_DIFFERS"),
        ({"transaction_type": "Other"}, "TYPE_INVALID"),
    ],
)
def test_faults_are_invalid(make, fault, code):
    row = one(make(fault))[0]
    assert code in row.error_codes
    assert row.status == "INVALID" and not row.is_ready


def test_zero_amount_allowed_for_some_banks(make):
    row = one(make({"amount": "0.00", "credit": None, "bank_code": 5}))[0]
    assert row.status == "REVIEW"
    assert row.warning_codes == ["ZERO_MEMO", "ZERO_VALUE"]


def test_balance_chain(make):
    df = make(
        {"balance": "1100.00"},
        {"credit": None, "debit": "100.00", "transaction_type": "Debit", "balance": "1000.00"},
        {"balance": "1200.00"},
        {"balance": None},
        {"balance": "1300.00"},
    )
    rows = one(df)
    assert [r.balance_status for r in rows] == ["NOT_CHECKABLE", "BALANCED", "MISMATCH", "NOT_CHECKABLE", "NOT_CHECKABLE"]
    assert rows[2].warnings == ["Running balance mismatch: expected 1,100.00, actual 1,200.00 (diff: 100.00)."]


def test_duplicates_need_equal_balance(make):
    same = {"transaction_date": dt.datetime(2001, 1, 1)}
    assert [r.is_duplicate for r in one(make(same, same))] == [True, True]
    assert [r.is_duplicate for r in one(make(same, same | {"balance": "200.00"}))] == [False, False]


def test_corrected_and_summary(spark, make):
    df = make({}, {"balance": "200.00"}, {"description": " ", "balance": "300.00"})
    audit = spark.createDataFrame(
        [(1, None, 1, 1, 1), (3, dt.datetime(2001, 6, 1), 1, 3, 1)],
        "transaction_id long, value_date timestamp, source_page_number int, source_line_index int, correction_count long",
    )
    rows = validate(df, audit).orderBy("seq").collect()
    assert [r.status for r in rows] == ["CORRECTED", "VALID", "INVALID"]
    assert "VALUE_DATE_LATE" in rows[2].warning_codes
    s = summarize(validate(df, audit)).first()
    assert (s.total_transactions, s.corrected_count, s.valid_count, s.invalid_count) == (3, 1, 1, 1)
    assert (s.matched_count, s.mismatched_count, s.is_ready) == (2, 0, False)
    assert s.net_movement == 300


def test_debit_hides_credit_in_summary(make):
    s = summarize(validate(make({"debit": "100.00"}))).first()
    assert (s.debit_count, s.credit_count) == (1, 0)
