"""Cell and row rules of single banks, and statements that the general heading analysis cannot read."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerspark.model import WORD
from ledgerspark.operators import profiles as Pf
from ledgerspark.operators import universal as U

CELL = (
    "file_id long, profile string, row_index long, page int, date_text string, line_date string, value_date_text string, "
    "reference string, debit_text string, credit_text string, amount_text string, indicator string, balance_text string, description string"
)
BALANCE = "file_id long, opening_balance decimal(18,2), closing_balance decimal(18,2)"


@pytest.fixture
def built(spark):
    """Transactions of one profile from short cell dicts."""

    def build(profile, *cells):
        names = [x.split()[0] for x in CELL.split(", ")]
        rows = []
        for i, cell in enumerate(cells, start=1):
            base = dict.fromkeys(names) | {"file_id": 1, "profile": profile, "row_index": i, "page": 1, "date_text": "01-02-2024"}
            rows.append(tuple((base | cell)[n] for n in names))
        made = Pf.with_cell_rules(spark.createDataFrame(rows, CELL))
        out = U.build_transactions(made.drop("profile"), spark.createDataFrame([], BALANCE))
        return Pf.with_row_rules(out.withColumn("parser_version", F.lit(profile))).orderBy("row_index").collect()

    return build


def test_overdrawn_balances_are_negative(built):
    cells = [{"debit_text": "10.00", "balance_text": "1,234.50 Dr"}, {"credit_text": "5.00", "balance_text": "20.00", "indicator": "Dr"}]
    for profile, want in (("CENTRAL-v1", -1), ("BOI-v1", -1), ("PNB-v1", 1)):
        assert [r.balance * want for r in built(profile, *cells)] == [Decimal("1234.50"), Decimal("20.00")]


def test_a_last_comma_can_be_the_decimal_point(built):
    cell = {"debit_text": "1,234,56", "balance_text": "9,00"}
    assert (built("SBI-v1", cell)[0].debit, built("SBI-v1", cell)[0].balance) == (Decimal("1234.56"), Decimal("9.00"))
    assert built("PNB-v1", cell)[0].debit == Decimal("123456")


def test_negative_amounts_are_reversals(built):
    got = built("HDFC-v1", {"debit_text": "-5.00", "balance_text": "1.00"}, {"credit_text": "-7.00", "balance_text": "1.00"})
    assert [(r.debit, r.credit) for r in got] == [(None, Decimal("5.00")), (Decimal("7.00"), None)]


def test_rows_that_are_no_transactions(built):
    note = {"description": "BS RT CHG 9.5", "balance_text": "1.00"}
    bare = {"description": "text"}
    paid = {"description": "paid", "debit_text": "1.00", "balance_text": "1.00"}
    assert [r.description for r in built("CENTRAL-v1", note, bare, paid)] == ["paid"]
    assert [r.description for r in built("BOB-v1", note, bare, paid)] == ["paid"]
    assert len(built("PNB-v1", note, bare, paid)) == 3


def test_references_from_the_narration(built):
    cell = {"description": "IMPS/123456789012/x", "debit_text": "1.00"}
    assert (built("ICICI-v1", cell)[0].reference, built("ICICI-v1", cell)[0].utr) == ("123456789012", "123456789012")
    assert built("BOB-v1", cell | {"description": "BARB0ABC12 pay"})[0].utr == "BARB0ABC12"
    assert built("BOB-v1", cell | {"reference": "R1"})[0].reference == "R1"


def words_of(spark, lines):
    """One page of words from ``(y, [(x, text), ...])``."""
    return spark.createDataFrame(
        [(1, 1, 842.0, 1190.0, float(x), float(y), 6.0 * len(t), 10.0, t) for y, line in lines for x, t in line], WORD
    )


def test_boi_bands_and_flags(spark):
    head = [(20, "SlNo"), (70, "Date"), (150, "Instruments"), (250, "Description"), (480, "Debit"), (560, "Credit"), (640, "Balance")]
    lines = [(100, head)]
    for i, (side, amount, balance, flag) in enumerate([(480, "10.00", "90.00", "Cr"), (480, "100.00", "10.00", "Dr"), (560, "30.00", "20.00", "Cr")]):
        row = [(20, str(i + 1)), (70, f"0{i + 1}-02-2024"), (250, "narration"), (side, amount), (640, balance), (745, flag)]
        lines.append((140 + 30 * i, row))
    run = U.UniversalParse(words_of(spark, lines))
    routed = spark.createDataFrame([(1, "BOI-v1")], "file_id long, profile string")
    got = Pf.parse_profiles(run, routed).orderBy("row_index").collect()
    assert [(r.debit, r.credit, r.balance) for r in got] == [
        (Decimal("10.00"), None, Decimal("90.00")),
        (Decimal("100.00"), None, Decimal("-10.00")),
        (None, Decimal("30.00"), Decimal("20.00")),
    ]


def test_a_known_bank_without_a_heading_is_still_read(spark):
    lines = [(200 + 30 * i, [(20, f"0{i + 1}-02-2024"), (120, "narration"), (365, "10.00"), (495, f"{90 - 10 * i}.00")]) for i in range(3)]
    run = U.UniversalParse(words_of(spark, lines))
    routed = spark.createDataFrame([(1, "SBI-v1")], "file_id long, profile string")
    got = Pf.parse_profiles(run, routed).orderBy("row_index").collect()
    assert [(r.debit, r.balance) for r in got] == [(Decimal("10.00"), Decimal(b)) for b in ("90.00", "80.00", "70.00")]


def test_a_second_amount_opens_a_block(spark):
    lines = [(200, [(20, "01/02/2024"), (150, "one"), (265, "10.00")]), (215, [(150, "two"), (265, "20.00")]), (228, [(150, "more")])]
    run = U.UniversalParse(words_of(spark, lines))
    bounded = U.with_page_bounds(run.lines, run.structure)
    marks = Pf.blocks(U.table_lines(bounded), Pf.shows_amount()).orderBy("line_no").collect()
    assert [m.block_no for m in marks] == [1, 2, 2]


def test_closing_balance_that_is_not_reached(spark):
    rows = spark.createDataFrame([(1, Decimal(5), None), (1, None, Decimal(2)), (2, Decimal(1), None)], "file_id long, debit decimal(18,2), credit decimal(18,2)")
    balances = spark.createDataFrame([(1, Decimal(10), Decimal(7)), (2, Decimal(10), Decimal(8))], BALANCE)
    assert [(r.file_id, r.reached) for r in Pf.closing_differences(rows, balances).collect()] == [(2, Decimal("9.00"))]
