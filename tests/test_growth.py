"""What a query writes and shuffles beside its answer, and that it reads its statements once."""

import glob
import os

from pyspark.sql import functions as F

from ledgerspark.functions.text import strip
from ledgerspark.operators import anchors as An
from ledgerspark.operators import sheets as S
from ledgerspark.plans import QUERIES
from ledgerspark.plans.stores import scratch
from ledgerspark.session import ensure_checkpoint_dir
from ledgerspark.sources import documents as D
from ledgerspark.sources.bridge import Ledger
from tests.conftest import SF

WORDS = "file_id long, page int, page_width double, page_height double, words array<struct<x:double,y:double,width:double,height:double,text:string,column_type:string>>"


def checkpoints(spark):
    ensure_checkpoint_dir(spark)
    return set(glob.glob(os.path.join(spark.sparkContext.getCheckpointDir().removeprefix("file:"), "rdd-*")))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_anchored_rows_write_and_shuffle_no_words(spark):
    before = checkpoints(spark)
    got = QUERIES["anchor_rows_on_baseline"](spark, SF)
    assert checkpoints(spark) == before
    # One reading of the rows: the ledger table is scanned once.
    assert plan(got).count("l_shipdate") and plan(got).count("l_tax#") and plan(got).count("Relation [l_orderkey") == 1


def test_anchors_of_a_page(spark):
    def w(x, y, text, kind, height=8.0):
        return (float(x), float(y), len(text) * 5.0, height, text, kind)

    heading = [w(260, 120, "Withdrawal", "Debit"), w(450, 120, "Balance", "Balance")]
    rows = [
        w(50, 130, "01/04/2001", "Date"), w(120, 130, "B/F", "Description"), w(450, 130, "7.00", "Balance"),
        w(50, 150, "02/04/2001", "Date"), w(60, 150, "03/04/2001", "Date"), w(120, 152, "first", "Description"), w(260, 150, "1.00", "Debit"), w(450, 153, "6.00", "Balance"),
        w(50, 165, "04/04/2001", "Date"), w(120, 165, "second", "Description"), w(120, 156, "lower", "Description"),
        w(50, 190, "05/04/2001", "Date"), w(340, 190, "2.00", "Credit"), w(450, 190, "8.00", "Balance"), w(120, 174, "third", "Description"), w(120, 720, "foot", "Description"),
    ]
    total = [w(50, 700, "TOTAL:", "Date"), w(120, 705, "after", "Description")]
    bare = [w(50, 150, "02/04/2001", "Date"), w(260, 150, "1.00", "Debit"), w(450, 150, "6.00", "Balance")]
    pages = spark.createDataFrame([(1, 1, 595.0, 842.0, heading + rows + total), (1, 2, 595.0, 842.0, bare), (1, 3, 595.0, 842.0, heading + bare), (2, 1, 595.0, 842.0, bare)], WORDS)
    got = An.rows_at_anchors(An.with_anchors(pages), 715.0).orderBy("file_id", "row_index").collect()
    assert [(r.row_index, r.page, r.date_text, str(r.debit), str(r.credit), str(r.balance), r.narration, str(r.opening_balance)) for r in got] == [
        (1, 1, "02/04/2001", "1.00", "None", "6.00", "first lower second", "7.00"),
        (2, 1, "05/04/2001", "None", "2.00", "8.00", "third", "7.00"),
        (3, 3, "02/04/2001", "1.00", "None", "6.00", "", "7.00"),
    ]


def test_extraction_documents_are_packed_and_pages_are_not_shuffled_again(spark):
    pages = Ledger(spark, SF).word_pages
    path = f"{scratch(Ledger(spark, SF))}/words"
    D.write_extraction(pages, path)
    parts = glob.glob(os.path.join(path.removeprefix("file:"), "part-*"))
    assert parts and all(p.endswith(".txt.gz") for p in parts)
    plain = pages.select(F.sum(F.length(F.to_json(F.struct("file_id", "page", "words"))))).first()[0]
    assert sum(os.path.getsize(p) for p in parts) < plain / 8
    assert D.read_extraction(spark, path).count() == pages.select(F.sum(F.size("words"))).first()[0]


def test_reprocessed_statements_are_read_once(spark):
    assert plan(QUERIES["review_reprocess"](spark, SF)).count("Relation [l_orderkey") == 1


def test_a_sheet_row_is_read_once_for_all_its_rules(spark):
    text = plan(QUERIES["sheet_filter"](spark, SF))
    # The text of a raw date is made of the ledger once, and the issues of a row are listed once.
    assert text.count("dd-MMM-yyyy, Some") == 1
    assert text.count("Ledger Name cannot be empty") == 1


def test_white_space_of_every_kind_is_trimmed(spark):
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace() and not 0x1C <= i <= 0x1F]
    texts = ["", " ", "a", "a b", "\n a　b \x85", "".join(spaces), *[f"{s}x{s}y{s}" for s in spaces], "​x​", "\x1cx"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    was = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert rows.filter(~strip("t").eqNullSafe(was)).count() == 0
    assert "regexp" not in plan(rows.select(strip("t")))


def test_held_columns_keep_rows_and_names(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, 3)], "k int, t string, n int")
    out = S.held(rows, "t", "n")
    assert sorted(map(tuple, out.select("k", "t", "n").collect())) == sorted(map(tuple, rows.collect()))
