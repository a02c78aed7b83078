from pyspark.sql import functions as F

from ledgerspark.functions import parse as P
from ledgerspark.operators import universal as U
from ledgerspark.operators import words as Wd
from ledgerspark.operators.ordered import find_hot
from ledgerspark.plans import QUERIES
from ledgerspark.sources import bridge

from conftest import SF

WORDS = "file_id long, page int, page_width double, page_height double, x double, y double, width double, height double, text string"


def some_words(spark):
    """Words out of order: ties, overlaps, drifting heights, several pages, one word alone, no text."""
    rows = []
    for file in (1, 2, 3):
        for k in range(file * 40):
            text = None if k % 17 == 3 else "w" * (k % 5 + 1)
            rows.append((file, 1 + k % file, 595.0, 842.0, float(k * 37 % 90), float(k * 13 % 60), 5.0 * (k % 5), float(k % 11), text))
    rows.append((4, 2, 595.0, 842.0, 1.0, 1.0, 5.0, 8.0, "alone"))
    return spark.createDataFrame(rows, WORDS)


def listed(lines):
    return sorted(map(str, lines.select(*sorted(lines.columns)).collect()))


def test_lines_inside_pages_are_those_of_windows(spark):
    words = some_words(spark)
    want = listed(Wd.build_lines(Wd.to_lines(words)))
    assert len(want) > 10 and listed(Wd.lines_of(words)) == want
    assert listed(Wd.lines_of(words, find_hot(words, "file_id", 50))) == want
    assert listed(Wd.lines_of(words, None, 3.0)) == listed(Wd.build_lines(Wd.to_lines(words, None, 3.0)))
    assert Wd.flatten_pages(Wd.page_words(words)).exceptAll(words).isEmpty()


def test_no_task_sorts_single_words(spark):
    """Words stay inside their pages: nothing is exploded before lines are made, and lines need no second exchange."""
    plan = QUERIES["line_text"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "inline(" not in plan and plan.count("Exchange hashpartitioning(l_orderkey") <= 2 and "hashpartitioning(file_id" not in plan


def test_large_ledgers_are_dealt_over_tasks_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(bridge, "ROWS_PER_TASK", 300)
    led = bridge.Ledger(spark, SF)
    many = led.transactions
    assert many.rdd.getNumPartitions() == -(-led.table("lineitem").count() // 300)
    monkeypatch.setattr(bridge, "ROWS_PER_TASK", 100_000)
    assert many.exceptAll(bridge.Ledger(spark, SF).transactions).agg(F.count("*")).first()[0] == 0


def test_columns_of_a_heading_are_those_of_its_tokens(spark):
    """Blank words, neighbours at the gap, two on one edge, and a page without a width."""
    word = "struct<x:double,text:string,y:double,width:double,height:double,piece:string>"
    heads = [
        (1, 595.0, [(50.0, "Txn"), (65.0, "Date"), (100.0, " "), (120.0, "Narration"), (180.0, "Debit"), (260.0, "Credit"), (260.0, "Dr"), (400.0, "Balance")]),
        (2, 0.0, [(10.0, "Balance")]),
        (3, None, [(10.0, "Other"), (200.0, "Value"), (230.0, "Date")]),
    ]
    rows = [(i, w, [(x, t, 1.0, 5.0 * len(t), 8.0, t) for x, t in words]) for i, w, words in heads]
    headers = spark.createDataFrame(rows, f"file_id long, page_width double, fragments array<{word}>")
    want = U.detect_columns(U.header_tokens(headers)).select("file_id", "columns")
    got = headers.select("file_id", U.layout_of(F.col("fragments"), F.col("page_width")).alias("columns"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3


def test_lines_are_not_written(spark, monkeypatch):
    """Neither the parse nor the structure of page 1 saves the lines of all files."""
    def fail(df):
        raise AssertionError("saved")

    monkeypatch.setattr(U, "checkpointed", fail)
    run = U.UniversalParse(bridge.Ledger(spark, SF).word_pages)
    plan = run.structure._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3 and "universal" not in plan
    assert run.cells._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 3


def test_large_files_have_the_structure_of_their_first_page(spark):
    led = bridge.Ledger(spark, SF)
    hot = find_hot(led.table("lineitem"), "l_orderkey", 9)
    assert hot is not None
    columns = ["file_id", "page", "line_no", "header_bottom", "top_bound", "bottom_bound", "columns"]
    plain = U.UniversalParse(led.word_pages).bounded.select(*columns)
    assert plain.exceptAll(U.UniversalParse(led.word_pages, hot).bounded.select(*columns)).isEmpty() and not plain.isEmpty()


def test_tables_and_repeated_lines_read_the_ledger_once(spark):
    for name in ("candidate_table", "repeated_lines", "repeated_line_flags"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 3, name


def test_repeated_lines_of_large_files(spark):
    lines = Wd.lines_of(bridge.Ledger(spark, SF).word_pages).select("file_id", "line_no", "page", "page_height", "y", "line_text")
    flags = ["file_id", "line_no", "is_header", "is_footer"]
    plain = Wd.flag_repeated(lines).select(*flags)
    assert plain.where("is_header OR is_footer").count() > 0
    assert plain.exceptAll(Wd.flag_repeated(lines, find_hot(lines, "file_id", 30)).select(*flags)).isEmpty()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_page_words_are_made_once(spark):
    """No filter below the lines, and no other column, repeats the expression that prints a page."""
    for name in ("line_text", "best_header_row", "scan_balances", "words_to_lines"):
        assert optimized(QUERIES[name](spark, SF)).count("Computer") == 1, name


def test_statements_are_read_once_for_rows_and_balances(spark):
    assert optimized(QUERIES["universal_parse"](spark, SF)).count("Relation [l_orderkey") == 1
    assert optimized(QUERIES["universal_route"](spark, SF)).count("Relation [l_orderkey") == 2


def test_balances_beside_lines_are_those_of_the_scan(spark):
    lines = [
        (1, 1, 1, "Opening Balance 5.00", ["5.00"]), (1, 2, 1, "b/f", ["x"]), (1, 3, 2, "Carried Forward 7.00 9.00", ["7.00", "9.00"]), (1, 4, 2, "closing balance", ["1.00"]),
        (2, 1, 1, "brought forward", ["-"]), (2, 2, 1, "B/F 3.00", ["3.00"]), (3, 1, 1, None, ["4.00"]), (None, 1, 1, "c/f", ["8.00"]),
    ]
    rows = [(f, n, p, t, 595.0, 842.0, 10.0 * n, 8.0, [(50.0, w, 10.0 * n, 20.0, 8.0, w) for w in ws]) for f, n, p, t, ws in lines]
    schema = "file_id long, line_no long, page int, line_text string, page_width double, page_height double, y double, height double, fragments array<struct<x:double,text:string,y:double,width:double,height:double,piece:string>>"
    df = spark.createDataFrame(rows, schema)
    names = ["file_id", "opening_balance", "closing_balance"]
    got = U.with_structure(df, stated=True).select(*names).distinct().filter("coalesce(opening_balance, closing_balance) is not null")
    want = U.scan_balances(df).select(*names)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.file_id: (str(r.opening_balance), str(r.closing_balance)) for r in want.collect()} == {1: ("5.00", "9.00"), 2: ("3.00", "None"), None: ("None", "8.00")}


def test_phrases_and_headings_are_those_of_their_patterns(spark):
    texts = [
        "Date", "DATE", "update", "Txn  Date", "Dr", "dr.", "hundred", "CR.", "crore", "Amount(INR)", "Deposit Balance", "Page 1", "Page", "page total", "B/F", "c/f", "Grand Total",
        "Computer Generated", "toll free", "DEBIT CREDIT", "Dr.Cr.", "drXcrX", "narration date", "", " ", "İdate", "daſte", "dİsclaimer", None,
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    score = sum((t.rlike(p).cast("int") for p in P.HEADER_CLASSES), F.lit(0))
    heads = sum((F.lower(t).rlike(p).cast("int") for p in P.HEADING_GROUPS), F.lit(0)) >= 2
    pairs = [
        (P.header_keyword_score(t), score), (P.is_column_header_line(t), heads), (P.is_summary_line(t), F.lower(t).rlike(P.SUMMARY_PHRASES)),
        (P.is_footer_line(t), F.lower(t).rlike(P.FOOTER_PHRASES)), (P.is_table_end(t), F.lower(t).rlike(P.TABLE_END_PHRASES)),
    ]
    for got, want in pairs:
        assert rows.filter(~got.eqNullSafe(want)).count() == 0


def test_words_get_the_first_column_that_holds_them(spark):
    columns = [(1, "B", 100.0, 150.0), (0, "A", 50.0, 100.0), (2, "C", 108.0, 160.0)]
    words = [(x, str(x), 10.0, 5.0, 8.0, "") for x in (0.0, 39.0, 40.0, 95.0, 94.9, 103.0, 102.9, 184.0, 185.0, 500.0)]
    schema = "file_id long, row_index long, row_page int, date_text string, columns array<struct<column_index:int,column_type:string,left_x:double,right_x:double>>, fragments array<struct<x:double,text:string,y:double,width:double,height:double,piece:string>>"
    df = spark.createDataFrame([(1, 1, 1, None, columns, words)], schema)
    got = {r.x: r.column_type for r in U.words_in_columns(df).collect()}
    assert got == {0.0: None, 39.0: None, 40.0: "A", 95.0: "B", 94.9: "A", 103.0: "C", 102.9: "B", 184.0: "C", 185.0: "C", 500.0: "C"}
    edited = {r.x: r.column_type for r in U.words_in_columns(df, edited=True).collect()}
    # As given: B to 45, A from 40 to 103, C from 98 to 185.
    assert edited == {40.0: "A", 95.0: "A", 94.9: "A", 102.9: "A", 103.0: "C", 184.0: "C"}
    # The interval of a column is found once for a line.
    assert optimized(U.words_in_columns(df)).count("array_sort") == 1
