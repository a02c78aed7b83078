"""Statements of unknown layout: header, columns, rows, cells, transactions, confidence and routing."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions import parse as P
from ledgerspark.functions.text import strip
from ledgerspark.model import MONEY
from ledgerspark.operators import continuity as C
from ledgerspark.operators.ordered import (
    Hot,
    lag,
    last_before,
    last_upto,
    max_before,
    rownum,
    running_max,
    running_sum,
    with_group,
    with_ordered,
)
from ledgerspark.operators.words import lines_of, named
from ledgerspark.session import checkpointed

ENGINE = "Universal-v2-extraction"
REVIEW_REQUIRED, COMPLETED = 6, 2


def best_header(lines: DataFrame) -> DataFrame:
    """Best heading line of page 1 per file: most keyword classes, at least three, the first on a tie."""
    scored = named(lines.filter("page = 1"), "score", P.header_keyword_score(F.col("line_text")))
    scored = scored.filter("score >= 3")
    line = F.struct("line_no", "line_text", "y", "height", "page_width", "fragments", "score")
    best = scored.groupBy("file_id").agg(F.min_by(line, F.struct(-F.col("score"), F.col("line_no"))).alias("h"))
    return best.select("file_id", "h.*")


def header_tokens(headers: DataFrame, hot: Hot | None = None, gap: float = 15.0) -> DataFrame:
    """Phrases of the heading line: neighbours closer than ``gap`` belong together."""
    frags = headers.select("file_id", "page_width", F.inline("fragments")).filter(strip("text") != "")
    right = F.col("x") + F.col("width")
    frags = with_ordered(frags, ["file_id"], ["x", "text"], {"_r": lag(right)}, hot)
    frags = frags.withColumn("_new", F.coalesce(F.col("x") - F.col("_r") >= gap, F.lit(True)).cast("int"))
    frags = with_ordered(frags, ["file_id"], ["x", "text"], {"token_no": running_sum(F.col("_new"))}, hot)
    words = F.array_sort(F.collect_list(F.struct("x", "text")))
    return frags.groupBy("file_id", "token_no").agg(
        strip(F.array_join(words["text"], " ")).alias("phrase"),
        F.min("x").alias("left_x"),
        F.first("page_width").alias("page_width"),
    )


def detect_columns(tokens: DataFrame) -> DataFrame:
    """One row per file with its ordered column layout (a heading line has only a handful of phrases)."""
    kind = P.classify_column(F.col("phrase"))
    column = F.struct(
        "token_no",
        "left_x",
        F.col("phrase").alias("header_text"),
        kind.alias("column_type"),
        F.when(kind != "Unknown", 0.90).otherwise(0.40).alias("confidence"),
    )
    per_file = tokens.groupBy("file_id").agg(
        F.array_sort(F.collect_list(column)).alias("cols"), F.first("page_width").alias("page_width")
    )
    width = F.col("page_width")

    def edged(c: Column, i: Column) -> Column:
        nxt = F.get("cols", i + 1)["left_x"]
        last = F.when(width > 0, width - 20.0).otherwise(c["left_x"] + 100.0)
        return F.struct(
            i.alias("column_index"),
            c["column_type"].alias("column_type"),
            c["header_text"].alias("header_text"),
            c["left_x"].alias("left_x"),
            F.coalesce(nxt, last).alias("right_x"),
            c["confidence"].alias("confidence"),
        )

    return per_file.select("file_id", "page_width", F.transform("cols", edged).alias("columns"))


def layout_of(fragments: Column, page_width: Column, gap: float = 15.0) -> Column:
    """The columns that ``detect_columns(header_tokens(...))`` finds, from the words of one heading line."""
    shown = F.filter(fragments, lambda f: strip(f["text"]) != "")

    def starts(words: Column) -> Column:
        def opens(i: Column) -> Column:
            prev = F.get(words, i - 1)
            return (i == 0) | F.coalesce(F.get(words, i)["x"] - (prev["x"] + prev["width"]) >= gap, F.lit(True))

        return F.filter(F.sequence(F.lit(0), F.size(words) - 1), opens)

    # A one-element array names a value once; inside, it is not computed again for every use.
    def once(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def phrases(words: Column) -> Column:
        def phrase(at: Column) -> Column:
            def token(start: Column, k: Column) -> Column:
                own = F.slice(words, start + 1, F.coalesce(F.get(at, k + 1), F.size(words)) - start)
                return F.struct(strip(F.array_join(own["text"], " ")).alias("phrase"), F.array_min(own["x"]).alias("left_x"))

            return F.transform(at, token)

        return once(starts(words), phrase)

    def kinds(t: Column) -> Column:
        return F.struct(t["phrase"].alias("phrase"), t["left_x"].alias("left_x"), P.classify_column(t["phrase"]).alias("kind"))

    def edged(tokens: Column) -> Column:
        def column(t: Column, i: Column) -> Column:
            last = F.when(page_width > 0, page_width - 20.0).otherwise(t["left_x"] + 100.0)
            return F.struct(
                i.alias("column_index"),
                t["kind"].alias("column_type"),
                t["phrase"].alias("header_text"),
                t["left_x"].alias("left_x"),
                F.coalesce(F.get(tokens, i + 1)["left_x"], last).alias("right_x"),
                F.when(t["kind"] != "Unknown", 0.90).otherwise(0.40).alias("confidence"),
            )

        return F.transform(tokens, column)

    return once(F.transform(once(shown, phrases), kinds), edged)


def has_column(*types: str) -> Column:
    return F.exists("columns", lambda c: c["column_type"].isin(*types))


def is_sufficient() -> Column:
    return (
        has_column("Date")
        & has_column("Description")
        & has_column("Debit", "Credit", "SignedAmount")
        & has_column("Balance")
    )


# Where a bank name and an account number appear in the top of page 1.
BANK_NAME_PATTERN = (
    r"(?i)\b([A-Za-z\s.&'-]{3,35}\b(?:Bank|Gramin\s+Bank|Co-?operative\s+Bank|Sahakari\s+Bank|Financial\s+Services))\b"
)
ACCOUNT_PATTERN = r"(?i)(?:Account\s*(?:No|Number)|A/c\s*(?:No|Number))\s*[:.]?\s*(\d{9,18})"
SAMPLE_DATE = r"\b(\d{2}[/-]\d{2}[/-]\d{2,4}|\d{1,2}\s+[A-Za-z]{3}\s+\d{2,4}|\d{1,2}-[A-Za-z]{3}-\d{2,4})\b"


def with_structure(lines: DataFrame, stated: bool = False) -> DataFrame:
    """Add what page 1 says of the file to each of its lines: ``columns``, ``header_bottom`` and ``footer_top``.

    The lines stand in tasks by file, so these are windows over the file and the lines are read once. Files with very many lines are given
    the values of their first page by a join instead (``UniversalParse.bounded``). With ``stated`` the balances of ``scan_balances`` come along.
    """
    file = Window.partitionBy("file_id")
    first = F.col("page") == 1
    out = lines.withColumn("_score", F.when(first, P.header_keyword_score(F.col("line_text"))))
    heading = F.col("_score") >= 3
    out = out.withColumns(
        {
            "_key": F.when(heading, F.struct((-F.col("_score")).alias("s"), F.col("line_no").alias("n"))),
            "_own": F.when(heading, layout_of(F.col("fragments"), F.col("page_width"))),
            "_low": F.when(first & P.is_table_end(F.col("line_text")), F.col("y")),
            **(_stated_balance() if stated else {}),
        }
    )
    balances = {f"{n}_balance": F.min_by("_value", F.when((F.col("_said") == n) & F.col("_value").isNotNull(), F.col("line_no"))).over(file) for n in STATED}
    out = out.withColumns(
        {
            "columns": F.min_by("_own", "_key").over(file),
            "_end": F.max(F.when(first, F.struct("line_no", "page_height"))).over(file)["page_height"],
            # The lowest line that ends a table stands below the heading, or none does.
            "_low": F.max("_low").over(file),
            **(balances if stated else {}),
        }
    )

    def first_word(i: int) -> Column:
        return F.upper(F.split(F.get("columns", F.lit(i))["header_text"], " ")[0])

    upper, second = F.upper("line_text"), first_word(1)
    heads = first & upper.contains(first_word(0)) & (second.isNull() | upper.contains(second))
    bottom = F.col("y") + F.when(F.col("height") > 0, F.col("height")).otherwise(15.0)
    out = out.withColumn("_head", F.when(heads, F.struct("line_no", bottom.alias("bottom"))))
    out = out.withColumn("header_bottom", F.coalesce(F.min("_head").over(file)["bottom"], F.lit(150.0)))
    edge = F.when(F.col("_end") > 0, F.col("_end") - 30.0).otherwise(800.0)
    out = out.withColumn("footer_top", F.coalesce(F.when(F.col("_low") > F.col("header_bottom"), F.col("_low") - 5.0), edge))
    none = F.slice(F.array(_no_column()), 1, 0)
    return out.withColumn("columns", F.coalesce("columns", none)).drop("_score", "_key", "_own", "_end", "_head", "_low", "_said", "_value")


def analyze_structure(lines: DataFrame) -> DataFrame:
    """Table bounds, names and a sample date from page 1; every file with text gets a row."""
    body = with_structure(lines.filter("page = 1"))
    top = F.when(F.col("y") <= F.col("page_height") * 0.35, F.struct("line_no", "line_text"))
    inside = (F.col("y") > F.col("header_bottom")) & (F.col("y") < F.col("footer_top"))
    dated = inside & F.col("line_text").rlike(SAMPLE_DATE)
    per_file = body.groupBy("file_id").agg(
        F.first("columns").alias("columns"),
        F.max_by("page_height", "line_no").alias("page_height"),
        F.first("header_bottom").alias("header_bottom"),
        F.first("footer_top").alias("footer_top"),
        # Lines of the top third of one page.
        F.array_sort(F.collect_list(top)).alias("_top"),
        F.count_if(inside).alias("table_rows"),
        F.min_by("line_text", F.when(dated, F.col("line_no"))).alias("_dated"),
    )
    joined = F.regexp_replace(F.array_join(F.col("_top")["line_text"], " "), r"\s+", " ")
    per_file = per_file.withColumn("_text", joined).withColumns(
        {
            "bank_name": F.nullif(strip(F.regexp_extract("_text", BANK_NAME_PATTERN, 1)), F.lit("")),
            "account_number": F.nullif(F.regexp_extract("_text", ACCOUNT_PATTERN, 1), F.lit("")),
            "is_sufficient": is_sufficient(),
            "sample_date": F.regexp_extract("_dated", SAMPLE_DATE, 1),
        }
    )
    return per_file.drop("_top", "_text", "_dated")


def _no_column() -> Column:
    return F.struct(
        F.lit(0).alias("column_index"),
        F.lit("").alias("column_type"),
        F.lit("").alias("header_text"),
        F.lit(0.0).alias("left_x"),
        F.lit(0.0).alias("right_x"),
        F.lit(0.0).alias("confidence"),
    )


def with_page_bounds(lines: DataFrame, structure: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Add the file's structure and the vertical table limits of each page."""
    return page_limits(lines.join(structure.select("file_id", "columns", "header_bottom", "footer_top"), "file_id"), hot)


def page_limits(lines: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Add the vertical table limits of each page; page-wide values are window aggregates on the file partitioning."""
    keys = ["file_id", "page"]
    out = with_ordered(lines, keys, ["line_no"], {"row_on_page": rownum()}, hot)
    heading = P.is_column_header_line(F.col("line_text"))
    bottom = F.col("y") + F.when(F.col("height") > 0, F.col("height")).otherwise(15.0)
    repeated = F.when(heading & (F.col("row_on_page") <= 10), F.struct("row_on_page", bottom.alias("bottom")))
    foot = F.when(P.is_footer_line(F.col("line_text")), F.col("y") - 5.0)
    out = out.withColumns({"_rep": repeated, "_foot": foot})
    out = with_group(out, keys, {"_head": F.min("_rep"), "_low": F.min("_foot")}, hot)
    later = F.coalesce(F.col("_head")["bottom"], F.greatest(F.lit(40.0), F.col("page_height") * 0.06))
    top = F.when(F.col("page") > 1, later).otherwise(F.col("header_bottom"))
    edge = F.when(F.col("page_height") > 0, F.col("page_height") - 25.0).otherwise(800.0)
    low = F.least(edge, F.col("_low"))
    out = out.withColumns({"top_bound": top, "_edge": low})
    limit = F.when(F.col("_edge") > F.col("top_bound"), F.least("footer_top", "_edge")).otherwise(F.col("footer_top"))
    return out.withColumn("bottom_bound", limit).drop("_rep", "_foot", "_head", "_low", "_edge")


def date_in_column(left: Column, right: Column) -> Column:
    """Date token of a line in or near the date column, else at the start of the line; null when there is none."""
    near = F.filter("fragments", lambda f: (f["x"] >= F.greatest(F.lit(0.0), left - 20.0)) & (f["x"] <= right + 15.0))
    texts = F.transform(near, lambda f: strip(f["text"]))
    single = F.filter(
        F.transform(texts, lambda t: F.regexp_extract(t, P.DATE_INSIDE, 0)), lambda t: t != ""
    )
    joined = F.regexp_extract(F.array_join(F.slice(texts, 1, 3), " "), P.DATE_INSIDE, 0)
    starts = F.regexp_extract(strip("line_text"), r"^(?:" + P.DATE_INSIDE.replace("(?i)", "") + r")", 0)
    return F.coalesce(
        F.get(single, F.lit(0)),
        F.when(F.size(texts) >= 2, F.nullif(joined, F.lit(""))),
        F.nullif(starts, F.lit("")),
    )


def table_lines(bounded: DataFrame) -> DataFrame:
    """Lines inside the table without headings and summaries, with the date token each shows in its date column."""
    y, text = F.col("y"), F.col("line_text")
    kept = bounded.filter(
        (y >= F.col("top_bound") - 2.0)
        & (y < F.col("bottom_bound"))
        & (strip("line_text") != "")
        & ~P.is_column_header_line(text)
        & ~P.is_summary_line(text)
    )
    date_column = F.get(F.filter("columns", lambda c: c["column_type"] == "Date"), F.lit(0))
    left = F.coalesce(date_column["left_x"], F.lit(0.0))
    right = F.coalesce(date_column["right_x"] + 25.0, F.lit(150.0))
    return kept.withColumn("date_text", date_in_column(left, right))


def segment_rows(
    bounded: DataFrame, hot: Hot | None = None, across_pages: bool = False, max_gap: float = 45.0
) -> DataFrame:
    """Lines of each transaction row: a date opens a row, close lines below continue it.

    After a gap of ``max_gap`` the rest of the row's lines drop out until the next date. With ``across_pages`` an
    open row goes on over a page break.
    """
    y = F.col("y")
    kept = table_lines(bounded)
    dated = F.col("date_text").isNotNull()
    kept = kept.withColumns({"_d": dated.cast("int"), "_dp": F.when(dated, F.col("page"))})
    order = ["line_no"]
    kept = with_ordered(
        kept, ["file_id"], order, {"row_index": running_sum(F.col("_d")), "row_page": last_upto(F.col("_dp"))}, hot
    )
    same_page = F.lit(True) if across_pages else F.col("page") == F.col("row_page")
    kept = kept.filter((F.col("row_index") > 0) & same_page)
    keys = ["file_id", "row_index"]
    kept = with_ordered(kept, keys, ["page", "line_no"], {"_low": max_before(y + F.col("height"))}, hot)
    gap = y - F.col("_low")
    if across_pages:
        kept = with_ordered(kept, keys, ["page", "line_no"], {"_pp": lag(F.col("page"))}, hot)
        gap = F.when(F.col("_pp") == F.col("page"), gap)
    kept = kept.withColumn("_far", F.coalesce(gap >= max_gap, F.lit(False)).cast("int"))
    kept = with_ordered(kept, keys, ["page", "line_no"], {"_broken": running_max(F.col("_far"))}, hot)
    return kept.filter("_broken = 0").drop("_d", "_dp", "_low", "_far", "_broken", "_pp")


def _from_left(a: Column, b: Column) -> Column:
    """Order of two columns by left edge, however close they are."""
    return (a["left_x"] > b["left_x"]).cast("int") - (a["left_x"] < b["left_x"]).cast("int")


def column_spans(columns: Column, edited: bool = False) -> Column:
    """Type and interval of each column, in the order given: from 10 left of its edge to 5 before the next edge.

    The last column is open; of an edited layout it ends 25 right of its right edge.
    """
    def span(c: Column, i: Column) -> Column:
        last = c["right_x"] + 25.0 if edited else F.lit(float("inf"))
        end = F.coalesce(F.get(columns, i + 1)["left_x"] - 5.0, last)
        return F.struct((c["left_x"] - 10.0).alias("low"), end.alias("high"), c["column_type"].alias("column_type"))

    return F.transform(columns, span)


def type_at(spans: Column, x: Column) -> Column:
    """Type of the first column whose interval holds ``x``. ``spans`` is named twice, so that a plan does not move its making in here."""
    found = F.filter(spans, lambda c: (x >= c["low"]) & (x < c["high"]))
    return F.when(spans.isNotNull(), F.get(found, F.lit(0))["column_type"])


def _balances_of(rows: DataFrame) -> list[str]:
    """The stated balances, if the rows already bring them."""
    return [c for c in (f"{n}_balance" for n in STATED) if c in rows.columns]


def words_in_columns(segmented: DataFrame, edited: bool = False) -> DataFrame:
    """Words of segmented rows with their column type. Edited layouts drop words outside every column."""
    # The intervals are made for a line, not for each of its words, and the types of a line are found before its words become rows.
    lines = segmented.withColumn("_ordered", F.col("columns") if edited else F.array_sort("columns", _from_left))
    lines = lines.withColumn("_spans", column_spans(F.col("_ordered"), edited))
    lines = lines.withColumn("_types", F.transform("fragments", lambda w: type_at(F.col("_spans"), w["x"])))
    found = F.arrays_zip(*[F.col("fragments")[c].alias(c) for c in ("x", "text", "y", "width", "height")], F.col("_types").alias("column_type"))
    # What is exploded stands last: a generator forgets its input by place, and places move when columns before them are not needed.
    keys = ["file_id", "row_index", "row_page", "line_date", *_balances_of(segmented)]
    lines = lines.withColumnRenamed("date_text", "line_date").select(*keys, "fragments", "_types")
    words = lines.select(*keys, F.inline(found))
    return words.filter("column_type is not null") if edited else words


def extract_cells(words: DataFrame) -> DataFrame:
    """Cell texts per row: the last date or amount wins, reference and description are joined in reading order."""
    text = strip("text")
    words = words.withColumn("text", text).filter(~F.col("text").isin("", "-", "--"))
    at = F.struct("y", "x")
    kind = F.col("column_type")
    is_date, is_amount = P.is_date_token(F.col("text")), P.is_amount_token(F.col("text"))

    def last(name: str, ok: Column) -> Column:
        return F.max_by("text", F.when((kind == name) & ok, at))

    def joined(cond: Column) -> Column:
        # Words of one transaction row.
        items = F.array_sort(F.collect_list(F.when(cond, F.struct("y", "x", "text"))))
        return F.nullif(F.array_join(items["text"], " "), F.lit(""))

    valued = ["Date", "ValueDate", "Reference", "Debit", "Credit", "SignedAmount", "Indicator", "Balance"]
    loose = kind.isNull() | ~kind.isin(*valued)
    return words.groupBy("file_id", "row_index").agg(
        F.first("row_page").alias("page"),
        last("Date", is_date).alias("date_text"),
        F.max("line_date").alias("line_date"),
        last("ValueDate", is_date).alias("value_date_text"),
        joined(kind == "Reference").alias("reference"),
        last("Debit", is_amount).alias("debit_text"),
        last("Credit", is_amount).alias("credit_text"),
        last("SignedAmount", is_amount).alias("amount_text"),
        last("Indicator", F.lit(True)).alias("indicator"),
        last("Balance", is_amount).alias("balance_text"),
        joined(loose).alias("description"),
        *[F.first(c).alias(c) for c in _balances_of(words)],
    )


STATED = ("opening", "closing")


def _stated_balance() -> dict[str, Column]:
    """Which balance a line states, and the last amount of that line."""
    lower = F.lower("line_text")
    opens = lower.contains("opening balance") | lower.contains("brought forward") | lower.contains("b/f")
    closes = lower.contains("closing balance") | lower.contains("carried forward") | lower.contains("c/f")
    amounts = F.filter("fragments", lambda f: P.is_amount_token(f["text"]))
    value = P.parse_amount_universal(F.try_element_at(amounts, F.lit(-1))["text"])
    return {"_said": F.when(opens, "opening").when(closes, "closing"), "_value": F.when(opens | closes, value)}


def scan_balances(lines: DataFrame) -> DataFrame:
    """Stated opening and closing balance per file: the last amount of the first matching line."""
    stated = _stated_balance()
    rows = named(lines, "_said", stated["_said"]).filter(F.col("_said").isNotNull())
    rows = named(rows, "_value", stated["_value"]).filter("_value is not null")
    return rows.groupBy("file_id").agg(
        *[F.min_by("_value", F.when(F.col("_said") == n, F.col("line_no"))).alias(f"{n}_balance") for n in STATED]
    )


def build_transactions(cells: DataFrame, balances: DataFrame | None, hot: Hot | None = None) -> DataFrame:
    """Typed rows. Rows without a readable date drop out; a signed amount takes its side from the evidence.

    ``balances`` may be None where the cells bring what their file states.
    """
    rows = cells.withColumn(
        "transaction_date", P.parse_date_multi(F.coalesce("date_text", "line_date"))
    ).filter("transaction_date is not null")
    if balances is not None:
        rows = rows.join(balances, "file_id", "left")
    d, c = P.parse_amount_universal(F.col("debit_text")), P.parse_amount_universal(F.col("credit_text"))
    rows = rows.withColumns(
        {
            "_d": F.when(d > 0, d),
            "_c": F.when(c > 0, c),
            "_s": P.parse_amount_universal(F.col("amount_text")),
            "balance": P.parse_amount_universal(F.col("balance_text")),
        }
    )
    rows = with_ordered(rows, ["file_id"], ["row_index"], {"_prev": last_before(F.col("balance"))}, hot)
    size = F.abs("_s")
    delta = F.col("balance") - F.coalesce("_prev", "opening_balance")
    tol = F.lit("0.05").cast(MONEY)
    ind = F.lower("indicator")
    side = (
        F.when(F.col("indicator").isNotNull(), F.when(ind.contains("dr"), "D").when(ind.contains("cr"), "C"))
        .when(F.col("_s") < 0, "D")
        .when((delta < 0) & (F.abs(-delta - size) <= tol), "D")
        .when((delta > 0) & (F.abs(delta - size) <= tol), "C")
    )
    bare = F.col("_d").isNull() & F.col("_c").isNull()
    rows = rows.withColumns(
        {
            "debit": F.when(bare & (side == "D"), size).otherwise(F.col("_d")).cast(MONEY),
            "credit": F.when(bare & (side == "C"), size).otherwise(F.col("_c")).cast(MONEY),
        }
    )
    return rows.select(
        "file_id",
        "row_index",
        "page",
        "transaction_date",
        P.parse_date_multi(F.col("value_date_text")).alias("value_date"),
        F.coalesce("description", F.lit("Transaction")).alias("description"),
        "debit",
        "credit",
        F.coalesce("debit", "credit", F.lit(0)).cast(MONEY).alias("amount"),
        "balance",
        "reference",
        F.when(F.col("credit") > 0, "Credit").otherwise("Debit").alias("transaction_type"),
        F.lit(99).alias("bank_code"),
        F.lit(ENGINE).alias("parser_version"),
        F.lit(0.85).alias("confidence"),
        "opening_balance",
        "closing_balance",
    )


def judge(transactions: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Financial verdict per file against the stated balances; the last row's balance closes when none is stated."""
    rows = C.judge_rows(transactions, "file_id", F.col("opening_balance"), ["row_index"], hot)
    closing = F.coalesce(F.max("closing_balance"), F.max_by("balance", "row_no"))
    return C.judge_files(rows, "file_id", closing)


def columns_monotonic(columns: Column) -> Column:
    """Every column starts left of the next."""
    return F.forall(
        F.sequence(F.lit(0), F.greatest(F.size(columns) - 2, F.lit(0))),
        lambda i: F.coalesce(F.get(columns, i)["left_x"] < F.get(columns, i + 1)["left_x"], F.lit(True)),
    )


def confidence(structure: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Weighted score (35 % header, 35 % columns, 30 % continuity), reason count and level per file."""
    out = structure.select("file_id", "columns", "is_sufficient").join(verdicts, "file_id", "left")
    quarter = F.lit(0.25)
    header = (
        F.when(has_column("Date"), quarter).otherwise(0.0)
        + F.when(has_column("Description"), quarter).otherwise(0.0)
        + F.when(has_column("Debit", "Credit", "SignedAmount"), quarter).otherwise(0.0)
        + F.when(has_column("Balance"), quarter).otherwise(0.0)
    )
    n = F.size("columns")
    geometry = F.when(n >= 4, F.when(columns_monotonic(F.col("columns")), 0.90).otherwise(0.40)).otherwise(n * 0.15)
    data = (
        F.when(F.coalesce("total_rows", F.lit(0)) == 0, 0.0)
        .when(F.col("fully_reconciled"), 1.0)
        .otherwise(F.col("reconciliation_rate"))
    )
    out = out.withColumns({"header_score": header, "column_score": geometry, "data_score": data})
    empty = F.coalesce("total_rows", F.lit(0)) == 0
    named = (F.col("failed_rows") > 0) | (F.col("discrepancy_count") > 0)
    unproved = ~empty & (F.col("data_score") < 0.80) & ~F.coalesce(named, F.lit(False))
    reasons = (
        (F.col("header_score") < 0.75).cast("int")
        + (n < 4).cast("int")
        + empty.cast("int")
        + F.coalesce(F.col("failed_rows") > 0, F.lit(False)).cast("int")
        + F.coalesce(F.col("missing_amount") > 0, F.lit(False)).cast("int")
        + F.coalesce(F.least("discrepancy_count", F.lit(2)), F.lit(0)).cast("int")
        + unproved.cast("int")
    )
    score = F.col("header_score") * 0.35 + F.col("column_score") * 0.35 + F.col("data_score") * 0.30
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 10))), 2)
    out = out.withColumns({"overall_score": score, "reason_count": reasons})
    level = (
        F.when((F.col("overall_score") >= 0.80) & (F.col("reason_count") == 0), "High")
        .when(F.col("overall_score") >= 0.50, "Medium")
        .otherwise("Low")
    )
    return out.withColumn("level", level)


def route(scored: DataFrame) -> DataFrame:
    """Accept a file only with high confidence, full reconciliation and at least one row; else it needs review."""
    good = (
        (F.col("level") == "High")
        & F.coalesce("fully_reconciled", F.lit(False))
        & (F.coalesce("total_rows", F.lit(0)) > 0)
    )
    return scored.withColumns(
        {"success": good, "needs_review": ~good, "processing_status": F.when(good, COMPLETED).otherwise(REVIEW_REQUIRED)}
    )


def fingerprints(layouts: DataFrame) -> DataFrame:
    """Layout hash per file from column types, relative positions and headings, left to right."""
    width = F.when(F.col("page_width") > 0, F.col("page_width")).otherwise(595.0)
    cols = F.array_sort("columns", _from_left)
    out = layouts.withColumns({"_c": cols, "_w": width})
    positions = F.transform("_c", lambda c: F.format_string("%.2f", F.bround(c["left_x"] / F.col("_w"), 2)))
    heads = F.filter(F.transform("_c", lambda c: F.lower(strip(c["header_text"]))), lambda h: h != "")
    types = F.col("_c")["column_type"]
    text = F.concat_ws("|", F.array_join(types, ","), F.array_join(positions, ","), F.array_join(heads, ","))
    return out.select(
        "file_id",
        F.sha2(text, 256).alias("fingerprint"),
        F.size("_c").alias("column_count"),
        (F.array_contains(types, "Debit") & F.array_contains(types, "Credit")).alias("has_explicit_debit_credit"),
        types.alias("column_order"),
        heads.alias("header_keywords"),
    )


def store_fingerprints(store: DataFrame | None, new: DataFrame) -> DataFrame:
    """One record per hash. A matched hash keeps its record and raises the usage count; an unknown one is added.

    The counts are map-side sums, so a layout shared by most files is never gathered.
    """
    seen = new.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("usage_count"),
        F.min("file_id").alias("first_file_id"),
        F.first("column_count").alias("column_count"),
        F.first("has_explicit_debit_credit").alias("has_explicit_debit_credit"),
    )
    if store is None:
        return seen
    both = store.unionByName(seen)
    return both.groupBy("fingerprint").agg(
        F.sum("usage_count").alias("usage_count"),
        F.min("first_file_id").alias("first_file_id"),
        F.first("column_count").alias("column_count"),
        F.first("has_explicit_debit_credit").alias("has_explicit_debit_credit"),
    )


def match_fingerprints(new: DataFrame, store: DataFrame) -> DataFrame:
    """Files whose layout hash is known. The store has one row per layout, far fewer than files."""
    known = store.select("fingerprint", F.col("usage_count").alias("known_usage"))
    return new.join(known, "fingerprint", "left").withColumn("is_known", F.col("known_usage").isNotNull())


class UniversalParse:
    """The chain over all files; each stage is built on first use.

    Lines are not saved: written out they are many times the ledger that statements come from, while every stage that reads them
    shares one exchange by file. ``save_lines`` writes them to the shared checkpoint folder where they are dear to make.
    """

    def __init__(self, words: DataFrame, hot: Hot | None = None, save_lines: bool = False):
        self.words = words
        self.hot = hot
        self.save_lines = save_lines

    @cached_property
    def lines(self) -> DataFrame:
        lines = lines_of(self.words, self.hot)
        return checkpointed(lines) if self.save_lines else lines

    @cached_property
    def headers(self) -> DataFrame:
        return best_header(self.lines)

    @cached_property
    def tokens(self) -> DataFrame:
        return header_tokens(self.headers, self.hot)

    @cached_property
    def layouts(self) -> DataFrame:
        columns = layout_of(F.col("fragments"), F.col("page_width"))
        return self.headers.select("file_id", "page_width", columns.alias("columns"))

    @cached_property
    def structure(self) -> DataFrame:
        return analyze_structure(self.lines)

    @cached_property
    def balances(self) -> DataFrame:
        return scan_balances(self.lines)

    @cached_property
    def bounded(self) -> DataFrame:
        if self.hot is not None:
            return with_page_bounds(self.lines, self.structure.filter("is_sufficient"), self.hot)
        return page_limits(with_structure(self.lines).filter(is_sufficient()))

    @cached_property
    def segmented(self) -> DataFrame:
        return segment_rows(self.bounded, self.hot)

    @cached_property
    def cell_words(self) -> DataFrame:
        return words_in_columns(self.segmented)

    @cached_property
    def cells(self) -> DataFrame:
        return extract_cells(self.cell_words)

    @cached_property
    def transactions(self) -> DataFrame:
        if self.hot is not None:
            return build_transactions(self.cells, self.balances, self.hot)
        # The balances come with the lines, which are then made once.
        bounded = page_limits(with_structure(self.lines, stated=True).filter(is_sufficient()))
        return build_transactions(extract_cells(words_in_columns(segment_rows(bounded))), None)

    @cached_property
    def verdicts(self) -> DataFrame:
        return judge(self.transactions, self.hot)

    @cached_property
    def scores(self) -> DataFrame:
        return confidence(self.structure, self.verdicts)

    @cached_property
    def routed(self) -> DataFrame:
        return route(self.scores)
