"""Bank-specific layouts as data: column calibration, row boundaries and amount rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.parse import (
    extract_identifiers,
    extract_utr_prefixed,
    is_amount_token,
    is_date_token,
    parse_amount_universal,
    repair_decimal_separator,
    reversal_sides,
)
from ledgerspark.functions.text import strip
from ledgerspark.model import MONEY
from ledgerspark.operators import continuity as C
from ledgerspark.operators import universal as U
from ledgerspark.operators.ordered import Hot, lag, last_before, last_upto, running_sum, with_ordered
from ledgerspark.session import checkpointed


@dataclass(frozen=True)
class Profile:
    """A statement family: how rows are bounded and which continuity policy applies."""

    boundary: str
    policy: str
    lead: float = 0.0


# Row boundary, continuity policy and anchor lead per profile.
PROFILES = {
    "HDFC-v1": Profile("date_cross_page", "hdfc"),
    "YES-v1": Profile("prefix_suffix", "yes"),
    "AXIS-v1": Profile("blocks", "axis"),
    "CENTRAL-v1": Profile("date_cross_page", "central"),
    "ICICI-v1": Profile("midpoint", "icici_v1"),
    "ICICI-v2": Profile("anchor", "icici_v2", 3.0),
    "SBI-v1": Profile("date_cross_page", "sbi"),
    "BOI-v1": Profile("anchor", "boi", 4.0),
    "KOTAK-v1": Profile("date_cross_page", "kotak"),
    "PNB-v1": Profile("date_cross_page", "pnb"),
    "BOB-v1": Profile("date_cross_page", "bob"),
}
# Left edges per profile as (column, heading word, offset from it, edge when the word is missing).
CALIBRATION = {
    "HDFC-v1": [
        ("Date", None, 0.0, 0.0),
        ("Description", None, 0.0, 58.0),
        ("Reference", r"(?i)Chq|Ref", -15.0, 270.0),
        ("ValueDate", r"(?i)Value", -8.0, 355.0),
        ("Debit", r"(?i)Withdrawal", -12.0, 395.0),
        ("Credit", r"(?i)Deposit", -12.0, 475.0),
        ("Balance", r"(?i)Closing|Balance", -12.0, 555.0),
    ],
    "YES-v1": [
        ("Date", None, 0.0, 0.0),
        ("ValueDate", r"(?i)Value", -10.0, 95.0),
        ("Reference", r"(?i)Cheque|Reference|TranID", -10.0, 170.0),
        ("Description", r"(?i)Description|Remarks", -80.0, 295.0),
        ("Debit", r"(?i)Withdrawal|Withdrawl", -12.0, 515.0),
        ("Credit", r"(?i)Deposit", -12.0, 590.0),
        ("Balance", r"(?i)Balance|Running", -12.0, 660.0),
    ],
    "AXIS-v1": [
        ("SerialNumber", None, 0.0, 0.0),
        ("Date", r"(?i)Transaction", -5.0, 35.0),
        ("ValueDate", r"(?i)Value", -5.0, 85.0),
        ("Description", r"(?i)Particulars", -8.0, 135.0),
        ("SignedAmount", r"(?i)Amount", -10.0, 260.0),
        ("Indicator", r"(?i)Debit/Credit|DR/CR", -8.0, 312.0),
        ("Balance", r"(?i)Balance", -10.0, 365.0),
        ("Reference", r"(?i)Cheque", -10.0, 445.0),
        ("Branch", r"(?i)Branch", -10.0, 500.0),
    ],
    "CENTRAL-v1": [
        ("ValueDate", None, 0.0, 0.0),
        ("Date", r"(?i)^Post$", -8.0, 75.0),
        ("Description", r"(?i)^Detail", -25.0, 110.0),
        ("Reference", r"(?i)^Chq", -3.0, 248.0),
        ("Debit", r"(?i)^Debit$", -20.0, 285.0),
        ("Credit", r"(?i)^Credit$", -20.0, 370.0),
        ("Balance", r"(?i)^Balance", -20.0, 460.0),
    ],
    "ICICI-v1": [
        ("Date", r"(?i)^DATE$", -10.0, 20.0),
        ("Description", r"(?i)^MODE$", -5.0, 68.0),
        ("Credit", r"(?i)^DEPOSITS$", -15.0, 335.0),
        ("Debit", r"(?i)^WITHDRAWALS$", -10.0, 395.0),
        ("Balance", r"(?i)^BALANCE$", -10.0, 470.0),
    ],
    "ICICI-v2": [
        ("SerialNumber", None, 0.0, 0.0),
        ("Unknown", r"(?i)^(?:Tran|ID)$", -12.0, 65.0),
        ("ValueDate", r"(?i)^Value$", -15.0, 115.0),
        ("Date", r"(?i)^Transaction$", -15.0, 185.0),
        ("Reference", r"(?i)^(?:Cheque|RefNo)$", -10.0, 255.0),
        ("Description", r"(?i)^Remarks$", -18.0, 312.0),
        ("Debit", r"(?i)^(?:Withdrawl|\(Dr\))$", -15.0, 395.0),
        ("Credit", r"(?i)^(?:Deposit|\(Cr\))$", -10.0, 455.0),
        ("Balance", r"(?i)^Balance$", -10.0, 505.0),
    ],
    "SBI-v1": [
        ("Date", None, 0.0, 0.0),
        ("Description", None, 0.0, 100.0),
        ("Reference", None, 0.0, 270.0),
        ("Debit", None, 0.0, 360.0),
        ("Credit", None, 0.0, 430.0),
        ("Balance", None, 0.0, 490.0),
    ],
    "BOI-v1": [
        ("SerialNumber", None, 0.0, 0.0),
        ("Date", None, 0.0, 65.0),
        ("Reference", None, 0.0, 140.0),
        ("Description", None, 0.0, 210.0),
        ("Debit", None, 0.0, 470.0),
        ("Credit", None, 0.0, 550.0),
        ("Balance", None, 0.0, 635.0),
        ("Indicator", None, 0.0, 740.0),
    ],
}
# Profiles with fixed bands; their edges are trusted where these headings start inside their own band.
BANDED = {
    "SBI-v1": [(r"(?i)^(?:Debit|Withdrawal)", 360.0, 430.0), (r"(?i)^(?:Credit|Deposit)", 430.0, 490.0), (r"(?i)^Balance", 490.0, 1e9)],
    "BOI-v1": [(r"(?i)^(?:Debit|Withdrawal)", 470.0, 550.0), (r"(?i)^(?:Credit|Deposit)", 550.0, 635.0), (r"(?i)^Balance", 635.0, 740.0)],
}
# Profiles whose balance carries a Dr mark when it is overdrawn, whose last comma may be the decimal point, whose
# negative amounts are reversals, whose rows need an amount on one side, or any amount at all.
SIGNED_BALANCE = ["BOI-v1", "CENTRAL-v1"]
COMMA_DECIMALS = ["SBI-v1"]
REVERSALS = ["HDFC-v1"]
NEEDS_SIDE = ["BOB-v1"]
NEEDS_AMOUNT = ["CENTRAL-v1"]
# Rows that only tell of a changed rate, per profile.
NOTES = {"CENTRAL-v1": r"(?i)BS RT CHG|CA RT CHG"}
# Bank codes of the profiles whose narrations hold a UTR of the bank's own shape.
UTR_BANKS = {"BOB-v1": 10, "PNB-v1": 9, "KOTAK-v1": 8}
# Columns whose heading words must all be present before a profile's own edges are trusted.
ESSENTIAL = {
    "HDFC-v1": ["Debit", "Credit", "Balance"],
    "YES-v1": ["Description", "Debit", "Credit", "Balance"],
    "AXIS-v1": ["Date", "Description", "SignedAmount", "Indicator", "Balance"],
    "CENTRAL-v1": ["Date", "Description", "Debit", "Credit", "Balance"],
    "ICICI-v1": ["Date", "Credit", "Debit", "Balance"],
    "ICICI-v2": ["ValueDate", "Date", "Description", "Debit", "Credit", "Balance"],
}


def _heading(pattern: str) -> Column:
    return F.get(F.filter("fragments", lambda f: f["text"].rlike(pattern)), F.lit(0))["x"]


def calibrate(headers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Left edges per file: heading word plus offset, else the profile's default; sorted from left to right.

    ``is_trusted`` says that every essential heading word of the profile was found.
    """
    rows = headers.select("file_id", "fragments").join(profiles.select("file_id", "profile"), "file_id")
    edges, trusted = None, None
    for name, columns in CALIBRATION.items():
        items = [
            F.struct(
                (F.coalesce(_heading(p) + off, F.lit(default)) if p else F.lit(default)).alias("left_x"),
                F.lit(column).alias("column_type"),
            )
            for column, p, off, default in columns
        ]
        found = F.lit(name in ESSENTIAL or name in BANDED)
        for pattern, low, high in BANDED.get(name, []):
            x = _heading(pattern)
            found = found & x.isNotNull() & (x >= low) & (x < high)
        for column, p, _, _ in columns:
            if column in ESSENTIAL.get(name, []):
                found = found & _heading(p).isNotNull()
        here = F.col("profile") == name
        value = F.array_sort(F.array(*items))
        edges = F.when(here, value) if edges is None else edges.when(here, value)
        trusted = F.when(here, found) if trusted is None else trusted.when(here, found)
    return rows.select(
        "file_id", "profile", edges.alias("edges"), F.coalesce(trusted, F.lit(False)).alias("is_trusted")
    )


def default_edges(profile: Column) -> Column:
    """A profile's edges where no heading line was found at all; profiles without edges use the first with plain columns."""
    out = None
    for name in PROFILES:
        columns = CALIBRATION.get(name, CALIBRATION["SBI-v1"])
        items = [F.struct(F.lit(default).alias("left_x"), F.lit(column).alias("column_type")) for column, _, _, default in columns]
        value = F.array_sort(F.array(*items))
        out = F.when(profile == name, value) if out is None else out.when(profile == name, value)
    return out


def edges_of_layout(columns: Column) -> Column:
    """A detected layout as left edges: the first column opens 10 before its heading, later ones 5 before."""
    return F.transform(
        columns,
        lambda c, i: F.struct(
            (c["left_x"] - F.when(i == 0, 10.0).otherwise(5.0)).alias("left_x"), c["column_type"].alias("column_type")
        ),
    )


def column_from(edges: Column, x: Column) -> Column:
    """Column whose left edge is the last one not right of ``x``."""
    return F.try_element_at(F.filter(edges, lambda e: e["left_x"] <= x), F.lit(-1))["column_type"]


# ---------------------------------------------------------------- row boundaries


def _words(lines: DataFrame, *extra: str) -> DataFrame:
    return lines.select("file_id", "page", "line_no", F.col("date_text").alias("line_date"), *extra, F.inline("fragments"))


def bands_by_anchor(words: DataFrame, is_anchor: Column, lead_pt: float, hot: Hot | None = None) -> DataFrame:
    """A row reaches from ``lead_pt`` above its anchor word to just above the next anchor of the page."""
    words = words.withColumn("_a", F.coalesce(is_anchor, F.lit(False)).cast("int"))
    words = words.withColumns(
        {
            "_k": F.when(F.col("_a") == 1, F.col("y") - lead_pt).otherwise(F.col("y")),
            "_t": 1 - F.col("_a"),
            "_ap": F.when(F.col("_a") == 1, F.col("page")),
        }
    )
    order = ["page", "_k", "_t", "x", "text"]
    words = with_ordered(
        words, ["file_id"], order, {"row_index": running_sum(F.col("_a")), "row_page": last_upto(F.col("_ap"))}, hot
    )
    return words.filter(F.col("row_page") == F.col("page")).drop("_a", "_k", "_t", "_ap")


def bands_by_midpoint(words: DataFrame, is_anchor: Column, hot: Hot | None = None) -> DataFrame:
    """A word belongs to the nearer of the anchors above and below it; the midpoint itself goes to the lower one."""
    words = words.withColumns(
        {"_a": F.coalesce(is_anchor, F.lit(False)).cast("int"), "_cy": F.col("y") + F.col("height") / 2}
    )
    centre = F.when(F.col("_a") == 1, F.col("_cy"))
    words = words.withColumns({"_t": 1 - F.col("_a"), "_ac": centre, "_ncy": -F.col("_cy"), "_npage": -F.col("page")})
    keys = ["file_id"]
    words = with_ordered(
        words, keys, ["page", "_cy", "_t", "x", "text"], {"_count": running_sum(F.col("_a"))}, hot
    )
    page_keys = ["file_id", "page"]
    words = with_ordered(
        words, page_keys, ["_cy", "_t", "x", "text"], {"_up": last_upto(F.col("_ac"))}, hot
    )
    words = with_ordered(
        words, page_keys, ["_ncy", "_t", "x", "text"], {"_down": last_upto(F.col("_ac"))}, hot
    )
    middle = (F.col("_up") + F.col("_down")) / 2
    lower = (F.col("_a") == 0) & F.col("_down").isNotNull() & (F.col("_up").isNull() | (F.col("_cy") >= middle))
    # A word on the baseline of an anchor counts as below it already.
    lower = lower & ~((F.col("_up") == F.col("_cy")) & F.col("_up").isNotNull())
    words = words.filter("_up is not null or _down is not null")
    words = words.withColumn("row_index", F.col("_count") + lower.cast("int")).withColumn("row_page", F.col("page"))
    return words.drop("_a", "_cy", "_t", "_ac", "_ncy", "_npage", "_count", "_up", "_down")


def shows_amount(min_x: float = 255.0) -> Column:
    """A line with money in the amount columns: an amount token with decimals, right of the narration."""
    return F.exists("fragments", lambda f: (f["x"] >= min_x) & is_amount_token(f["text"]) & strip(f["text"]).rlike(r"\.\d{1,2}"))


def _fold_pages(lines: DataFrame, fields: list[str], zero: Column, step) -> DataFrame:
    """Fold the lines of each page in order. ``step(acc, line)`` returns the accumulator with one more mark.

    The marks depend on earlier marks, which no window expresses. The fold runs inside the JVM over one page, and
    a page holds what fits on paper.
    """
    line = F.struct("line_no", *fields)
    pages = lines.groupBy("file_id", "page").agg(F.array_sort(F.collect_list(line)).alias("ls"))
    folded = pages.withColumn("marks", F.aggregate("ls", zero, step, lambda acc: acc["marks"]))
    pairs = F.arrays_zip(F.col("ls")["line_no"].alias("line_no"), F.col("marks").alias("mark"))
    return folded.select("file_id", "page", F.inline(pairs))


def blocks(lines: DataFrame, has_amount: Column) -> DataFrame:
    """Block number per line of a page: a second date, a second amount or a gap over 20 starts a new block."""
    lines = lines.withColumns({"_d": F.col("date_text").isNotNull(), "_m": F.coalesce(has_amount, F.lit(False))})
    zero = F.struct(
        F.lit(0).alias("no"),
        F.lit(False).alias("d"),
        F.lit(False).alias("m"),
        F.lit(0.0).alias("y"),
        F.array().cast("array<int>").alias("marks"),
    )

    def step(acc: Column, ln: Column) -> Column:
        fresh = (acc["no"] > 0) & ((ln["_d"] & acc["d"]) | (ln["_m"] & acc["m"]) | (ln["y"] - acc["y"] > 20.0))
        opens = fresh | (acc["no"] == 0)
        no = F.when(opens, acc["no"] + 1).otherwise(acc["no"])
        return F.struct(
            no.alias("no"),
            F.when(opens, ln["_d"]).otherwise(acc["d"] | ln["_d"]).alias("d"),
            F.when(opens, ln["_m"]).otherwise(acc["m"] | ln["_m"]).alias("m"),
            ln["y"].alias("y"),
            F.concat(acc["marks"], F.array(no)).alias("marks"),
        )

    return _fold_pages(lines, ["y", "_d", "_m"], zero, step).withColumnRenamed("mark", "block_no")


# Transfer rails that announce the next row, and entries that never take a prefix.
RAILS = r"NEFT|YESBN|RTGS|IMPS|UPI"
NO_PREFIX = r"SWEEP|INT\. ON"


def prefix_suffix(lines: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Row index per line where undated lines join the row above or announce the row below.

    Only the distance to the row above depends on earlier choices; it is folded inside a page. Whether a row is
    open at the top of a page and where the next dated line lies come from windows over the file.
    """
    dated = F.col("date_text").isNotNull()
    lines = lines.withColumns({"_d": dated.cast("int"), "_n": -F.col("line_no")})
    ahead = F.when(dated, F.struct("y", "line_text"))
    lines = with_ordered(lines, ["file_id"], ["line_no"], {"_rows": running_sum(F.col("_d"))}, hot)
    lines = with_ordered(lines, ["file_id", "page"], ["_n"], {"_next": last_before(ahead)}, hot)
    upper = F.upper("line_text")
    lines = lines.withColumns(
        {
            "_open": F.col("_rows") > 0,
            "_to_next": F.coalesce(F.col("_next")["y"] - F.col("y"), F.lit(1e9)),
            "_rail": upper.rlike(RAILS),
            "_plain": ~F.coalesce(F.upper(F.col("_next")["line_text"]).rlike(NO_PREFIX), F.lit(False)),
        }
    )
    zero = F.struct(
        F.lit(False).alias("here"), F.lit(0.0).alias("y"), F.array().cast("array<int>").alias("marks")
    )

    def step(acc: Column, ln: Column) -> Column:
        has_next = ln["_to_next"] < 1e8
        dated_line = ln["_d"] == 1
        far_page = F.when(ln["_open"] & ~ln["_rail"], False).otherwise(has_next)
        same_page = (
            F.when(ln["_rail"] & has_next & (ln["_to_next"] <= 14.0), True)
            .when(ln["_open"] & (ln["y"] - acc["y"] <= 12.0), False)
            .when(has_next & (ln["_to_next"] <= 7.0) & ln["_plain"], True)
            .otherwise(~ln["_open"])
        )
        prefix = ~dated_line & (F.when(acc["here"], same_page).otherwise(far_page) | ~ln["_open"])
        stays = dated_line | ~prefix
        return F.struct(
            (acc["here"] | stays).alias("here"),
            F.when(stays, ln["y"]).otherwise(acc["y"]).alias("y"),
            F.concat(acc["marks"], F.array(prefix.cast("int"))).alias("marks"),
        )

    marks = _fold_pages(lines, ["y", "_d", "_open", "_to_next", "_rail", "_plain"], zero, step)
    rows = lines.select("file_id", "line_no", "_rows").join(marks, ["file_id", "line_no"])
    return rows.select("file_id", "page", "line_no", (F.col("_rows") + F.col("mark")).alias("row_index"))


def staggered_dates(dates: DataFrame, reach: float = 12.0) -> DataFrame:
    """Anchors with their value date: a date line less than ``reach`` below the last anchor is its value date."""
    dates = dates.withColumn("line_no", F.col("y"))
    zero = F.struct(F.lit(-1e9).alias("y"), F.lit(0).alias("no"), F.array().cast("array<int>").alias("marks"))

    def step(acc: Column, ln: Column) -> Column:
        fresh = ln["y"] - acc["y"] >= reach
        no = acc["no"] + fresh.cast("int")
        return F.struct(
            F.when(fresh, ln["y"]).otherwise(acc["y"]).alias("y"),
            no.alias("no"),
            F.concat(acc["marks"], F.array(no)).alias("marks"),
        )

    marks = _fold_pages(dates, ["y"], zero, step)
    rows = dates.join(marks, ["file_id", "page", "line_no"])
    return rows.groupBy("file_id", "page", "mark").agg(
        F.min("y").alias("y"), F.min_by("day", "y").alias("day"), F.max_by("day", "y").alias("value_day")
    ).drop("mark")


def amounts_by_position(words: DataFrame, min_x: float = 340.0, split_x: float = 425.0, end_x: float = 500.0) -> DataFrame:
    """Debit, credit and balance of a row from the order and place of its amounts; long whole numbers are not money."""
    text = strip("text")
    value = parse_amount_universal(text)
    money = (F.col("x") >= min_x) & ~text.rlike(r"^\d{4,16}$") & value.isNotNull()
    item = F.when(money, F.struct("y", "x", value.alias("v")))
    rows = words.groupBy("file_id", "row_index").agg(F.array_sort(F.collect_list(item)).alias("a"))
    n = F.size("a")

    def at(i: int) -> Column:
        return F.try_element_at("a", F.lit(i))

    two_d = at(-2)["x"] < split_x
    one_d, one_c = at(-1)["x"] < split_x, (at(-1)["x"] >= split_x) & (at(-1)["x"] < end_x)
    positive_d, positive_c = F.when(at(-3)["v"] > 0, at(-3)["v"]), F.when(at(-2)["v"] > 0, at(-2)["v"])
    debit = F.when(n >= 3, positive_d).when((n == 2) & two_d, at(-2)["v"]).when((n == 1) & one_d, at(-1)["v"])
    credit = F.when(n >= 3, positive_c).when((n == 2) & ~two_d, at(-2)["v"]).when((n == 1) & one_c, at(-1)["v"])
    balance = F.when(n >= 2, at(-1)["v"]).when((n == 1) & ~one_d & ~one_c, at(-1)["v"])
    return rows.select(
        "file_id",
        "row_index",
        debit.cast(MONEY).alias("debit"),
        credit.cast(MONEY).alias("credit"),
        balance.cast(MONEY).alias("balance"),
    )


def rows_by_boundary(lines: DataFrame, boundary: str, lead_pt: float = 0.0, hot: Hot | None = None) -> DataFrame:
    """Words of the table with the row each belongs to, under one boundary rule."""
    def date_word() -> Column:
        return (F.col("x") < 115) & is_date_token(F.col("text"))

    if boundary == "date_cross_page":
        lines = lines.withColumn("_d", F.col("date_text").isNotNull().cast("int"))
        lines = with_ordered(lines, ["file_id"], ["line_no"], {"row_index": running_sum(F.col("_d"))}, hot)
        return _words(lines.filter("row_index > 0"), "row_index", F.col("page").alias("row_page"))
    if boundary == "anchor":
        return bands_by_anchor(_words(lines), date_word(), lead_pt, hot)
    if boundary == "midpoint":
        return bands_by_midpoint(_words(lines), date_word(), hot)
    if boundary == "blocks":
        marks = blocks(lines, shows_amount())
        marks = with_ordered(
            marks.withColumn("_s", F.lit(0)), ["file_id", "page", "block_no"], ["line_no"], {"_r": lag(F.lit(1))}, hot
        )
        marks = marks.withColumn("_new", F.col("_r").isNull().cast("int"))
        marks = with_ordered(marks, ["file_id"], ["line_no"], {"row_index": running_sum(F.col("_new"))}, hot)
        rows = marks.select("file_id", "line_no", "row_index")
    else:
        rows = prefix_suffix(lines, hot).select("file_id", "line_no", "row_index")
    lines = lines.join(rows, ["file_id", "line_no"])
    return _words(lines, "row_index", F.col("page").alias("row_page"))


def parse_profiles(run: U.UniversalParse, routed: DataFrame) -> DataFrame:
    """Transactions of every statement with a known profile, in one job.

    Files are split by boundary rule; columns come from the profile's own edges where its headings are on the
    page, else from the detected layout. Each policy then judges its own files.
    """
    from functools import reduce

    # The routing carries every detection pattern in its plan; the saved table is two short columns.
    known = checkpointed(routed.filter(F.col("profile") != "universal").select("file_id", "profile"))
    # Five boundary rules read these lines, so they are written once.
    # A known bank does not need the general heading analysis: a file it fails on keeps default bounds and the profile's edges.
    structure = run.structure.join(known, "file_id", "left_semi")
    bounded = U.with_page_bounds(run.lines, structure, run.hot)
    lines = checkpointed(U.table_lines(bounded).join(known, "file_id"))
    edges = known.join(calibrate(run.headers, known).drop("profile"), "file_id", "left")
    edges = edges.join(structure.select("file_id", "columns", "is_sufficient"), "file_id", "left")
    seen = F.when(F.col("is_sufficient"), edges_of_layout(F.col("columns")))
    own = F.coalesce("edges", default_edges(F.col("profile")))
    edges = edges.select("file_id", F.when(F.col("is_trusted"), own).otherwise(F.coalesce(seen, own)).alias("edges"))
    groups: dict[tuple, list[str]] = {}
    for name, p in PROFILES.items():
        groups.setdefault((p.boundary, p.lead), []).append(name)
    parts = []
    for (boundary, lead_pt), names in groups.items():
        part = rows_by_boundary(lines.filter(F.col("profile").isin(*names)), boundary, lead_pt, run.hot)
        parts.append(part.select("file_id", "row_index", "row_page", "line_date", "x", "y", "text"))
    words = checkpointed(reduce(DataFrame.unionByName, parts)).join(checkpointed(edges), "file_id")
    words = words.withColumn("column_type", column_from(F.col("edges"), F.col("x"))).drop("edges")
    cells = with_cell_rules(U.extract_cells(words).join(known, "file_id"))
    rows = U.build_transactions(cells.drop("profile"), run.balances, run.hot)
    rows = rows.drop("parser_version").join(known.withColumnRenamed("profile", "parser_version"), "file_id")
    return with_row_rules(rows)


def with_cell_rules(cells: DataFrame) -> DataFrame:
    """Cell texts read the way each profile prints them, and without rows that are no transactions there."""
    profile = F.col("profile")
    texts = ["debit_text", "credit_text", "balance_text"]
    is_note = F.lit(False)
    for name, pattern in NOTES.items():
        is_note = is_note | ((profile == name) & F.coalesce(F.col("description").rlike(pattern), F.lit(False)))
    no_amount = F.coalesce(*texts, "amount_text").isNull()
    out = cells.filter(~is_note & ~(profile.isin(*NEEDS_AMOUNT) & no_amount))
    comma = profile.isin(*COMMA_DECIMALS)
    out = out.withColumns({c: F.when(comma, repair_decimal_separator(strip(c))).otherwise(F.col(c)) for c in texts})
    balance = F.col("balance_text")
    marked = F.coalesce(strip(balance).rlike(r"(?i)dr\.?$"), F.lit(False)) | F.coalesce(F.col("indicator").rlike("(?i)dr"), F.lit(False))
    size = F.abs(parse_amount_universal(balance))
    signed = F.when(profile.isin(*SIGNED_BALANCE) & marked, (-size).cast("string")).otherwise(balance)
    sides = reversal_sides(parse_amount_universal(F.col("debit_text")), parse_amount_universal(F.col("credit_text")))
    reverses = profile.isin(*REVERSALS)
    out = out.withColumns({"balance_text": signed, "_sides": sides})
    return out.withColumns(
        {
            "debit_text": F.when(reverses, F.col("_sides.debit").cast("string")).otherwise(F.col("debit_text")),
            "credit_text": F.when(reverses, F.col("_sides.credit").cast("string")).otherwise(F.col("credit_text")),
        }
    ).drop("_sides")


def with_row_rules(rows: DataFrame) -> DataFrame:
    """References and UTRs from the narration, where the profile has them there; rows without a side drop out of profiles that need one."""
    profile = F.col("parser_version")
    no_side = F.coalesce("debit", "credit").isNull()
    out = rows.filter(~(profile.isin(*NEEDS_SIDE) & no_side))
    ids = extract_identifiers(F.col("description"))
    found = F.struct(F.coalesce("reference", ids["reference"]).alias("reference"), ids["utr"].alias("utr"))
    for name, bank in UTR_BANKS.items():
        found = F.when(profile == name, extract_utr_prefixed(F.col("description"), F.col("reference"), bank)).otherwise(found)
    return out.withColumn("_ids", found).withColumns({"reference": F.col("_ids.reference"), "utr": F.col("_ids.utr")}).drop("_ids")


def closing_differences(rows: DataFrame, balances: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Files whose opening balance and movements do not lead to the closing balance that the statement gives."""
    moved = F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))
    ends = rows.groupBy("file_id").agg(F.sum(moved).alias("moved"))
    out = ends.join(balances.select("file_id", "opening_balance", "closing_balance"), "file_id")
    reached = F.coalesce("opening_balance", F.lit(0)) + F.col("moved")
    out = out.withColumn("reached", reached.cast(MONEY)).filter("closing_balance is not null")
    return out.filter(F.abs(F.col("reached") - F.col("closing_balance")) > F.lit(tolerance).cast(MONEY)).select(
        "file_id", "reached", "closing_balance"
    )


def judge_profiles(rows: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Balance status of each row under its profile's own policy; every policy sees only its files."""
    from functools import reduce

    rows = checkpointed(rows)
    parts = []
    for name, p in PROFILES.items():
        part = rows.filter(F.col("parser_version") == name)
        judged = C.continuity(part, p.policy, "file_id", ["row_index"], F.col("opening_balance"), hot)
        parts.append(judged.select(*rows.columns, "expected_balance", "balance_status"))
    return reduce(DataFrame.unionByName, parts)
