"""Queries over rendered statements: words, lines, columns, rows, transactions and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import parse as P
from ledgerspark.operators import universal as U
from ledgerspark.operators import words as Wd
from ledgerspark.plans.registry import cte, query
from ledgerspark.session import checkpointed
from ledgerspark.sources.bridge import BANK_TITLES, LEGEND, ROWS_PER_PAGE, Ledger

_TITLES = ", ".join("'" + t + "'" for t in BANK_TITLES)
cte(
    "clean_rows",
    f"""SELECT *, CAST((row_no - 1) // {ROWS_PER_PAGE} + 1 AS INT) page, (row_no - 1) % {ROWS_PER_PAGE} slot,
 CAST((n_rows + {ROWS_PER_PAGE - 1}) // {ROWS_PER_PAGE} AS INT) n_pages FROM (SELECT *, row_number() OVER
 (PARTITION BY source_file_id ORDER BY seq) row_no, count(*) OVER (PARTITION BY source_file_id) n_rows
 FROM transactions WHERE defect > 6)""",
)
cte(
    "doc_words",
    f"""SELECT file_id, page, CAST(x AS DOUBLE) x, CAST(y AS DOUBLE) y, length(t) * 5.0::DOUBLE AS width, 8.0::DOUBLE AS height,
 t AS text FROM (
 SELECT source_file_id file_id, page, 50 + 5 * (length(array_to_string(string_split(s.t, ' ')[1:u.i - 1], ' '))
  + CASE WHEN u.i > 1 THEN 1 ELSE 0 END) x, s.y, string_split(s.t, ' ')[u.i] t FROM clean_rows,
  LATERAL (VALUES (40, ([{_TITLES}])[1 + bank_code % 11]),
  (50, CASE WHEN bank_code IN (1, 99) THEN 'CITY OFFICE' ELSE '{LEGEND}' END),
  (68, 'From ' || strftime(transaction_date, '%d/%m/%Y') || ' To ' || strftime(value_date, '%d/%m/%Y')),
  (76, 'MR CLIENT ' || client_id || ' :')) s(y, t), (SELECT unnest(range(1, 20)) i) u
  WHERE row_no = 1 AND u.i <= len(string_split(s.t, ' '))
 UNION ALL SELECT source_file_id, page, w.x, w.y, coalesce(w.t, lpad(CAST(client_id + 1000000 AS VARCHAR), 12, '4'))
  FROM clean_rows, (VALUES (50, 60, 'Account'), (90, 60, 'Number'), (130, 60, NULL), (50, 90, 'Opening'),
  (90, 90, 'Balance'), (455, 90, '10,000.00')) w(x, y, t) WHERE row_no = 1
 UNION ALL SELECT source_file_id, page, w.x, 120, w.t FROM clean_rows, (VALUES (50, 'Date'), (120, 'Narration'),
  (260, 'Withdrawal'), (340, 'Deposit'), (450, 'Balance')) w(x, t) WHERE slot = 0
 UNION ALL SELECT source_file_id, page, w.x, 780, CASE w.x WHEN 75 THEN CAST(page AS VARCHAR)
  WHEN 100 THEN CAST(n_pages AS VARCHAR) ELSE w.t END FROM clean_rows, (VALUES (50, 'Page'), (75, NULL), (85, 'of'),
  (100, NULL), (110, 'Computer'), (155, 'Generated'), (205, 'Statement')) w(x, t) WHERE slot = 0
 UNION ALL SELECT source_file_id, page, w.x, 150 + 18 * slot, CASE w.x WHEN 50 THEN strftime(transaction_date, '%d/%m/%Y')
  WHEN 265 THEN format('{{:,.2f}}', CAST(debit AS DOUBLE)) WHEN 345 THEN format('{{:,.2f}}', CAST(credit AS DOUBLE))
  ELSE format('{{:,.2f}}', CAST(balance AS DOUBLE)) END FROM clean_rows, (VALUES (50), (265), (345), (455)) w(x)
 UNION ALL SELECT source_file_id, page, CASE WHEN row_no % 7 = 0 AND u.i = len(string_split(description, ' ')) THEN 120
  ELSE 120 + 5 * (length(array_to_string(string_split(description, ' ')[1:u.i - 1], ' ')) + CASE WHEN u.i > 1 THEN 1 ELSE 0 END)
  END, 150 + 18 * slot + CASE WHEN row_no % 7 = 0 AND u.i = len(string_split(description, ' ')) THEN 10 ELSE 0 END,
  string_split(description, ' ')[u.i] FROM clean_rows, (SELECT unnest(range(1, 8)) i) u
  WHERE u.i <= len(string_split(description, ' '))) WHERE t IS NOT NULL""",
)
cte(
    "doc_lined",
    "SELECT *, dense_rank() OVER (PARTITION BY file_id ORDER BY page, y) line_no FROM doc_words",
)
cte(
    "doc_lines",
    """SELECT file_id, line_no, any_value(page) page, min(y) y, 8.0::DOUBLE height, count(*) words,
 string_agg(repeat(' ', CAST(spaces AS INT)) || text, '' ORDER BY x) line_text FROM (SELECT *, CASE WHEN pr IS NULL THEN 0
 WHEN x - pr <= 3.5 * 1.8 THEN 1 ELSE greatest(2, least(8, round_even((x - pr) / 3.5, 0))) END spaces
 FROM (SELECT *, lag(x + width) OVER (PARTITION BY file_id, line_no ORDER BY x) pr FROM doc_lined)) GROUP BY file_id, line_no""",
)


def parse(led: Ledger) -> U.UniversalParse:
    return U.UniversalParse(led.word_pages, led.hot)


def headings(led: Ledger) -> U.UniversalParse:
    """For queries that read the lines once."""
    return U.UniversalParse(led.word_pages, led.hot)


@query("words_flatten", "SELECT file_id, page, x, y, width, text FROM doc_words")
def words_flatten(led: Ledger) -> DataFrame:
    """Statements written as one nested JSON document per page, read back and flattened."""
    block = F.struct("text", "x", "y", "width", "height")
    pages = led.words.groupBy("file_id", "page", "page_width", "page_height").agg(F.collect_list(block).alias("blocks"))
    docs = pages.select(
        F.to_json(
            F.struct("file_id", F.array(F.struct("page", "page_width", "page_height", "blocks")).alias("pages"))
        ).alias("doc")
    )
    parsed = docs.select(F.from_json("doc", Wd.DOCUMENT).alias("d")).select("d.*")
    return Wd.flatten_words(parsed).select("file_id", "page", "x", "y", "width", "text")


@query("words_to_lines", "SELECT file_id, page, x, y, text, line_no FROM doc_lined")
def words_to_lines(led: Ledger) -> DataFrame:
    return Wd.to_lines(led.words, led.hot).select("file_id", "page", "x", "y", "text", "line_no")


@query("line_text", "SELECT file_id, line_no, line_text FROM doc_lines")
def line_text(led: Ledger) -> DataFrame:
    return Wd.lines_of(led.word_pages, led.hot).select("file_id", "line_no", "line_text")


@query("line_bbox", "SELECT file_id, line_no, page, y, height FROM doc_lines")
def line_bbox(led: Ledger) -> DataFrame:
    lines = Wd.lines_of(led.word_pages, led.hot)
    return lines.select("file_id", "line_no", "page", "y", "height")


@query(
    "extraction_stats",
    """SELECT w.file_id, w.page_count, w.word_count, w.char_count, l.row_count, w.char_count >= 10 AND w.word_count >= 2
 AS has_usable_text, 'DigitalWithText' AS pdf_type FROM (SELECT file_id, count(DISTINCT page) page_count, count(*) word_count,
 CAST(sum(length(text)) AS BIGINT) char_count FROM doc_words GROUP BY 1) w JOIN (SELECT file_id, count(*) row_count
 FROM doc_lines GROUP BY 1) l ON l.file_id = w.file_id""",
)
def extraction_stats(led: Ledger) -> DataFrame:
    lined = Wd.to_lines(led.words, led.hot)
    lines = lined.select("file_id", "page", "line_no").distinct()
    return Wd.document_stats(Wd.page_stats(lined, lines))


@query(
    "repeated_lines",
    """WITH z AS (SELECT *, CASE WHEN y <= 842 * 0.12 AND length(t) >= 4 THEN 'header' WHEN y >= 842 * 0.9 THEN 'footer' END zone
 FROM (SELECT *, regexp_replace(line_text, '\\s+', ' ', 'g') t FROM doc_lines)),
 s AS (SELECT file_id, zone, upper(CASE WHEN zone = 'footer' THEN regexp_replace(t, '\\b\\d+\\b', '#', 'g') ELSE t END) signature, y
 FROM z WHERE zone IS NOT NULL), p AS (SELECT file_id, max(page) pages FROM doc_lines GROUP BY 1)
 SELECT s.file_id, zone, signature, count(*) AS times FROM s JOIN p ON p.file_id = s.file_id WHERE pages > 1 GROUP BY 1, 2, 3
 HAVING count(*) >= greatest(2, least(5, ceil(max(pages) * 0.2)))""",
)
def repeated_lines(led: Ledger) -> DataFrame:
    return Wd.repeated_lines(Wd.lines_of(led.word_pages, led.hot))


@query(
    "repeated_line_flags",
    """WITH z AS (SELECT *, CASE WHEN y <= 842 * 0.12 THEN 'header' WHEN y >= 842 * 0.9 THEN 'footer' END zone
 FROM (SELECT *, regexp_replace(line_text, '\\s+', ' ', 'g') t FROM doc_lines)),
 s AS (SELECT *, upper(CASE WHEN zone = 'header' THEN t ELSE regexp_replace(t, '\\b\\d+\\b', '#', 'g') END) signature FROM z),
 p AS (SELECT file_id, max(page) pages FROM doc_lines GROUP BY 1),
 r AS (SELECT s.file_id, zone, signature FROM s JOIN p ON p.file_id = s.file_id WHERE zone IS NOT NULL AND pages > 1
 AND (zone = 'footer' OR length(t) >= 4) GROUP BY 1, 2, 3 HAVING count(*) >= greatest(2, least(5, ceil(max(pages) * 0.2))))
 SELECT s.file_id, s.line_no, coalesce(s.zone = 'header' AND r.file_id IS NOT NULL, false) AS is_header,
 coalesce(s.zone = 'footer' AND r.file_id IS NOT NULL, false) AS is_footer FROM s LEFT JOIN r ON r.file_id = s.file_id AND r.zone = s.zone
 AND r.signature = s.signature""",
)
def repeated_line_flags(led: Ledger) -> DataFrame:
    """Every line with whether it repeats as a header or footer."""
    lines = Wd.lines_of(led.word_pages, led.hot)
    return Wd.flag_repeated(lines, led.hot).select("file_id", "line_no", "is_header", "is_footer")


@query(
    "x_clusters",
    """WITH c AS (SELECT *, sum(n) OVER (PARTITION BY file_id, page ORDER BY x ROWS UNBOUNDED PRECEDING) cluster FROM
 (SELECT *, CASE WHEN coalesce(x - lag(x) OVER (PARTITION BY file_id, page ORDER BY x) > 18, true) THEN 1 ELSE 0 END n
 FROM (SELECT file_id, page, x, count(*) members FROM doc_words GROUP BY ALL)))
 SELECT file_id, page, CAST(cluster AS BIGINT) AS cluster, min(x) AS left_x, max(x) AS right_x,
 CAST(sum(members) AS BIGINT) AS members FROM c GROUP BY 1, 2, 3""",
)
def x_clusters(led: Ledger) -> DataFrame:
    return Wd.x_clusters(led.words, led.hot).drop("page_width")


@query(
    "candidate_table",
    """WITH wide AS (SELECT * FROM doc_lined w WHERE (SELECT max(words) FROM doc_lines l WHERE l.file_id = w.file_id
 AND l.line_no = w.line_no) >= 3), c0 AS (SELECT *, sum(n) OVER (PARTITION BY file_id, page ORDER BY x
 ROWS UNBOUNDED PRECEDING) cluster FROM (SELECT *, CASE WHEN coalesce(x - lag(x) OVER (PARTITION BY file_id, page ORDER BY x)
 > 18, true) THEN 1 ELSE 0 END n FROM (SELECT DISTINCT file_id, page, x FROM wide))),
 c1 AS (SELECT file_id, page, cluster, min(x) lx FROM c0 GROUP BY 1, 2, 3),
 cols AS (SELECT *, coalesce(lead(lx) OVER (PARTITION BY file_id, page ORDER BY cluster) - 4, 585) rx FROM c1),
 ncol AS (SELECT file_id, page, count(*) k FROM cols GROUP BY 1, 2),
 hit AS (SELECT w.file_id, w.page, w.line_no, count(DISTINCT c.cluster) cells FROM wide w JOIN cols c
 ON c.file_id = w.file_id AND c.page = w.page AND w.x >= c.lx - 8 AND w.x < c.rx GROUP BY 1, 2, 3),
 tot AS (SELECT file_id, page, count(*) n FROM doc_lines GROUP BY 1, 2)
 SELECT h.file_id, h.page, count(*) AS row_count, CAST(max(k) AS INT) AS column_count,
 round(least(1.0, round_even(count(*) / max(n)::DOUBLE, 2) + 0.3), 4) AS confidence FROM hit h
 JOIN ncol ON ncol.file_id = h.file_id AND ncol.page = h.page JOIN tot ON tot.file_id = h.file_id AND tot.page = h.page
 WHERE cells >= 2 AND k >= 3 GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def candidate_table(led: Ledger) -> DataFrame:
    lines = Wd.lines_of(led.word_pages, led.hot)
    return Wd.candidate_tables(lines).select("file_id", "page", "row_count", "column_count", "confidence")


@query(
    "best_header_row",
    "SELECT file_id, line_no, 5 AS score FROM doc_lines WHERE page = 1 AND y = 120",
)
def best_header_row(led: Ledger) -> DataFrame:
    return headings(led).headers.select("file_id", "line_no", "score")


@query(
    "header_tokens",
    """SELECT DISTINCT file_id, w.k AS token_no, w.p AS phrase, w.x AS left_x FROM doc_lines, (VALUES (1, 'Date', 50.0),
 (2, 'Narration', 120.0), (3, 'Withdrawal', 260.0), (4, 'Deposit', 340.0), (5, 'Balance', 450.0)) w(k, p, x)""",
)
def header_tokens(led: Ledger) -> DataFrame:
    return headings(led).tokens.select("file_id", "token_no", "phrase", "left_x")


COLUMNS_SQL = """SELECT DISTINCT file_id, w.i AS column_index, w.t AS column_type, w.l AS left_x, w.r AS right_x, 0.9 AS confidence
 FROM doc_lines, (VALUES (0, 'Date', 50.0, 120.0), (1, 'Description', 120.0, 260.0), (2, 'Debit', 260.0, 340.0),
 (3, 'Credit', 340.0, 450.0), (4, 'Balance', 450.0, 575.0)) w(i, t, l, r)"""


@query("detect_columns", COLUMNS_SQL)
def detect_columns(led: Ledger) -> DataFrame:
    return headings(led).layouts.select("file_id", F.inline("columns")).drop("header_text")


@query("column_edges", f"SELECT file_id, column_index, right_x FROM ({COLUMNS_SQL})")
def column_edges(led: Ledger) -> DataFrame:
    return headings(led).layouts.select("file_id", F.inline("columns")).select("file_id", "column_index", "right_x")


@query("columns_monotonic", "SELECT DISTINCT file_id, true AS is_monotonic FROM doc_lines")
def columns_monotonic(led: Ledger) -> DataFrame:
    return headings(led).layouts.select("file_id", U.columns_monotonic(F.col("columns")).alias("is_monotonic"))


@query(
    "structure_analysis",
    """SELECT l.file_id, 128.0 AS header_bottom, 775.0 AS footer_top, true AS is_sufficient,
 count(*) FILTER (l.y > 128 AND l.y < 775) AS table_rows, any_value(c.account) AS account_number,
 any_value(c.d) AS sample_date FROM doc_lines l JOIN (SELECT source_file_id file_id,
 lpad(CAST(client_id + 1000000 AS VARCHAR), 12, '4') account, strftime(transaction_date, '%d/%m/%Y') d FROM clean_rows
 WHERE row_no = 1) c ON c.file_id = l.file_id WHERE l.page = 1 GROUP BY l.file_id""",
)
def structure_analysis(led: Ledger) -> DataFrame:
    return parse(led).structure.select(
        "file_id", "header_bottom", "footer_top", "is_sufficient", "table_rows", "account_number", "sample_date"
    )


@query(
    "page_bounds",
    """SELECT DISTINCT file_id, page, 128.0 AS top_bound, 775.0 AS bottom_bound FROM doc_lines""",
)
def page_bounds(led: Ledger) -> DataFrame:
    return parse(led).bounded.groupBy("file_id", "page").agg(
        F.max("top_bound").alias("top_bound"), F.max("bottom_bound").alias("bottom_bound")
    )


@query(
    "scan_balances",
    "SELECT DISTINCT file_id, 10000.00 AS opening_balance, CAST(NULL AS DECIMAL(18,2)) AS closing_balance FROM doc_lines",
)
def scan_balances(led: Ledger) -> DataFrame:
    return headings(led).balances


SEGMENT_SQL = """SELECT source_file_id AS file_id, row_no AS row_index, page AS row_page,
 CASE WHEN row_no % 7 = 0 THEN 2 ELSE 1 END AS line_count FROM clean_rows"""


@query("segment_rows", SEGMENT_SQL)
def segment_rows(led: Ledger) -> DataFrame:
    rows = parse(led).segmented
    return rows.groupBy("file_id", "row_index", "row_page").agg(F.count(F.lit(1)).alias("line_count"))


@query("segment_rows_cross_page", SEGMENT_SQL)
def segment_rows_cross_page(led: Ledger) -> DataFrame:
    run = parse(led)
    rows = U.segment_rows(run.bounded, led.hot, across_pages=True)
    return rows.groupBy("file_id", "row_index", "row_page").agg(F.count(F.lit(1)).alias("line_count"))


CELL_WORDS_SQL = """SELECT w.file_id, w.page, w.x, w.y, w.text, CASE WHEN w.x < 115 THEN 'Date' WHEN w.x < 255 THEN 'Description'
 WHEN w.x < 335 THEN 'Debit' WHEN w.x < 445 THEN 'Credit' ELSE 'Balance' END AS column_type FROM doc_words w
 WHERE w.y >= 150 AND w.y < 780"""


@query("words_to_columns", CELL_WORDS_SQL)
def words_to_columns(led: Ledger) -> DataFrame:
    words = parse(led).cell_words
    return words.select("file_id", F.col("row_page").alias("page"), "x", "y", "text", "column_type")


@query("words_to_columns_edited", CELL_WORDS_SQL)
def words_to_columns_edited(led: Ledger) -> DataFrame:
    words = U.words_in_columns(parse(led).segmented, edited=True)
    return words.select("file_id", F.col("row_page").alias("page"), "x", "y", "text", "column_type")


@query(
    "extract_cells",
    """SELECT source_file_id AS file_id, row_no AS row_index, strftime(transaction_date, '%d/%m/%Y') AS date_text, description,
 format('{:,.2f}', CAST(debit AS DOUBLE)) AS debit_text, format('{:,.2f}', CAST(credit AS DOUBLE)) AS credit_text,
 format('{:,.2f}', CAST(balance AS DOUBLE)) AS balance_text FROM clean_rows""",
)
def extract_cells(led: Ledger) -> DataFrame:
    return parse(led).cells.select(
        "file_id", "row_index", "date_text", "description", "debit_text", "credit_text", "balance_text"
    )


@query(
    "universal_parse",
    """SELECT source_file_id AS file_id, row_no AS row_index, page, CAST(transaction_date AS DATE) AS transaction_date,
 description, debit, credit, amount, balance, CASE WHEN credit > 0 THEN 'Credit' ELSE 'Debit' END AS transaction_type
 FROM clean_rows""",
)
def universal_parse(led: Ledger) -> DataFrame:
    return parse(led).transactions.select(
        "file_id",
        "row_index",
        "page",
        "transaction_date",
        "description",
        "debit",
        "credit",
        "amount",
        "balance",
        "transaction_type",
    )


cte(
    "clean_verdicts",
    """SELECT file_id, count(*) total_rows, count(*) FILTER (ok) reconciled_rows, count(*) FILTER (NOT ok) failed_rows,
 CASE WHEN abs(10000 + sum(net) - arg_max(balance, row_no)) > 0.05 THEN 1 ELSE 0 END gap FROM (SELECT source_file_id file_id,
 row_no, balance, coalesce(credit, 0) - coalesce(debit, 0) net, abs(coalesce(lag(balance) OVER w, 10000)
 + coalesce(credit, 0) - coalesce(debit, 0) - balance) <= 0.05 ok FROM clean_rows
 WINDOW w AS (PARTITION BY source_file_id ORDER BY row_no)) GROUP BY file_id""",
)
cte(
    "clean_scores",
    """SELECT *, failed_rows = 0 AND gap = 0 fully_reconciled, CASE WHEN failed_rows = 0 AND gap = 0 THEN 1.0
 ELSE round_even(reconciled_rows / total_rows::DOUBLE, 4) END data_score,
 CASE WHEN failed_rows > 0 THEN 1 ELSE 0 END + least(failed_rows + gap, 2) reason_count FROM clean_verdicts""",
)


@query(
    "universal_confidence",
    """SELECT file_id, total_rows, reconciled_rows, failed_rows, fully_reconciled, reason_count, overall_score,
 CASE WHEN overall_score >= 0.8 AND reason_count = 0 THEN 'High' WHEN overall_score >= 0.5 THEN 'Medium' ELSE 'Low' END AS level
 FROM (SELECT *, round_even(round(0.35 + 0.9 * 0.35 + data_score * 0.3, 10), 2) overall_score FROM clean_scores)""",
)
def universal_confidence(led: Ledger) -> DataFrame:
    return parse(led).scores.select(
        "file_id",
        "total_rows",
        "reconciled_rows",
        "failed_rows",
        "fully_reconciled",
        "reason_count",
        "overall_score",
        "level",
    )


@query(
    "universal_route",
    """SELECT file_id, fully_reconciled AS success, NOT fully_reconciled AS needs_review,
 CASE WHEN fully_reconciled THEN 2 ELSE 6 END AS processing_status FROM clean_scores""",
)
def universal_route(led: Ledger) -> DataFrame:
    return parse(led).routed.select("file_id", "success", "needs_review", "processing_status")


PRINT_SQL = """sha256('Date,Description,Debit,Credit,Balance|0.08,0.20,0.44,0.57,0.76|date,narration,withdrawal,deposit,balance')"""


@query("layout_fingerprint", f"SELECT DISTINCT file_id, {PRINT_SQL} AS fingerprint, 5 AS column_count FROM doc_lines")
def layout_fingerprint(led: Ledger) -> DataFrame:
    return U.fingerprints(headings(led).layouts).select("file_id", "fingerprint", "column_count")


@query(
    "fingerprint_store",
    f"""SELECT {PRINT_SQL} AS fingerprint, count(DISTINCT file_id) AS usage_count, min(file_id) AS first_file_id
 FROM doc_lines""",
)
def fingerprint_store(led: Ledger) -> DataFrame:
    out = U.store_fingerprints(None, U.fingerprints(headings(led).layouts))
    return out.select("fingerprint", "usage_count", "first_file_id")


@query(
    "fingerprint_match",
    f"""SELECT DISTINCT file_id, true AS is_known, (SELECT count(DISTINCT file_id) FROM doc_lines) AS known_usage
 FROM doc_lines""",
)
def fingerprint_match(led: Ledger) -> DataFrame:
    # Once for the store and once to look up: what is kept is a short row per file.
    new = U.fingerprints(headings(led).layouts).select("file_id", "fingerprint", "column_count", "has_explicit_debit_credit")
    new = checkpointed(new)
    return U.match_fingerprints(new, U.store_fingerprints(None, new)).select("file_id", "is_known", "known_usage")
