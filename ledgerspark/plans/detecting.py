"""Queries over bank detection and parser routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators import detect as D
from ledgerspark.plans.parsing import headings
from ledgerspark.plans.registry import cte, query
from ledgerspark.session import checkpointed
from ledgerspark.sources.bridge import Ledger


def _q(text: str) -> str:
    return text.replace("'", "''")


cte(
    "file_texts",
    """SELECT file_id, string_agg(line_text, chr(10) ORDER BY line_no) AS text FROM doc_lines WHERE page <= 4
 GROUP BY file_id""",
)
cte(
    "signal_rows",
    "SELECT file_id, text, "
    + ", ".join(
        f"regexp_matches(text, '(?i){_q(p)}') {bank}_{signal}"
        for bank, rules in D.SIGNALS.items()
        for signal, p, _, _ in rules
    )
    + " FROM file_texts",
)


def _cols(bank: str) -> str:
    return "(" + " + ".join(f"CAST({bank}_{s} AS INT)" for s, _, _, c in D.SIGNALS[bank] if c) + ")"


_V2_ROW = "(icici_v2_withdrawl AND icici_v2_deposit AND icici_balance AND icici_v2_tran)"
_V2_COLS = (
    "("
    + " + ".join(f"CAST(icici_v2_{n} AS INT)" for n in "detailed tran remarks withdrawl deposit cheque".split())
    + f" + 2 * CAST({_V2_ROW} AS INT))"
)
_V2 = f"""({_V2_ROW} OR (icici_v2_detailed AND {_V2_COLS} >= 4) OR (icici_v2_withdrawl AND icici_v2_deposit AND icici_v2_tran
 AND (icici_ifsc OR icici_brand)))"""


def _score(bank: str) -> str:
    cols = _cols(bank) if bank != "icici" else f"(greatest({_cols('icici')}, {_V2_COLS}) + 8 * CAST({_V2_ROW} AS INT))"
    return f"({cols} * 5" + "".join(
        f" + {w} * CAST({bank}_{s} AS INT)" for s, _, w, _ in D.SIGNALS[bank] if w
    ) + ")"


_CANDIDATE = {
    "hdfc": f"(hdfc_ifsc OR hdfc_header OR (hdfc_brand AND (hdfc_narration OR hdfc_closing))) AND {_cols('hdfc')} >= 5",
    "yes": f"""(yes_ifsc OR yes_header OR (yes_brand AND (yes_desc OR yes_running OR yes_label OR yes_service)))
 AND {_cols('yes')} >= 5""",
    "axis": f"""(axis_ifsc OR axis_header OR (axis_brand AND (axis_particulars OR axis_drcr OR axis_label)))
 AND {_cols('axis')} >= 5""",
    "central": f"""(central_ifsc OR central_domain OR (central_brand AND (central_post_date OR central_details
 OR central_scheme))) AND {_cols('central')} >= 5""",
    "icici": f"""(icici_ifsc OR icici_header OR icici_domain OR {_V2} OR (icici_brand AND (icici_particulars
 OR icici_withdrawals OR icici_label))) AND ({_cols('icici')} >= 4 OR {_V2})""",
    "sbi": f"(sbi_ifsc OR sbi_domain OR (sbi_brand AND (sbi_forward OR sbi_summary OR sbi_post_date))) AND {_cols('sbi')} >= 4",
    "boi": f"""(boi_ifsc OR boi_domain OR boi_slogan OR (boi_brand AND (boi_tran_date OR boi_inst_no OR boi_opening)))
 AND ({_cols('boi')} >= 4 OR boi_ifsc)""",
    "kotak": f"""(kotak_ifsc OR kotak_header OR kotak_crn OR (kotak_brand AND (kotak_ref OR (kotak_withdrawal
 AND kotak_deposit)))) AND ({_cols('kotak')} >= 4 OR kotak_ifsc)""",
    "pnb": f"""(pnb_ifsc OR pnb_slogan OR (pnb_brand AND (pnb_withdrawal OR pnb_deposit OR pnb_alpha OR pnb_cheque
 OR pnb_header))) AND ({_cols('pnb')} >= 4 OR pnb_ifsc OR (pnb_brand AND {_cols('pnb')} >= 3))""",
    "bob": f"""(bob_ifsc OR bob_slogan OR (bob_brand AND (bob_withdrawal OR bob_deposit OR bob_serial OR bob_cheque
 OR bob_header))) AND ({_cols('bob')} >= 4 OR bob_ifsc OR (bob_brand AND {_cols('bob')} >= 3))""",
}
cte(
    "bank_score_rows",
    "SELECT *, "
    + ", ".join(f"{_cols(b)} {b}_cols, {_score(b)} {b}_score, ({_CANDIDATE[b]}) {b}_candidate" for b in D.SIGNALS)
    + " FROM signal_rows",
)


def _others(bank: str) -> list[str]:
    return [o for o in D.SIGNALS if o != bank and not (bank == "axis" and o == "central")]


_DECISION = "CASE " + " ".join(
    f"WHEN {b}_candidate AND {b}_score > greatest({', '.join(o + '_score' for o in _others(b))}) THEN '{b}'"
    for b in D.STRICT_ORDER
)
_DECISION += " WHEN yes_candidate AND " + " AND ".join(
    f"(NOT {o}_candidate OR yes_score > {o}_score)" for o in D.RIVALS
)
_DECISION += " THEN 'yes' WHEN hdfc_candidate AND " + " AND ".join(
    f"(NOT {o}_candidate OR hdfc_score >= {o}_score)" for o in ["yes", *D.RIVALS[1:]]
)
_DECISION += " THEN 'hdfc' END"
cte("bank_decisions", f"SELECT *, {_DECISION} bank FROM bank_score_rows")


def scored(led: Ledger) -> DataFrame:
    """One saved row per file: the decision compares every score many times, and must not score again each time."""
    return checkpointed(D.score_files(D.signal_flags(D.file_texts(headings(led).lines))))


@query(
    "bank_signals",
    "SELECT file_id, bank, signal FROM ("
    + " UNION ALL ".join(
        f"SELECT file_id, '{b}' bank, '{s}' signal FROM signal_rows WHERE {b}_{s}" for b, r in D.SIGNALS.items() for s, *_ in r
    )
    + ")",
)
def bank_signals(led: Ledger) -> DataFrame:
    flags = D.signal_flags(D.file_texts(headings(led).lines))
    out = D.signal_names(flags)
    bank = F.substring_index("name", "_", 1)
    return out.select("file_id", bank.alias("bank"), F.expr("substring(name, length(substring_index(name, '_', 1)) + 2)").alias("signal"))


@query("bank_scores", "SELECT file_id, " + ", ".join(f"{b}_score" for b in D.SIGNALS) + " FROM bank_score_rows")
def bank_scores(led: Ledger) -> DataFrame:
    return scored(led).select("file_id", *[f"{b}_score" for b in D.SIGNALS])


@query("bank_candidates", "SELECT file_id, " + ", ".join(f"{b}_candidate" for b in D.SIGNALS) + " FROM bank_score_rows")
def bank_candidates(led: Ledger) -> DataFrame:
    return scored(led).select("file_id", *[f"{b}_candidate" for b in D.SIGNALS])


@query("bank_detect", "SELECT file_id, bank, bank IS NOT NULL AS is_supported FROM bank_decisions")
def bank_detect(led: Ledger) -> DataFrame:
    return D.decide(scored(led)).select("file_id", "bank", F.col("bank").isNotNull().alias("is_supported"))


# Every rendered account number has twelve digits; only these banks' patterns accept that length.
_TWELVE = "('hdfc', 'yes', 'axis', 'central', 'icici', 'sbi', 'boi', 'kotak')"
_PROOF = " ".join(
    f"WHEN '{b}' THEN 0.9 + CASE WHEN {b}_brand AND ("
    + " OR ".join(f"{b}_{n}" if n != "is_v2" else _V2 for n in names)
    + f") THEN 0.05 ELSE 0 END + CASE WHEN {b}_cols >= {wanted}"
    + (f" OR {_V2_COLS} >= {wanted}" if b == "icici" else "")
    + f" THEN 0.03 ELSE 0 END + CASE WHEN '{b}' IN {_TWELVE} THEN 0.02 ELSE 0 END"
    for b, (names, wanted) in D.IDENTITY.items()
)


@query("bank_confidence", f"SELECT file_id, round(least(1.0, CASE bank {_PROOF} ELSE 0 END), 4) AS confidence FROM bank_decisions")
def bank_confidence(led: Ledger) -> DataFrame:
    return D.detect(scored(led)).select("file_id", "confidence")


_FIRST = """(SELECT source_file_id, lpad(CAST(client_id + 1000000 AS VARCHAR), 12, '4') account, CAST(transaction_date AS DATE) a,
 CAST(value_date AS DATE) b, 'MR CLIENT ' || client_id nm FROM clean_rows WHERE row_no = 1)"""


@query("extract_account_no", f"SELECT source_file_id AS file_id, account AS account_number FROM {_FIRST}")
def extract_account_no(led: Ledger) -> DataFrame:
    return D.detect(scored(led)).select("file_id", "account_number")


@query("extract_period", f"SELECT source_file_id AS file_id, a AS period_start, b AS period_end FROM {_FIRST}")
def extract_period(led: Ledger) -> DataFrame:
    return D.detect(scored(led)).select("file_id", "period_start", "period_end")


@query("extract_customer_name", f"SELECT source_file_id AS file_id, nm AS customer_name FROM {_FIRST}")
def extract_customer_name(led: Ledger) -> DataFrame:
    return D.detect(scored(led)).select("file_id", "customer_name")


@query(
    "parser_route",
    f"""SELECT file_id, CASE bank WHEN 'hdfc' THEN 'HDFC-v1' WHEN 'yes' THEN 'YES-v1' WHEN 'axis' THEN 'AXIS-v1'
 WHEN 'central' THEN 'CENTRAL-v1' WHEN 'icici' THEN CASE WHEN {_V2} THEN 'ICICI-v2' ELSE 'ICICI-v1' END
 WHEN 'sbi' THEN 'SBI-v1' WHEN 'boi' THEN 'BOI-v1' WHEN 'kotak' THEN 'KOTAK-v1' WHEN 'pnb' THEN 'PNB-v1'
 WHEN 'bob' THEN 'BOB-v1' ELSE 'universal' END AS profile FROM bank_decisions""",
)
def parser_route(led: Ledger) -> DataFrame:
    return D.route(D.decide(scored(led))).select("file_id", "profile")
