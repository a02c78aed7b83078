"""Bank detection: signals held as data, scores and the decision as expressions over one text per file."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.parse import parse_date_multi
from ledgerspark.functions.text import strip
from ledgerspark.model import BANKS, code_case

# Signals per bank as (signal, pattern ignoring case, weight, counts as a table column).
SIGNALS: dict[str, list[tuple[str, str, int, bool]]] = {
    "hdfc": [
        ("brand", r"HDFC BANK", 15, False),
        ("ifsc", r"\bHDFC0[A-Z0-9]{6}\b", 40, False),
        ("header", r"HDFC BANK LIMITED", 40, False),
        ("date", r"Date", 0, True),
        ("narration", r"Narration", 20, True),
        ("ref", r"Chq|Ref\.No", 0, True),
        ("value_date", r"Value Dt|Value Date", 0, True),
        ("withdrawal", r"Withdrawal", 0, True),
        ("deposit", r"Deposit", 0, True),
        ("closing", r"Closing Balance", 15, False),
        ("balance", r"Balance", 0, True),
    ],
    "yes": [
        ("brand", r"YES BANK", 15, False),
        ("ifsc", r"\bYESB0[A-Z0-9]{6}\b", 40, False),
        ("header", r"YES BANK LIMITED|YES BANK LTD", 40, False),
        ("service", r"YesRewardz|YES TOUCH", 0, False),
        ("label", r"Statement of account:|Transaction details for your account number", 20, False),
        ("date", r"Transaction Date", 0, True),
        ("value_date", r"Value Date|ValueDate", 0, True),
        ("ref", r"Cheque No|Reference No|Chequeno/RefNo|TranID", 0, True),
        ("desc", r"Description|Transaction Remarks", 20, True),
        ("withdrawal", r"Withdrawals|Withdrawl\(Dr\)", 0, True),
        ("deposit", r"Deposits|Deposit \(Cr\)", 0, True),
        ("running", r"Running Balance", 20, False),
        ("balance", r"Balance", 0, True),
    ],
    "axis": [
        ("brand", r"AXIS BANK", 15, False),
        ("ifsc", r"\bUTIB0[A-Z0-9]{6}\b", 40, False),
        ("header", r"AXIS BANK LIMITED|AXIS BANK LTD", 40, False),
        (
            "label",
            r"Statement of Axis Bank Account No|Account Statement Report|corporate\.ib@axisbank\.com"
            r"|customer\.service@axisbank\.com",
            20,
            False,
        ),
        ("serial", r"S\.NO", 0, True),
        ("date", r"Transaction Date", 0, True),
        ("value_date", r"Value Date", 0, True),
        ("particulars", r"Particulars", 20, True),
        ("amount", r"Amount", 0, True),
        ("drcr", r"Debit/Credit|DR/CR", 20, True),
        ("balance", r"Balance", 0, True),
        ("cheque", r"Cheque", 0, True),
        ("branch", r"Branch Name|\(SOL\)", 0, True),
    ],
    "central": [
        ("brand", r"CENTRAL BANK", 25, False),
        ("ifsc", r"\bCBIN0[A-Z0-9]{6}\b", 40, False),
        ("domain", r"@centralbank\.co\.in|@centralbank\.bank\.in|centralbankofindia\.co\.in", 40, False),
        ("scheme", r"Cent Mudra|Cent Sahyog", 20, False),
        ("value_date", r"(?s)Value.*Date|Date.*Value", 0, True),
        ("post_date", r"Post", 0, True),
        ("details", r"Details", 20, True),
        ("cheque", r"Chq", 0, True),
        ("debit", r"Debit", 0, True),
        ("credit", r"Credit", 0, True),
        ("balance", r"Balance", 0, True),
    ],
    "icici": [
        ("brand", r"ICICI", 25, False),
        ("ifsc", r"\bICIC0[A-Z0-9]{6}\b", 40, False),
        ("header", r"ICICI BANK LIMITED|ICICI Bank Ltd", 40, False),
        ("domain", r"icicibank\.com", 30, False),
        (
            "label",
            r"Statement of Transactions in Savings Account|Statement of Transactions in Current Account"
            r"|STATEMENT SUMMARY",
            25,
            False,
        ),
        ("date", r"DATE", 0, True),
        ("mode", r"MODE", 0, True),
        ("particulars", r"PARTICULARS", 0, True),
        ("deposits", r"DEPOSITS", 0, True),
        ("withdrawals", r"WITHDRAWALS", 0, True),
        ("balance", r"BALANCE", 0, True),
        ("v2_detailed", r"Detailed Statement", 30, False),
        ("v2_tran", r"Tran", 0, False),
        ("v2_remarks", r"Remarks", 0, False),
        ("v2_withdrawl", r"Withdrawl", 0, False),
        ("v2_deposit", r"Deposit", 0, False),
        ("v2_cheque", r"Cheque no/|RefNo", 0, False),
    ],
    "sbi": [
        ("brand", r"\b(?:STATE\s+BANK\s+OF\s+INDIA|OSBI)\b|STATE BANK OF INDIA", 30, False),
        ("ifsc", r"\bSBIN0[A-Z0-9]{6}\b", 40, False),
        ("domain", r"sbi\.co\.in|statebankofindia\.com", 30, False),
        ("forward", r"BROUGHT FORWARD", 25, False),
        ("summary", r"Statement Summary", 20, False),
        ("notice", r"In Case Your Account Is Operated", 15, False),
        ("post_date", r"Post Date", 0, True),
        ("value_date", r"Value Date", 0, True),
        ("desc", r"Description|Particulars", 0, True),
        ("ref", r"Cheque|No/Reference|Ref No", 0, True),
        ("debit", r"Debit", 0, True),
        ("credit", r"Credit", 0, True),
        ("balance", r"Balance", 0, True),
    ],
    "boi": [
        ("brand", r"BANK OF INDIA|\b(?:BANK\s+OF\s+INDIA|BOI)\b", 30, False),
        ("ifsc", r"\bBKID0[A-Z0-9]{6}\b", 40, False),
        ("domain", r"bankofindia\.co\.in|bankofindia\.com", 30, False),
        ("slogan", r"RELATIONSHIP BEYOND BANKING", 25, False),
        ("opening", r"OPENING BALANCE", 20, False),
        ("helpline", r"022-40919191|1800 220 229", 15, False),
        ("serial", r"SNO", 0, True),
        ("tran_date", r"TRAN DATE", 0, True),
        ("inst_no", r"INST NO", 0, True),
        ("desc", r"DESCRIPTION", 0, True),
        ("debits", r"DEBITS", 0, True),
        ("credits", r"CREDITS", 0, True),
        ("balance", r"BALANCE", 0, True),
    ],
    "kotak": [
        ("brand", r"Kotak|KMBL", 30, False),
        ("ifsc", r"\bKKBK0[A-Z0-9]{6}\b", 40, False),
        ("header", r"Kotak Mahindra Bank Limited|Kotak Mahindra Bank Ltd|27 BKC|kotak\.com", 40, False),
        ("crn", r"CRN|Customer Relationship Number", 25, False),
        ("date", r"Date", 0, True),
        ("desc", r"Description|Narration|Particulars", 0, True),
        ("ref", r"Chq/Ref\. No\.|Chq/Ref\.No|Chq / Ref No|Chq/Ref No|Cheque No|Ref\. No|Ref No", 20, True),
        ("withdrawal", r"Withdrawal|Dr\.", 0, True),
        ("deposit", r"Deposit|Cr\.", 0, True),
        ("balance", r"Balance", 0, True),
    ],
    "pnb": [
        ("brand", r"PUNJAB NATIONAL BANK|पंजाब नैशनल बैंक|pnbindia\.in|PNB ONE|\b(?:PUNJAB\s+NATIONAL\s+BANK|PNB)\b", 30, False),
        ("ifsc", r"\bPUNB0[A-Z0-9]{6}\b", 40, False),
        ("slogan", r"the name you can BANK upon|भरोसे का प्रतीक", 30, False),
        ("header", r"Statement of Account No|Statement for Period", 25, False),
        ("tran_date", r"Tran Date|Txn Date", 0, True),
        ("withdrawal", r"Withdrawal", 0, True),
        ("deposit", r"Deposit", 0, True),
        ("balance", r"Balance", 0, True),
        ("alpha", r"Alpha", 15, True),
        ("cheque", r"CHQ\. NO\.|CHQ NO\.|Cheque No|Chq No", 0, True),
        ("narration", r"Narration|Particulars", 0, True),
        ("info", r"Additional Info", 0, True),
    ],
    "bob": [
        (
            "brand",
            r"BANK OF BARODA|बैंक ऑफ़ बड़ौदा|बैंक ऑफ बड़ौदा|bankofbaroda\.in|bankofbaroda\.com|bob World|Baroda Connect"
            r"|\b(?:BANK\s+OF\s+BARODA|BOB)\b",
            30,
            False,
        ),
        ("ifsc", r"\bBARB0[A-Z0-9]{6}\b", 40, False),
        ("slogan", r"India's International Bank|Indias International Bank", 30, False),
        ("header", r"Account Statement|Statement of Account", 25, False),
        ("date", r"Date", 0, True),
        ("value_date", r"Value Date", 0, True),
        ("serial", r"S\.No|S No|Sl\.No|Sl No", 15, True),
        ("particulars", r"Particulars|Description|Narration", 0, True),
        ("cheque", r"CHQ\. NO\.|CHQ NO\.|Cheque No|Chq No|Chq/Ref No", 0, True),
        ("withdrawal", r"Withdrawal|Debit", 0, True),
        ("deposit", r"Deposit|Credit", 0, True),
        ("balance", r"Balance", 0, True),
    ],
}
CODES = {"hdfc": 1, "yes": 2, "axis": 3, "central": 4, "icici": 5, "sbi": 6, "boi": 7, "kotak": 8, "pnb": 9, "bob": 10}
# The banks in the order they are decided.
STRICT_ORDER = ["bob", "pnb", "kotak", "boi", "sbi", "icici", "central", "axis"]
RIVALS = ["hdfc", "icici", "sbi", "boi", "kotak", "pnb", "bob"]
# Signals that prove identity beside the brand, and the column count that adds confidence.
IDENTITY = {
    "hdfc": (["ifsc", "header"], 6),
    "yes": (["ifsc", "header"], 6),
    "axis": (["ifsc", "header"], 6),
    "central": (["ifsc", "domain"], 6),
    "icici": (["ifsc", "header", "domain", "is_v2"], 5),
    "sbi": (["ifsc", "domain"], 5),
    "boi": (["ifsc", "domain", "slogan"], 5),
    "kotak": (["ifsc", "header", "crn"], 5),
    "pnb": (["ifsc", "slogan"], 5),
    "bob": (["ifsc", "slogan"], 5),
}
# Account number patterns per bank, tried in order.
ACCOUNTS = {
    "hdfc": [r"Account\s*(?:No|Number)\s*[:.]?\s*(\d{10,18})"],
    "yes": [
        r"(?:Statement\s+of\s+account|account\s*(?:number|no\.?|num))\s*[:.]?\s*(\d{10,18})",
        r"\b(\d{15})\b",
    ],
    "axis": [r"(?:Statement\s+of\s+Axis\s+Bank\s+Account\s+No|Account\s*(?:No|Number))\s*[:.]?\s*(\d{10,18})"],
    "central": [r"Account\s*(?:No\.?|Number)?\s*[:.]?\s*(\d{10,18})"],
    "icici": [r"(?:Savings\s+(?:Account|A/c)|Account\s+Number)\s*[:.]?\s*([X\d]{8,18})"],
    "sbi": [r"Account\s*(?:No|Number)\s*[:.]?\s*(\d{11,18})"],
    "boi": [
        r"(?:Account|A/C)(?:\s*(?:No|Number))?[^\d\r\n]{0,30}(\d{15})",
        r"Account\s*(?:No|Number)\s*[:.]?\s*(\d{11,18})",
        r"\b(\d{15})\b",
    ],
    "kotak": [r"Account\s*(?:No|Number|#)\s*[:.]?\s*(\d{10,18})"],
    "pnb": [r"(?:Statement\s+of\s+Account\s*No\.?|Account\s*(?:No|Number))\s*[:.]?\s*(\d{13,18})"],
    "bob": [r"(?:Account\s*(?:No|Number)|A/c\s*(?:No|Number))\s*[:.]?\s*(\d{14,16})"],
}
ICICI_V2_ACCOUNTS = [
    r"(?:A/C\s*No|Account\s*(?:No|Number))\s*[:.]?\s*(\d{10,18})",
    r"\b(\d{12})\s+(?:ICIC0[A-Z0-9]{6})",
]
# Statement period patterns per bank.
PERIODS = {
    "hdfc": r"(?:Statement\s+)?From\s*[:.]?\s*(\d{2}/\d{2}/\d{2,4})\s*To\s*[:.]?\s*(\d{2}/\d{2}/\d{2,4})",
    "yes": r"Period\s*[:.]?\s*From\s*[:.]?\s*(\d{2}-[A-Za-z]{3}-\d{4})\s*To\s*[:.]?\s*(\d{2}-[A-Za-z]{3}-\d{4})",
    "axis": r"From\s*[:.]?\s*(\d{2}/\d{2}/\d{4})\s*To\s*[:.]?\s*(\d{2}/\d{2}/\d{4})",
    "central": r"Statement\s+From\s*[:.]?\s*(\d{2}/\d{2}/\d{4})\s*to\s*[:.]?\s*(\d{2}/\d{2}/\d{4})",
    "sbi": r"Statement\s+From\s*[:.]?\s*(\d{2}-\d{2}-\d{4})\s*To\s*[:.]?\s*(\d{2}-\d{2}-\d{4})",
    "boi": r"FROM\s*[:.]?\s*(\d{2}-\d{2}-\d{4})\s*TO\s*[:.]?\s*(\d{2}-\d{2}-\d{4})",
    "kotak": r"(?:Period|From)\s*[:.]?\s*(\d{2}[/-]\d{2}[/-]\d{4})\s*(?:To|-)\s*(\d{2}[/-]\d{2}[/-]\d{4})",
    "pnb": r"(?:Statement\s+for\s+Period|Period|From)\s*[:.]?\s*(\d{2}[/-]\d{2}[/-]\d{4})\s*(?:to|To|-)\s*(\d{2}[/-]\d{2}[/-]\d{4})",
    "bob": r"(?:Statement\s+Period|Period|From)\s*[:.]?\s*(\d{2}[/-]\d{2}[/-]\d{4})\s*(?:to|To|-)\s*(\d{2}[/-]\d{2}[/-]\d{4})",
}
# Customer name patterns; a whole match counts where there is no group.
NAMES = {
    "hdfc": (r"\b(?:MR|MRS|MS|M/S\.?)\s+[A-Z0-9\s.]{3,40}", 0),
    "axis": (r"Account\s+Statement\s+Report\s*\n+([A-Z0-9\s.&'-]{3,60})\n+(?:Joint\s+Holder|PLOT|Scheme)", 1),
    "central": (r"Branch\s+Code\s*[:.]?\s*\d+\s*\r?\n\s*([^\r\n]{3,60})", 1),
    "icici": (r"ACCOUNT\s+HOLDERS?\s*[:.]?\s*([A-Z0-9\s.&'-]{3,60})", 1),
    "sbi": (r"(?:Mr\.|Mrs\.|Ms\.|Shri|Smt\.)\s+([A-Z\s.&'-]{3,60})", 0),
    "boi": (r"(?:M/S|Mr\.|Mrs\.|Ms\.|Shri|Smt\.)\s+([A-Z\s.&'-]{3,60})", 0),
    "kotak": (r"(?:Customer\s+Name|Name|Account\s+Holder\s*Name)\s*[:.]?\s*([A-Za-z\s.]{3,40})(?:\r?\n|\t|$)", 1),
    "pnb": (
        r"Customer\s+Name\s*[:.]?\s*([A-Za-z0-9\s.&'-]{3,60})(?:\r?\n|\t|CKYC|Customer\s+Address|Branch\s+Address"
        r"|Branch\s+Contact|$)",
        1,
    ),
    "bob": (
        r"(?:Customer\s+Name|Account\s+Name|Name)\s*[:.]?\s*([A-Za-z0-9\s.&'-]{3,60}?)(?:\r?\n|\t|Branch"
        r"|Customer\s+ID|Cust\s+ID|Address|Account\s+No|$)",
        1,
    ),
}


def file_texts(lines: DataFrame, pages: int = 4) -> DataFrame:
    """Text of the first pages of each file, lines in order. Four pages bound what one file gathers."""
    line = F.struct("line_no", "line_text")
    out = lines.filter(F.col("page") <= pages).groupBy("file_id").agg(F.array_sort(F.collect_list(line)).alias("_l"))
    return out.select("file_id", F.array_join(F.col("_l")["line_text"], "\n").alias("text"))


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _folded(text: Column) -> Column:
    """a-z as capitals and nothing else, as patterns that ignore case compare."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.upper(text)).otherwise(F.translate(text, _LOWER, _UPPER))


def fold(text: str) -> str:
    return "".join(c.upper() if c in _LOWER else c for c in text)


def _alternatives(pattern: str) -> list[str]:
    """Ways of a pattern that are split at its outermost bars."""
    ways, depth, at = [""], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            ways[-1] += pattern[at : at + 2]
            at += 2
            continue
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            ways.append("")
        else:
            ways[-1] += c
        at += 1
    return ways


def _piece(way: str) -> tuple[str, bool]:
    """The longest literal that every match of one way holds, and whether it is all of the way; empty if there is none."""
    run, best, exact = "", "", True
    for kind, value in sre_parse.parse(way):
        if kind is sre.LITERAL:
            run += chr(value)
            best = max(best, run, key=len)
        else:
            run, exact = "", False
    return fold(best), exact


def needed(pattern: str) -> tuple[list[str], bool] | None:
    """``(pieces, exact)``: every match holds one of the pieces, in capitals; exact if the pieces alone are the pattern. None if unknown."""
    found = [_piece(way) for way in _alternatives(pattern)]
    if not all(piece for piece, _ in found):
        return None
    return sorted({piece for piece, _ in found}), all(exact for _, exact in found)


def pattern_test(pattern: str) -> Column:
    """Whether ``text`` has the pattern: pieces are looked for in ``folded``, and the pattern is only tried on texts that have one."""
    known = needed(pattern)
    whole = F.col("text").rlike("(?i)" + pattern)
    if known is None:
        return whole
    pieces, exact = known
    has = F.lit(False)
    for piece in pieces:
        has = has | F.col("folded").contains(piece)
    return has if exact else has & whole


#: Every signal as the name of its bank and its own, in order; its number is its bit, 63 to a long.
NAMES_OF_SIGNALS = [f"{bank}_{signal}" for bank, rules in SIGNALS.items() for signal, _, _, _ in rules]
_BIT = {name: divmod(k, 63) for k, name in enumerate(NAMES_OF_SIGNALS)}
_LONGS = 1 + max(part for part, _ in _BIT.values())


def signal_flags(texts: DataFrame) -> DataFrame:
    """``(file_id, text, h0, h1, ...)``: the signals found per file as bits.

    A pattern that several banks share is tested once. Tests stay in one array of the plan, so that none is repeated for a later use.
    """
    alike: dict[tuple, tuple[str, list[str]]] = {}
    for bank, rules in SIGNALS.items():
        for signal, pattern, _, _ in rules:
            known = needed(pattern)
            key = (tuple(known[0]),) if known and known[1] else (pattern, None)
            alike.setdefault(key, (pattern, []))[1].append(f"{bank}_{signal}")
    rows = texts.select("file_id", "text", _folded(F.col("text")).alias("folded"))
    rows = rows.select("file_id", "text", F.array(*[pattern_test(p) for p, _ in alike.values()]).alias("tests"))
    bits = []
    for part in range(_LONGS):
        total = F.lit(0).cast("long")
        for k, (_, names) in enumerate(alike.values()):
            if own := sum(1 << _BIT[n][1] for n in names if _BIT[n][0] == part):
                total = total + F.when(F.get("tests", F.lit(k)), F.lit(own).cast("long")).otherwise(0)
        bits.append(total.alias(f"h{part}"))
    return rows.select("file_id", "text", *bits)


def signal_names(flags: DataFrame) -> DataFrame:
    """``(file_id, name)`` of the signals found."""
    found = F.array(*[F.when(_h(n), F.lit(n)) for n in NAMES_OF_SIGNALS])
    return flags.select("file_id", F.explode(F.array_compact(found)).alias("name"))


def _h(name: str) -> Column:
    part, bit = _BIT[name]
    return F.col(f"h{part}").bitwiseAND(F.lit(1 << bit)) != 0


def _count(*names: str) -> Column:
    out = F.lit(0)
    for name in names:
        out = out + _h(name).cast("int")
    return out


def _columns(bank: str) -> Column:
    return _count(*[f"{bank}_{s}" for s, _, _, is_column in SIGNALS[bank] if is_column])


def score_files(flags: DataFrame) -> DataFrame:
    """Column counts, scores and candidate flags per bank."""
    out = flags.withColumns({f"{bank}_cols": _columns(bank) for bank in SIGNALS})
    v2_row = _h("icici_v2_withdrawl") & _h("icici_v2_deposit") & _h("icici_balance") & _h("icici_v2_tran")
    v2_names = ["detailed", "tran", "remarks", "withdrawl", "deposit", "cheque"]
    v2_cols = _count(*[f"icici_v2_{n}" for n in v2_names]) + F.when(v2_row, 2).otherwise(0)
    out = out.withColumns({"icici_v2_row": v2_row, "icici_v2_cols": v2_cols})
    is_v2 = (
        F.col("icici_v2_row")
        | (_h("icici_v2_detailed") & (F.col("icici_v2_cols") >= 4))
        | (
            _h("icici_v2_withdrawl")
            & _h("icici_v2_deposit")
            & _h("icici_v2_tran")
            & (_h("icici_ifsc") | _h("icici_brand"))
        )
    )
    out = out.withColumn("icici_is_v2", is_v2)
    scores = {}
    for bank, rules in SIGNALS.items():
        score = F.col(f"{bank}_cols") * 5
        if bank == "icici":
            score = F.greatest("icici_cols", "icici_v2_cols") * 5 + F.when(F.col("icici_v2_row"), 40).otherwise(0)
        for signal, _, weight, _ in rules:
            if weight:
                score = score + F.when(_h(f"{bank}_{signal}"), weight).otherwise(0)
        scores[f"{bank}_score"] = score
    out = out.withColumns(scores)

    def any_of(bank: str, *names: str) -> Column:
        cond = F.lit(False)
        for n in names:
            cond = cond | _h(f"{bank}_{n}")
        return cond

    def structure(bank: str, sure: list[str], with_brand: list[str]) -> Column:
        return any_of(bank, *sure) | (_h(f"{bank}_brand") & any_of(bank, *with_brand))

    def cols(bank: str, n: int) -> Column:
        return F.col(f"{bank}_cols") >= n

    kotak_sides = _h("kotak_brand") & _h("kotak_withdrawal") & _h("kotak_deposit")
    icici = structure(
        "icici", ["ifsc", "header", "domain"], ["particulars", "withdrawals", "label"]
    ) | F.col("icici_is_v2")
    candidates = {
        "hdfc": structure("hdfc", ["ifsc", "header"], ["narration", "closing"]) & cols("hdfc", 5),
        "yes": structure("yes", ["ifsc", "header"], ["desc", "running", "label", "service"]) & cols("yes", 5),
        "axis": structure("axis", ["ifsc", "header"], ["particulars", "drcr", "label"]) & cols("axis", 5),
        "central": structure("central", ["ifsc", "domain"], ["post_date", "details", "scheme"]) & cols("central", 5),
        "icici": icici & (cols("icici", 4) | F.col("icici_is_v2")),
        "sbi": structure("sbi", ["ifsc", "domain"], ["forward", "summary", "post_date"]) & cols("sbi", 4),
        "boi": structure("boi", ["ifsc", "domain", "slogan"], ["tran_date", "inst_no", "opening"])
        & (cols("boi", 4) | _h("boi_ifsc")),
        "kotak": (structure("kotak", ["ifsc", "header", "crn"], ["ref"]) | kotak_sides)
        & (cols("kotak", 4) | _h("kotak_ifsc")),
        "pnb": structure("pnb", ["ifsc", "slogan"], ["withdrawal", "deposit", "alpha", "cheque", "header"])
        & (cols("pnb", 4) | _h("pnb_ifsc") | (_h("pnb_brand") & cols("pnb", 3))),
        "bob": structure("bob", ["ifsc", "slogan"], ["withdrawal", "deposit", "serial", "cheque", "header"])
        & (cols("bob", 4) | _h("bob_ifsc") | (_h("bob_brand") & cols("bob", 3))),
    }
    return out.withColumns({f"{bank}_candidate": cond for bank, cond in candidates.items()})


def decide(scored: DataFrame) -> DataFrame:
    """Winning bank per file; null when none wins."""
    def score(bank: str) -> Column:
        return F.col(f"{bank}_score")

    def is_candidate(bank: str) -> Column:
        return F.col(f"{bank}_candidate")

    out = None
    for bank in STRICT_ORDER:
        cond = is_candidate(bank)
        for other in SIGNALS:
            if other != bank and not (bank == "axis" and other == "central"):
                cond = cond & (score(bank) > score(other))
        out = F.when(cond, bank) if out is None else out.when(cond, bank)
    yes = is_candidate("yes")
    for other in RIVALS:
        yes = yes & (~is_candidate(other) | (score("yes") > score(other)))
    hdfc = is_candidate("hdfc")
    for other in ["yes", *RIVALS[1:]]:
        hdfc = hdfc & (~is_candidate(other) | (score("hdfc") >= score(other)))
    return scored.withColumn("bank", out.when(yes, "yes").when(hdfc, "hdfc"))


def _first_match(patterns: list[str]) -> Column:
    found = [F.nullif(F.regexp_extract("text", "(?i)" + p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found)


def account_of(bank: str) -> Column:
    found = _first_match(ACCOUNTS[bank])
    if bank == "icici":
        return F.when(F.col("icici_is_v2"), F.coalesce(_first_match(ICICI_V2_ACCOUNTS), found)).otherwise(found)
    return found


def period_of(bank: str) -> Column:
    """Struct of start and end date of the statement period."""
    pattern = PERIODS.get(bank)
    if pattern is None:
        none = F.lit(None).cast("date")
        return F.struct(none.alias("start"), none.alias("end"))
    side = [parse_date_multi(F.regexp_extract("text", "(?i)" + pattern, i)) for i in (1, 2)]
    return F.struct(side[0].alias("start"), side[1].alias("end"))


def name_of(bank: str) -> Column:
    if bank not in NAMES:
        return F.lit(None).cast("string")
    pattern, group = NAMES[bank]
    return F.nullif(strip(F.regexp_extract("text", "(?i)" + pattern, group)), F.lit(""))


def route(decided: DataFrame) -> DataFrame:
    """Bank code and parser profile of a decided file; ``universal`` when no bank won."""
    codes = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    out = decided.withColumn("bank_code", F.coalesce(F.try_element_at(codes, F.col("bank")), F.lit(0)))
    version = code_case(F.col("bank_code"), {c: v for c, _, v in BANKS}, "universal")
    return out.withColumn(
        "profile", F.when((F.col("bank") == "icici") & F.col("icici_is_v2"), "ICICI-v2").otherwise(version)
    )


def detect(scored: DataFrame) -> DataFrame:
    """Bank, confidence, account, period and customer name per file; the bank's own patterns come first."""
    out = decide(scored)

    def per_bank(make) -> Column:
        case = None
        for bank in SIGNALS:
            hit = F.col("bank") == bank
            case = F.when(hit, make(bank)) if case is None else case.when(hit, make(bank))
        return case

    def proof(bank: str) -> Column:
        names, wanted = IDENTITY[bank]
        known = F.lit(False)
        for n in names:
            known = known | (F.col("icici_is_v2") if n == "is_v2" else _h(f"{bank}_{n}"))
        enough = F.col(f"{bank}_cols") >= wanted
        if bank == "icici":
            enough = enough | (F.col("icici_v2_cols") >= wanted)
        base = F.lit(0.90)
        base = base + F.when(_h(f"{bank}_brand") & known, 0.05).otherwise(0.0)
        base = base + F.when(enough, 0.03).otherwise(0.0)
        return base + F.when(account_of(bank).isNotNull(), 0.02).otherwise(0.0)

    fallback = period_of("hdfc")
    period = per_bank(period_of)
    out = out.withColumns(
        {
            "confidence": F.when(
                F.col("bank").isNotNull(), F.round(F.least(F.lit(1.0), per_bank(proof)), 4)
            ).otherwise(F.lit(0.0)),
            "account_number": F.coalesce(per_bank(account_of), account_of("hdfc")),
            "period_start": F.coalesce(period["start"], fallback["start"]),
            "period_end": F.coalesce(period["end"], fallback["end"]),
            "customer_name": F.coalesce(per_bank(name_of), name_of("hdfc")),
            "is_supported": F.col("bank").isNotNull(),
        }
    )
    return route(out)
