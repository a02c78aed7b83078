"""Amounts, dates and identifiers from text, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.functions.text import strip
from ledgerspark.model import MONEY

# Token shapes in statements.
DATE_TOKEN = (
    r"(?i)^(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}\s+[A-Za-z]{3}\s+\d{2,4}|\d{1,2}-[A-Za-z]{3}-\d{2,4}"
    r"|\d{1,2}\.[A-Za-z]{3}\.\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{2,4})$"
)
DATE_INSIDE = (
    r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}\s+[A-Za-z]{3}\s+\d{2,4}|\d{1,2}-[A-Za-z]{3}-\d{2,4}"
    r"|\d{1,2}\.[A-Za-z]{3}\.\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{2,4})\b"
)
AMOUNT_TOKEN = (
    r"(?i)^(?:(?:₹|INR|Rs\.?|\$)\s*)?-?[\d,]+(?:\.\d{1,2})?(?:\s*(?:Cr\.?|Dr\.?))?$"
    r"|^\((?:(?:₹|INR|Rs\.?|\$)\s*)?[\d,]+(?:\.\d{1,2})?\)$"
)
MONTHS = "JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER".split()


def is_date_token(c: Column) -> Column:
    return strip(c).rlike(DATE_TOKEN)


def is_amount_token(c: Column) -> Column:
    return strip(c).rlike(AMOUNT_TOKEN)


def _number(clean: Column) -> Column:
    """Decimal from text with an optional leading or trailing sign; anything else is null."""
    clean = strip(clean)
    body = F.regexp_replace(clean, r"^(.*[^+-])\s*([+-])$", "$2$1")
    good = body.rlike(r"^[+-]?\s*(?:\d+\.?\d*|\.\d+)$")
    return F.when(good, F.regexp_replace(body, r"\s", "")).try_cast(MONEY)


def parse_amount_universal(c: Column) -> Column:
    """Drop currency and Dr/Cr marks; brackets negate; long digit runs without a point are not money."""
    clean = strip(F.regexp_replace(c, r"(?i)₹|INR|Rs\.?|Cr\.?|Dr\.?|,", ""))
    clean = F.regexp_replace(clean, r"^\(\s*(.*?)\s*\)$", "-$1")
    number_like = (F.length(clean) <= 10) | clean.contains(".")
    return F.when(number_like, _number(clean))


def parse_amount_drcr(c: Column, keep_sign: bool = False) -> Column:
    """A Dr suffix makes the value negative, a Cr suffix positive; else the sign is kept or dropped."""
    clean = strip(F.regexp_replace(c, ",", ""))
    value = _number(F.regexp_replace(clean, r"(?i)[dc]r$", ""))
    size = F.abs(value)
    kept = value if keep_sign else size
    return F.when(clean.rlike(r"(?i)dr$"), -size).when(clean.rlike(r"(?i)cr$"), size).otherwise(kept).cast(MONEY)


def parse_amount_sheet(c: Column) -> Column:
    """Drop separators, currency signs and a trailing Dr/Cr without touching the sign."""
    clean = strip(F.regexp_replace(strip(c), r"[,₹$]", ""))
    return _number(F.regexp_replace(clean, r"(?i)[dc]r$", ""))


def parse_balance_signed(c: Column) -> Column:
    """A Dr suffix marks an overdrawn, negative balance."""
    text = strip(c)
    value = _number(F.regexp_replace(text, r"(?i)Dr|Cr|,", ""))
    return F.when(text.rlike(r"(?i)dr$"), -value).otherwise(value).cast(MONEY)


def repair_decimal_separator(c: Column) -> Column:
    """Read a last comma followed by two digits as the decimal point."""
    return F.regexp_replace(c, r",(\d{2})$", ".$1")


def _iso(year: Column, month: Column, day: Column) -> Column:
    """Date from number texts; two-digit years up to 49 are 20xx; impossible dates are null."""
    century = F.when(F.length(year) == 4, "").when(year <= "49", "20").otherwise("19")
    text = F.concat_ws("-", F.concat(century, year), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(text >= "0001", text.try_cast("date"))


def _month_number(name: Column, full: bool) -> Column:
    """Number of a month name as text; 0 if it is none. With ``full`` the whole name counts too."""
    upper = F.upper(name)
    out = F.find_in_set(upper, F.lit(",".join(m[:3] for m in MONTHS)))
    if full:
        out = F.greatest(out, F.find_in_set(upper, F.lit(",".join(MONTHS))))
    return out.cast("string")


def _match(c: Column, pattern: str, build) -> Column:
    """``build(parts)`` when the pattern matches, else null; parts are cut at date separators, so they cost one pass."""
    def part(i: int) -> Column:
        return F.get(F.split(c, r"[-/. ]|(?<=\d)T"), F.lit(i))

    return F.when(c.rlike(pattern), build(part))


def parse_date_multi(c: Column) -> Column:
    """Day-first numeric dates with / - or . , month names, and year-first dates."""
    text = strip(c)
    return F.coalesce(
        _match(text, r"^\d{1,2}([/.-])\d{1,2}\1(?:\d{4}|\d{2})$", lambda g: _iso(g(2), g(1), g(0))),
        _match(text, r"^\d{1,2}([ /-])[A-Za-z]{3}\1\d{4}$", lambda g: _iso(g(2), _month_number(g(1), False), g(0))),
        _match(text, r"^\d{1,2} [A-Za-z]{3,9} \d{4}$", lambda g: _iso(g(2), _month_number(g(1), True), g(0))),
        _match(text, r"^\d{4}([/.-])\d{2}\1\d{2}$", lambda g: _iso(g(0), g(1), g(2))),
    )


def parse_date_sheet(c: Column) -> Column:
    """Sheet dates; day before month, month before day only where the first reading is impossible."""
    text = strip(c)
    return F.coalesce(
        _match(text, r"^\d{1,2}([/-])\d{1,2}\1\d{4}$", lambda g: _iso(g(2), g(1), g(0))),
        _match(text, r"^\d{1,2}([ -])[A-Za-z]{3}\1\d{4}$", lambda g: _iso(g(2), _month_number(g(1), False), g(0))),
        _match(text, r"^\d{4}([/-])\d{2}\1\d{2}$", lambda g: _iso(g(0), g(1), g(2))),
        _match(text, r"^\d{1,2}/\d{1,2}/\d{4}(?: \d{1,2}:\d{2}.*)?$", lambda g: _iso(g(2), g(0), g(1))),
        _match(text, r"^\d{4}-\d{1,2}-\d{1,2}(?:[T ]\d{1,2}:\d{2}.*)?$", lambda g: _iso(g(0), g(1), g(2))),
    )


# Payment references inside a narration, tried in this order. The flag says whether the match is also a UTR.
IDENTIFIERS = [
    (r"(?i)(?:NEFT|RTGS)[-/]([A-Z0-9]{16,22})", True),
    (r"(?i)(?:MMT/)?IMPS/(\d{12})", True),
    (r"(?i)NFS/(?:CASH WDL/)?(\d{12})", False),
    (r"/(\d{12})/", True),
    (r"/(?:ICI|UPI)([a-zA-Z0-9]{20,})", False),
]


def extract_identifiers(c: Column) -> Column:
    """Struct (reference, utr) from the first pattern that matches."""
    none = F.lit(None).cast("string")
    reference, utr = none, none
    for pattern, both in reversed(IDENTIFIERS):
        hit, found = c.rlike(pattern), F.regexp_extract(c, pattern, 1)
        reference = F.when(hit, found).otherwise(reference)
        utr = F.when(hit, found if both else none).otherwise(utr)
    return F.struct(reference.alias("reference"), utr.alias("utr"))


# UTR shapes per bank, tried in order.
UTR_PATTERNS = {
    10: [
        r"\b(BARB[A-Z0-9]+)\b",
        r"\b(UPI/[A-Za-z0-9/_-]+|IMPS/[A-Za-z0-9/_-]+|NEFT/[A-Za-z0-9/_-]+|[A-Z0-9]{12,22})\b",
    ],
    9: [r"\b(PUNB[A-Z0-9]+|UPI/[A-Za-z0-9/_-]+|IMPS/[A-Za-z0-9/_-]+|NEFT/[A-Za-z0-9/_-]+|[A-Z0-9]{12,22})\b"],
    8: [
        r"\b(UPI-[A-Za-z0-9]+|MB-[A-Za-z0-9]+|IMPS-[A-Za-z0-9]+|EBPP-[A-Za-z0-9]+|TBMS-[A-Za-z0-9]+"
        r"|[A-Z0-9]{12,22})\b"
    ],
}


def extract_utr_prefixed(c: Column, reference: Column, bank: int) -> Column:
    """Struct (reference, utr): the bank's own prefix first, then a general shape; fills a missing reference."""
    utr = F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in UTR_PATTERNS[bank]])
    return F.struct(F.coalesce(F.nullif(reference, F.lit("")), utr).alias("reference"), utr.alias("utr"))


def reversal_sides(withdrawal: Column, deposit: Column) -> Column:
    """Struct (debit, credit, notes): a negative withdrawal is a credit, a negative deposit a debit."""
    credit = F.when(deposit >= 0, deposit).when(withdrawal < 0, -withdrawal)
    debit = F.when(deposit < 0, -deposit).when(withdrawal >= 0, withdrawal)
    notes = F.array_compact(
        F.array(
            F.when(withdrawal < 0, "Negative withdrawal interpreted as credit reversal."),
            F.when(deposit < 0, "Negative deposit interpreted as debit reversal."),
        )
    )
    return F.struct(debit.cast(MONEY).alias("debit"), credit.cast(MONEY).alias("credit"), notes.alias("notes"))


def canonical_amount(debit: Column, credit: Column, otherwise: str = "Unknown") -> Column:
    """Struct (amount, transaction_type) from the positive side."""
    amount = F.when(debit > 0, debit).when(credit > 0, credit).otherwise(F.lit(0)).cast(MONEY)
    kind = F.when(debit > 0, "Debit").when(credit > 0, "Credit").otherwise(otherwise)
    return F.struct(amount.alias("amount"), kind.alias("transaction_type"))


def safe_export_name(file_name: Column, bank: Column, day: Column, prefix: str = "Ledger") -> Column:
    """File name for an export: cleaned and clamped bank and base name plus the day."""
    def clean(c: Column, size: int) -> Column:
        kept = F.regexp_replace(c, r"[^a-zA-Z0-9_-]", "_")
        return F.substring(F.regexp_replace(kept, r"^_+|_+$", ""), 1, size)

    base = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return F.concat_ws(
        "_", F.lit(prefix), clean(bank, 20), clean(base, 40), F.concat(F.date_format(day, "yyyyMMdd"), F.lit(".xlsx"))
    )


# Header phrases in the order they are tried; (column type, contained phrases, whole phrases).
COLUMN_PHRASES = [
    ("ValueDate", ["value date", "value dt", "val date"], []),
    ("Date", ["date"], []),
    ("SerialNumber", ["s.no", "sl.no", "sr no", "serial no"], []),
    ("Reference", ["chq", "cheque", "ref", "utr", "instrument"], []),
    ("Debit", ["withdrawal", "debit", "dr.", "payment"], ["dr"]),
    ("Credit", ["deposit", "credit", "cr.", "receipt"], ["cr"]),
    ("Balance", ["balance", "closing", "running"], []),
    ("Description", ["particular", "narration", "description", "details", "remarks"], []),
    ("Indicator", ["debit/credit", "dr/cr", "cr/dr", "d/c"], ["type"]),
    ("SignedAmount", ["amount"], []),
    ("Branch", ["branch"], []),
]

def classify_column(phrase: Column) -> Column:
    lower = F.lower(phrase)
    out = F.lit("Unknown")
    for name, parts, whole in reversed(COLUMN_PHRASES):
        cond = F.lit(False)
        for part in parts:
            cond = cond | lower.contains(part)
        if whole:
            cond = cond | lower.isin(*whole)
        out = F.when(cond, name).otherwise(out)
    return out


# Header keyword classes.
HEADER_CLASSES = [
    r"(?i)\b(?:Date|Txn\s*Date|Tran\s*Date|Post\s*Date|Booking\s*Date)\b",
    r"(?i)\b(?:Particulars|Narration|Description|Transaction\s*Details|Details|Remarks)\b",
    r"(?i)\b(?:Withdrawal|Debit|Dr\.?|Debit\s*Amount)\b",
    r"(?i)\b(?:Deposit|Credit|Cr\.?|Credit\s*Amount)\b",
    r"(?i)\b(?:Balance|Closing\s*Balance|Running\s*Balance)\b",
    r"(?i)\b(?:Amount|Amount\(INR\)|Txn\s*Amount|Transaction\s*Amount)\b",
]


# A match of each class contains one of these in lower case; a search for them costs far less than the pattern.
HEADER_LITERALS = [
    ["date"],
    ["particulars", "narration", "description", "details", "remarks"],
    ["withdrawal", "debit", "dr"],
    ["deposit", "credit", "cr"],
    ["balance"],
    ["amount"],
]


def _contains_any(text: Column, parts: list[str]) -> Column:
    return reduce(or_, [text.contains(p) for p in parts])


def _has_phrase(text: Column, phrases: str) -> Column:
    """``text.rlike(phrases)`` for plain alternatives, in which only a point is escaped."""
    return _contains_any(text, [p.replace("\\.", ".") for p in phrases.split("|")])


def header_keyword_score(line: Column) -> Column:
    score, lower = F.lit(0), F.lower(line)
    for pattern, parts in zip(HEADER_CLASSES, HEADER_LITERALS, strict=True):
        score = score + (_contains_any(lower, parts) & line.rlike(pattern)).cast("int")
    return score


# Phrases of summary, heading and footer lines.
SUMMARY_PHRASES = r"opening balance|brought forward|b/f|closing balance|carried forward|c/f|grand total|page total"
FOOTER_PHRASES = r"page |computer generated|toll free|disclaimer|registered office|end of statement"
TABLE_END_PHRASES = r"page |computer generated|grand total|page total|disclaimer|toll free"
HEADING_GROUPS = [
    r"date",
    r"particular|narration|description|details",
    r"debit|dr\.|withdrawal",
    r"credit|cr\.|deposit",
    r"balance",
]


def is_summary_line(line: Column) -> Column:
    return _has_phrase(F.lower(line), SUMMARY_PHRASES)


def is_footer_line(line: Column) -> Column:
    return _has_phrase(F.lower(line), FOOTER_PHRASES)


def is_table_end(line: Column) -> Column:
    return _has_phrase(F.lower(line), TABLE_END_PHRASES)


def is_column_header_line(line: Column) -> Column:
    lower = F.lower(line)
    hits = F.lit(0)
    for pattern in HEADING_GROUPS:
        hits = hits + _has_phrase(lower, pattern).cast("int")
    return hits >= 2


def period_from_dates(text: Column) -> Column:
    """First and second distinct date token of a text."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\d{2}[/-]\d{2}[/-]\d{4})\b"), F.lit(1)))
    return F.struct(F.get(found, F.lit(0)).alias("period_from"), F.get(found, F.lit(1)).alias("period_to"))
