"""Running-balance checks: one operator, the bank differences held in a policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.model import LEDGER_ORDER, MONEY, TOTAL
from ledgerspark.operators.ordered import Hot, lag, last_before, last_upto, rownum, running_sum, with_ordered

BALANCED, MISMATCH, NOT_CHECKABLE = "BALANCED", "MISMATCH", "NOT_CHECKABLE"


def zero() -> Column:
    return F.lit(0).cast(MONEY)


@dataclass(frozen=True)
class Policy:
    """How a statement family finds the previous balance and judges the difference.

    previous  ``immediate`` row, ``carry`` the last known balance, or ``filled`` (missing balances computed)
    tolerance largest accepted difference
    first     row 1: ``skip``, ``check`` against a seed, ``opening`` when one is known, or ``implied`` from itself
    positive  count only sides above zero
    debit_wins  a present debit hides the credit
    sweep     zero-balance sweep entries are exempt
    infer     a row without sides takes its side from the balance change
    """

    previous: str
    tolerance: str
    first: str = "skip"
    positive: bool = False
    debit_wins: bool = False
    sweep: bool = False
    infer: bool = False


# How each statement family checks continuity.
POLICIES = {
    "validate": Policy("immediate", "0.01", positive=True),
    "financial": Policy("immediate", "0.05", first="opening"),
    "hdfc": Policy("carry", "0.01"),
    "yes": Policy("immediate", "0.01", sweep=True),
    "axis": Policy("carry", "0.05", debit_wins=True),
    "central": Policy("carry", "0.01"),
    "icici_v1": Policy("carry", "0.001", first="check", debit_wins=True),
    "icici_v2": Policy("carry", "0.01", first="implied"),
    "sbi": Policy("carry", "0.01", first="check", debit_wins=True, infer=True),
    "boi": Policy("carry", "0.01", first="check", infer=True),
    "kotak": Policy("filled", "0.05"),
    "pnb": Policy("filled", "0.05"),
    "bob": Policy("filled", "0.05"),
}

# Narrations of sweep entries.
SWEEP = r"SWEEP-IN|INT\. ON SWCR|TDS RECOVERED"


def is_sweep(description: Column) -> Column:
    return F.upper(description).rlike(SWEEP)


def _side(col: Column, policy: Policy) -> Column:
    return F.when(col > 0, col).otherwise(zero()) if policy.positive else F.coalesce(col, zero())


def net_change(debit: Column, credit: Column) -> Column:
    return F.coalesce(credit, zero()) - F.coalesce(debit, zero())


def continuity(
    df: DataFrame,
    policy: Policy | str,
    key: str = "source_file_id",
    order: list[str] | None = None,
    opening: Column | None = None,
    hot: Hot | None = None,
) -> DataFrame:
    """Add ``row_no``, ``prev_balance``, ``expected_balance``, ``balance_status`` (and inferred/filled values).

    One ordered pass per file. ``opening`` is a column of ``df`` with the stated opening balance, if known.
    """
    p = POLICIES[policy] if isinstance(policy, str) else policy
    opening = F.lit(None).cast(MONEY) if opening is None else opening
    balance, debit, credit = F.col("balance"), F.col("debit"), F.col("credit")
    order = order or LEDGER_ORDER

    if p.previous == "filled":
        net = net_change(debit, credit)
        out = with_ordered(df, [key], order, {"row_no": rownum(), "_run": running_sum(net)}, hot)
        anchor = balance - F.col("_run")
        out = with_ordered(
            out, [key], order, {"_before": last_before(anchor), "_upto": last_upto(anchor)}, hot
        )
        seed = F.coalesce(opening, zero())
        expected = (F.coalesce(F.col("_before"), seed) + F.col("_run")).cast(MONEY)
        filled = (F.coalesce(F.col("_upto"), seed) + F.col("_run")).cast(MONEY)
        out = out.withColumns({"expected_balance": expected, "filled_balance": filled})
        out = out.withColumn("prev_balance", (F.col("expected_balance") - net).cast(MONEY))
        checkable = balance.isNotNull() & (F.col("row_no") > 1)
    else:
        previous = lag(balance) if p.previous == "immediate" else last_before(balance)
        out = with_ordered(df, [key], order, {"row_no": rownum(), "_prev": previous}, hot)
        first_row = F.col("row_no") == 1
        prev = F.col("_prev")
        if p.first == "opening":
            prev = F.when(first_row, opening).otherwise(prev)
        elif p.first == "check":
            prev = F.coalesce(prev, opening, F.when(first_row, balance), zero())
        elif p.first == "implied":
            prev = F.coalesce(prev, F.when(first_row, balance - net_change(debit, credit)), zero())
        out = out.withColumn("prev_balance", prev.cast(MONEY))
        if p.infer:
            delta = balance - F.col("prev_balance")
            bare = debit.isNull() & credit.isNull() & balance.isNotNull()
            out = out.withColumns(
                {
                    "debit": F.when(bare & (delta < 0), -delta).otherwise(debit).cast(MONEY),
                    "credit": F.when(bare & (delta > 0), delta).otherwise(credit).cast(MONEY),
                }
            )
        d, c = _side(debit, p), _side(credit, p)
        if p.debit_wins:
            c = F.when(debit.isNotNull(), zero()).otherwise(c)
        out = out.withColumn("expected_balance", (F.col("prev_balance") - d + c).cast(MONEY))
        checkable = F.col("prev_balance").isNotNull() & balance.isNotNull()

    close = F.abs(F.col("expected_balance") - balance) <= F.lit(p.tolerance).cast("decimal(18,3)")
    if p.sweep:
        close = close | (is_sweep(F.coalesce("description", F.lit(""))) & (balance == 0))
    status = F.when(checkable, F.when(close, BALANCED).otherwise(MISMATCH)).otherwise(NOT_CHECKABLE)
    return out.withColumn("balance_status", status).drop("_prev", "_run", "_before", "_upto")


def carry_confidence(start: Column, status: Column, balance: Column) -> Column:
    """1.0 when proved, 0.98 for the first known balance, lowered to no less than 0.5 on a mismatch."""
    return (
        F.when(status == BALANCED, F.lit(1.0))
        .when(status == MISMATCH, F.greatest(F.lit(0.5), start - 0.25))
        .when(balance.isNotNull(), F.lit(0.98))
        .otherwise(start)
    )


def infer_signed_side(df: DataFrame, key: str, order: list[str], opening: Column, hot: Hot | None = None) -> DataFrame:
    """Turn a signed ``raw_amount`` with an optional DR/CR ``indicator`` into debit and credit.

    Order of evidence: the indicator, a negative sign, then the balance change (within 0.05).
    """
    out = with_ordered(df, [key], order, {"_prev": last_before(F.col("balance"))}, hot)
    raw, ind = F.col("raw_amount"), F.upper(F.coalesce("indicator", F.lit("")))
    size = F.abs(raw)
    delta = F.col("balance") - F.coalesce(F.col("_prev"), opening)
    side = (
        F.when(raw.isNull(), None)
        .when(ind.contains("DR"), "D")
        .when(ind.contains("CR"), "C")
        .when(raw < 0, "D")
        .when(F.abs(delta - size) <= F.lit("0.05").cast(MONEY), "C")
        .when(F.abs(delta + size) <= F.lit("0.05").cast(MONEY), "D")
    )
    return out.withColumns(
        {
            "debit": F.when(side == "D", size).cast(MONEY),
            "credit": F.when(side == "C", size).cast(MONEY),
        }
    ).drop("_prev")


def judge_rows(
    df: DataFrame, key: str, opening: Column, order: list[str] | None = None, hot: Hot | None = None
) -> DataFrame:
    """Reconcile each row with the opening balance or its predecessor and flag rows without an amount."""
    out = continuity(df, "financial", key, order, opening, hot)
    no_debit = ~F.coalesce(F.col("debit") > 0, F.lit(False))
    no_credit = ~F.coalesce(F.col("credit") > 0, F.lit(False))
    return out.withColumns({"missing_amount": no_debit & no_credit, "opening_balance": opening})


def judge_files(rows: DataFrame, key: str, closing: Column | None = None) -> DataFrame:
    """Document verdict per file. ``closing`` is an aggregate; the last known balance when not given."""
    n, ok = F.count(F.lit(1)), F.count_if(F.col("balance_status") == BALANCED)
    failed, missing = F.count_if(F.col("balance_status") == MISMATCH), F.count_if("missing_amount")

    def positive(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(name) > 0, F.col(name))), F.lit(0)).cast(TOTAL)

    if closing is None:
        closing = F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("row_no")))
    out = rows.groupBy(key).agg(
        n.alias("total_rows"),
        ok.alias("reconciled_rows"),
        failed.alias("failed_rows"),
        F.count_if(F.col("balance").isNull()).alias("missing_balance"),
        missing.alias("missing_amount"),
        positive("debit").alias("total_debits"),
        positive("credit").alias("total_credits"),
        F.max("opening_balance").alias("opening_balance"),
        closing.alias("closing_balance"),
    )
    opening = F.col("opening_balance")
    out = out.withColumn(
        "calculated_closing", (opening + F.col("total_credits") - F.col("total_debits")).cast(TOTAL)
    )
    gap = F.abs(F.col("calculated_closing") - F.col("closing_balance")) > F.lit("0.05").cast(MONEY)
    gap = F.coalesce(gap, F.lit(False))
    pairs = F.col("total_rows") - F.when(opening.isNull(), 1).otherwise(0)
    seen = F.col("total_rows") - F.col("missing_balance")
    issues = F.col("missing_amount") + F.col("failed_rows") + gap.cast("int")
    return out.withColumns(
        {
            "discrepancy_count": issues,
            "fully_reconciled": (pairs > 0) & (F.col("reconciled_rows") == pairs) & (issues == 0),
            "reconciliation_rate": F.when(seen > 0, F.bround(F.col("reconciled_rows") / seen, 4)).otherwise(
                F.lit(0.0)
            ),
        }
    )


def first_discrepancies(rows: DataFrame, key: str, limit: int, hot: Hot | None = None) -> DataFrame:
    """The first ``limit`` discrepancies per file as ``code@row``; a running count keeps the lists short."""
    where = F.col("row_no").cast("string")
    issues = F.array_compact(
        F.array(
            F.when(F.col("missing_amount"), F.concat(F.lit("MISSING_AMOUNT@"), where)),
            F.when(F.col("balance_status") == MISMATCH, F.concat(F.lit("BALANCE@"), where)),
        )
    )
    out = rows.withColumn("_issues", issues)
    out = with_ordered(out, [key], ["row_no"], {"_upto": running_sum(F.size("_issues"))}, hot)
    room = F.lit(limit) - (F.col("_upto") - F.size("_issues"))
    out = out.filter((F.size("_issues") > 0) & (room > 0))
    kept = F.slice("_issues", 1, F.least(room, F.size("_issues")).cast("int"))
    lists = F.sort_array(F.collect_list(F.struct("row_no", kept.alias("kept"))))
    return out.groupBy(key).agg(F.array_join(F.flatten(lists["kept"]), ",").alias("first_two"))


def penalty_confidence(date_ok: Column) -> Column:
    """Row confidence that starts at 0.95 and loses a fixed amount per weakness, within 0.1 and 1."""
    from ledgerspark.functions.text import is_blank

    no_amount = F.coalesce(F.col("amount") <= 0, F.lit(True))
    sided = F.col("debit").isNotNull() | F.col("credit").isNotNull()
    weak = [
        (~date_ok, 0.30),
        (no_amount, 0.30),
        (F.col("transaction_type").isNull(), 0.25),
        (F.col("balance").isNull(), 0.20),
        (is_blank(F.col("description")), 0.15),
        ((F.col("balance_status") == MISMATCH) & sided, 0.10),
    ]
    score = F.lit(0.95)
    for cond, loss in weak:
        score = score - F.when(cond, loss).otherwise(0.0)
    return F.greatest(F.lit(0.10), F.least(F.lit(1.0), score))


def capped_confidence(start: Column, date_ok: Column) -> Column:
    """Row confidence capped by its worst weakness: 0.5 without date or side, 0.6 with both sides."""
    d, c = F.col("debit").isNotNull(), F.col("credit").isNotNull()
    return F.least(
        start,
        F.when(~date_ok, 0.5).otherwise(1.0),
        F.when(~d & ~c, 0.5).otherwise(1.0),
        F.when(d & c, 0.6).otherwise(1.0),
    )
