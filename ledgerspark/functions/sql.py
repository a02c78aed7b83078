"""The scalar helpers as SQL functions, made from their bodies in this folder; they stay inside Catalyst.

Each body is a column expression over its arguments, and its SQL text is what the analysed expression says of itself. Helpers that give a
struct become table functions, to be used with ``LATERAL``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import parse as P
from ledgerspark.functions.text import mask_digits, normalize_ws, strip
from ledgerspark.operators import detect as D

MONEY_SQL = "DECIMAL(18,2)"


@dataclass(frozen=True)
class Function:
    """Parameters as (name, type), what comes back, and the body over the parameters; ``table`` if that is a struct of columns."""

    params: tuple[tuple[str, str], ...]
    returns: str
    body: Callable[..., Column]
    table: bool = False


def _text(returns: str, body: Callable[..., Column], table: bool = False) -> Function:
    return Function((("s", "STRING"),), returns, body, table)


def _utr(bank: int) -> Function:
    params = (("s", "STRING"), ("known", "STRING"))
    return Function(params, "reference STRING, utr STRING", lambda s, known: P.extract_utr_prefixed(s, known, bank), True)


def _of_text(make: Callable[[str], Column], bank: str) -> Callable[[Column], Column]:
    """Detection reads a column named ``text``."""
    return lambda s: make(bank)


def _default_type(kind: Column, debit: Column) -> Column:
    return F.coalesce(kind, F.when(debit.isNotNull(), "Debit").otherwise("Credit"))


FUNCTIONS: dict[str, Function] = {
    "ledger_strip": _text("STRING", strip),
    "ledger_normalize_ws": _text("STRING", normalize_ws),
    "ledger_mask_digits": _text("STRING", mask_digits),
    "ledger_amount_universal": _text(MONEY_SQL, P.parse_amount_universal),
    "ledger_amount_drcr": _text(MONEY_SQL, P.parse_amount_drcr),
    "ledger_amount_sheet": _text(MONEY_SQL, P.parse_amount_sheet),
    "ledger_balance_signed": _text(MONEY_SQL, P.parse_balance_signed),
    "ledger_repair_decimal": _text("STRING", P.repair_decimal_separator),
    "ledger_date": _text("DATE", P.parse_date_multi),
    "ledger_date_sheet": _text("DATE", P.parse_date_sheet),
    "ledger_is_date": _text("BOOLEAN", P.is_date_token),
    "ledger_is_amount": _text("BOOLEAN", P.is_amount_token),
    "ledger_default_type": Function((("kind", "STRING"), ("debit", MONEY_SQL)), "STRING", _default_type),
    "ledger_identifiers": _text("reference STRING, utr STRING", P.extract_identifiers, True),
    "ledger_utr_kotak": _utr(8),
    "ledger_utr_pnb": _utr(9),
    "ledger_utr_bob": _utr(10),
    **{
        f"ledger_period_{bank}": Function((("text", "STRING"),), "start DATE, end DATE", _of_text(D.period_of, bank), True)
        for bank in D.PERIODS
    },
}


def body_sql(spark: SparkSession, of: Function) -> str:
    """SQL text of a body over its parameters."""
    typed = spark.range(1).select(*[F.lit(None).cast(kind).alias(name) for name, kind in of.params])
    made = typed.select(of.body(*[F.col(name) for name, _ in of.params]).alias("r"))
    return made._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions for this session and return their names."""
    for name, of in FUNCTIONS.items():
        params = ", ".join(f"{n} {kind}" for n, kind in of.params)
        sql = body_sql(spark, of)
        if of.table:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS TABLE({_quoted(of.returns)}) RETURN SELECT inline(array({sql}))")
        else:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {of.returns} RETURN {sql}")
    return list(FUNCTIONS)


def _quoted(fields: str) -> str:
    return ", ".join("`{}` {}".format(*f.split(" ", 1)) for f in fields.split(", "))
