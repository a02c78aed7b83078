"""Named queries with their equivalent SQL."""

from __future__ import annotations

from ledgerspark.plans.registry import ORACLES, QUERIES  # noqa: F401
from ledgerspark.plans import (  # noqa: F401,E402
    anchored,
    books,
    detecting,
    ledger,
    listing,
    parsing,
    profiled,
    reviewing,
    scalars,
    stores,
    streams,
)
