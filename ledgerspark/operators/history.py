"""The ledger at any time: an append-only log of corrections with snapshots of the whole ledger in between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators import audit as A
from ledgerspark.operators.ordered import Hot
from ledgerspark.sources.commits import Commits

EVENTS, STATES = "events", "states"
#: Bucket of the ledger as it was imported, before every correction.
FIRST = "0001-01-01 00:00:00"


def correction_events(requests: DataFrame, ledger: DataFrame, snapshots: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Log entries with the state of the row ``after`` each; entries that change nothing are not logged."""
    return A.logged(requests, ledger, snapshots, hot).select(
        "transaction_id", "ts", "request_no", "user_id", "reason", "changes", F.col("new").alias("after")
    )


def _second(at: Column | str) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


class LedgerHistory:
    """Events by month and snapshots by time, in the tables of one store.

    A state is the newest snapshot before a time, and for each row that was corrected since then what its last event up to that time left.
    Only that snapshot and the months in between are read. Events are never rewritten; a run that is repeated writes its own months again.
    """

    def __init__(self, store: Commits):
        self.store = store

    def start(self, ledger: DataFrame) -> int:
        """The ledger as imported. A second start is an error: history is not rewritten."""
        at = self.store.state()
        if STATES in at.live:
            raise ValueError(f"{self.store.path} has a history already")
        return self._snapshot(ledger, FIRST)

    def append(self, events: DataFrame, run: str) -> int:
        """One commit with the events of one run; a run of the same name takes the place of its first try."""
        at = self.store.state()
        marked = events.withColumn("bucket", F.concat_ws("|", F.date_format("ts", "yyyy-MM"), F.lit(run)))
        made = self.store.write(EVENTS, marked, ["ts", "transaction_id"])
        old = {b: [] for b in at.live.get(EVENTS, {}) if b.endswith(f"|{run}")}
        return self.store.commit({EVENTS: old | made}, {EVENTS: events.schema}, at)

    def snapshot(self, time: str) -> int:
        """Save the state at ``time`` (``yyyy-MM-dd HH:mm:ss``); later states start from it. Events must not be logged out of order after that."""
        return self._snapshot(self.as_of(time), time)

    def _snapshot(self, rows: DataFrame, time: str) -> int:
        at = self.store.state()
        made = self.store.write(STATES, rows.withColumn("bucket", F.lit(time)), ["source_file_id", "id"])
        return self.store.commit({STATES: {time: made.get(time, [])}}, {STATES: rows.schema}, at)

    def as_of(self, time: str) -> DataFrame:
        """Every row of the ledger as it was at ``time``, corrections of that second included."""
        at = self.store.state()
        since = max((b for b in at.live.get(STATES, {}) if b <= time), default=None)
        if since is None:
            raise ValueError(f"no state at or before {time}")
        base = self.store.read(STATES, [since], at)
        months = [b for b in at.live.get(EVENTS, {}) if since[:7] <= b.split("|")[0] <= time[:7]]
        events = self.store.read(EVENTS, months, at)
        if events is None:
            return base
        upto = events.where((_second("ts") > since) & (_second("ts") <= time))
        last = upto.groupBy(F.col("transaction_id").alias("id")).agg(F.max_by("after", F.struct("ts", "request_no")).alias("after"))
        fixed = F.col("after").isNotNull()
        return base.join(last, "id", "left").select(
            *[F.when(fixed, F.col("after")[c]).otherwise(F.col(c)).alias(c) if c in A.FIELDS else F.col(c) for c in base.columns]
        )

    def timeline(self, ids: DataFrame) -> DataFrame:
        """All events of some rows in order, with the number of each."""
        events = self.store.read(EVENTS)
        if events is None:
            raise ValueError("nothing was logged")
        own = events.join(ids.select(F.col(ids.columns[0]).alias("transaction_id")).distinct(), "transaction_id", "left_semi")
        return own.select("transaction_id", "ts", "request_no", "user_id", "reason", F.size("changes").alias("change_count"))
