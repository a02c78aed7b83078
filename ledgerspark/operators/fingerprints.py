"""Layouts that were seen before, kept over runs: what each run saw is added as a delta, and deltas are merged from time to time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.session import checkpointed
from ledgerspark.sources.commits import Commits, Live, State, key_bucket

NAME = "fingerprints"
BASE_BUCKETS = 64
#: Hashes up to which a look-up is pushed down to the files, whose Bloom filters skip those without them.
PUSHED = 1000


class FingerprintStore:
    """``(fingerprint, usage_count, first_file_id, last_run, column_count, has_explicit_debit_credit)`` for each layout hash.

    The base lies in buckets of the hash, each run's delta in a bucket of its own name. A run that is repeated takes the place of its first
    try, so that usage is counted once. Names of runs must sort in the order of the runs.
    """

    def __init__(self, store: Commits):
        self.store = store

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        first = F.struct("last_run", "first_file_id")
        return rows.groupBy("fingerprint").agg(
            F.sum("usage_count").alias("usage_count"),
            F.min("first_file_id").alias("first_file_id"),
            F.max("last_run").alias("last_run"),
            F.min_by("column_count", first).alias("column_count"),
            F.min_by("has_explicit_debit_credit", first).alias("has_explicit_debit_credit"),
        )

    def add(self, seen: DataFrame, run: str) -> int:
        """One commit with the layouts that one run saw (``file_id, fingerprint, ...`` as :func:`universal.fingerprints` gives them).

        Raises if the run was merged into the base already: its files would be counted twice.
        """
        at = self.store.state()
        changes, schemas = self.delta(seen, run, at)
        return self.store.commit(changes, schemas, at)

    def delta(self, seen: DataFrame, run: str, at: State) -> tuple[Live, dict[str, T.StructType]]:
        """What :meth:`add` commits, for a commit that changes other tables too."""
        if run in at.live.get("fingerprint_runs", {}) and f"run-{run}" not in at.live.get(NAME, {}):
            raise ValueError(f"run {run} was merged already")
        delta = self._merged(
            seen.select(
                "fingerprint",
                F.lit(1).cast("long").alias("usage_count"),
                F.col("file_id").alias("first_file_id"),
                F.lit(run).alias("last_run"),
                F.col("column_count").cast("int").alias("column_count"),
                "has_explicit_debit_credit",
            )
        )
        delta = checkpointed(delta)
        made = self.store.write(NAME, delta.withColumn("bucket", F.lit(f"run-{run}")), ["fingerprint"], bloom="fingerprint")
        names = delta.sparkSession.createDataFrame([(run,)], "run string")
        marks = self.store.write("fingerprint_runs", names.withColumn("bucket", F.col("run")), ["run"])
        return {NAME: {f"run-{run}": []} | made, "fingerprint_runs": marks}, {NAME: delta.schema, "fingerprint_runs": names.schema}

    def read(self) -> DataFrame | None:
        """One row for each hash, base and deltas merged; partial sums are made before the exchange."""
        rows = self.store.read(NAME)
        return None if rows is None else self._merged(rows)

    def look_up(self, new: DataFrame) -> DataFrame:
        """``new`` with ``known_usage`` and ``is_known``: what earlier runs know of each hash.

        Few hashes are pushed down as a list; with many all of the store is joined, which has far fewer rows than there are files.
        """
        rows = self.store.read(NAME)
        if rows is None:
            return new.select("*", F.lit(None).cast("long").alias("known_usage"), F.lit(False).alias("is_known"))
        asked = [r.fingerprint for r in new.select("fingerprint").distinct().limit(PUSHED + 1).collect()]
        if len(asked) <= PUSHED:
            rows = rows.where(F.col("fingerprint").isin(asked)) if asked else rows.limit(0)
        usage = rows.groupBy("fingerprint").agg(F.sum("usage_count").alias("known_usage"))
        return new.join(usage, "fingerprint", "left").withColumn("is_known", F.col("known_usage").isNotNull())

    def compact(self) -> int:
        """Merge all deltas into the base in one commit. A run that commits meanwhile makes this one fail, not the other way round."""
        at = self.store.state()
        live = at.live.get(NAME, {})
        deltas = [b for b in live if b.startswith("run-")]
        if not deltas:
            return at.version
        # Only the base buckets that a delta touches are read and written again.
        new = self.store.read(NAME, deltas, at)
        marked = new.withColumn("bucket", key_bucket("fingerprint", BASE_BUCKETS))
        touched = [r.bucket for r in marked.select("bucket").distinct().collect()]  # at most BASE_BUCKETS
        rows = self._merged(new.unionByName(self.store.read(NAME, touched, at)))
        made = self.store.write(NAME, rows.withColumn("bucket", key_bucket("fingerprint", BASE_BUCKETS)), ["fingerprint"], bloom="fingerprint")
        return self.store.commit({NAME: dict.fromkeys(deltas, []) | made}, {NAME: rows.schema}, at)
