"""Approval of reviewed statements as one commit over ledger, snapshots, import results and known layouts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators import review as R
from ledgerspark.operators.fingerprints import FingerprintStore
from ledgerspark.operators.ordered import Hot
from ledgerspark.session import checkpointed
from ledgerspark.sources.commits import Commits, replaced

#: Row numbers of a file that fit below its id.
ID_STEP = 1_000_000


@dataclass
class Approved:
    """What an approval led to: the version, and the ledger rows of all files that were asked for and may be there."""

    version: int
    rows: DataFrame


def approve_in_store(store: Commits, rows: DataFrame, layouts: DataFrame, started_at: str, hot: Hot | None = None) -> Approved:
    """Take review rows into the ledger; a second call with the same rows commits nothing and gives the same ledger rows.

    Files with blockers, and files that the ledger has already, are left as they are. ``layouts`` are fingerprints by file; those of the files
    approved here are counted, under a run named after the version. All four tables change together or not at all.
    """
    at = store.state()
    existing = store.read("ledger", at=at)
    have = rows.select(F.col("file_id").alias("source_file_id")).limit(0) if existing is None else existing.select("source_file_id")
    added, results = R.approve(rows, have, hot)
    ident = (F.col("source_file_id") * ID_STEP + F.col("seq")).alias("id")
    added = checkpointed(added.select(ident, *added.columns))
    asked = rows.select(F.col("file_id").alias("source_file_id")).distinct()
    if added.isEmpty():
        known = added if existing is None else existing.join(asked, "source_file_id", "left_semi")
        return Approved(at.version, known)
    snapshots = added.select(
        F.col("id").alias("transaction_id"),
        *[c for c in added.columns if c != "id"],
        F.lit(1).alias("source_page_number"),
        F.col("seq").alias("source_line_index"),
    )
    results = checkpointed(results.select("*", F.lit(started_at).cast("timestamp").alias("started_at")))
    changes = {
        "ledger": replaced(store, "ledger", added, "source_file_id", ["seq"], at),
        "snapshots": replaced(store, "snapshots", snapshots, "source_file_id", ["seq"], at),
        "import_results": replaced(store, "import_results", results, "source_file_id", [], at),
    }
    schemas = {"ledger": added.schema, "snapshots": snapshots.schema, "import_results": results.schema}
    seen = layouts.join(results.select(F.col("source_file_id").alias("file_id")), "file_id", "left_semi")
    more, kinds = FingerprintStore(store).delta(seen, f"approval-{at.version + 1:012d}", at)
    version = store.commit(changes | more, schemas | kinds, at)
    return Approved(version, store.read("ledger").join(asked, "source_file_id", "left_semi"))
