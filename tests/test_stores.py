"""What is kept between runs: commits, history, documents, layouts, arriving statements, approvals."""

import datetime as dt
import glob
import hashlib
import os
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerspark.operators import audit as A
from ledgerspark.operators.approval import approve_in_store
from ledgerspark.operators.fingerprints import FingerprintStore
from ledgerspark.operators.history import LedgerHistory
from ledgerspark.sources import documents as D
from ledgerspark.sources.commits import CommitConflict, Commits, remove_from_store, replace_in_store
from ledgerspark.streaming import assemble as S

ROWS = "source_file_id long, seq int, amount double"


def ledger(spark, files, scale=1.0):
    return spark.createDataFrame([(f, s, scale * (10 * f + s)) for f in files for s in range(3)], ROWS)


def sums(folder):
    return {p: hashlib.md5(open(p, "rb").read()).hexdigest() for p in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


@pytest.fixture
def store(spark, tmp_path):
    return Commits(spark, str(tmp_path / "store"), 8)


# ---------------------------------------------------------------- commits


def test_only_touched_buckets_are_written(spark, store):
    assert store.read("ledger") is None and store.state().version == 0
    replace_in_store(store, "ledger", ledger(spark, range(40)), "source_file_id", ["seq"])
    before, first = store.state().live["ledger"], sums(store.path)
    replace_in_store(store, "ledger", ledger(spark, [7], 2.0).where("seq < 2"), "source_file_id", ["seq"])
    after = store.state().live["ledger"]
    assert sum(before[b] != after[b] for b in before) == 1 and {p: c for p, c in sums(store.path).items() if p in first} == first
    rows = {(r.source_file_id, r.seq): r.amount for r in store.read("ledger").collect()}
    assert len(rows) == 119 and rows[7, 1] == 142.0 and (7, 2) not in rows and rows[8, 2] == 82.0
    # The commit before still reads as it was.
    assert store.read("ledger", at=store.state(1)).count() == 120


def test_a_failed_job_changes_nothing(spark, store):
    replace_in_store(store, "ledger", ledger(spark, range(4)), "source_file_id", ["seq"])
    broken = ledger(spark, [2]).withColumn("amount", F.when(F.col("seq") == 1, F.raise_error(F.lit("unreadable")).cast("double")).otherwise(1.0))
    with pytest.raises(PySparkException):
        replace_in_store(store, "ledger", broken, "source_file_id", ["seq"])
    assert store.state().version == 1 and store.read("ledger").agg(F.sum("amount")).first()[0] == sum(10 * f + s for f in range(4) for s in range(3))
    assert replace_in_store(store, "ledger", ledger(spark, []), "source_file_id", ["seq"]) == 1  # nothing parsed, nothing replaced


def test_the_later_of_two_commits_on_one_base_fails(spark, store):
    replace_in_store(store, "ledger", ledger(spark, [1]), "source_file_id", ["seq"])
    base = store.state()
    rows = ledger(spark, [2]).withColumn("bucket", F.lit("0"))
    made = store.write("ledger", rows, ["seq"])
    replace_in_store(store, "ledger", ledger(spark, [3]), "source_file_id", ["seq"])
    with pytest.raises(CommitConflict):
        store.commit({"ledger": made}, {}, base)
    assert store.state().version == 2 and {r.source_file_id for r in store.read("ledger").collect()} == {1, 3}


def test_a_large_bucket_is_several_files(spark, store):
    rows = spark.range(200_000).selectExpr("1L AS source_file_id", "cast(id AS int) AS seq", "cast(id AS double) AS amount")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        replace_in_store(store, "ledger", rows, "source_file_id", ["seq"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folders = [f for b in store.state().live["ledger"].values() for f in b]
    assert len(folders) == 1 and len(glob.glob(f"{store.path}/{folders[0]}/*.parquet")) > 1 and store.read("ledger").count() == 200_000


def test_removal_and_vacuum(spark, store):
    for k in range(3):
        replace_in_store(store, "ledger", ledger(spark, range(6), 1.0 + k), "source_file_id", ["seq"])
    gone = spark.createDataFrame([(2,), (99,)], "id long")
    remove_from_store(store, {"ledger": ("source_file_id", ["seq"]), "never": ("source_file_id", [])}, gone)
    want = sorted(map(tuple, store.read("ledger").collect()))
    assert {r[0] for r in want} == {0, 1, 3, 4, 5}
    assert store.vacuum(keep=1) > 0 and sorted(map(tuple, store.read("ledger").collect())) == want
    assert store.versions() == [4]
    with pytest.raises(ValueError, match="no commit 1"):
        store.state(1)


# ---------------------------------------------------------------- history


def event(i, ts, no, **after):
    row = {f: None for f in A.FIELDS} | {"description": "d", "balance": None} | after
    return (i, dt.datetime.fromisoformat(ts), no, 1, "why", [("Description", "a", "b")], tuple(row[f] for f in A.FIELDS))


def test_states_are_replayed_from_the_snapshot_before(spark, store):
    after = "transaction_date timestamp, description string, debit decimal(18,2), credit decimal(18,2), amount decimal(18,2), balance decimal(18,2), reference string, transaction_type string"
    kind = f"transaction_id long, ts timestamp, request_no int, user_id long, reason string, changes array<struct<field_name: string, old_value: string, new_value: string>>, after struct<{after.replace(' timestamp', ': timestamp').replace(' string', ': string').replace(' decimal', ': decimal')}>"
    base = spark.createDataFrame([(i, 1, "as imported") for i in range(4)], "id long, source_file_id long, description string")
    base = base.selectExpr("*", *[f"cast(null AS {k}) AS {n}" for n, k in (x.split(" ") for x in after.split(", ")) if n != "description"])
    history = LedgerHistory(store)
    with pytest.raises(ValueError, match="no state"):
        history.as_of("2024-01-01 00:00:00")
    history.start(base)
    with pytest.raises(ValueError, match="history already"):
        history.start(base)
    one = [event(1, "2024-01-10 10:00:00", 1, description="one"), event(1, "2024-01-10 10:00:00", 2, description="two"), event(2, "2024-02-01 00:00:00", 1, description="feb")]
    two = [event(1, "2024-03-05 00:00:00", 1, description="march"), event(3, "2024-03-31 23:59:59", 1, description="late")]
    history.append(spark.createDataFrame(one, kind), "a")
    history.append(spark.createDataFrame(one, kind), "a")  # a run that is repeated

    def seen(time):
        return {r.id: r.description for r in history.as_of(time).collect()}

    plain = {i: "as imported" for i in range(4)}
    assert seen("2024-01-10 09:59:59") == plain and seen("2024-01-10 10:00:00") == plain | {1: "two"}
    history.snapshot("2024-02-15 00:00:00")
    history.append(spark.createDataFrame(two, kind), "b")
    assert seen("2024-02-20 00:00:00") == plain | {1: "two", 2: "feb"}
    assert seen("2024-03-31 23:59:59") == plain | {1: "march", 2: "feb", 3: "late"}
    assert seen("2024-01-31 00:00:00") == plain | {1: "two"}  # before the snapshot, from the log
    assert history.timeline(spark.createDataFrame([(1,)], "id long")).count() == 3
    assert store.read("events").count() == 5


# ---------------------------------------------------------------- documents


def audit_records(spark, n, files=1):
    frozen = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "description" else F.concat(F.lit('text "'), F.col("id").cast("string")).alias("description") for f in A.ORIGINAL.fields])
    entry = F.struct(F.timestamp_seconds("id").alias("ts"), F.col("id").alias("user_id"), F.lit("why").alias("reason"), F.array(F.struct(F.lit("Balance").alias("field_name"), F.lit(None).cast("string").alias("old_value"), F.col("id").cast("string").alias("new_value"))).alias("changes"))
    history = F.when(F.col("id") % 10 == 0, F.array(entry, entry)).otherwise(F.slice(F.array(entry), 1, 0))
    return spark.range(n).select(F.col("id").alias("transaction_id"), (F.col("id") % files).alias("source_file_id"), frozen.alias("original_values"), history.alias("history"))


def test_a_very_large_document_is_split(spark, tmp_path):
    path = str(tmp_path / "audit")
    D.write_audit(audit_records(spark, 60_000), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert D.read_lines(spark, path, []).rdd.getNumPartitions() > 4
        snapshots, corrections, changes = D.read_audit(spark, path)
        assert snapshots.count() == 60_000 and corrections.count() == changes.count() == 12_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = changes.where("transaction_id = 50").orderBy("entry_no").collect()
    assert [tuple(r) for r in got] == [(50, 0, n, 0, "Balance", None, "50") for n in (0, 1)]
    assert snapshots.where("transaction_id = 50").first().description == 'text "50'
    assert snapshots.schema["value_date"].dataType == A.ORIGINAL["value_date"].dataType


@pytest.mark.parametrize("line", ["{broken", '{"source_file_id": 1}', "[]", '"text"', '{"source_file_id": 1, "records": {}} trailing', '{"source_file_id": 1, "records": {}} {"source_file_id": 2, "records": {}}'])
def test_a_broken_document_is_an_error_with_its_path(spark, tmp_path, line):
    path = str(tmp_path / "audit")
    D.write_audit(audit_records(spark, 30, 3), path)
    with open(os.path.join(path, "zz-broken.txt"), "w") as out:
        out.write("\n  \n" + line + "\n")
    with pytest.raises(PySparkException, match="malformed document in .*zz-broken.txt"):
        D.read_audit(spark, path)[0].count()


def test_words_come_back_as_they_were(spark, tmp_path):
    words = spark.createDataFrame([(f, p, 595.0, 842.0, x * 1.5, 2.0 * p, 5.0, 8.0, f'w"{x}\\ é') for f in (1, 2) for p in (1, 2, 3) for x in range(4)], "file_id long, page int, page_width double, page_height double, x double, y double, width double, height double, text string")
    path = str(tmp_path / "words")
    D.write_extraction(words, path)
    back = D.read_extraction(spark, path)
    assert back.columns == words.columns and sorted(map(tuple, back.collect())) == sorted(map(tuple, words.collect()))


# ---------------------------------------------------------------- layouts


def layouts(spark, *rows):
    return spark.createDataFrame([(f, h, 5, True) for f, h in rows], "file_id long, fingerprint string, column_count int, has_explicit_debit_credit boolean")


def test_usage_adds_up_over_runs_restarts_and_merges(spark, store, tmp_path):
    known = FingerprintStore(store)
    assert known.read() is None and not known.look_up(layouts(spark, (1, "a"))).first().is_known
    known.add(layouts(spark, (5, "a"), (3, "a"), (4, "b")), "r1")
    known.add(layouts(spark, (6, "a"), (7, "c")), "r2")
    known.add(layouts(spark, (6, "a"), (7, "c")), "r2")  # the run again after a failure
    known = FingerprintStore(Commits(spark, store.path))  # another process
    usage = lambda: {r.fingerprint: (r.usage_count, r.first_file_id, r.last_run) for r in known.read().collect()}
    want = {"a": (3, 3, "r2"), "b": (1, 4, "r1"), "c": (1, 7, "r2")}
    assert usage() == want
    known.compact()
    assert usage() == want and not [b for b in store.state().live["fingerprints"] if b.startswith("run-")]
    with pytest.raises(ValueError, match="merged already"):
        known.add(layouts(spark, (6, "a")), "r2")
    version = known.compact()
    assert version == store.state().version
    known.add(layouts(spark, (8, "b")), "r3")
    known.compact()
    assert usage() == want | {"b": (2, 4, "r3")}
    got = {(r.file_id, r.is_known, r.known_usage) for r in known.look_up(layouts(spark, (1, "a"), (2, "x"))).collect()}
    assert got == {(1, True, 3), (2, False, None)}


def test_many_hashes_are_joined_as_few_are(spark, store, monkeypatch):
    from ledgerspark.operators import fingerprints

    known = FingerprintStore(store)
    known.add(layouts(spark, *[(k, f"h{k % 50}") for k in range(200)]), "r1")
    asked = layouts(spark, *[(k, f"h{k}") for k in range(80)])
    few = sorted(map(tuple, known.look_up(asked).collect()))
    monkeypatch.setattr(fingerprints, "PUSHED", 10)
    assert sorted(map(tuple, known.look_up(asked).collect())) == few and sum(r[-1] for r in few) == 50


# ---------------------------------------------------------------- arriving statements


def page(f, n, count, minute, text="w"):
    return (f, n, count, 595.0, 842.0, [(f"{text}{n}", 1.0, 2.0, 3.0, 4.0)], dt.datetime(2024, 1, 1, minute // 60, minute % 60))


def test_pieces_meet_once_and_time_runs_out(spark, tmp_path):
    source, out = str(tmp_path / "in"), []

    def arrive(*pages):
        spark.createDataFrame(pages, S.PAGE).coalesce(1).write.mode("append").parquet(source)

    def take(words, batch):
        out.extend((r.file_id, r.page, r.text, r.is_complete) for r in words.collect())

    def run():
        out.clear()
        S.run_assembled(spark.readStream.schema(S.PAGE).parquet(source), str(tmp_path / "ckpt"), take, 15 * 60 * 1000, "10 minutes")
        return sorted(out)

    arrive(page(1, 2, 2, 60), page(2, 1, 3, 60), page(3, 1, 1, 60), page(3, 1, 1, 60))
    assert run() == [(3, 1, "w1", True)]
    arrive(page(1, 1, 2, 62), page(1, 2, 2, 62), page(3, 1, 1, 62))  # the rest of 1, and pages that came before
    assert run() == [(1, 1, "w1", True), (1, 2, "w2", True)]  # after a restart from the checkpoint
    arrive(page(2, 3, 3, 63))
    assert run() == []
    arrive(page(4, 1, 1, 200))  # two hours later: the time of 2 is up
    assert run() == [(2, 1, "w1", False), (2, 3, "w3", False), (4, 1, "w1", True)]
    arrive(page(2, 2, 3, 201), page(4, 1, 1, 201))
    assert run() == []


# ---------------------------------------------------------------- approval


def test_an_approval_is_one_commit_and_is_not_repeated(spark, store):
    kind = """file_id long, row_number int, date date, value_date date, description string, reference string, debit decimal(18,2),
 credit decimal(18,2), amount decimal(18,2), balance decimal(18,2), direction string, errors array<string>, warnings array<string>"""

    def row(f, n, amount=5):
        day = dt.date(2024, 1, n)
        return (f, n, day, day, "d", None, None, Decimal(5), Decimal(amount), None, "Credit", [], [])

    rows = spark.createDataFrame([row(1, 1), row(1, 2), row(2, 1), row(3, 1, 0)], kind)
    seen = layouts(spark, (1, "a"), (2, "a"), (3, "b"))
    first = approve_in_store(store, rows, seen, "2024-01-01 00:00:00")
    assert first.version == 1 and sorted((r.source_file_id, r.seq) for r in first.rows.collect()) == [(1, 1), (1, 2), (2, 1)]
    files = sums(store.path)
    again = approve_in_store(store, rows, seen, "2024-01-02 00:00:00")
    assert again.version == 1 and sums(store.path) == files
    assert sorted(map(tuple, again.rows.collect())) == sorted(map(tuple, first.rows.collect()))
    assert {r.source_file_id: r.processed_count for r in store.read("import_results").collect()} == {1: 2, 2: 1}
    assert store.read("snapshots").count() == 3
    assert [(r.fingerprint, r.usage_count) for r in FingerprintStore(store).read().collect()] == [("a", 2)]
