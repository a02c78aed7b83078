"""What is written as files: tenants' folders, vouchers and exports in numbered parts, job events in order of time."""

import datetime as dt
import glob
import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions.sql import FUNCTIONS, register_functions
from ledgerspark.operators import detect as D
from ledgerspark.operators import listing as L
from ledgerspark.operators import sheets as S
from ledgerspark.streaming import ordered as O
from ledgerspark.streaming.assemble import rocks_state
from ledgerspark.streaming.jobs import STAGES, transitions


def test_tenants_that_get_no_rows_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "tenants")
    rows = spark.createDataFrame([(i, u, c, 2000 + y) for i, (u, c, y) in enumerate((u, c, y) for u in (1, 2) for c in (1, 2) for y in (0, 1))], "id long, user_id int, client_id int, year int")
    L.write_tenants(rows, path, ["id"])
    sums = {p: hashlib.md5(open(p, "rb").read()).hexdigest() for p in glob.glob(f"{path}/**/*.parquet", recursive=True)}
    assert len(sums) == 8  # small folders are single files
    again = rows.where("user_id = 1 AND client_id = 2 AND year = 2001").withColumn("id", F.col("id") + 100)
    L.write_tenants(again, path, ["id"])
    left = [p for p in sums if "user_id=1/client_id=2/year=2001" not in p]
    assert len(left) == 7 and all(hashlib.md5(open(p, "rb").read()).hexdigest() == sums[p] for p in left)
    assert {r.id for r in L.read_tenant(spark, path).collect()} == ({r.id for r in rows.collect()} - {3}) | {103}
    assert {r.user_id for r in L.read_tenant(spark, path, 2).collect()} == {2}


def test_a_tenant_with_most_rows_is_several_files(spark, tmp_path):
    path = str(tmp_path / "tenants")
    rows = spark.range(100_000).selectExpr("id", "cast(if(id < 90000, 1, id % 50) AS int) AS user_id", "1 AS client_id", "2000 AS year")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        L.write_tenants(rows, path, ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{path}/user_id=1/*/*/*.parquet")) > 1 and L.read_tenant(spark, path).count() == 100_000


def test_a_large_voucher_batch_is_numbered_parts_of_one_document(spark, tmp_path):
    path = str(tmp_path / "xml")
    lines = spark.range(20_000).selectExpr("1L AS batch_id", "1 AS part", "cast(id AS int) AS row_number", "concat('<V>', id, '</V>') AS value")
    edges = spark.createDataFrame([(1, 0, 0, "<HEAD>"), (1, 2, 0, "</HEAD>")], "batch_id long, part int, row_number int, value string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    made, S.voucher_documents = S.voucher_documents, lambda *a: lines.unionByName(edges)
    try:
        S.write_voucher_files(None, path)
    finally:
        S.voucher_documents = made
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(glob.glob(f"{path}/batch_id=1/part-*"))
    assert len(parts) > 1
    assert "".join(open(p).read() for p in parts).split() == ["<HEAD>", *[f"<V>{k}</V>" for k in range(20_000)], "</HEAD>"]


def test_events_in_any_order_are_judged_in_order_of_time(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    start = dt.datetime(2024, 1, 1)
    names = list(STAGES)
    events = [(k, k % 7, start + dt.timedelta(seconds=(k * 7919) % 3000), names[(k * 31) % len(names)]) for k in range(600)]
    kind = "event_id long, job_id long, ts timestamp, stage string"

    def arrive(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        with rocks_state(spark):
            made = O.ordered_transitions(stream, "1 hour").writeStream.option("checkpointLocation", str(tmp_path / "ckpt"))
            made.trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).start().awaitTermination()

    arrive(events[:250])
    arrive(events[200:400])  # some come twice
    run()
    arrive(events[400:] + [(9001, 3, None, "Queued"), (9002, 3, start, "Unknown"), (None, 3, start, "Queued")])
    arrive([(9003, 99, start + dt.timedelta(hours=9), "Queued")])
    run()  # after a restart
    got = {r.event_id: (r.job_id, r.previous, r.status, r.is_allowed) for r in spark.read.parquet(out).where("job_id < 99").collect()}
    want = {r.event_id: (r.job_id, r.previous, r.status, r.is_allowed) for r in transitions(spark.createDataFrame(events, kind)).collect()}
    assert got == want and spark.read.parquet(out).where("job_id < 99").count() == 600


@pytest.mark.parametrize("pattern, known", [
    (r"Balance", (["BALANCE"], True)),
    (r"Value Dt|Value Date", (["VALUE DATE", "VALUE DT"], True)),
    (r"\bHDFC0[A-Z0-9]{6}\b", (["HDFC0"], False)),
    (r"a|[bc]", None),
    (r"S\.No|(?:x|y)z+long", (["LONG", "S.NO"], False)),
])
def test_pieces_that_every_match_holds(pattern, known):
    assert D.needed(pattern) == known


def test_flags_are_those_of_the_patterns(spark):
    import re

    texts = [
        "HDFC BANK LIMITED HDFC0001234 date narration CHQ Value dt withdrawal Deposit closing balance",
        "state  bank of\nindia SBIN0123456 Post Date Ref No debit credit", "value x\ndate", "Date y Value", "pnb one BOB World Kotak",
        "ſtate bank of india ıcıcı", "", "Sl No S.No CHQ. NO. Chq/Ref No", "xHDFC0001234x BOIL", "भरोसे का प्रतीक Bank of Baroda",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    got = {(r.file_id, r.name) for r in D.signal_names(D.signal_flags(frame)).collect()}
    want = {(k, f"{b}_{s}") for k, t in enumerate(texts) for b, rules in D.SIGNALS.items() for s, p, _, _ in rules if re.search("(?i)(?a:" + p.replace("(?s)", "") + ")", t, re.S)}
    plain = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    by_regex = {(r.file_id, r.name) for r in plain.select("file_id", F.explode(F.array_compact(F.array(*[F.when(F.col("text").rlike("(?i)" + p), F.lit(f"{b}_{s}")) for b, rules in D.SIGNALS.items() for s, p, _, _ in rules]))).alias("name")).collect()}
    assert got == by_regex and len(want) > 40


def test_sql_functions_do_what_their_bodies_do(spark):
    register_functions(spark)
    texts = [None, "", " 1,234.50 Cr", "(12.30)", "99 Dr", "₹ 7", "01/02/2003", "3 Mar 2004", "2005-06-07", "13/1/2001", "x", "NEFT-ABCD0123456789012 x", "1.234,56", "From 01/02/2003 To 28/02/2003"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, s string").withColumn("text", F.col("s"))
    for name, of in FUNCTIONS.items():
        if [p for p, _ in of.params] in (["s"], ["text"]):
            body = of.body(F.col("s"))
            if of.table:
                frame.createOrReplaceTempView("said")
                got = {r[0]: tuple(r)[1:] for r in spark.sql(f"SELECT k, t.* FROM said, LATERAL {name}(s) t").collect()}
                want = {r[0]: tuple(r[1]) for r in frame.select("k", body).collect()}
            else:
                got = {r[0]: r[1] for r in frame.selectExpr("k", f"{name}(s)").collect()}
                want = {r[0]: r[1] for r in frame.select("k", body).collect()}
            assert got == want, name
