from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerspark.operators import audit as A
from ledgerspark.operators import listing as L
from ledgerspark.streaming import jobs as J

from conftest import SF


def test_registry_is_consistent():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 150


def test_flagship_schema(spark):
    out = entry.entry(spark)
    assert "invalid_count" in out.columns and out.count() > 0


def test_paging_limits():
    assert L.page_bounds(0, 0) == (1, 50)
    assert L.page_bounds(2, 1000) == (501, 1000)


def test_malformed_audit_document_is_set_aside(spark):
    docs = spark.createDataFrame([('{"source_file_id": 1, "records": {}}',), ("{broken",)], "doc string")
    good, bad = A.parse_audit_documents(docs)
    assert good.count() == 1 and bad.first().doc == "{broken"


def test_stream_matches_batch(spark, tmp_path):
    raw = spark.read.parquet(f"{SF}/events.parquet")
    stage = F.when(F.col("event_type") == "signup", "Queued").when(F.col("event_type") == "view", "Extracting").otherwise("Failed")
    cols = ["event_id", F.col("user_id").alias("job_id"), "ts", stage.alias("stage")]
    stream = spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(SF).select(*cols)
    J.run_available(J.stream_transitions(stream), str(tmp_path / "o"), str(tmp_path / "c"), "append")
    got = spark.read.parquet(str(tmp_path / "o")).select("event_id", "previous", "status", "is_allowed")
    want = J.transitions(raw.select(*cols)).select("event_id", "previous", "status", "is_allowed")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_recovery(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 2)], "id long, processing_status int")
    rows = {r.id: r for r in J.recover(df).collect()}
    assert rows[1].processing_status == 3 and rows[1].processing_error == J.INTERRUPTED
    assert rows[2].requeue and rows[3].processing_status == 2
