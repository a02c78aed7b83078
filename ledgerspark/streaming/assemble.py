"""Statements that arrive in pieces: pages are held per file until all are there, or for a time at most.

Time is that of arrival as the pages tell it, so that a run over what is there ends, and a replay gives what the first run gave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerspark.operators.words import BLOCK, WORD_COLUMNS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: A page of a statement as it arrives: ``page_count`` is how many the file has, ``arrived_at`` drives the time.
PAGE = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("page_count", T.IntegerType()),
        T.StructField("page_width", T.DoubleType()),
        T.StructField("page_height", T.DoubleType()),
        T.StructField("blocks", T.ArrayType(BLOCK)),
        T.StructField("arrived_at", T.TimestampType()),
    ]
)
_HELD = "file_id long, page int, page_count int, page_width double, page_height double, blocks string"
#: Milliseconds after its first page at which a file goes on as it is, and how late a page may come after later ones of any file.
TIMEOUT_MS, LATENESS = 15 * 60 * 1000, "1 hour"


def pages_of(words: DataFrame, arrived_at: Column) -> DataFrame:
    """Words as pages that arrive at the given times; what is gathered is one page."""
    pages = words.groupBy("file_id", "page", "page_width", "page_height").agg(
        F.collect_list(F.struct(*[f.name for f in BLOCK.fields])).alias("blocks")
    )
    counts = words.groupBy("file_id").agg(F.max("page").alias("page_count"))
    pages = pages.join(counts, "file_id").withColumn("arrived_at", arrived_at)
    return pages.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PAGE.fields])


class PageCollector(StatefulProcessor):
    """State of a file: its pages so far as a map by number, and whether it went on already.

    A page that comes again, in the same batch or a later one, replaces itself; one that comes after its file went on is dropped.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        page = T.StructType([T.StructField("page", T.IntegerType())])
        held = T.StructType(
            [
                T.StructField("page_count", T.IntegerType()),
                T.StructField("page_width", T.DoubleType()),
                T.StructField("page_height", T.DoubleType()),
                T.StructField("blocks", T.StringType()),
            ]
        )
        self.handle = handle
        self.pages = handle.getMapState("pages", page, held)
        # started, then done: a file's mark stays, so that replayed pages are known.
        self.mark = handle.getValueState("mark", T.StructType([T.StructField("done", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started = self.mark.exists()
        if started and self.mark.get()[0]:
            return
        wanted, first = 0, None
        for frame in rows:
            came = int(frame["arrived_at"].min().timestamp() * 1000)
            first = came if first is None else min(first, came)
            for r in frame.itertuples(index=False):
                self.pages.updateValue((int(r.page),), (int(r.page_count), float(r.page_width), float(r.page_height), r.blocks))
                wanted = max(wanted, int(r.page_count))
        if sum(1 for _ in self.pages.keys()) >= wanted:
            yield from self._leave(key, True)
        elif not started:
            self.mark.update((False,))
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs()) + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.mark.get()[0]:
            yield from self._leave(key, False)

    def _leave(self, key, complete: bool) -> Iterator[pd.DataFrame]:
        names = ["file_id", "page", "page_count", "page_width", "page_height", "blocks", "is_complete"]
        rows = [(key[0], page[0], *held, complete) for page, held in self.pages.iterator()]
        yield pd.DataFrame(rows, columns=names)
        self.pages.clear()
        self.mark.update((True,))

    def close(self) -> None:
        pass


def assembled(pages: DataFrame, timeout_ms: int = TIMEOUT_MS, lateness: str = LATENESS) -> DataFrame:
    """Words of each file with ``is_complete``, all in the batch that brings its last page or sees its time run out.

    ``pages`` is a stream of ``PAGE``. A file's time runs out once pages have arrived that are ``lateness`` and ``timeout_ms`` younger than its
    first one. Pages without id, number or time of arrival belong to no file and are dropped. Each file goes on once; its state after that is one mark. Needs the RocksDB state store, which
    :func:`run_assembled` sets.
    """
    placed = pages.where(F.col("file_id").isNotNull() & F.col("page").isNotNull() & F.col("arrived_at").isNotNull())
    flat = placed.select(
        "file_id",
        "page",
        F.coalesce("page_count", F.lit(1)).alias("page_count"),
        "page_width",
        "page_height",
        F.to_json("blocks").alias("blocks"),
        "arrived_at",
    ).withWatermark("arrived_at", lateness)
    whole = flat.groupBy("file_id").transformWithStateInPandas(
        PageCollector(timeout_ms), f"{_HELD}, is_complete boolean", "Append", "EventTime"
    )
    blocks = F.from_json("blocks", T.ArrayType(BLOCK))
    return whole.select("file_id", "page", "page_width", "page_height", "is_complete", F.inline(blocks)).select(*WORD_COLUMNS, "is_complete")


@contextmanager
def rocks_state(spark: SparkSession):
    """State with maps and timers lives in RocksDB; the session's own setting returns afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def run_assembled(
    pages: DataFrame, checkpoint: str, take: Callable[[DataFrame, int], None], timeout_ms: int = TIMEOUT_MS, lateness: str = LATENESS
) -> StreamingQuery:
    """Drain what is available and hand the words of files that are ready to ``take(words, batch id)``.

    A batch may come twice after a failure, with the same files and id, so ``take`` must replace what it did before.
    """
    with rocks_state(pages.sparkSession):
        query = (
            assembled(pages, timeout_ms, lateness)
            .writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(take)
            .start()
        )
        query.awaitTermination()
    return query
