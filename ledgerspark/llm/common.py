"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(made)] = (weakref.ref(made), path)
    return made


_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def discard(*frames: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote, once nothing lazy reads them any more."""
    for frame in frames:
        of, path = _PATHS.pop(id(frame), (None, None))
        if of is not None and of() is frame:
            spark = frame.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever the case: the given ones, with underscores before them until they are free."""
    taken = {c.lower() for c in df.columns}
    free = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        free.append(name)
    return free


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_hash(column: str = "text") -> Column:
    """With the id it names a row, so that repeated ids with other texts stay apart."""
    return F.xxhash64(text_of(column))


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, every other letter left alone; pure ASCII takes the fast path."""
    plain = F.octet_length(column) == F.char_length(column)
    return F.when(plain, F.lower(column)).otherwise(F.translate(column, UPPER, UPPER.lower()))
