"""Best-fit packing of tokenised documents by hierarchical residual packing.

Each partition packs its pieces best-fit, longest first. Bins that are nearly full are final. Underfull bins go on as
items to a round of fewer partitions, again and again, so that the leftovers of all partitions meet in a tree.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerspark.llm.common import stored

#: One piece as bins carry it: a bin of ``capacity`` tokens holds at most so many of them.
MEMBER = np.dtype([("has_id", "?"), ("doc_id", "<i8"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
#: Items that one task packs at a time.
TASK_ITEMS = 50_000
#: Partitions of a round that meet in one of the next.
FAN_IN = 8


@cache
def _encoder(ranks_path: str, special: str, special_id: int) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: special_id}
    )


@cache
def _library(ranks_path: str) -> Tokenizer:
    """The same vocabulary in the library's form, which lies beside the ranks."""
    return Tokenizer.from_file(f"{ranks_path.removesuffix('.tiktoken')}.json")


def _ids(text: str, ranks_path: str, special: str, special_id: int) -> list[int]:
    """Token ids; a run of blanks too long for the rank encoder's pattern is left to the tokenizers library."""
    try:
        return _encoder(ranks_path, special, special_id).encode(text, allowed_special="all")
    except ValueError as error:
        if "Max stack size" not in str(error):
            raise
        return _library(ranks_path).encode(text, add_special_tokens=False).ids


def pieces(
    docs: DataFrame,
    capacity: int = 1024,
    separator: int = 2,
    ranks_path: str | None = None,
    special: str = "<|endoftext|>",
    special_id: int = 50256,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids and the separator, cut only if too long.

    The ids are those the tokenizers library gives for the same vocabulary; ranks are read from ``ranks_path`` because
    the rank encoder is four times as fast; a text it cannot split is given to that library. A text that holds ``special`` gets its id there. All pieces but the first are full. Null
    text counts as empty and gives the separator alone.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*_ids(text.as_py() or "", str(path), special, special_id), separator], "<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        column.append(value)
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size, in the order given: the fullest bin with room, or a new one.

    Room is a whole number up to ``capacity``, so open bins are listed by room, and a bit mask says which lists have any.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = made = 0
    where = []
    for size in sizes:
        if fits := mask >> size:
            room = size + (fits & -fits).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                mask &= ~(1 << room)
        else:
            room, at, made = capacity, made, made + 1
        where.append(at)
        room -= size
        if room:
            open_bins[room].append(at)
            mask |= 1 << room
    return where


def _merge(items: DataFrame, capacity: int) -> DataFrame:
    """One round: ``(used, members)`` of each partition packed into bins of the same form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes]] = []
        for batch in batches:
            rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        rows.sort(key=lambda r: (-r[0], r[1]))
        bins: list[list] = []
        for (used, members), at in zip(rows, best_fit([r[0] for r in rows], capacity), strict=True):
            if at == len(bins):
                bins.append([0, []])
            bins[at][0] += used
            bins[at][1].append(members)
        for k in range(0, len(bins), 5000):
            some = bins[k : k + 5000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b[0] for b in some], pa.int32()), pa.array([b"".join(b[1]) for b in some], pa.binary())],
                ["used", "members"],
            )

    return items.select("used", "members").mapInArrow(run, "used int, members binary")


def _as_items(parts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros(batch.num_rows, MEMBER)
            for name, column in zip(("doc_id", "piece", "start", "length", "crc"), batch.columns, strict=True):
                rows[name] = column.fill_null(0).to_numpy(zero_copy_only=False)
            rows["has_id"] = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["length"], pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["used", "members"]
            )

    return parts.mapInArrow(run, "used int, members binary")


def _as_rows(bins: DataFrame, doc_id: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bytes_of = batch.column(1).to_pylist()
            rows = np.frombuffer(b"".join(bytes_of), MEMBER)
            counts = np.array([len(b) // MEMBER.itemsize for b in bytes_of], np.int64)
            sequence = np.repeat(batch.column(0).to_numpy(), counts)
            ends = np.cumsum(rows["length"], dtype=np.int64)
            before = ends - rows["length"]
            starts = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
            offset = before - np.repeat(before[starts], counts) if len(rows) else before
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["doc_id"], pa.int64(), mask=~rows["has_id"]).cast(pa.int32() if doc_id == "int" else pa.int64()),
                    pa.array(rows["piece"]),
                    pa.array(rows["start"]),
                    pa.array(rows["length"].astype(np.int64)),
                    pa.array(rows["crc"].astype(np.int64)),
                    pa.array(sequence),
                    pa.array(offset),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = f"doc_id {doc_id}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return bins.mapInArrow(run, schema)


def pack(cut: DataFrame, capacity: int = 1024, slack: int | None = None, task_items: int = TASK_ITEMS) -> DataFrame:
    """``cut`` (see :func:`pieces`) with ``sequence_id`` and ``offset``, one row per row.

    Full pieces are sequences of their own. Bins with at most ``slack`` tokens of room (one in 256 unless given) are final as soon
    as they are made. A round deals the rest to an eighth of the partitions, but never more than about ``task_items`` to one of
    them; items too large to fit each other therefore stay spread out. Equal pieces are packed one by one.
    """
    slack = capacity // 256 if slack is None else slack
    kind = dict(cut.dtypes)["doc_id"]
    full = cut.where(F.col("length") == capacity)
    items = _as_items(cut.where(F.col("length") < capacity).select("doc_id", "piece", "start", "length", "ids_crc32"))
    parts = -(-max(1, cut.where(F.col("length") < capacity).count()) // task_items)
    bins = stored(_merge(items.repartition(parts), capacity), "bins")
    final = bins.where(F.col("used") >= capacity - slack)
    rest = bins.where(F.col("used") < capacity - slack)
    while parts > 1:
        needed = -(-max(1, rest.count()) // task_items)
        last, parts = needed >= parts, max(needed, -(-parts // FAN_IN))
        bins = stored(_merge(rest.repartition(parts), capacity), "bins")
        final = final.unionByName(bins.where(F.col("used") >= capacity - slack))
        rest = bins.where(F.col("used") < capacity - slack)
        if last:
            break
    packed = _as_rows(final.unionByName(rest).select(F.monotonically_increasing_id().alias("sequence_id"), "members"), kind)
    alone = full.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, capacity: int = 1024, separator: int = 2, ranks_path: str | None = None) -> DataFrame:
    """Documents tokenised, cut and packed into sequences of ``capacity`` tokens; see :func:`pieces` and :func:`pack`.

    Null and empty texts are the separator alone; repeated rows are packed each; a null doc_id is kept; no document gives
    no row. Columns other than doc_id and text are not read.
    """
    return pack(stored(pieces(docs, capacity, separator, ranks_path), "pieces"), capacity)
