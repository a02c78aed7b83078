"""How quality filters act together: every order of them over the same documents, from one pass over the bytes of the texts.

A table-driven transducer reads UTF-8. A byte has a class, class and state give the next state and what is put out: a word starts, a word
ends, a capital, a code point, a symbol. Words that end go as spans into a hash table, which compares the bytes of equal hashes. From the counts
of each document come the filters it fails, and from the numbers of documents that fail alike all orders are worked out at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import stored

#: Classes of bytes.
BLANK, CAPITAL, SYMBOL, PLAIN, LEAD, FOLLOW = range(6)
#: States: between words, in a word.
OUTSIDE, INSIDE = range(2)
#: What a step puts out.
STARTS, ENDS, UPPER, POINT, MARKED = 1, 2, 4, 8, 16
#: Bytes of texts that go through the transducer together; a longer text goes alone.
BLOCK = 4 << 20

FILTERS = "ABCDE"


def byte_classes() -> np.ndarray:
    """The class of each byte."""
    kinds = np.full(256, PLAIN, np.uint8)
    kinds[[0x20, *range(0x09, 0x0E)]] = BLANK
    kinds[0x41:0x5B] = CAPITAL
    kinds[list(b"#$%&*|")] = SYMBOL
    kinds[0x80:0xC0] = FOLLOW
    kinds[0xC0:] = LEAD
    return kinds


def machine() -> tuple[np.ndarray, np.ndarray]:
    """``(next state, output)`` by state and class."""
    to = np.full((2, 6), INSIDE, np.uint8)
    to[:, BLANK] = OUTSIDE
    out = np.full((2, 6), POINT, np.uint8)
    out[:, FOLLOW] = 0
    out[OUTSIDE, CAPITAL:] |= STARTS
    out[INSIDE, BLANK] |= ENDS
    out[:, CAPITAL] |= UPPER
    out[:, SYMBOL] |= MARKED
    return to, out


CLASSES = byte_classes()
NEXT, OUT = machine()


def transduce(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(outputs, state after)`` of each byte of texts laid end to end; ``edges`` are where texts start, and the end.

    Every state has the same successor for a class, so the state after a byte follows from that byte, and the outputs of all bytes are
    looked up together. A text starts outside of words.
    """
    kinds = CLASSES[data]
    after = NEXT[OUTSIDE][kinds]
    before = np.empty_like(after)
    before[1:] = after[:-1]
    begins = edges[:-1]
    before[begins[begins < len(data)]] = OUTSIDE
    return OUT[before, kinds], after


def count_texts(texts: list[bytes]) -> list[tuple[int, int, int, int, bool]]:
    """``(words, distinct words, capitals, code points, holds a symbol)`` of each text."""
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    whole = b"".join(texts)
    data = np.frombuffer(whole, np.uint8)
    out, after = transduce(data, edges)

    def per_text(bit: int) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(out & bit), edges))

    starts = np.flatnonzero(out & STARTS)
    # A word also ends with its text; each text then has as many ends as starts, in the same order.
    lasts = edges[1:][(np.diff(edges) > 0) & (after[np.maximum(edges[1:] - 1, 0)] == INSIDE)] if len(data) else edges[:0]
    ends = np.sort(np.concatenate([np.flatnonzero(out & ENDS), lasts]), kind="stable")
    cuts = np.searchsorted(starts, edges).tolist()
    first, last = starts.tolist(), ends.tolist()
    capitals, points, marked = per_text(UPPER).tolist(), per_text(POINT).tolist(), per_text(MARKED).tolist()
    made = []
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        table = {whole[i:j] for i, j in zip(first[a:b], last[a:b], strict=True)}
        made.append((b - a, len(table), capitals[k], points[k], marked[k] > 0))
    return made


def blocks(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > BLOCK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def count_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, n_words, n_distinct, n_capitals, n_points, has_symbol, text_sha)``, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            rows, shas = [], []
            for block in blocks((x.as_py() or b"") for x in texts):
                rows += count_texts(block)
                shas += [hashlib.sha256(t).digest() for t in block]
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], pa.array(shas, pa.binary())],
                ["doc_id", "part", "n_words", "n_distinct", "n_capitals", "n_points", "has_symbol", "text_sha"],
            )

    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    kinds = "n_words long, n_distinct long, n_capitals long, n_points long, has_symbol boolean, text_sha binary"
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, part string, {kinds}")


def verdicts(docs: DataFrame) -> DataFrame:
    """The counts of each document and ``failed``, the bits of the filters A to E (1, 2, 4, 8, 16) that it fails.

    One row per row of ``docs``. A: under 200 words. B: distinct words are under half of the words. C: over 3 capitals per 100 code points.
    D: holds one of ``#$%&*|``. E: the whole text is that of a smaller doc_id; a row without an id is never a copy nor an original. Null and
    empty texts have no words and fail A alone, and E if one with a smaller id is empty or null too.
    """
    rows = stored(count_documents(docs), "text-counts")
    firsts = rows.groupBy("text_sha").agg(F.min("doc_id").alias("first_id"))
    rows = rows.join(firsts, "text_sha")
    fails = {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > 3 * F.col("n_points"),
        "D": F.col("has_symbol"),
        "E": F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False)),
    }
    bits = sum((F.when(fails[name], 1 << k).otherwise(0) for k, name in enumerate(FILTERS)), F.lit(0))
    return rows.select("doc_id", "part", "n_words", "n_distinct", "n_capitals", "n_points", "has_symbol", bits.alias("failed"))


def _orders() -> Column:
    """Every filter of every order: the order, the step, the filter's bit and the bits of the filters before it."""
    made = []
    for order in permutations(FILTERS):
        gone = 0
        for step, name in enumerate(order, start=1):
            bit = 1 << FILTERS.index(name)
            made.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(bit).alias("bit"), F.lit(gone).alias("gone")))
            gone |= bit
    return F.array(*made)


def interactions(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each place of each order, by part; see :func:`audit`."""
    marks = labels.groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("bad")
    )
    known = judged.select("doc_id", "part", "failed").join(marks.where(F.col("doc_id").isNotNull()), "doc_id", "left")
    alike = known.groupBy("part", "failed", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("bad"))
    # At most 32 x 4 rows a part from here on, whatever the number of documents.
    rows = alike.agg(F.count("*").alias("n")).select("*", F.explode(_orders()).alias("o")).select("*", "o.*")
    own = F.col("failed").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("failed").bitwiseAND(F.col("gone")) != 0
    count = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).cast("long")
    # Of the filters that a document fails, each comes first in the same share of the 120 orders.
    share = F.col("n") * F.expr("120 div greatest(bit_count(failed), 1)")
    return rows.groupBy("part", "filter_order", "step").agg(
        count(~own & ~earlier).alias("kept"),
        count(own & ~earlier).alias("removed"),
        count(own & earlier).alias("redundant"),
        count(F.col("failed") == F.col("bit")).alias("unique_fails"),
        count(own & ~earlier & F.col("good")).alias("good_lost"),
        count(own & ~earlier & F.col("bad")).alias("toxic_lost"),
        F.coalesce(F.sum(F.when(own, share)), F.lit(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included; a part is a language, null counts as the empty string.

    Columns are those of the contract: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. A document repeated whole
    counts as often as it stands there. It is good or toxic if any of its labels says so; labels without an id are ignored. An empty table
    gives no rows, and a table without labels loses nothing good. Ties cannot occur: filters look at a document alone, but for E, which
    goes by the least id. Texts are read whole, whatever their length; columns other than doc_id, text, lang, quality and toxic are not read.
    """
    return interactions(verdicts(docs), labels)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
firsts AS (SELECT t AS ft, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id AS lid, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(first_id < doc_id, false)] AS fails
  FROM d JOIN firsts ON t = ft LEFT JOIN l ON doc_id = lid),
g AS (SELECT part, good, bad, fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (SELECT [a.i, b.i, c.i, e.i, h.i] AS o FROM x a, x b, x c, x e, x h
  WHERE len(list_distinct([a.i, b.i, c.i, e.i, h.i])) = 5),
steps AS (SELECT o, x.i AS step, o[x.i] AS own, list_transform(o, lambda k: substr('ABCDE', k, 1)) AS names FROM orders, x),
r AS (SELECT part, good, bad, fails, n, step, array_to_string(names, '') AS filter_order, own, fails[own] AS mine,
    list_bool_or(list_transform(o[1:step - 1], lambda k: fails[k])) AS earlier,
    len(list_filter(fails, lambda k: k)) AS n_fails FROM g, steps),
t AS (SELECT part, filter_order, step, own,
    CAST(coalesce(sum(n) FILTER (WHERE NOT mine AND NOT coalesce(earlier, false)), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (WHERE mine AND NOT coalesce(earlier, false)), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE mine AND coalesce(earlier, false)), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE mine AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (WHERE mine AND NOT coalesce(earlier, false) AND good), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (WHERE mine AND NOT coalesce(earlier, false) AND bad), 0) AS BIGINT) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM t
"""
