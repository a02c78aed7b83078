"""Exact line dedup over all documents, in DataFrame functions only.

Line keys are hashed and range-partitioned on hash and a slice of the documents, sorted by document and position within;
the sorted stream shows where a document's first line of a key is. What comes back is a compressed keep bitmap of each
document, as runs of kept lines; texts are cut by it without being compared again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import BLANKS, ascii_lower, stored, text_hash, text_of, unused

#: Parts into which the documents of one key are dealt, so that no key lies in one task.
SLICES = 256


def lines_of(column: Column) -> Column:
    """Lines of a text; an empty text is one empty line."""
    return F.split(column, "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_rows(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``(doc_id, text_key, pos, h1, h2)`` of every line whose key has ``min_chars`` code points; two hashes make 128 bits."""
    rows = docs.select("doc_id", text_hash().alias("text_key"), F.posexplode(lines_of(text_of())).alias("pos", "line"))
    keys = rows.select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.char_length("key") >= max(1, min_chars)).select(
        "doc_id", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2")
    )


def first_occurrences(rows: DataFrame) -> DataFrame:
    """Line rows streamed in key order: ``new_doc`` is true on the first line of a key in each document."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int").alias("slice")
    dealt = rows.select("*", part).repartitionByRange("h1", "h2", "slice")
    stream = Window.partitionBy("h1", "h2", "slice").orderBy("doc_id", "text_key", "pos")
    before = F.lag("doc_id").over(stream)
    new_doc = (F.row_number().over(stream) == 1) | ~before.eqNullSafe(F.col("doc_id"))
    return dealt.select("*", new_doc.alias("new_doc"))


def frequent_keys(rows: DataFrame, min_docs: int) -> DataFrame:
    """Keys in at least ``min_docs`` documents, with the number and the ``first`` line; gathered in each slice before it is shuffled."""
    place = F.struct("doc_id", "text_key", "pos")
    seen = first_occurrences(rows).groupBy("h1", "h2").agg(F.count_if("new_doc").alias("n_docs"), F.min(place).alias("first"))
    return seen.where(F.col("n_docs") >= min_docs)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``(doc_id, text_key, dropped)`` of the documents that lose lines: sorted positions of the lines with frequent keys.

    With ``keep_first`` the first line of a key, by doc_id and position, is not among them.
    """
    rows = stored(line_rows(docs, min_chars), "lines")
    # Written, so that both sides of the join are exchanged and a key with very many lines can be split.
    keys = stored(frequent_keys(rows, min_docs).select("h1", "h2", "first"), "line-keys")
    hit = rows.join(keys, ["h1", "h2"])
    if keep_first:
        hit = hit.where(~F.struct("doc_id", "text_key", "pos").eqNullSafe(F.col("first")))
    return hit.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def keep_runs(n_lines: Column, dropped: Column) -> Column:
    """The bitmap as runs: ``array<struct<start, length>>`` of the lines between dropped ones."""
    before = F.concat(F.array(F.lit(-1)), dropped)
    after = F.concat(dropped, F.array(n_lines.cast("int")))
    gaps = F.zip_with(before, after, lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")))
    return F.filter(gaps, lambda g: g["length"] > 0)


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped``, ``keep_runs`` and ``kept_text``; one row per row of ``docs``.

    A key is the line without blanks at both ends, A-Z lower-cased. Keys of ``min_chars`` or more code points in at least
    ``min_docs`` documents lose all their lines, or with ``keep_first`` all but the first; blank lines have no key and stay. Null and empty texts are one empty line. Rows
    with the same doc_id count as one document; rows repeated whole get the same result. Columns of ``docs`` with the
    names of the results are replaced.
    """
    made = {"n_lines", "n_dropped", "keep_runs", "kept_text"}
    own_key, of_id, of_key, gone = unused(docs, "own_key", "of_id", "of_key", "gone")
    maps = keep_bitmaps(docs, min_docs, min_chars, keep_first).select(
        F.col("doc_id").alias(of_id), F.col("text_key").alias(of_key), F.col("dropped").alias(gone)
    )
    plain = docs.select(*[c for c in docs.columns if c.lower() not in made], text_hash().alias(own_key))
    joined = plain.join(maps, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(own_key) == F.col(of_key)), "left")
    dropped = F.coalesce(F.col(gone), F.array().cast("array<int>"))
    lines = lines_of(text_of())
    n_lines = F.size(lines).cast("long")
    runs = keep_runs(n_lines, dropped)
    kept = F.when(F.col(gone).isNull(), text_of()).otherwise(F.array_join(F.flatten(_cut(lines, F.col("keep_runs"))), "\n"))
    out = joined.select(
        *[c for c in plain.columns if c != own_key],
        n_lines.alias("n_lines"),
        F.size(dropped).cast("long").alias("n_dropped"),
        runs.alias("keep_runs"),
        gone,
    )
    return out.select("*", kept.alias("kept_text")).drop(gone)


def _cut(lines: Column, runs: Column) -> Column:
    """Slices of ``lines`` for each run; the lines are bound once, not once for each run."""
    return F.transform(F.array(lines), lambda all_lines: F.flatten(
        F.transform(runs, lambda r: F.slice(all_lines, r["start"] + 1, r["length"]))
    ))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, string_split(t, chr(10)) AS ls FROM docs),
rows AS (SELECT doc_id, t, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
keyed AS (SELECT doc_id, t, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM rows),
freq AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(freq.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE freq.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN freq ON keyed.k = freq.k GROUP BY doc_id
"""
