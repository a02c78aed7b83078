"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text's k-mers of words are numbered by occurrence, so repeats count. A random order of the numbered k-mers is cut into
buckets by its leading bits; each bucket takes its least few, puts them back into text order and hashes the tuple. Two texts
agree in a bucket if they share those k-mers in the same order, which makes agreement fall with edit distance, moved
passages included. One hash serves all buckets, so the work for a text is one sort of its k-mers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import stored, text_hash, text_of

#: Words are runs of up to 12 other characters than blanks; from U+2E80 on each character is a word of its own.
WORD = r"[^\s\x{2E80}-\x{10FFFF}]{1,12}|\S"
K = 3
BUCKETS = 64
#: Numbered k-mers that each bucket takes.
TAKE = 2

_POS_BITS = 28
_HASH_BITS = 64 - _POS_BITS
_BUCKET_BITS = BUCKETS.bit_length() - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for a row, however often lambdas in ``use`` read it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _packed(hashed: Column, pos: Column) -> Column:
    """Upper bits of a hash with a position below; positions beyond the field share its largest value."""
    top = F.shiftleft(F.shiftrightunsigned(hashed, _POS_BITS), _POS_BITS)
    return top.bitwiseOR(F.least(pos.cast("long"), F.lit((1 << _POS_BITS) - 1)))


def _high(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, _POS_BITS)


def _run_starts(values: Column, part: Callable[[Column], Column]) -> Column:
    """Indexes in a sorted array at which ``part`` of the value changes."""
    index = F.sequence(F.lit(0), F.size(values) - 1)
    return F.filter(index, lambda i: (i == 0) | (part(F.get(values, i)) != part(F.get(values, i - 1))))


def _ends(starts: Column, size: Column) -> Column:
    return F.concat(F.slice(starts, 2, F.size(starts)), F.array(size))


def kmer_hashes(text: Column, k: int = K) -> Column:
    """Hashes of all k-mers of words in text order; fewer than k words are one k-mer, no words none."""

    def windows(words: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
        )
        few = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(words) >= k, many).otherwise(few)

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return let(words, windows)


def numbered(hashes: Column) -> Column:
    """Sorted array of (hash of k-mer and occurrence number, position), packed into longs."""

    def number(sorted_kmers: Column) -> Column:
        def mark(starts: Column) -> Column:
            occurrence = F.flatten(
                F.zip_with(starts, _ends(starts, F.size(sorted_kmers)), lambda a, b: F.sequence(F.lit(0), b - a - 1))
            )
            mask = F.lit((1 << _POS_BITS) - 1)
            return F.sort_array(
                F.zip_with(
                    sorted_kmers,
                    occurrence,
                    lambda x, n: _packed(F.xxhash64(_high(x), n), x.bitwiseAND(mask)),
                )
            )

        return let(_run_starts(sorted_kmers, _high), mark)

    packed = F.transform(hashes, lambda h, i: _packed(h, i))
    none = F.array().cast("array<bigint>")
    return let(F.sort_array(packed), lambda s: F.when(F.size(s) > 0, number(s)).otherwise(none))


def signature(text: Column, k: int = K) -> Column:
    """``array<int>`` of the buckets that have k-mers: bucket number in the upper bits, 16 bits of its tuple's hash below."""
    shift = 64 - _BUCKET_BITS
    bucket = lambda x: F.shiftrightunsigned(x, shift)

    def least_of(ranked: Column) -> Column:
        chosen = F.filter(
            ranked, lambda x, i: (i < TAKE) | (bucket(F.get(ranked, i - TAKE)) != bucket(x))
        )
        return let(chosen, tuples)

    def tuples(chosen: Column) -> Column:
        starts = _run_starts(chosen, bucket)
        return let(
            starts,
            lambda s: F.zip_with(s, _ends(s, F.size(chosen)), lambda a, b: entry(F.slice(chosen, a + 1, b - a))),
        )

    def entry(group: Column) -> Column:
        by_place = F.sort_array(
            F.transform(group, lambda x: F.shiftleft(x, _HASH_BITS).bitwiseOR(F.shiftrightunsigned(x, _POS_BITS)))
        )
        mask = F.lit((1 << _HASH_BITS) - 1)
        tuple_hash = F.xxhash64(F.transform(by_place, lambda y: y.bitwiseAND(mask))).bitwiseAND(F.lit(0xFFFF))
        return F.shiftleft(bucket(F.get(group, F.lit(0))), 16).bitwiseOR(tuple_hash).cast("int")

    none = F.array().cast("array<int>")
    return let(numbered(kmer_hashes(text, k)), lambda r: F.when(F.size(r) > 0, least_of(r)).otherwise(none))


def likeness(one: Column, other: Column) -> Column:
    """Share of text in common, 0 to 1, from two signatures; two without k-mers are alike.

    Buckets agree with the probability that all their k-mers are shared: J ** TAKE for Jaccard likeness J. 2J / (1 + J) is the
    share of either text that is shared when both are equally long.
    """
    number = lambda s: F.transform(s, lambda e: F.shiftrightunsigned(e, 16))
    held = F.size(F.array_union(number(one), number(other)))
    share = F.size(F.array_intersect(one, other)) / held
    jaccard = F.pow(share, F.lit(1.0 / TAKE))
    return F.when(held == 0, F.lit(1.0)).otherwise(2 * jaccard / (1 + jaccard))


def shown(sig: Column) -> Column:
    """Signature as text: six hexadecimal digits for each bucket that has k-mers."""
    return F.array_join(F.transform(sig, lambda e: F.lpad(F.lower(F.hex(e)), 6, "0")), "")


def next_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, n_chars, next_id, next_key)`` of distinct rows by descending doc_id; the first follows the last.

    Ids are range-partitioned; each partition reads its own neighbours, and one row a partition is passed to the one before.
    """
    ids = docs.select("doc_id", text_hash().alias("text_key"), F.char_length(text_of()).alias("n_chars")).distinct()
    parts = ids.repartitionByRange(F.desc("doc_id"), "text_key").withColumn("part", F.spark_partition_id())
    parts = stored(parts, "ranged-ids")
    own = Window.partitionBy("part").orderBy(F.desc("doc_id"), "text_key")
    there = F.struct(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    rows = parts.select("*", F.lead(there).over(own).alias("after"), F.row_number().over(own).alias("row"))
    heads = rows.where("row = 1").select("part", there.alias("head"))
    ring = Window.orderBy("part")
    first = F.first("head").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(ring), first).alias("head"))
    following = F.coalesce("after", "head")
    return rows.join(heads, "part").select(
        "doc_id", "text_key", "n_chars", following["id"].alias("next_id"), following["key"].alias("next_key")
    )


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """``(doc_id, signature)``, one row per row of ``docs``. Null and empty texts have an empty signature."""
    return docs.select("doc_id", signature(text_of(), k).alias("signature"))


def edited_likeness(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text has the last half of its code points, rounded down, replaced by the first as many (or all) of the next
    document by descending doc_id; the last document is followed by the first. One row per row of ``docs``; rows repeated whole are
    one document and get equal answers, rows with the same doc_id and other texts follow by text hash. Null text is empty; null
    ids come last. Columns other than doc_id and text are not read.
    """
    order = stored(next_documents(docs), "next-documents")
    base = docs.select("doc_id", text_of().alias("text"), text_hash().alias("text_key"))
    wanted = order.select(
        F.col("doc_id").alias("for_id"),
        F.col("text_key").alias("for_key"),
        F.floor(F.col("n_chars") / 2).cast("int").alias("need"),
        "next_id",
        "next_key",
    )
    is_next = base["doc_id"].eqNullSafe(wanted["next_id"]) & (base["text_key"] == wanted["next_key"])
    heads = base.join(wanted, is_next).select("for_id", "for_key", F.left("text", F.col("need")).alias("head"))
    if docs.select("doc_id").count() > order.count():
        heads = heads.dropDuplicates(["for_id", "for_key"])
    mine = base["doc_id"].eqNullSafe(heads["for_id"]) & (base["text_key"] == heads["for_key"])
    n_chars = F.char_length("text")
    pairs = base.join(heads, mine).select(
        "doc_id",
        "text_key",
        "text",
        F.concat(F.left("text", n_chars - F.floor(n_chars / 2).cast("int")), F.col("head")).alias("edited"),
    )
    made = stored(
        pairs.select(
            "doc_id",
            "text_key",
            n_chars.cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            signature(F.col("text"), k).alias("own"),
            signature(F.col("edited"), k).alias("changed"),
        ),
        "fingerprints",
    )
    after = order.select("doc_id", "text_key", "next_id", "next_key")
    theirs = made.select(
        F.col("doc_id").alias("next_id"), F.col("text_key").alias("next_key"), F.col("own").alias("following")
    ).dropDuplicates(["next_id", "next_key"])
    is_next = after["next_id"].eqNullSafe(theirs["next_id"]) & (after["next_key"] == theirs["next_key"])
    beside = after.join(theirs, is_next).select(
        F.col("doc_id").alias("for_id"), F.col("text_key").alias("for_key"), "following"
    )
    mine = made["doc_id"].eqNullSafe(beside["for_id"]) & (made["text_key"] == beside["for_key"])
    return made.join(beside, mine).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("own")).alias("fingerprint"),
        shown(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
