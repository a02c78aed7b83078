"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts and items are words. Of each sliding window of hashes of k words the least is kept, so that two texts which share a span of
``k + window - 1`` words share a kept hash inside it. The kept hashes of texts and items are joined, and each hit is extended word by word
to both sides; it counts if it covers a window of the item. Every such window holds a kept hash, so none is missed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import ascii_lower, stored, text_hash, text_of

#: Words in a window of an item, and words in a hash; items of fewer words than that have a hash over all of them.
SPAN = 10
GRAM = 6
#: Largest number of item rows that is broadcast (about 16 bytes each for hashes, 400 with their words); more are shuffled.
BROADCAST_ROWS = 100_000
#: Longs in the bitmap of item hashes: four a hash, up to this. A fuller one lets more places of texts on to the join, and loses none.
BITMAP_LONGS = 1 << 14
#: What separates words: ASCII but digits and small letters, once A-Z is lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(column: str = "text") -> Column:
    return F.array_remove(F.split(ascii_lower(text_of(column)), BETWEEN), "")


def gram_hashes(words: Column, k: int) -> Column:
    """A 32-bit hash of each ``k`` words in a row, in the upper half of a long."""
    last = F.size(words) - (k - 1)
    upper = lambda i: F.shiftleft(F.xxhash64(F.lit(k), F.slice(words, i, k)), 32)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), upper)).otherwise(F.array().cast("array<long>"))


def minima(words: Column, k: int, window: int) -> Column:
    """Winnowed hashes as longs: the hash in the upper half, the place of its first word in the lower; of equal hashes the first.

    The least of ``window`` places is built from the least of runs of 1, 2, 4, ... places.
    """
    marked = F.transform(gram_hashes(words, k), lambda h, i: h.bitwiseOR(i.cast("long")))

    def over(values: Column, width: int) -> Column:
        if width == window:
            return F.slice(values, 1, F.greatest(F.size(values) - (window - 1), F.lit(0)))
        step = min(width, window - width)
        pairs = lambda v: F.zip_with(v, F.slice(v, step + 1, F.size(v)), lambda x, y: F.least(x, y))
        return bound(values, lambda v: bound(F.when(F.size(v) > step, pairs(v)).otherwise(v), lambda u: over(u, width + step)))

    return F.array_distinct(over(marked, 1))


def families(spans: list[int]) -> list[tuple[int, int]]:
    """``(words in a hash, hashes in a window)`` that leave a hash in every span of any of the given lengths."""
    short = [(s, 1) for s in sorted(set(spans)) if s < GRAM]
    long = [s for s in spans if s >= GRAM]
    return short + ([(GRAM, min(long) - GRAM + 1)] if long else [])


def contexts(benchmark: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    """Kept hashes of the items with the words around: each once, and ``(c1, c2, item)`` for the items that have it.

    A context has the words of the hash and after it (``ahead``, at most ``span``) and those before it, nearest first (``back``).
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of().alias("words"))
    items = stored(items.where(F.size("words") > 0).select("*", F.least(F.size("words"), F.lit(span)).alias("span")), "items")
    # At most ``span`` different lengths.
    spans = [r.span for r in items.select("span").distinct().collect()]
    parts = None
    for k, window in families(spans):
        own = items.where(F.col("span") == k) if k < GRAM else items.where(F.col("span") >= GRAM)
        at = own.select("item", "words", "span", F.lit(k).alias("k"), F.explode(minima(F.col("words"), k, window)).alias("mark"))
        parts = at if parts is None else parts.unionByName(at)
    if parts is None:
        parts = items.select("item", "words", "span", F.lit(1).alias("k"), F.lit(0).cast("long").alias("mark")).limit(0)
    first = F.col("at") + 1
    rows = parts.select("*", _hash(), _place()).select(
        "item",
        "hash",
        "k",
        "span",
        F.slice("words", first, F.col("span")).alias("ahead"),
        _before(F.col("words"), F.col("at"), F.col("span") - F.col("k")).alias("back"),
    )
    name = [F.xxhash64(*x, "hash", "k", "span", "ahead", F.lit("|"), "back") for x in ([F.lit(1)], [F.lit(2)])]
    rows = stored(rows.select("*", name[0].alias("c1"), name[1].alias("c2")), "item-contexts")
    return rows.drop("item").distinct(), rows.select("c1", "c2", "item").distinct(), families(spans)


def _hash() -> Column:
    return F.shiftright("mark", 32).alias("hash")


def _place() -> Column:
    return F.col("mark").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at")


def _before(words: Column, at: Column, most: Column) -> Column:
    """Up to ``most`` words before place ``at`` (from 0), the nearest first."""
    size = F.least(at, most)
    return F.reverse(F.slice(words, at - size + 1, size))


def _same(a: Column, b: Column) -> Column:
    """How many elements two arrays share from their start."""
    equal = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return bound(equal, lambda e: F.when(F.array_position(e, False) > 0, F.array_position(e, False) - 1).otherwise(F.size(e))).cast("int")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast only what was counted to be small; otherwise both sides are exchanged, and AQE splits a hot key."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def bitmap(items: DataFrame) -> Callable[[Column], Column]:
    """A test for marks whose hash may be that of an item, by the low bits of the hash: one long of the bitmap a row on the way to the driver."""
    hashes = items.select("hash").distinct()
    longs = 1
    while longs < min(hashes.count() * 4, BITMAP_LONGS):
        longs *= 2
    slot = hashes.select(
        F.shiftright("hash", 6).bitwiseAND(F.lit(longs - 1)).alias("at"), F.expr("shiftleft(1L, cast(hash & 63 AS int))").alias("bit")
    )
    filled = {r["at"]: r["bits"] for r in slot.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()}
    # A constant: an array made of one string is folded when the query is planned.
    held = F.split(F.lit(",".join(str(filled.get(k, 0)) for k in range(longs))), ",").cast("array<long>")

    def may_have(mark: Column) -> Column:
        at = F.shiftright(mark, 38).bitwiseAND(F.lit(longs - 1)).cast("int")
        return F.getbit(F.get(held, at), F.shiftright(mark, 32).bitwiseAND(F.lit(63)).cast("int")) == 1

    return may_have


def matches(docs: DataFrame, items: DataFrame, kinds: list[tuple[int, int]]) -> DataFrame:
    """``(doc_id, text_key, c1, c2, start, stop)``: stretches of words that hold a window of an item, at one of its contexts."""
    if not kinds:
        kinds = [(1, 1)]
    bits = bitmap(items)
    rows = docs.select("doc_id", text_hash().alias("text_key"), words_of().alias("words"))

    def places(words: Column) -> Column:
        """Kept hashes that an item may have, with the words around."""
        marks = F.filter(F.concat(*[minima(words, k, window) for k, window in kinds]), bits)
        around = lambda m: bound(
            m.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"),
            lambda at: F.struct(
                m.alias("mark"), F.slice(words, at + 1, SPAN).alias("ahead"), _before(words, at, F.lit(SPAN - 1)).alias("back")
            ),
        )
        return F.transform(marks, around)

    near = rows.select("doc_id", "text_key", F.explode(bound(F.col("words"), places)).alias("x")).select(
        "doc_id", "text_key", F.col("x.mark").alias("mark"), F.col("x.ahead").alias("own_ahead"), F.col("x.back").alias("own_back")
    )
    pairs = near.select("*", _hash(), _place()).join(_small(items), "hash")
    grown = pairs.select(
        "*", _same(F.col("own_ahead"), F.col("ahead")).alias("right"), _same(F.col("own_back"), F.col("back")).alias("left")
    )
    return grown.where((F.col("right") >= F.col("k")) & (F.col("left") + F.col("right") >= F.col("span"))).select(
        "doc_id", "text_key", "c1", "c2", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("stop")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, n_words, spans, items)``, one row per row of ``docs``: spans of words found in items, and those items.

    ``spans`` are ``(start, stop)`` from 0, stop exclusive, joined where they touch and in order; ``items`` are sorted as strings. An item of
    fewer than ten words must occur whole. Null and empty texts and items have no words and hit nothing; item rows of one id are one item,
    those without an id count as the empty name. Rows repeated whole get the same result, and other texts under one id stay apart.
    Empty tables give no rows or no hits. Only doc_id, text and item_id, text are read, so other columns may have any name.
    """
    items, holders, kinds = contexts(benchmark)
    found = stored(matches(docs, items, kinds), "leaks")
    key = ["doc_id", "text_key"]
    # A window holds the stretches of one text; their number is bounded by its words.
    order = Window.partitionBy(*key).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.select(*key, "start", "stop").distinct().select("*", reach.alias("reach"))
    islands = islands.select("*", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(order).alias("island"))
    spans = islands.groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    names = found.select(*key, "c1", "c2").distinct().join(_small(holders), ["c1", "c2"])
    names = names.groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = docs.select("doc_id", text_hash().alias("text_key"), F.size(words_of()).cast("long").alias("n_words"))
    for part in (spans, names):
        of = part.withColumnsRenamed({"doc_id": "of_id", "text_key": "of_key"})
        same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
        rows = rows.join(of, same, "left").drop("of_id", "of_key")
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def digest(result: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
    return result.select("*", hit.alias("n_hit")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
cuts AS (SELECT item, ws, least(10, len(ws)) AS s, unnest(range(len(ws) - least(10, len(ws)) + 1)) AS p FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, s, array_to_string(ws[p + 1:p + s], ' ') AS gram FROM cuts),
spans AS (SELECT DISTINCT s FROM win),
starts AS (SELECT r, ws, s, unnest(range(len(ws) - s + 1)) AS p FROM d, spans WHERE len(ws) >= s),
occ AS (SELECT r, starts.s AS s, p, item FROM starts JOIN win ON starts.s = win.s AND array_to_string(ws[p + 1:p + starts.s], ' ') = gram),
hit AS (SELECT r, count(DISTINCT w) AS n FROM (SELECT r, unnest(range(p, p + s)) AS w FROM occ) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN named ON d.r = named.r
"""
