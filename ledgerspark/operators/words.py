"""Positioned words to visual lines, repeated lines, clusters and candidate tables.

Every step is keyed by file first, so one exchange on ``file_id`` serves the whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.text import mask_digits, normalize_ws, strip
from ledgerspark.operators.ordered import Hot, lag, running_sum, with_group, with_ordered

BLOCK = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("width", T.DoubleType()),
        T.StructField("height", T.DoubleType()),
    ]
)
DOCUMENT = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField(
            "pages",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("page", T.IntegerType()),
                        T.StructField("page_width", T.DoubleType()),
                        T.StructField("page_height", T.DoubleType()),
                        T.StructField("blocks", T.ArrayType(BLOCK)),
                    ]
                )
            ),
        ),
    ]
)
WORD_COLUMNS = ["file_id", "page", "page_width", "page_height", "x", "y", "width", "height", "text"]


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """Words of nested extraction documents on disk."""
    return flatten_words(spark.read.schema(DOCUMENT).json(path, multiLine=True))


def flatten_words(documents: DataFrame) -> DataFrame:
    pages = documents.select("file_id", F.inline("pages"))
    return pages.select("file_id", "page", "page_width", "page_height", F.inline("blocks")).select(*WORD_COLUMNS)


def named(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column through a generator, so that it is computed once and not again inside whatever uses it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def page_words(words: DataFrame) -> DataFrame:
    """Words gathered to one row per page; rows that are pages already stay as they are."""
    if "words" in words.columns:
        return words
    return words.groupBy("file_id", "page").agg(
        F.first("page_width").alias("page_width"),
        F.first("page_height").alias("page_height"),
        F.collect_list(F.struct("x", "y", "width", "height", "text")).alias("words"),
    )


def flatten_pages(pages: DataFrame) -> DataFrame:
    return pages.select("file_id", "page", "page_width", "page_height", F.inline("words"))


def lines_of(words: DataFrame, hot: Hot | None = None, tolerance: float | None = None) -> DataFrame:
    """The rows of ``build_lines(to_lines(words))``, with words sorted inside their pages instead of inside a whole task.

    What is gathered is one page, so neither a window nor an aggregate holds the words of many files. ``words`` are rows or pages of words.
    """
    # Functions over the elements of an array are interpreted, so they make single values here; structs are zipped from arrays of values.
    parts = ["x", "text", "y", "width", "height"]

    def zipped(array: str, *more: tuple[Column, str], first: bool = False) -> Column:
        own = [F.col(array)[c].alias(c) for c in parts]
        added = [value.alias(name) for value, name in more]
        return F.arrays_zip(*(added + own if first else own + added))

    pages = page_words(words).filter(F.col("words").isNotNull())
    pages = pages.withColumn("_cy", F.transform("words", lambda w: w["y"] + w["height"] / 2))
    # The centres are sorted apart: a field of the sorted words would be taken from all of them again for every element.
    pages = pages.withColumns({"words": F.sort_array(zipped("words", (F.col("_cy"), "cy"), first=True)), "_cy": F.sort_array("_cy")})

    def opens(i: Column) -> Column:
        word, prev = F.get("words", i), F.get("words", i - 1)
        limit = F.lit(tolerance) if tolerance is not None else F.greatest(prev["height"], word["height"], F.lit(6.0)) * 0.45
        return word["cy"] - prev["cy"] > limit

    # Words stand by their centres, so a line can open only with the first word of a centre.
    others = F.slice(F.array_distinct("_cy"), 2, F.size("_cy"))
    firsts = F.transform(others, lambda c: (F.array_position("_cy", c) - 1).cast("int"))
    at = F.concat(F.array(F.lit(0)), F.filter(firsts, opens))
    # A page without words has no lines.
    pages = pages.withColumn("_at", F.when(F.size("words") > 0, at).otherwise(F.array().cast("array<int>")))

    pages = with_ordered(pages, ["file_id"], ["page"], {"_upto": running_sum(F.size("_at"))}, hot)
    keep = ["file_id", "page", "page_width", "page_height", "words", "_at", (F.col("_upto") - F.size("_at") + 1).alias("_first")]
    lines = pages.select(*keep, F.posexplode("_at").alias("_pos", "_start"))
    end = F.coalesce(F.get("_at", F.col("_pos") + 1), F.size("words"))
    lines = lines.withColumn("words", F.slice("words", F.col("_start") + 1, end - F.col("_start")))
    lines = lines.withColumn("_words", F.sort_array(zipped("words")))

    def piece(word: Column, prev: Column) -> Column:
        spaces = F.when(prev.isNull(), 0).otherwise(gap_spaces(prev["x"] + prev["width"], prev["height"], word["x"], word["height"]))
        return F.concat(F.call_function("repeat", F.lit(" "), spaces), word["text"])

    before = F.concat(F.array(F.get("_words", F.lit(-1))), F.slice("_words", 1, F.size("_words") - 1))
    lines = lines.withColumn("_pieces", F.zip_with("_words", before, piece))
    low = F.array_min(F.col("_words")["y"])
    ends = F.array_max(F.transform("_words", lambda w: w["y"] + w["height"]))
    return lines.select(
        "file_id",
        (F.col("_first") + F.col("_pos")).alias("line_no"),
        "page",
        "page_width",
        "page_height",
        F.round(low, 2).alias("y"),
        F.round(ends - low, 2).alias("height"),
        zipped("_words", (F.col("_pieces"), "piece")).alias("fragments"),
        F.array_join("_pieces", "").alias("line_text"),
    )


def to_lines(words: DataFrame, hot: Hot | None = None, tolerance: float | None = None) -> DataFrame:
    """Add ``line_no``, rising over the pages of a file.

    A word opens a line when its centre lies further below the word before it than 0.45 of the larger height
    (or than a fixed ``tolerance``). Words of one line must therefore not drift by more than that in sum.
    """
    height = F.greatest("height", F.lit(6.0))
    words = words.withColumns({"_cy": F.col("y") + F.col("height") / 2, "_h": height})
    order = ["page", "_cy", "x", "text"]
    words = with_ordered(words, ["file_id"], order, {"_p": lag(F.struct("page", "_cy", "_h"))}, hot)
    prev = F.col("_p")
    limit = F.lit(tolerance) if tolerance is not None else F.greatest(prev["_h"], F.col("_h")) * 0.45
    opens = prev.isNull() | (prev["page"] != F.col("page")) | (F.col("_cy") - prev["_cy"] > limit)
    words = words.withColumn("_new", opens.cast("int"))
    words = with_ordered(words, ["file_id"], order, {"line_no": running_sum(F.col("_new"))}, hot)
    return words.drop("_p", "_cy", "_h", "_new")


def gap_spaces(prev_right: Column, prev_height: Column, x: Column, height: Column) -> Column:
    """Spaces between two words: one inside a phrase, two to eight across a column gap."""
    gap = x - prev_right
    ref = F.greatest(F.least(prev_height, height), F.lit(6.0))
    char = F.greatest(ref * 0.38, F.lit(3.5))
    wide = F.greatest(F.lit(2), F.least(F.lit(8), F.bround(gap / char).cast("int")))
    return F.when((gap <= 0) | (gap <= char * 1.8), 1).otherwise(wide)


def build_lines(lined: DataFrame, hot: Hot | None = None) -> DataFrame:
    """One row per visual line: text with kept gaps, box, and its words from left to right."""
    keys = ["file_id", "line_no"]
    seen = F.struct((F.col("x") + F.col("width")).alias("right"), "height")
    lined = with_ordered(lined, keys, ["x", "text"], {"_p": lag(seen)}, hot)
    spaces = gap_spaces(F.col("_p")["right"], F.col("_p")["height"], F.col("x"), F.col("height"))
    piece = F.when(F.col("_p").isNull(), F.col("text")).otherwise(F.concat(F.expr("repeat(' ', 1)"), F.col("text")))
    lined = lined.withColumn("_n", F.when(F.col("_p").isNull(), 0).otherwise(spaces))
    piece = F.concat(F.expr("repeat(' ', _n)"), F.col("text"))
    word = F.struct("x", "text", "y", "width", "height", piece.alias("piece"))
    out = lined.groupBy(*keys).agg(
        F.first("page").alias("page"),
        F.first("page_width").alias("page_width"),
        F.first("page_height").alias("page_height"),
        F.round(F.min("y"), 2).alias("y"),
        F.round(F.max(F.col("y") + F.col("height")) - F.min("y"), 2).alias("height"),
        F.array_sort(F.collect_list(word)).alias("fragments"),
    )
    return out.withColumn("line_text", F.array_join(F.col("fragments")["piece"], ""))


def page_stats(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Words, characters and rows per page with the page's usable flag."""
    per_words = words.groupBy("file_id", "page").agg(
        F.count(F.lit(1)).alias("word_count"), F.sum(F.length("text")).alias("char_count")
    )
    per_lines = lines.groupBy("file_id", "page").agg(F.count(F.lit(1)).alias("row_count"))
    out = per_words.join(per_lines, ["file_id", "page"])
    return out.withColumn("has_usable_text", (F.col("char_count") >= 5) & (F.col("word_count") >= 1))


def document_stats(pages: DataFrame) -> DataFrame:
    out = pages.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum("word_count").alias("word_count"),
        F.sum("char_count").alias("char_count"),
        F.sum("row_count").alias("row_count"),
    )
    usable = (F.col("char_count") >= 10) & (F.col("word_count") >= 2)
    return out.withColumns(
        {
            "has_usable_text": usable,
            "pdf_type": F.when(usable, "DigitalWithText").otherwise("ScannedOrRasterizedNoText"),
        }
    )


# What makes a footer line a transaction line instead.
FOOTER_AMOUNT = r"\b\d{1,3}(?:,\d{2,3})*\.\d{2}\b"
FOOTER_DATE = r"^\d{2}[/-]\d{2}[/-]\d{2,4}"
FOOTER_PAYMENT = (
    r"(?i)PAYMENT\s+FROM|UPI-|UPI/|IMPS-|NEFT\s+|RTGS\s+|@|\bATM\b|\bPOS\b|\bTRANSFER\b|\bINVOICE\b|\bBILL\b"
)
PAGE_NUMBER = r"(?i)^Page\s+\d+(\s+of\s+\d+)?$"


def _in_zones(text: Column) -> tuple[Column, Column]:
    """Whether a line may repeat as a header, and as a footer."""
    header = (F.col("y") <= F.col("page_height") * 0.12) & (F.length(text) >= 4)
    low = F.col("y") >= F.col("page_height") * 0.90
    content = text.rlike(FOOTER_AMOUNT) | text.rlike(FOOTER_DATE) | text.rlike(FOOTER_PAYMENT)
    return header, low & ~content & ((F.length(text) >= 15) | text.rlike(PAGE_NUMBER))


def repeated_lines(lines: DataFrame) -> DataFrame:
    """Header and footer lines repeated over the pages of a file, one row per (file, zone, text). The lines are read once."""
    text = normalize_ws("line_text")
    masked = mask_digits(text)
    header, footer = _in_zones(text)
    zone = F.when(header, "header").when(footer, "footer")
    signature = F.when(zone.isNotNull(), F.upper(F.when(header, text).otherwise(masked)))
    zoned = lines.select("file_id", "page", "y", zone.alias("zone"), signature.alias("signature"))
    # Lines outside the zones make one group of a file; they only tell how many pages it has.
    found = zoned.groupBy("file_id", "zone", "signature").agg(
        F.count(F.lit(1)).alias("times"), (F.max("y") - F.min("y")).alias("spread"), F.max("page").alias("_page")
    )
    found = found.withColumn("pages", F.max("_page").over(Window.partitionBy("file_id"))).filter("zone is not null")
    return found.filter(_repeats()).select("file_id", "zone", "signature", "times")


def _repeats() -> Column:
    needed = F.greatest(F.lit(2), F.least(F.lit(5), F.ceil(F.col("pages") * 0.20)))
    return (F.col("pages") > 1) & (F.col("times") >= needed) & (F.col("spread") <= 20)


def flag_repeated(lines: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Mark lines that repeat as header or footer; the counts are windows beside the lines, which are read once."""
    text = normalize_ws("line_text")
    zone = F.when(F.col("y") <= F.col("page_height") * 0.12, "header").when(
        F.col("y") >= F.col("page_height") * 0.90, "footer"
    )
    signature = F.upper(F.when(zone == "header", text).otherwise(mask_digits(text)))
    header, footer = _in_zones(text)
    out = lines.withColumns(
        {
            "zone": F.coalesce(zone, F.lit("")),
            "signature": F.when(zone.isNotNull(), F.coalesce(signature, F.lit(""))).otherwise(""),
            "_y": F.when(header | footer, F.col("y")),
        }
    )
    counts = {"times": F.count("_y"), "_hi": F.max("_y"), "_lo": F.min("_y")}
    out = with_group(out, ["file_id", "zone", "signature"], counts, hot).withColumn("spread", F.col("_hi") - F.col("_lo"))
    out = with_group(out, ["file_id"], {"pages": F.max("page")}, hot)
    hit = F.coalesce(_repeats(), F.lit(False))
    return out.withColumns(
        {"is_header": hit & (F.col("zone") == "header"), "is_footer": hit & (F.col("zone") == "footer")}
    ).drop("_y", "_hi", "_lo", "times", "spread", "pages", "signature", "zone")


def x_clusters(fragments: DataFrame, hot: Hot | None = None, tolerance: float = 18.0) -> DataFrame:
    """Clusters of left edges per page. A gap above the tolerance starts a cluster."""
    keys = ["file_id", "page"]
    out = fragments.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n"), F.first("page_width").alias("page_width"))
    out = with_ordered(out, keys, ["x"], {"_p": lag(F.col("x"))}, hot)
    out = out.withColumn("_new", F.coalesce(F.col("x") - F.col("_p") > tolerance, F.lit(True)).cast("int"))
    out = with_ordered(out, keys, ["x"], {"cluster": running_sum(F.col("_new"))}, hot)
    return out.groupBy(*keys, "cluster").agg(
        F.min("x").alias("left_x"), F.max("x").alias("right_x"), F.sum("n").alias("members"),
        F.first("page_width").alias("page_width"),
    )


def candidate_tables(lines: DataFrame) -> DataFrame:
    """Pages that hold a table: at least three rows of three words over three clusters, and three rows of two cells."""
    # A page has few rows and clusters; they are gathered, so that the lines are read once.
    wide = F.when(F.size("fragments") >= 3, F.struct("y", "height", F.col("fragments")["x"].alias("xs")))
    pages = lines.groupBy("file_id", "page").agg(
        F.first("page_width").alias("page_width"), F.collect_list(wide).alias("_wide"), F.count(F.lit(1)).alias("n")
    )

    pages = pages.filter(F.size("_wide") >= 3)
    pages = named(pages, "_x", F.sort_array(F.array_distinct(F.flatten(F.col("_wide")["xs"]))))

    def opens(i: Column) -> Column:
        return (i == 0) | (F.get("_x", i) - F.get("_x", i - 1) > 18.0)

    pages = named(pages, "_at", F.filter(F.sequence(F.lit(0), F.size("_x") - 1), opens))

    def cluster(start: Column, k: Column) -> Column:
        right = F.coalesce(F.get("_x", F.get("_at", k + 1)) - 4.0, F.col("page_width") - 10.0)
        return F.struct(F.round(F.get("_x", start), 2).alias("left"), F.round(right, 2).alias("right"))

    pages = named(pages, "columns", F.transform("_at", cluster)).filter(F.size("columns") >= 3)

    def cells(row: Column) -> Column:
        return F.size(F.filter("columns", lambda c: F.exists(row["xs"], lambda x: (x >= c["left"] - 8.0) & (x < c["right"]))))

    pages = named(pages, "_rows", F.filter("_wide", lambda r: cells(r) >= 2)).filter(F.size("_rows") >= 3)
    top = F.array_min(F.col("_rows")["y"])
    low = F.array_max(F.transform("_rows", lambda r: r["y"] + r["height"]))
    rows = F.size("_rows").cast("long")
    confidence = F.least(F.lit(1.0), F.bround(rows / F.col("n"), 2) + 0.3)
    return pages.select(
        "file_id",
        "page",
        rows.alias("row_count"),
        F.size("columns").alias("column_count"),
        top.alias("table_top"),
        F.round(low - top, 2).alias("table_height"),
        F.array_min(F.col("columns")["left"]).alias("table_left"),
        F.array_max(F.col("columns")["right"]).alias("table_right"),
        F.round(confidence, 4).alias("confidence"),
    )
