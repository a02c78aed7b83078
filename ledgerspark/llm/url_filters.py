"""URL filters that judge every capture by the lists as they were when it was fetched.

Dated list entries become validity intervals: an entry holds until the next one of its pattern. Captures and intervals meet by pattern and
month, and the interval that covers the fetch date counts, so a pattern with a long history costs no more than one with a short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import stored

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """Host in lower case without user, port and last dots; empty if there is none."""
    return F.rtrim(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), HOST, 1), F.lit("."))


def suffixes_of(host: Column) -> Column:
    """The host and the domains above it, down to two labels."""
    labels = F.split(host, r"\.")
    return F.when(
        F.size(labels) > 1,
        F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    ).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame, until: Column) -> DataFrame:
    """``(pattern, action, since, before, month)`` of entries ``(pattern, action, dated)``, a row for each month up to ``until``.

    Of entries with one pattern and date the last by action counts. Actions ``block`` and ``allow`` open an interval; any other, like
    ``remove``, only ends the one before. Null patterns and dates are no entries.
    """
    known = entries.where(F.col("pattern").isNotNull() & F.col("dated").isNotNull())
    daily = known.groupBy("pattern", F.col("dated").alias("since")).agg(F.max("action").alias("action"))
    following = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    spans = daily.withColumn("before", following).where(F.col("action").isin("block", "allow"))
    last = F.least(F.coalesce(F.date_sub("before", 1), until), until)
    spans = spans.where(F.col("since") <= last)
    months = F.sequence(F.trunc("since", "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    return spans.select("pattern", "action", "since", "before", F.explode(months).alias("month"))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` with ``host, pattern, action, kept``, one row per row; columns of those names are replaced.

    ``captures`` has ``url`` and ``fetched_on``. The longest pattern that is the host or a domain above it and in force on that date decides;
    ``kept`` is false if it blocks. Null or unreadable urls and null dates match nothing and are kept. Captures are written by key, so a
    domain that holds much of the web is split by AQE.
    """
    base = captures.drop("host", "pattern", "action", "kept").withColumn("host", host_of(F.col("url")))
    seen = base.select("host", "fetched_on").where(F.col("fetched_on").isNotNull()).distinct()
    until = seen.agg(F.max("fetched_on")).first()[0]
    if until is None:
        none = F.lit(None).cast("string")
        return base.withColumn("pattern", none).withColumn("action", none).withColumn("kept", F.lit(True))
    spans = stored(intervals(entries, F.lit(until)), "url-intervals")
    asked = seen.select("host", "fetched_on", F.trunc("fetched_on", "month").alias("month"), F.explode(suffixes_of(F.col("host"))).alias("pattern"))
    hit = asked.join(spans, ["pattern", "month"]).where(
        (F.col("fetched_on") >= F.col("since")) & (F.col("before").isNull() | (F.col("fetched_on") < F.col("before")))
    )
    longest = F.max(F.struct(F.char_length("pattern").alias("length"), "pattern", "action")).alias("best")
    decided = hit.groupBy("host", "fetched_on").agg(longest).select("host", "fetched_on", "best.pattern", "best.action")
    decided = stored(decided, "url-verdicts")
    return base.join(decided, ["host", "fetched_on"], "left").select(
        *base.columns, "pattern", "action", F.coalesce(F.col("action") != "block", F.lit(True)).alias("kept")
    )


def _number(value: Column) -> Column:
    """28-bit number of a text, the same in every engine."""
    return F.conv(F.substring(F.md5(value), 1, 7), 16, 10).cast("long")


def dated_captures(pages: DataFrame) -> DataFrame:
    """``(page_id, url, fetched_on)``: pages carry no date, so each gets a day of 2023 or 2024 by its id."""
    day = (_number(F.concat_ws(":", F.lit("fetch"), F.col("page_id").cast("string"))) % 731).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), day).alias("fetched_on"))


def dated_list(pages: DataFrame) -> DataFrame:
    """``(pattern, action, dated)``: a third of the domains of the pages get three dated entries each, chosen by their names."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    domains = hosts.select(F.explode(suffixes_of(F.col("host"))).alias("pattern")).distinct()
    listed = domains.where(_number(F.col("pattern")) % 3 == 0).select("pattern", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    number = _number(F.concat_ws(":", F.col("pattern"), F.col("k").cast("string")))
    action = F.when(F.col("k") == 1, F.lit("remove")).when(number % 5 == 0, F.lit("allow")).otherwise(F.lit("block"))
    day = (F.floor(number / 5) % 731).cast("int")
    return listed.select("pattern", action.alias("action"), F.date_add(F.lit("2023-01-01").cast("date"), day).alias("dated"))


SQL = r"""
WITH caps AS (SELECT page_id, url,
  rtrim(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '.') AS host,
  DATE '2023-01-01' + CAST(('0x' || substr(md5('fetch:' || CAST(page_id AS VARCHAR)), 1, 7))::BIGINT % 731 AS INTEGER) AS fetched_on
  FROM pages),
split AS (SELECT DISTINCT host, string_split(host, '.') AS ls FROM caps),
suffix AS (SELECT host, array_to_string(ls[i:], '.') AS pattern FROM (SELECT host, ls, unnest(range(1, len(ls))) AS i FROM split)),
listed AS (SELECT pattern, k, ('0x' || substr(md5(pattern || ':' || CAST(k AS VARCHAR)), 1, 7))::BIGINT AS n
  FROM (SELECT DISTINCT pattern FROM suffix WHERE ('0x' || substr(md5(pattern), 1, 7))::BIGINT % 3 = 0), range(3) t(k)),
entries AS (SELECT pattern, CASE WHEN k = 1 THEN 'remove' WHEN n % 5 = 0 THEN 'allow' ELSE 'block' END AS action,
  DATE '2023-01-01' + CAST((n // 5) % 731 AS INTEGER) AS dated FROM listed),
daily AS (SELECT pattern, dated, max(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT pattern, action, dated AS since, lead(dated) OVER (PARTITION BY pattern ORDER BY dated) AS before FROM daily),
best AS (SELECT c.page_id, c.url, c.fetched_on, max_by(s.pattern, (length(s.pattern), s.pattern)) AS pattern,
  max_by(s.action, (length(s.pattern), s.pattern)) AS action
  FROM caps c JOIN suffix x ON x.host = c.host JOIN spans s ON s.pattern = x.pattern AND s.action IN ('block', 'allow')
   AND c.fetched_on >= s.since AND (s.before IS NULL OR c.fetched_on < s.before) GROUP BY ALL)
SELECT c.page_id, c.url, c.host, c.fetched_on, b.pattern, b.action, coalesce(b.action <> 'block', true) AS kept
FROM caps c LEFT JOIN best b ON b.page_id = c.page_id AND b.url = c.url
"""
