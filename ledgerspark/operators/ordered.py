"""Ordered and grouped columns that survive a group holding a large share of all rows.

A plain window puts one group into one task. Groups above a row limit ("hot" groups) are instead range-partitioned on
the full order key, so they spread over many tasks; each task computes its stretch with a window over
``(keys, segment)`` and a small carry table (one row per stretch) supplies what came before or comes after.
Everything below the limit keeps the single-exchange window plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.session import checkpointed

SEG = "_seg"
HOT_ROWS_CONF = "ledgerspark.hotGroupRows"
DEFAULT_HOT_ROWS = 4_000_000
BROADCAST_ROWS = 50_000


@dataclass(frozen=True)
class Hot:
    """Keys whose group exceeds the limit, how many there are, and how many stretches their rows need."""

    keys: DataFrame
    count: int
    segments: int

    def _named(self, column: str) -> DataFrame:
        keys = self.keys.select(F.col(self.keys.columns[0]).alias(column))
        return F.broadcast(keys) if self.count <= BROADCAST_ROWS else keys

    def cold_rows(self, df: DataFrame, column: str) -> DataFrame:
        return df.join(self._named(column), column, "left_anti")

    def hot_rows(self, df: DataFrame, column: str) -> DataFrame:
        return df.join(self._named(column), column, "left_semi")


def hot_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


def find_hot(df: DataFrame, column: str, limit: int | None = None) -> Hot | None:
    """One key-column pass with map-side counts. ``None`` when every group fits the limit.

    At most ``rows / limit`` keys can qualify, so the saved key table stays small at any scale.
    """
    limit = limit or hot_limit(df)
    counts = df.groupBy(column).count().filter(F.col("count") > limit)
    total = counts.agg(F.count("*").alias("n"), F.sum("count").alias("rows")).first()
    if total["n"] == 0:
        return None
    keys = checkpointed(counts.select(column))
    return Hot(keys, total["n"], max(2, -(-2 * total["rows"] // limit)))


@dataclass(frozen=True)
class Spec:
    """One derived column: what to compute and over which expression."""

    kind: str
    expr: Column | None = None


def rownum() -> Spec:
    return Spec("rownum")


def lag(expr: Column) -> Spec:
    """Value in the previous row of the group."""
    return Spec("lag", expr)


def lead(expr: Column) -> Spec:
    """Value in the next row of the group."""
    return Spec("lead", expr)


def last_before(expr: Column) -> Spec:
    """Last non-null value strictly before the row."""
    return Spec("last_before", expr)


def last_upto(expr: Column) -> Spec:
    """Last non-null value up to and including the row."""
    return Spec("last_upto", expr)


def running_sum(expr: Column) -> Spec:
    """Sum up to and including the row; nulls count as zero."""
    return Spec("sum", F.coalesce(expr, F.lit(0)))


def running_max(expr: Column) -> Spec:
    """Maximum up to and including the row."""
    return Spec("max", expr)


def max_before(expr: Column) -> Spec:
    """Maximum strictly before the row."""
    return Spec("max_before", expr)


def _over(spec: Spec, part, order: list[Column]) -> Column:
    by = part.orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    e = spec.expr
    return {
        "rownum": lambda: F.row_number().over(by),
        "lag": lambda: F.lag(e).over(by),
        "lead": lambda: F.lead(e).over(by),
        "last_before": lambda: F.last(e, ignorenulls=True).over(before),
        "last_upto": lambda: F.last(e, ignorenulls=True).over(upto),
        "sum": lambda: F.sum(e).over(upto),
        "max": lambda: F.max(e).over(upto),
        "max_before": lambda: F.max(e).over(before),
    }[spec.kind]()


def with_ordered(
    df: DataFrame, keys: list[str], order: list[str], specs: dict[str, Spec], hot: Hot | None = None
) -> DataFrame:
    """Add one column per spec over groups ``keys`` in ascending ``order``.

    ``hot`` lists large values of ``keys[0]``. ``order`` must be a total order inside a group for a defined result.
    """
    part = Window.partitionBy(*keys)
    cols = [F.col(c) for c in order]
    plain = {name: _over(spec, part, cols) for name, spec in specs.items()}
    if hot is None:
        return df.withColumns(plain)
    cold = hot.cold_rows(df, keys[0]).withColumns(plain)
    types = dict(cold.dtypes)
    warm = _segmented(hot.hot_rows(df, keys[0]), keys, order, specs, hot)
    warm = warm.select(*[F.col(c).cast(types[c]).alias(c) if c in specs else F.col(c) for c in cold.columns])
    return cold.unionByName(warm)


def _segmented(df: DataFrame, keys: list[str], order: list[str], specs: dict[str, Spec], hot: Hot) -> DataFrame:
    named = [F.col(c) for c in keys + order]
    # The tie column keeps equal order keys splittable; such rows are interchangeable.
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(hot.segments, *named, F.col("_tie"))
    rows = checkpointed(rows.withColumn(SEG, F.spark_partition_id()))
    order = order + ["_tie"]
    at = F.struct(*[F.col(c) for c in order])

    ends: dict[str, Column] = {"_n": F.count("*")}
    for name, spec in specs.items():
        e = spec.expr
        if spec.kind == "lag":
            ends[f"_e_{name}"] = F.max_by(F.struct(e.alias("v")), at)
        elif spec.kind == "lead":
            ends[f"_e_{name}"] = F.min_by(F.struct(e.alias("v")), at)
        elif spec.kind in ("last_before", "last_upto"):
            ends[f"_e_{name}"] = F.max_by(e, F.when(e.isNotNull(), at))
        elif spec.kind == "sum":
            ends[f"_e_{name}"] = F.sum(e)
        elif spec.kind in ("max", "max_before"):
            ends[f"_e_{name}"] = F.max(e)
    stretch = rows.groupBy(*keys, SEG).agg(*[c.alias(n) for n, c in ends.items()])

    by = Window.partitionBy(*keys).orderBy(SEG)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    carry: dict[str, Column] = {"_spans": F.count("*").over(Window.partitionBy(*keys))}
    for name, spec in specs.items():
        end = F.col(f"_e_{name}")
        carry[f"_c_{name}"] = {
            "rownum": lambda: F.sum("_n").over(before),
            "lag": lambda end=end: F.lag(end).over(by),
            "lead": lambda end=end: F.lead(end).over(by),
            "last_before": lambda end=end: F.last(end, ignorenulls=True).over(before),
            "last_upto": lambda end=end: F.last(end, ignorenulls=True).over(before),
            "sum": lambda end=end: F.sum(end).over(before),
            "max": lambda end=end: F.max(end).over(before),
            "max_before": lambda end=end: F.max(end).over(before),
        }[spec.kind]()
    # Only groups that cross a stretch boundary need a carry: at most two per stretch.
    carries = stretch.withColumns(carry).filter("_spans > 1")
    carries = carries.select(*keys, SEG, *[f"_c_{n}" for n in specs])
    if 2 * hot.segments <= BROADCAST_ROWS:
        carries = F.broadcast(carries)

    local = Window.partitionBy(*keys, SEG)
    cols = [F.col(c) for c in order]
    edge = {"_first": F.row_number().over(local.orderBy(*cols)) == 1}
    if any(s.kind == "lead" for s in specs.values()):
        edge["_last"] = F.lead(F.lit(1)).over(local.orderBy(*cols)).isNull()
    out = rows.withColumns(edge | {f"_l_{n}": _over(s, local, cols) for n, s in specs.items()})
    out = out.join(carries, keys + [SEG], "left")
    result: dict[str, Column] = {}
    for name, spec in specs.items():
        here, there = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if spec.kind in ("rownum", "sum"):
            result[name] = here + F.coalesce(there, F.lit(0))
        elif spec.kind == "lag":
            result[name] = F.when(F.col("_first"), there["v"]).otherwise(here)
        elif spec.kind == "lead":
            result[name] = F.when(F.col("_last"), there["v"]).otherwise(here)
        elif spec.kind in ("max", "max_before"):
            result[name] = F.greatest(here, there)
        else:
            result[name] = F.coalesce(here, there)
    return out.withColumns(result)


def with_group(
    df: DataFrame, keys: list[str], aggs: dict[str, Column], hot: Hot | None = None
) -> DataFrame:
    """Add whole-group aggregates. Keys must not be null; ``hot`` lists large values of ``keys[0]``.

    Hot groups are pre-aggregated map-side and joined back, where AQE may split the skewed row side.
    """
    part = Window.partitionBy(*keys)
    plain = {name: agg.over(part) for name, agg in aggs.items()}
    if hot is None:
        return df.withColumns(plain)
    cold = hot.cold_rows(df, keys[0]).withColumns(plain)
    rows = hot.hot_rows(df, keys[0])
    totals = rows.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggs.items()])
    return cold.unionByName(rows.join(totals, keys))
