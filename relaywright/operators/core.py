"""Operators on DataFrames that Spark has no single call for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in `order`. Merge-on-read, DISTINCT ON and guarded upserts are this."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def matching(df: DataFrame, **equals) -> DataFrame:
    """The conjunction of the filters that are given; None is no filter, False is one, an empty list matches nothing."""
    for name, value in equals.items():
        if value is None:
            continue
        if isinstance(value, (list, tuple, set)):
            df = df.filter(F.col(name).isin(list(value))) if value else df.filter(F.lit(False))
        else:
            df = df.filter(F.col(name) == value)
    return df


def between(df: DataFrame, column: str, low=None, high=None, closed: bool = False) -> DataFrame:
    """low <= column < high, or <= high if closed; a bound that is None isn't one."""
    if low is not None:
        df = df.filter(F.col(column) >= F.lit(low))
    if high is not None:
        df = df.filter(F.col(column) <= F.lit(high) if closed else F.col(column) < F.lit(high))
    return df


def clamp(limit: int, most: int = 200, default: int = 50) -> int:
    """Page sizes out of bounds fall back to the default, not to the bound."""
    return limit if 0 < limit <= most else default


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page; `order` must end in a unique column."""
    return df.orderBy(*order).offset(offset).limit(clamp(limit))


def page_with_more(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """A first page, and whether there are rows after it: one row more is asked for than is shown."""
    rows = df.orderBy(*order).limit(limit + 1)
    numbered = rows.select("*", F.row_number().over(Window.orderBy(*order)).alias("_k"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("_n"))
    return numbered.filter(F.col("_k") <= limit).withColumn("has_more", F.col("_n") > limit).drop("_k", "_n")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], bucket: str = "day") -> DataFrame:
    """`left` with the `values` of the latest `right` row of the same keys that isn't later; ties in time go to the largest values.

    Keys are split by time bucket: inside a bucket one window over both sides finds the latest row, and
    the last row of the buckets before comes from a table with one row for each key and bucket. A hot
    key's rows are spread over its buckets, and nothing is joined on a range.
    """
    row = F.struct(*values)
    both = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("_right"))
    both = both.unionByName(right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_left"].dataType).alias("_left"), row.alias("_right")))
    both = both.withColumn("_bucket", F.date_trunc(bucket, "_t").cast("timestamp_ntz"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_right", ignorenulls=True).over(inside)).filter("_side = 1")
    lasts = both.groupBy(*keys, "_bucket").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_right"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(before)["_right"].alias("_carried"))
    joined = found.join(carried, [*keys, "_bucket"], "left").withColumn("_value", F.coalesce("_found", "_carried"))
    return joined.select("_left.*", *(F.col("_value")[v].alias(v) for v in values))


#: Cells are 2**level numbers wide.
LEVELS = tuple(range(6, 63, 6))


def range_lookup(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, priority: str, value: str, levels: Sequence[int] = LEVELS) -> DataFrame:
    """`points` with the `value` of the range that holds `point` (both ends in) and has the smallest `priority`, or null.

    Ranges are cut into aligned cells of the smallest level at which it takes 64 or fewer, so none gives more than 65 rows; a
    point looks up its cell of each level that ranges have by equality. Distinct points are looked up once, and their
    finds go back to all rows with that point, so rows that repeat in any column stay what they are. Ranges that end
    before they start hold nothing.
    """
    size = F.col(end) - F.col(start) + 1
    level = F.lit(levels[-1])
    for x in reversed(levels[:-1]):
        level = F.when(size <= F.lit((1 << x) * 64), F.lit(x)).otherwise(level)
    cells = ranges.filter(F.col(end) >= F.col(start)).withColumn("_level", level)
    used = sorted(r[0] for r in cells.select("_level").distinct().collect())  # as many rows as there are levels, at most
    cell = lambda column: F.expr(f"shiftright({column}, _level)")
    cells = cells.withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    distinct = points.select(F.col(point).alias("_x")).filter("_x IS NOT NULL").distinct()
    spread = distinct.withColumn("_level", F.explode(F.array(*map(F.lit, used)).cast("array<int>"))).withColumn("_cell", cell("_x"))
    hit = spread.join(cells.select("_level", "_cell", F.col(start).alias("_start"), F.col(end).alias("_end"), F.col(priority).alias("_priority"), F.col(value).alias("_value")), ["_level", "_cell"])
    best = hit.filter(F.col("_x").between(F.col("_start"), F.col("_end"))).groupBy("_x").agg(F.min_by("_value", "_priority").alias(value))
    return points.join(best, points[point] == best["_x"], "left").drop("_x")


def islands(df: DataFrame, keys: Sequence[str], order: str, flag: str) -> DataFrame:
    """`df` with `island`, a number for each run of equal `flag` along `order`."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag(flag).over(w) == F.col(flag), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn("island", F.sum("_change").over(w)).drop("_change")
