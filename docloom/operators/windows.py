"""Patterns over ordered rows of a group. Windows are always partitioned; callers reuse one spec per operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .storage import stored


def ordered(partition: list, order: list) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*order)


def before(w: WindowSpec) -> WindowSpec:
    """All rows before the current one."""
    return w.rowsBetween(Window.unboundedPreceding, -1)


def upto(w: WindowSpec) -> WindowSpec:
    """All rows up to and with the current one."""
    return w.rowsBetween(Window.unboundedPreceding, 0)


def running(flag: Column, w: WindowSpec) -> Column:
    """How often flag held up to and with the current row."""
    return F.sum(F.when(flag, 1).otherwise(0)).over(upto(w))


def islands(df: DataFrame, partition: list[str], order: str, name: str = "island") -> DataFrame:
    """Numbers runs of consecutive `order` values in each group: within a run, order minus the row number is constant.

    The number is the first order value of the run, so that it needs no second window.
    """
    w = ordered([*partition], [order])
    return df.withColumn(name, F.col(order) - F.row_number().over(w))


def runs(changed: Column, w: WindowSpec) -> Column:
    """The number of the current run, from 1, where changed marks the first row of each."""
    return running(changed, w)


def forward_fill(value: Column, w: WindowSpec) -> Column:
    """The last value that is not null, up to and with the current row."""
    return F.last(value, ignorenulls=True).over(upto(w))


def previous_smaller(level: Column, order: Column, w: WindowSpec, levels: int = 9) -> Column:
    """The last earlier row with a smaller level: the parent in a hierarchy that is listed in order.

    Same as popping a stack of headers while its top is not smaller. One conditional running maximum per level.
    """
    last = [F.max(F.when(level == k, order)).over(before(w)) for k in range(1, levels)]
    return F.greatest(F.lit(None).cast("long"), *(F.when(level > k, x) for k, x in enumerate(last, 1)))


def prior(value: Column, w: WindowSpec, n: int) -> Column:
    """The values of the last n rows before the current one, oldest first."""
    return F.collect_list(value).over(w.rowsBetween(-n, -1))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place from 1 in an order of all rows, without one task that sees them all.

    Rows are dealt by ranges of the order (equal ones by where they lie in the input), sorted and numbered in each range, and
    moved on by the counts of the ranges before, of which the driver sees one number each.
    """
    placed = stored(rows.withColumn("__lies", F.monotonically_increasing_id()))
    by = [*order, F.col("__lies")]
    dealt = stored(placed.repartitionByRange(*by).sortWithinPartitions(*by).drop("__lies").withColumn("__at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = sorted(map(tuple, dealt.groupBy(part.alias("part")).count().collect()))
    starts = [(p, sum(n for _, n in counts[:i])) for i, (p, _) in enumerate(counts)]
    before = rows.sparkSession.createDataFrame(starts, "__part long, __before long")
    out = dealt.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.withColumn(name, F.col("__before") + inside + 1).select(*rows.columns, name)
