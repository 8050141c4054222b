"""Scans over groups of any size: no group is sorted in one task.

The rows of a group are dealt in cells by the first column of the order. What a scan says of a cell as a whole (its rows, its
largest value) is added up, the cells of a group are scanned, a row each, and rows are then corrected inside their cell. Cells
are cut where the rows are: one with more than CELL_ROWS rows is cut again, so an outlier or a crowded hour makes no large task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells at first over all values, times that a crowded cell is cut (as a power of 2), and rows above which it is.
CELLS, CUT, CELL_ROWS = 65_536, 8, 1_000_000


def place(rows: DataFrame, column: str) -> Column:
    """A long that rises with the column: integers and times as they are, other numbers by 2**52 steps between their ends."""
    kind, value = rows.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp"))
    if isinstance(kind, (T.DateType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.unix_date(value).cast("long") if isinstance(kind, T.DateType) else value.cast("long")
    number = value.cast("double")
    low, high = rows.where(~F.isnan(number) & (F.abs(number) < float("inf"))).agg(F.min(number), F.max(number)).first()
    width = (high - low) if low is not None and high > low else 1.0
    step = F.floor((number - F.lit(low or 0.0)) / F.lit(width) * F.lit(float(1 << 52)))
    return F.when(F.isnan(number) | (number == float("inf")), 1 << 53).when(number == float("-inf"), -1).otherwise(step)


def celled(rows: DataFrame, order: str, group: list[str], cells: int = CELLS, most: int = CELL_ROWS) -> DataFrame:
    """Adds __cell, by which the rows of a group are dealt in the order's ranges: a long that rises with the column, null for a
    null. A cell has `most` rows at most, unless more share one value. If no group has so many, nothing is added."""
    keys = [F.col(g) for g in group]
    if rows.groupBy(*keys).count().where(F.col("count") > most).isEmpty():
        return rows
    value = place(rows, order)
    low, high = rows.agg(F.min(value), F.max(value)).first()
    shift = 0
    while low is not None and (high >> shift) - (low >> shift) >= cells:
        shift += 1
    cut = lambda s: F.shiftleft(F.shiftright(F.col("__place"), s), s)
    out = rows.withColumn("__place", value.cast("long")).withColumn("__cell", cut(shift))
    while shift:
        crowded = out.groupBy(*keys, "__cell").count().where((F.col("count") > most) & F.col("__cell").isNotNull())
        crowded = crowded.select(F.struct(*keys).alias("__group"), F.col("__cell").alias("__of"))
        if crowded.isEmpty():
            break
        shift = max(0, shift - CUT)
        met = out.join(crowded, F.struct(*keys).eqNullSafe(F.col("__group")) & (F.col("__cell") == F.col("__of")), "left")
        out = met.withColumn("__cell", F.when(F.col("__of").isNotNull(), cut(shift)).otherwise(F.col("__cell"))).drop("__group", "__of")
    return out.drop("__place")


def carried(placed: DataFrame, group: list[str], what: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds to rows with __cell the columns named in `what`, pairs of (what a cell adds up to, an aggregate; what a scan of the
    cells before makes of them, given that column), null in a group's first cell and where groups are not cut in cells."""
    if "__cell" not in placed.columns:
        return placed.withColumns({"__cell": F.lit(0).cast("long"), **{name: F.lit(None) for name in what}})
    keys = [F.col(g) for g in group]
    sums = placed.groupBy(*keys, "__cell").agg(*[total.alias(f"__sum_{name}") for name, (total, _) in what.items()])
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    scans = [scan(F.col(f"__sum_{name}")).over(before).alias(name) for name, (_, scan) in what.items()]
    offsets = sums.select(F.struct(*keys).alias("__group"), F.col("__cell").alias("__of"), *scans)
    same = F.struct(*keys).eqNullSafe(F.col("__group")) & F.col("__cell").eqNullSafe(F.col("__of"))
    return placed.join(offsets, same).drop("__group", "__of")


def inside(group: list[str], order: list[str]):
    """The window of a row's cell, by the order."""
    return Window.partitionBy(*group, "__cell").orderBy(*order)


def numbered(rows: DataFrame, order: list[str], group: list[str], name: str, cells: int = CELLS, most: int = CELL_ROWS) -> DataFrame:
    """Adds the row's number, from 1, in its group by the order (columns; the first a number or a time, nulls first)."""
    placed = carried(celled(rows, order[0], group, cells, most), group, {"__before": (F.count("*"), F.sum)})
    own = F.row_number().over(inside(group, order))
    return placed.withColumn(name, own + F.coalesce("__before", F.lit(0))).drop("__cell", "__before")


def running_max(rows: DataFrame, value: Column, order: list[str], group: list[str], name: str, before: bool = False, **how) -> DataFrame:
    """Adds the largest value so far of the row's group by the order; before: without the row's own."""
    valued = rows.withColumn("__value", value)
    placed = carried(celled(valued, order[0], group, **how), group, {"__before": (F.max("__value"), F.max)})
    frame = inside(group, order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return placed.withColumn(name, F.greatest(F.max("__value").over(frame), "__before")).drop("__cell", "__before", "__value")


def running_sum(rows: DataFrame, value: Column, order: list[str], group: list[str], name: str, **how) -> DataFrame:
    """Adds the sum of the values up to the row of its group by the order, nulls as 0."""
    valued = rows.withColumn("__value", F.coalesce(value, F.lit(0)))
    placed = carried(celled(valued, order[0], group, **how), group, {"__before": (F.sum("__value"), F.sum)})
    own = F.sum("__value").over(inside(group, order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(name, own + F.coalesce("__before", F.lit(0))).drop("__cell", "__before", "__value")


def overlapping(rows: DataFrame, order: list[str], group: list[str], behind: int, ahead: int, size: int = 4096, **how) -> DataFrame:
    """Rows dealt in chunks of `size` (__chunk) by their number in the group (__number), each with the `behind` rows before it and
    the `ahead` rows after it as copies (__copy), so that a window of so many rows stays in a chunk. Drop the copies after."""
    n = F.col("__number") - 1
    own, within = F.floor(n / size), n % size
    to = F.array(F.struct(own.alias("chunk"), F.lit(False).alias("copy")))
    to = F.when(within >= size - behind, F.concat(to, F.array(F.struct((own + 1).alias("chunk"), F.lit(True).alias("copy"))))).otherwise(to)
    to = F.when((within < ahead) & (own > 0), F.concat(to, F.array(F.struct((own - 1).alias("chunk"), F.lit(True).alias("copy"))))).otherwise(to)
    if size < max(behind, ahead):
        raise ValueError("a chunk must be as large as the rows that it looks back and ahead to")
    out = numbered(rows, order, group, "__number", **how).withColumn("__to", F.explode(to))
    return out.withColumns({"__chunk": F.col("__to.chunk"), "__copy": F.col("__to.copy")}).drop("__to")
