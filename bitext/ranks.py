"""Places in one order over a whole table, without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext.storage import materialize


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` and ``name``: the place (from 0) of each row in the order of ``order``.

    Rows are dealt by ranges of the order and written, so that a range keeps its number; each
    range is ranked by itself and starts where the counts of the ranges before it end. That
    small table has one row a range. Rows that tie in the whole order have places next to each
    other and one range; the order should be nearly unique.
    """
    part, start = f"{name}_part", f"{name}_start"
    dealt = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranked")
    before = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    ranked = dealt.withColumn(name, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    # one row a range: at most the number of shuffle partitions
    return ranked.join(F.broadcast(starts), part).withColumn(name, (F.col(name) + F.col(start)).cast("long")).drop(part, start)


class Ordered:
    """Rows of groups in order, for groups of any size: no task needs a whole one.

    Rows are dealt by ranges of (group, order) and written; windows run inside a range, and what
    crosses a border is carried over by a table of one row a range: the last row of the range
    before, and, for the group that a border cuts, the sum of its earlier ranges. Groups and
    orders may be null; rows that tie in both have no defined order among themselves.
    """

    def __init__(self, df: DataFrame, group: list[str], order: list[str], part: str = "range_no", dealt: bool = False):
        self.group, self.order, self.part = group, order, part
        ranges = df.repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id())
        self.rows = df if dealt else materialize(ranges, "ordered")

    def _with(self, rows: DataFrame) -> Ordered:
        return Ordered(rows, self.group, self.order, self.part, dealt=True)

    def with_column(self, name: str, value: Column) -> Ordered:
        return self._with(self.rows.withColumn(name, value))

    def result(self) -> DataFrame:
        return self.rows.drop(self.part)

    def previous(self, value: Column, name: str) -> Ordered:
        """Adds ``name``: ``value`` of the row before in the same group, null in its first row."""
        told = F.struct(F.struct(*self.group).alias("g"), value.alias("v"))
        last = self.rows.groupBy(self.part).agg(F.max_by(told, F.struct(*self.group, *self.order)).alias("last"))
        carried = last.select(self.part, F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy(self.part)).alias("carried"))
        inside = F.lag(told).over(Window.partitionBy(self.part).orderBy(*self.group, *self.order))
        # one row a range: at most the number of shuffle partitions
        rows = self.rows.withColumn(name, inside).join(F.broadcast(carried), self.part).withColumn(name, F.coalesce(name, "carried")).drop("carried")
        same = F.col(name)["g"].eqNullSafe(F.struct(*self.group))
        return self._with(rows.withColumn(name, F.when(same, F.col(name)["v"])))

    def running(self, value: Column, name: str) -> Ordered:
        """Adds ``name``: the sum of ``value`` up to this row in its group."""
        totals = self.rows.groupBy(self.part, *self.group).agg(F.sum(value).alias("total"))
        before = Window.partitionBy(*self.group).orderBy(self.part).rowsBetween(Window.unboundedPreceding, -1)
        earlier = totals.select(F.col(self.part).alias("of_part"), *(F.col(g).alias(f"of_{g}") for g in self.group), F.sum("total").over(before).alias("earlier")).where("earlier IS NOT NULL")
        inside = Window.partitionBy(self.part, *self.group).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        match = F.col(self.part) == F.col("of_part")
        for g in self.group:
            match = match & F.col(g).eqNullSafe(F.col(f"of_{g}"))
        # a border cuts one group: one row a range at most
        rows = self.rows.withColumn(name, F.sum(value).over(inside)).join(F.broadcast(earlier), match, "left")
        return self._with(rows.withColumn(name, F.col(name) + F.coalesce("earlier", F.lit(0))).drop("of_part", *(f"of_{g}" for g in self.group), "earlier"))

    def number(self, name: str) -> Ordered:
        """Adds ``name``: the place in the group, from 0."""
        rows = self.running(F.lit(1), name)
        return rows.with_column(name, F.col(name) - 1)
