"""Findings as rows: union, order, numbering, runs, groups and suppression."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def united(*lists: DataFrame) -> DataFrame:
    """Lists of findings one after the other; part tells which list a row is of."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows.withColumn("part", F.lit(k)) for k, rows in enumerate(lists)])


def ranked_by(value: Column, order: Sequence[str]) -> Column:
    """The place of a value in a fixed order, from 1; unknown ones come last."""
    place = F.array_position(F.lit(list(order)), value)
    return F.when(F.coalesce(place, F.lit(0)) == 0, len(order) + 1).otherwise(place).cast("int")


def shown(findings: DataFrame, check: str | None = None, hidden: Sequence[str] = ("META",), severity: str | None = None, text: str | None = None) -> DataFrame:
    """What a reader sees: hidden checks dropped, and the filters for a check, a severity and a part of the message."""
    rows = findings.where(~F.col("validator").isin(*hidden))
    if check:
        rows = rows.where(F.col("validator") == check)
    if severity:
        rows = rows.where(F.col("severity") == severity)
    if text:
        rows = rows.where(F.contains(F.lower("message"), F.lit(text.lower())))
    return rows


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], counts: Column, name: str = "number") -> DataFrame:
    """rows with a number from 1 for those that count, in order; null for the others."""
    so_far = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.when(counts, F.sum(F.when(counts, 1).otherwise(0)).over(so_far)).cast("long"))


def runs(rows: DataFrame, group: Sequence[str], order: str, same: Sequence[str]) -> DataFrame:
    """Consecutive rows that are the same in some columns: group, run (from 1), those columns, first, last and n."""
    along = Window.partitionBy(*group).orderBy(order)
    changed = reduce(Column.__or__, [~F.col(c).eqNullSafe(F.lag(c).over(along)) for c in same]) | F.lag(F.lit(1)).over(along).isNull()
    marked = rows.withColumn("run_start", changed.cast("int")).withColumn("run", F.sum("run_start").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*group, "run", *same).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def grouped(findings: DataFrame, outer: str, inner: str, item: str) -> DataFrame:
    """Two levels: outer, and of each inner its items in order."""
    one = findings.groupBy(outer, inner).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return one.groupBy(outer).agg(F.sort_array(F.collect_list(F.struct(inner, "items"))).alias("groups"))


def suppressed(rows: DataFrame, covered: DataFrame, place: Sequence[str]) -> DataFrame:
    """rows but for those at a place that a finding of more weight covers."""
    return rows.join(covered.select(*place).distinct(), list(place), "left_anti")


def code_counts(findings: DataFrame, owner: str) -> DataFrame:
    return findings.where("severity = 'ERROR'").groupBy(owner, "code").agg(F.count(F.lit(1)).alias("n"))
