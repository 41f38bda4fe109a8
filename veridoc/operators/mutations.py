"""Changes of tables as new tables: upserts, insert-ignore, rewrites, transitions, guards and access decisions.

Nothing is changed in place: each function returns the table as it is after the change, to be written as a whole or by
partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(key: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"o.{c}") == F.col(f"n.{c}") for c in key])


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str], business: Sequence[str]) -> DataFrame:
    """old after new rows came in: business columns of a known key are overwritten, all its others stay.

    verdict: created, updated, kept. A column that new doesn't have is null in created rows. new has one row for a key.
    """
    known, fresh = F.col("o.known").isNotNull(), F.col("n.fresh").isNotNull()
    joined = old.withColumn("known", F.lit(True)).alias("o").join(new.withColumn("fresh", F.lit(True)).alias("n"), _same(key), "full_outer")
    columns = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) if c in key else F.when(fresh & F.lit(c in business) | ~known, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns]
    return joined.select(*columns, F.when(known & fresh, "updated").when(known, "kept").otherwise("created").alias("verdict"))


def accepted(rows: DataFrame, problems: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a problem, and those with one and what it is: a bad row spoils no other."""
    judged = rows.withColumn("problem", problems)
    return judged.where("problem is null").drop("problem"), judged.where("problem is not null")


def insert_ignored(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """old and the new rows whose key it hasn't; of new rows with one key the first by all columns."""
    one = new.withColumn("new_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*new.columns))).where("new_rank = 1").drop("new_rank")
    return old.unionByName(one.join(old.select(*key), list(key), "left_anti"))


def rewritten(old: DataFrame, new: DataFrame, partition: str, touched: DataFrame) -> DataFrame:
    """old with the rows of touched partitions replaced by new's: what new doesn't have any more is gone."""
    return old.join(touched.select(partition).distinct(), partition, "left_anti").unionByName(new)


def write_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Overwrites only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def after_remarks(claims: DataFrame, remarks: DataFrame, terminal: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """claims (key, status) after a log of remarks (key, status_after or null, ...): no change goes past a terminal status.

    The status is that of the first terminal one in order, else of the last that is set.
    """
    known = remarks.where("status_after is not null").join(terminal.select(F.col("status").alias("status_after"), F.lit(True).alias("ends")).distinct(), "status_after", "left")
    at = F.struct(*order, "status_after")
    last = known.groupBy(key).agg(F.min(F.when(F.col("ends"), at)).alias("end"), F.max(at).alias("last"))
    ended = terminal.select("status", F.lit(True).alias("ended")).distinct()
    out = claims.join(last, key, "left").join(ended, "status", "left")
    moved = F.coalesce(F.col("end.status_after"), F.col("last.status_after"), F.col("status"))
    return out.select(*[F.when(F.col("ended").isNull(), moved).otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in claims.columns])


def advanced(status: Column, default: str, any_failed: Column, failed_to: str, passed_to: str) -> Column:
    """A claim at the default status moves on after its checks; any other status stays."""
    return F.when(status == default, F.when(any_failed, failed_to).otherwise(passed_to)).otherwise(status)


def soft_deleted(status: Column, chosen: Column) -> Column:
    return F.when(chosen, "DELETED").otherwise(status)


def restored(status: Column, chosen: Column) -> Column:
    return F.when(chosen & (status == "DELETED"), "ACTIVE").otherwise(status)


def bulk_report(targets: DataFrame, problem: Column, id_: str, most: int = 500) -> DataFrame:
    """One row for a bulk change: requested, succeeded, failed, and of the failures id and problem; more than `most` targets are refused whole."""
    judged = targets.withColumn("problem", problem)
    failures = F.sort_array(F.collect_list(F.when(F.col("problem").isNotNull(), F.struct(F.col(id_).alias("id"), "problem"))))
    one = judged.agg(F.count(F.lit(1)).alias("requested"), F.count_if(F.col("problem").isNull()).alias("ok"), failures.alias("failures"))
    refused = F.col("requested") > most
    return one.select("requested", F.when(refused, 0).otherwise(F.col("ok")).alias("succeeded"), F.when(refused, F.col("requested")).otherwise(F.col("requested") - F.col("ok")).alias("failed"), F.when(~refused, F.col("failures")).alias("failures"))


def defaults_right(statuses: DataFrame) -> DataFrame:
    """One row: how many statuses are the default, and whether exactly one is, and it is active."""
    on = F.col("is_default")
    return statuses.agg(F.count_if(on).alias("defaults"), ((F.count_if(on) == 1) & (F.count_if(on & (F.col("status") != "ACTIVE")) == 0)).alias("right"))


def may_go(statuses: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Of each status why it can't be deleted: it is the default, or it is in use; null where it can."""
    counts = used.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("uses"))
    return statuses.join(counts, key, "left").select(key, F.when(F.col("is_default"), "DEFAULT").when(F.coalesce("uses", F.lit(0)) > 0, "IN_USE").alias("refusal"))


def glossary(old: DataFrame, lines: DataFrame) -> DataFrame:
    """old terms (term, expansion, status) after lines (term, expansion) came in: new ones are added, dormant ones wake up.

    A line's expansion replaces the old one where it has one. Of lines with one term the one with the greatest expansion holds.
    """
    new = lines.groupBy("term").agg(F.max("expansion").alias("expansion"))
    joined = old.alias("o").join(new.withColumn("fresh", F.lit(True)).alias("n"), "term", "full_outer")
    verdict = F.when(F.col("o.status").isNull(), "created").when(F.col("fresh").isNull(), "kept").when(F.col("o.status") != "ACTIVE", "reactivated").otherwise("updated")
    return joined.select("term", F.coalesce("n.expansion", "o.expansion").alias("expansion"), F.when(F.col("fresh"), "ACTIVE").otherwise(F.col("o.status")).alias("status"), verdict.alias("verdict"))


def vocabulary_gaps(shipped: DataFrame, stored: DataFrame) -> DataFrame:
    """Shipped terms that are missing in the stored ones, or dormant there: term, state."""
    return shipped.select("term").distinct().join(stored, "term", "left").where("status is null or status <> 'ACTIVE'").select("term", F.when(F.col("status").isNull(), "missing").otherwise("dormant").alias("state"))


def lockout_seconds(failures: Column, longest: int = 900, locks_at: int = 5) -> Column:
    """Waiting time after so many failures: doubling from one second, and the longest from locks_at on."""
    return F.when(failures <= 0, 0).when(failures >= locks_at, longest).otherwise(F.least(F.lit(longest), F.pow(F.lit(2), failures - 1))).cast("long")


def access_code(checks: Sequence[tuple[str, Column]]) -> Column:
    """The code of the first check that doesn't hold, in order; OK where all do. A null check doesn't hold."""
    out = None
    for code, holds in checks:
        fails = ~F.coalesce(holds, F.lit(False))
        out = F.when(fails, code) if out is None else out.when(fails, code)
    return out.otherwise("OK")
