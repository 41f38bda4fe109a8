"""Relational building blocks of claim lists: filters, scope, joins, paging, latest rows, rules and sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

# ---- filters -----------------------------------------------------------------------------------------------------


def claim_filter(equal: Mapping[str, object], containing: Mapping[str, str] | None = None) -> Column:
    """All of the filters that are set: equality per column, and case-insensitive substrings. None means no filter."""
    parts = [F.col(c) == v for c, v in equal.items() if v is not None]
    parts += [contains_any([c], v) for c, v in (containing or {}).items() if v]
    return reduce(Column.__and__, parts, F.lit(True))


def lifecycle(status: Column, requested: str | None = None, everything: bool = False) -> Column:
    """Rows of the requested status where all may be asked for, else the active ones."""
    return status == ((requested if everything else None) or "ACTIVE")


def within_days(at: Column, first: str | None, last: str | None) -> Column:
    """first <= at <= last; a last without a time of day means that whole day."""
    kept = F.lit(True)
    if first:
        kept = kept & (at >= F.to_timestamp(F.lit(first)))
    if last:
        end = F.to_timestamp(F.lit(last))
        kept = kept & (at < end + F.expr("INTERVAL 1 DAY") if len(last) == 10 else at <= end)
    return kept


def json_has(column: Column, value: str) -> Column:
    """Whether a JSON array of strings has a value; anything else has none."""
    return F.coalesce(F.array_contains(F.from_json(column, "array<string>"), value), F.lit(False))


def any_present(columns: Sequence[str]) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()


def not_in(column: Column, values: Sequence[object]) -> Column:
    """Null is in no list and not outside of one either, as in SQL."""
    return ~column.isin(*values)


def contains_any(columns: Sequence[str], text: str) -> Column:
    """Case-insensitive substring in any of the columns."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
    return found


def scoped(rows: DataFrame, grants: DataFrame, key: str) -> DataFrame:
    """Rows whose key is granted; outside the grants nothing."""
    return rows.join(grants.select(key).distinct(), key, "left_semi")


def with_some(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return rows.join(others.select(key), key, "left_semi")


def without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return rows.join(others.select(key), key, "left_anti")


def all_known(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct keys are wanted, and whether all of them are known."""
    asked = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    found = known.select(key, F.lit(True).alias("is_known")).distinct()
    return asked.join(found, key, "left").agg(F.count(F.lit(1)).alias("wanted"), (F.count_if(F.col("is_known").isNull()) == 0).alias("all_known"))


# ---- joins -------------------------------------------------------------------------------------------------------


def child_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """parents with the number of their children; none counts 0."""
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def nested(parents: DataFrame, children: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """parents that have children, with these as an ordered array of structs."""
    columns = [order, *[c for c in children.columns if c not in (key, order)]]
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    return parents.join(lists, key)


def pairs_nearby(rows: DataFrame, group: str, place: str, value: str, reach: int = 1) -> DataFrame:
    """(group, low, high): pairs of different values of one group that stand at most `reach` places apart.

    Each row goes to the places around its own, so that the join is by equality and a group is never paired out.
    """
    near = rows.select(group, F.col(value).alias("high"), F.explode(F.sequence(F.col(place) - reach, F.col(place) + reach)).alias(place))
    return rows.select(group, place, F.col(value).alias("low")).join(near, [group, place]).where("low < high").select(group, "low", "high").distinct()


def last_seen(value: Column, group: Sequence[str], order: Sequence[Column]) -> Column:
    """The last value that isn't null, of the rows before."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def back_sides(rows: DataFrame, group: Sequence[str], place: str, kind: str) -> DataFrame:
    """Rows without a kind directly after one with a kind: its back side, with the kind of the front."""
    before = Window.partitionBy(*group).orderBy(place)
    seen = rows.withColumn("front", F.lag(kind).over(before)).withColumn("front_place", F.lag(place).over(before))
    return seen.where(F.col(kind).isNull() & F.col("front").isNotNull() & (F.col("front_place") == F.col(place) - 1)).drop("front_place")


def survivors(rows: DataFrame, same: Sequence[str], id_: str) -> DataFrame:
    """Of each row its id and the least id among rows that are the same."""
    least = rows.groupBy(*same).agg(F.min(id_).alias("survivor"))
    condition = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same])
    return rows.alias("a").join(least.alias("b"), condition).select(f"a.{id_}", "b.survivor")


def missing_required(present: DataFrame, required: DataFrame, owner: str, kind: str) -> DataFrame:
    """Of each owner the required kinds it doesn't have; required is a master table. Null kinds are none."""
    wanted = required.where(F.col(kind).isNotNull()).agg(F.sort_array(F.collect_set(kind)).alias("wanted"))
    have = present.groupBy(owner).agg(F.collect_set(kind).alias("have"))
    return have.crossJoin(F.broadcast(wanted)).select(owner, F.explode(F.array_except("wanted", "have")).alias(kind))  # wanted is one row


# ---- order, paging, top -------------------------------------------------------------------------------------------


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order that must not tie."""
    ranked = rows.withColumn("latest_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where(F.col("latest_rank") <= n).drop("latest_rank")


def sort_order(key: str, descending: bool, allowed: Mapping[str, str], default: str, id_: str) -> list[Column]:
    """The columns of an asked-for order: an unknown key is the default, descending; the id breaks ties."""
    column, down = (allowed[key], descending) if key in allowed else (default, True)
    first = F.desc(column) if down else F.asc(column)
    return [first] if column == id_ else [first, F.desc(id_) if down else F.asc(id_)]


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of a total order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def keyset_page(rows: DataFrame, at: str, key: str, after: tuple | None, size: int, backwards: bool = False) -> DataFrame:
    """The next rows in the order (at descending, key descending) after a seen pair; backwards: those before it."""
    if after is not None:
        moment, seen = F.lit(after[0]).cast(rows.schema[at].dataType), F.lit(after[1])
        further = (F.col(at) > moment) | (F.col(at) == moment) & (F.col(key) > seen) if backwards else (F.col(at) < moment) | (F.col(at) == moment) & (F.col(key) < seen)
        rows = rows.where(further)
    return rows.orderBy(*([F.asc(at), F.asc(key)] if backwards else [F.desc(at), F.desc(key)])).limit(size)


def capped(rows: DataFrame, most: int) -> DataFrame:
    """rows if there are at most `most`, else none: a set that is too large is refused, not cut."""
    many = rows.limit(most + 1).agg(F.count(F.lit(1)).alias("capped_n"))
    return rows.limit(most + 1).crossJoin(F.broadcast(many)).where(F.col("capped_n") <= most).drop("capped_n")  # one row


def top_used(rows: DataFrame, key: str, k: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), key).limit(k)


def prefix_budget(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows of each key, in order, until what came before them has used up the budget."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(size).over(before), F.lit(0))
    return rows.withColumn("spent_before", spent).where(F.col("spent_before") < budget)


def kth_matches(left: DataFrame, right: DataFrame, group: Sequence[str], order_left: str, order_right: str) -> DataFrame:
    """The k-th row of a group on the left with the k-th on the right: occurrences used up in turn."""
    number = lambda rows, order: rows.withColumn("kth", F.row_number().over(Window.partitionBy(*group).orderBy(order)))
    return number(left, order_left).join(number(right, order_right), [*group, "kth"])


def serial_numbers(rows: DataFrame, order: Sequence[str], name: str = "s_no", chunks: int = 64) -> DataFrame:
    """Rows numbered from 1 in a total order: within ranges of it, and then by what the ranges before have.

    No window goes over the whole table; rows of one range are numbered together. The placed rows are stored, so that
    both their numbers and the ranges' sizes come of the same cut.
    """
    placed = stored(rows.repartitionByRange(chunks, *order).withColumn("serial_part", F.spark_partition_id()))
    within = placed.withColumn("serial_rank", F.row_number().over(Window.partitionBy("serial_part").orderBy(*order)))
    # a row per range
    sizes = placed.groupBy("serial_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("serial_part", F.coalesce(F.sum("n").over(Window.orderBy("serial_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("serial_before"))
    return within.join(F.broadcast(before), "serial_part").withColumn(name, (F.col("serial_before") + F.col("serial_rank")).cast("long")).drop("serial_part", "serial_rank", "serial_before")


# ---- aggregates --------------------------------------------------------------------------------------------------


def owned_values(rows: DataFrame, group: Sequence[str], owner: str, most: int) -> DataFrame:
    """Of each value (group columns) its distinct owners: owners, the first `most` ascending, and n_owners.

    In two phases, so that a value of very many owners is no task's load: each task counts its owners and keeps its
    first `most` of each value (a bound on a row number goes before the shuffle), and only these meet.
    """
    distinct = rows.select(*group, owner).where(F.col(owner).isNotNull()).distinct()
    counted = distinct.groupBy(*group).agg(F.count(F.lit(1)).alias("n_owners"))
    ranked = distinct.withColumn("owner_rank", F.row_number().over(Window.partitionBy(*group).orderBy(owner))).where(F.col("owner_rank") <= most)
    listed = ranked.groupBy(*group).agg(F.sort_array(F.collect_list(owner)).alias("owners"))
    # a null is a value too
    same = [F.col(f"c.{g}").eqNullSafe(F.col(f"l.{g}")) for g in group]
    return counted.alias("c").join(listed.alias("l"), same).select(*[F.col(f"c.{g}") for g in group], "n_owners", "owners")


def shared_values(rows: DataFrame, group: Sequence[str], owner: str, most: int = 20) -> DataFrame:
    """Values that several owners share: group columns, owners (the first `most`, ascending) and n_owners.

    Grouped instead of joined with itself, so a value of many owners makes one row.
    """
    return owned_values(rows, group, owner, most).where("n_owners > 1").select(*group, "owners", "n_owners")


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], weight: str, share: int = 1000) -> DataFrame:
    """Inner join with a table that has one row for each key and says in weight how many rows of left have it.

    Keys with more than one in `share` of all these rows, which are fewer than `share` keys, are broadcast; the rows that
    they find are then spread by all their columns, so that no key of the shuffled part is larger than that.
    """
    rest = [c for c in right.columns if c not in on]
    total = right.agg(F.sum(weight).alias("_total"))
    marked = right.crossJoin(F.broadcast(total))  # one row
    large = F.col(weight) * share > F.col("_total")
    hot = marked.where(large).select(*on, F.struct(*rest).alias("_hot"))
    met = left.join(F.broadcast(hot), list(on), "left").withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.xxhash64(*left.columns)))
    cold = marked.where(~large).select(*on, F.struct(*rest).alias("_cold"), F.lit(0).cast("long").alias("_salt"))
    out = met.join(cold, [*on, "_salt"], "left").withColumn("_met", F.coalesce("_hot", "_cold")).where(F.col("_met").isNotNull())
    return out.select(*[out[c] for c in left.columns], *[F.col(f"_met.{c}").alias(c) for c in rest])


def first_of(rows: DataFrame, key: Sequence[str], order: Sequence[str], again: str) -> DataFrame:
    """The first row of each key, with the distinct values of `again` of its other rows, ascending."""
    ranked = rows.withColumn("first_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    rest = ranked.where("first_rank > 1").groupBy(*key).agg(F.sort_array(F.collect_set(again)).alias(f"other_{again}"))
    return ranked.where("first_rank = 1").drop("first_rank").join(rest, list(key), "left")


def union_box(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    """Aggregates: the least box around boxes given by a corner and sizes."""
    left, top = F.min(x), F.min(y)
    return [left.alias("x"), top.alias("y"), (F.max(x + w) - left).alias("w"), (F.max(y + h) - top).alias("h")]


def widened(selection: Column) -> Column:
    """Aggregate of selections (arrays): their union in order; a null selection means everything and so absorbs the others."""
    return F.when(F.count_if(selection.isNull()) == 0, F.array_sort(F.array_distinct(F.flatten(F.collect_list(selection)))))


# ---- rules -------------------------------------------------------------------------------------------------------


def collapsed(status: Column) -> Column:
    """What a report says of a check: failed, not available and doubtful stay, all else counts as passed."""
    return F.when(status == "FAILED", "FAILED").when(status.isin("DOCS_NOT_AVAILABLE", "DOCS N/A"), "DOCS N/A").when(status == "DOUBTFUL", "DOUBTFUL").otherwise("PASSED")


def failed_names(checks: Mapping[str, str]) -> Column:
    """The headers of failed checks, in order; checks maps headers to columns."""
    return F.concat_ws(", ", *[F.when(F.col(c) == "FAILED", F.lit(header)) for header, c in checks.items()])


def forgery_status(columns: Sequence[str]) -> Column:
    return F.when(F.coalesce(F.array_contains(F.array(*columns), "FAILED"), F.lit(False)), "Forged").otherwise("OK")


def compare(actual: Column, operator: Column, against: Column) -> Column:
    """actual and against are of one type; unknown operators and nulls fail, but a null differs from a value."""
    ops = {"EQ": actual == against, "GT": actual > against, "GTE": actual >= against, "LT": actual < against, "LTE": actual <= against}
    out = F.when(operator == "NEQ", ~actual.eqNullSafe(against))
    for name, test in ops.items():
        out = out.when(operator == name, F.coalesce(test, F.lit(False)))
    return out.otherwise(False)


def rule_passes(value: Column, operator: str, against: object) -> Column:
    """One rule on one fact; a null fact passes no rule but NEQ."""
    if operator not in ("EQ", "NEQ", "GT", "GTE", "LT", "LTE"):
        raise ValueError(f"unknown operator {operator}")
    return compare(value, F.lit(operator), F.lit(against))


def evaluated(facts: DataFrame, rules: DataFrame, key: str, numbers: Sequence[str] = (), texts: Sequence[str] = (), statuses: Sequence[str] = (), sets: Sequence[str] = ()) -> DataFrame:
    """Every rule (rule, field, operator, value) on every row of facts: key, rule, passed, actual.

    Rules are rows of a table and meet facts by the name of their field. numbers take all operators, the others EQ and
    NEQ: texts as they are, statuses collapsed on both sides, and sets (arrays), of which EQ asks for the value.
    """
    fact = lambda c, kind, n=None, t=None, s=None: F.struct(F.lit(c).alias("field"), F.lit(kind).alias("kind"), (F.lit(None) if n is None else n).cast("double").alias("n"), (F.lit(None) if t is None else t).cast("string").alias("t"), (F.lit(None) if s is None else s).cast("array<string>").alias("s"))
    rows = [fact(c, "n", n=F.col(c)) for c in numbers] + [fact(c, "t", t=F.col(c)) for c in texts] + [fact(c, "t", t=collapsed(F.col(c))) for c in statuses] + [fact(c, "s", s=F.col(c)) for c in sets]
    long = facts.select(key, F.explode(F.array(*rows)).alias("f")).select(key, "f.*")
    value = F.when(F.col("field").isin(*statuses), collapsed(F.upper(F.trim("value")))).otherwise(F.col("value")) if statuses else F.col("value")
    # rules are few: facts stay where they are, as by field they would meet in as many tasks as there are fields
    met = long.join(F.broadcast(rules.withColumn("value", value)), "field")
    equal_only = F.col("operator").isin("EQ", "NEQ")
    present = F.coalesce(F.array_contains("s", F.col("value")), F.lit(False))
    passed = (
        F.when(F.col("kind") == "n", compare(F.col("n"), F.col("operator"), F.expr("try_cast(value AS double)")))
        .when(F.col("kind") == "t", equal_only & compare(F.col("t"), F.col("operator"), F.col("value")))
        .otherwise(equal_only & (present == (F.col("operator") == "EQ")))
    )
    actual = F.when(F.col("kind") == "n", F.col("n").cast("long").cast("string")).when(F.col("kind") == "t", F.col("t")).otherwise(F.when(present, "present").otherwise("absent"))
    return met.select(key, "rule", passed.alias("passed"), actual.alias("actual"))
