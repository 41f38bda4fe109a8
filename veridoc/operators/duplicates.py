"""Duplicate data points: the same value of a field on another claim of the same scope.

Every page's values are read in one pass into an index (claim, field, norm). Claims meet by grouping on the value, so a
value of many claims makes one row and no pairs. The result is symmetric: both claims of a pair have their finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import stored
from . import extraction as E
from . import relational as R

#: Fields that fail a claim when shared, and those that are only shown.
HARD = ["ACCOUNT_NO", "RECEIPT_NO", "APPLICATION_NO", "EMP_CODE", "VEHICLE_NO", "ADDRESS", *E.IDENTIFIERS]
SOFT = ["NAME", "RELATION_FATHER", "DOB"]
MIN_LENGTH = 4
#: Other claims that a finding lists.
LISTED = 20
#: Hashes that values are counted by, the part of all rows (one in SHARE) that a task may have of one hash, and what it may always have.
PLACES, SHARE, FEW = 65_536, 1000, 10_000


def page_values(pages: DataFrame) -> DataFrame:
    """Every value of the fields above on every page: claim, document, page, field, value, norm.

    Values of fewer than MIN_LENGTH letters and digits are no evidence; nor are lines that name a town only. Pages have
    text, or read.
    """
    all_ = E.readings(pages)
    readers = {k: v for k, v in all_.items() if k in HARD + SOFT}
    readers["VEHICLE_NO"] = E.both(readers["VEHICLE_NO"], all_["PLATES"])
    # inside the array, as a filter on a column is moved before it and works it out a second time
    told = F.filter(E.value_rows(readers), lambda v: (v["field"] != "ADDRESS") | ~E.is_town_line(v["value"]))
    normal = F.transform(told, lambda v: F.struct(v["field"].alias("field"), v["value"].alias("value"), T.normal_value(v["field"], v["value"]).alias("norm")))
    long = F.filter(normal, lambda v: F.length(F.regexp_replace(v["norm"], r"\s", "")) >= MIN_LENGTH)
    return pages.select("claim", "document", "page", F.explode(long).alias("v")).select("claim", "document", "page", "v.*")


def field_index(values: DataFrame, *more: str) -> DataFrame:
    """One row for each value of a claim, at its first place: claim, field, norm, value, document, page, and more columns of the claim."""
    first = Window.partitionBy("claim", "field", "norm").orderBy("document", F.col("page").asc_nulls_last(), "value")
    return values.withColumn("k", F.row_number().over(first)).where("k = 1").select("claim", "field", "norm", F.substring("value", 1, 255).alias("value"), "document", "page", *more)


def placed(values: DataFrame, claims: DataFrame) -> DataFrame:
    """field_index with the claims' scope and status. One shuffle by claim serves both the join and the index."""
    return field_index(values.repartition("claim").join(claims.select("claim", "scope", "status"), "claim"), "scope", "status")


def owned(index: DataFrame) -> DataFrame:
    """Values of active claims in a placed index: scope, field, norm, claims, n_claims.

    claims: the first LISTED + 1 of them in order, so that each finds LISTED others in it.
    """
    out = R.owned_values(index.where("status = 'ACTIVE'"), ["scope", "field", "norm"], "claim", LISTED + 1)
    return out.select("scope", "field", "norm", F.col("owners").alias("claims"), F.col("n_owners").alias("n_claims"))


def shared(index: DataFrame, claims: DataFrame) -> DataFrame:
    """As owned, only what several active claims of a scope have."""
    return owned(placed(index, claims)).where("n_claims > 1")


def place() -> Column:
    return F.pmod(F.xxhash64("field", "norm"), F.lit(PLACES)).cast("int")


def hot_places(values: DataFrame) -> list[int]:
    """Of PLACES hashes of (field, norm) those of more rows than a task should have of one value: fewer than SHARE."""
    sizes = values.groupBy(place().alias("place")).agg(F.count(F.lit(1)).alias("n"))
    rows = [(r["place"], r["n"]) for r in sizes.collect()]  # PLACES at most
    most = max(FEW, sum(n for _, n in rows) // SHARE)
    return sorted(p for p, n in rows if n > most)


def met_in_tasks(index: DataFrame) -> DataFrame:
    """A placed index with claims and n_claims as owned has them; all rows of a value meet in one task, once."""
    of_value = Window.partitionBy("scope", "field", "norm")
    active = F.col("status").eqNullSafe("ACTIVE")
    ranked = index.withColumn("k", F.row_number().over(of_value.orderBy(F.when(active, 0).otherwise(1), "claim")))
    first = F.when(active & (F.col("k") <= LISTED + 1), F.col("claim"))
    return ranked.select("*", F.count_if(active).over(of_value).alias("n_claims"), F.sort_array(F.collect_list(first).over(of_value)).alias("claims")).drop("k")


def met_owners(values: DataFrame, claims: DataFrame) -> DataFrame:
    """The placed index with claims and n_claims; values that have very many rows meet their owners by a spread join."""
    index = placed(values, claims).where("scope is not null and field is not null and norm is not null")
    hot = hot_places(values)
    if not hot:
        return met_in_tasks(index)
    index = stored(index)
    many = index.where(place().isin(hot))
    spread = R.spread_join(many, stored(owned(many)), ["scope", "field", "norm"], "n_claims")
    return met_in_tasks(index.where(~place().isin(hot))).unionByName(spread)


def value_findings(values: DataFrame, claims: DataFrame) -> DataFrame:
    """As findings, with field and norm."""
    met = met_owners(values, claims)
    own = F.when(F.col("status") == "ACTIVE", 1).otherwise(0)
    met = met.withColumn("n_others", F.col("n_claims") - own).where("n_others > 0").withColumn("others", F.slice(F.array_remove("claims", F.col("claim")), 1, LISTED))
    severity = F.when(F.col("field").isin(*HARD), "ERROR").otherwise("WARNING")
    out = met.select("claim", "document", "page", F.concat(F.lit("DUP_"), "field").alias("code"), severity.alias("severity"), "value", "others", "n_others", "field", "norm")
    cards = values.where(F.col("field").isin(*E.CARD_NUMBERS)).select("claim", "field", "norm", F.col("document").alias("d"), F.col("page").alias("p"), F.col("value").alias("v")).distinct()
    again = out.where(F.col("field").isin(*E.CARD_NUMBERS)).join(cards, ["claim", "field", "norm"]).where(~((F.col("d") == F.col("document")) & F.col("p").eqNullSafe(F.col("page"))))
    again = again.select("claim", F.col("d").alias("document"), F.col("p").alias("page"), "code", "severity", F.col("v").alias("value"), "others", "n_others", "field", "norm")
    return out.unionByName(again)


def findings(values: DataFrame, claims: DataFrame) -> DataFrame:
    """claim, document, page, code, severity, value, others (at most LISTED claims), n_others.

    One finding for a value of a claim, at its first place; a card's number has one on each page that prints it. A claim
    that isn't active sees the active ones and isn't seen by them. values are used several times, so whoever reads them
    from pages stores them first.
    """
    return value_findings(values, claims).drop("field", "norm")


def verdicts(claims: DataFrame, found: DataFrame) -> DataFrame:
    """Of each claim its verdict: a shared hard value fails it; n_hard counts these."""
    hard = found.where("severity = 'ERROR'").groupBy("claim").agg(F.count_distinct("code", "value").alias("n_hard"))
    out = claims.select("claim").join(hard, "claim", "left").withColumn("n_hard", F.coalesce("n_hard", F.lit(0).cast("long")))
    return out.withColumn("status", F.when(F.col("n_hard") > 0, "FAILED").otherwise("PASSED"))
