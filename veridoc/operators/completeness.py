"""Extraction, claim ids and required documents: the META, INTRA and FULL checks over tables of documents and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..sources.scratch import stored
from . import classification as K

LARGEST = 25 * 1024 * 1024


def extraction_findings(documents: DataFrame) -> DataFrame:
    """Documents (claim, document, size, text, timed_out, pages_cut, pages_unread, signals): claim, document, code, severity.

    Text counts from three characters that aren't white space. signals: reasons that a file is made by a tool.
    """
    short = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")) < 3
    codes = F.array_compact(F.array(
        F.when((F.col("size") > LARGEST) | (short & ~F.col("timed_out")), "META_NO_TEXT"), F.when(F.col("timed_out"), "META_EXTRACT_TIMEOUT"), F.when(F.col("pages_cut") > 0, "META_PAGES_TRUNCATED"),
        F.when(F.col("pages_unread") > 0, "META_PAGES_UNREAD"), F.when(F.size("signals") > 0, "META_AI_ORIGIN"),
    ))
    return documents.select("claim", "document", F.explode(codes).alias("code"), F.lit("WARNING").alias("severity"))


def extraction_verdicts(documents: DataFrame) -> DataFrame:
    """Of each claim whether any document gave text: claim, with_text, documents, status."""
    read = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")) >= 3
    out = documents.groupBy("claim").agg(F.count_if(read).alias("with_text"), F.count(F.lit(1)).alias("documents"))
    return out.withColumn("status", F.when(F.col("with_text") == 0, "FAILED").otherwise("PASSED"))


def claim_id_findings(documents: DataFrame, claims: DataFrame) -> DataFrame:
    """Documents (claim, document, text) and claims (claim, vin): where the id is missing, if it is so everywhere, or misread: claim, document, code, severity, value."""
    t, vin = F.col("text"), F.col("vin")
    met = documents.where(F.coalesce(F.trim("text"), F.lit("")) != "").join(claims.select("claim", "vin"), "claim").withColumn("exact", F.coalesce(S.has_claim_id(t, vin), F.lit(False)))
    met = stored(met.select("claim", "document", "exact", F.when(~F.col("exact"), S.misread_claim_id(t, vin)).alias("misread")))  # used twice, and the search is the work
    found = met.groupBy("claim").agg(F.max(F.col("exact") | F.col("misread").isNotNull()).alias("found"))
    rows = met.join(found, "claim").where("not exact")
    missing = rows.where("not found").select("claim", "document", F.lit("INTRA_CLAIMID_MISSING").alias("code"), F.lit("ERROR").alias("severity"), F.lit(None).cast("string").alias("value"))
    return missing.unionByName(rows.where("misread is not null").select("claim", "document", F.lit("INTRA_CLAIMID_MISREAD").alias("code"), F.lit("WARNING").alias("severity"), F.col("misread").alias("value")))


def present_types(pages: DataFrame, files: DataFrame, types: Sequence[dict]) -> DataFrame:
    """claim, name: types that a claim has, by a file's name, by a card's markers on one page, or by what a page is or names first.

    types: rows (id, name, code, order) of the master table, code None for those known by name.
    """
    named = [r["name"] for r in types if not r.get("code")]
    t = F.col("text")
    markers = K.card_markers(t)
    cards = F.array_compact(F.array(*[F.when(markers[r["code"]], F.lit(r["name"])) for r in types if r.get("code") in markers]))
    own = F.array_compact(F.array(K.named_type(t, named, F.coalesce(K.business_type(t), F.lit(""))))) if named else F.array().cast("array<string>")
    by_page = pages.select("claim", F.explode(F.array_union(cards, own)).alias("name"))
    ids = F.create_map(*[F.lit(x) for r in types for x in (r["id"], r["name"])])
    by_file = files.select("claim", F.try_element_at(ids, K.file_type(F.col("file"), types)).alias("name")).where("name is not null")
    return by_page.unionByName(by_file).distinct()


def completeness_findings(claims: DataFrame, present: DataFrame, required: DataFrame, unread: DataFrame) -> DataFrame:
    """Of each claim the required types (name) it hasn't, and documents with unread pages (claim, document, cut, late): claim, document, code, severity, value."""
    wanted = required.select("name").distinct().agg(F.collect_set("name").alias("wanted"))
    have = claims.select("claim").join(present.groupBy("claim").agg(F.collect_set("name").alias("have")), "claim", "left")
    rows = have.crossJoin(F.broadcast(wanted)).select("claim", F.explode(F.array_except("wanted", F.coalesce("have", F.array().cast("array<string>")))).alias("value"))  # wanted is one row
    missing = rows.select("claim", F.lit(None).cast("string").alias("document"), F.lit("FULL_MISSING_TYPE").alias("code"), F.lit("ERROR").alias("severity"), "value")
    codes = F.array_compact(F.array(F.when(F.col("cut") > 0, "FULL_PAGES_NOT_READ"), F.when(F.col("late") > 0, "FULL_PAGES_UNREAD")))
    return missing.unionByName(unread.select("claim", F.col("document").cast("string").alias("document"), F.explode(codes).alias("code"), F.lit("ERROR").alias("severity"), F.lit(None).cast("string").alias("value")))


def verdict(findings: DataFrame, claims: DataFrame, also: Column | None = None) -> DataFrame:
    """Of each claim FAILED if it has an error, else PASSED."""
    errors = findings.where("severity = 'ERROR'").select("claim").distinct().withColumn("failed", F.lit(True))
    return claims.select("claim").join(errors, "claim", "left").select("claim", F.when(F.col("failed"), "FAILED").otherwise("PASSED").alias("status"))
