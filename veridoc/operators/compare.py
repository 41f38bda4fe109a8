"""Consistency of a claim's documents: each field must agree across the kinds of documents that print it.

Pages are (claim, document, page, text, card, type). Findings: claim, document, page, code, severity, expected, actual.
Values of a claim are few, and their comparison isn't transitive, so they are clustered greedily, claim by claim and
field by field, by a fold over the distinct values; all else is joins and expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import similarity as S
from ..functions import text as T
from ..sources.scratch import stored
from . import classification as K
from . import extraction as E

ALL = list(K.BUSINESS)
#: The fields that are compared, and the kinds of documents in which each counts.
SCOPES = {
    "NAME": ALL, "RELATION_FATHER": ALL, "RELATION_MOTHER": ALL, "RELATION_SPOUSE": ALL, "RELATION_GUARDIAN": ALL, "CHASSIS": ["INVOICE", "RC", "INSURANCE"], "ENGINE": ["INVOICE", "RC", "INSURANCE"],
    "VEHICLE_NO": ["RC", "INSURANCE"], "MODEL": ["INVOICE", "RC", "INSURANCE"], "EMP_CODE": ["STAFF_ID", "PAYSLIP"], "ADDRESS": ALL, "DOB": ALL,
}
#: Fields that stay errors on pages that couldn't be classified.
SURE = ["CHASSIS", "ENGINE", "VEHICLE_NO"]
TEMPORARY = r"(?i)temporary\s+(?:certificate\s+of\s+)?registration"


def page_fields(pages: DataFrame) -> DataFrame:
    """Every value in the scope of its field: claim, document, page, type, field, value. Pages have text, or read."""
    readers = {k: v for k, v in E.readings(pages).items() if k in SCOPES}
    rows = pages.select("claim", "document", "page", "type", F.explode(E.value_rows(readers)).alias("v")).select("claim", "document", "page", "type", "v.field", "v.value")
    allowed = F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit([*x, "UNKNOWN"]) for pair in SCOPES.items() for x in pair])
    return rows.where(F.array_contains(F.try_element_at(allowed, F.col("field")), F.col("type")))


def pair_matches(firsts: DataFrame) -> DataFrame:
    """Distinct values (claim, field, value) of a claim's field compared once each: claim, field, a, b (a before b), same."""
    one = firsts.select("claim", "field", "value")
    pairs = one.withColumnRenamed("value", "a").join(one.withColumnRenamed("value", "b"), ["claim", "field"]).where("a < b")  # within a claim's field
    same = F.lit(True)
    for matcher in dict.fromkeys(S.MATCHERS.values()):
        fields = [k for k, m in S.MATCHERS.items() if m is matcher]
        same = F.when(F.col("field").isin(*fields), matcher(F.col("a"), F.col("b"))).otherwise(same)
    return pairs.withColumn("same", same)


def clusters(values: DataFrame) -> DataFrame:
    """values with cluster: of a claim's field each value, in order of document and page, joins the first cluster whose first value it matches.

    Equal values join the same cluster, so only a claim's distinct values are gone through, and only where it has several.
    """
    key = ["claim", "field"]
    firsts = values.groupBy(*key, "value").agg(F.min(F.struct("document", "page")).alias("at"))
    lists = firsts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("listed")).where(F.size("listed") > 1)
    pairs = pair_matches(firsts.join(lists.select(*key), key, "left_semi")).where("same").groupBy(*key).agg(F.collect_list(F.struct("a", "b")).alias("same"))
    none = F.array().cast("array<struct<a: string, b: string>>")
    rows = lists.join(pairs, key, "left").select(*key, F.transform("listed", lambda x: x["value"]).alias("listed"), F.coalesce("same", none).alias("same"))

    def heads_with(heads: Column, v: Column) -> Column:
        match = F.exists(heads, lambda h: F.array_contains(F.col("same"), F.struct(F.least(h, v).alias("a"), F.greatest(h, v).alias("b"))))
        return F.when(match, heads).otherwise(F.concat(heads, F.array(v)))

    def own(v: Column) -> Column:
        """The first head that v is or matches."""
        fits = F.transform("heads", lambda h, i: F.when((h == v) | F.array_contains(F.col("same"), F.struct(F.least(h, v).alias("a"), F.greatest(h, v).alias("b"))), i))
        return F.array_min(F.array_compact(fits))

    rows = rows.withColumn("heads", F.reduce("listed", F.array().cast("array<string>"), heads_with))
    several = rows.select(*key, F.explode(F.transform("listed", lambda v: F.struct(v.alias("value"), own(v).alias("cluster")))).alias("x")).select(*key, "x.*")
    return values.join(several, [*key, "value"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(0))).select(*values.columns, "cluster")


def set_aside(pages: DataFrame, claims: DataFrame) -> DataFrame:
    """Pages of registrations and policies of another car (claim, document, page, vin): they have whole chassis numbers, and none is the claim's."""
    vins = pages.where(F.col("type").isin("RC", "INSURANCE")).select("claim", "document", "page", F.filter(E.page_vins(F.col("text")), S.looks_like_vin).alias("vins")).where(F.size("vins") > 0)
    met = vins.join(claims.select("claim", "vin"), "claim").where(S.full_chassis(F.upper("vin")))
    own = F.exists("vins", lambda v: S.same_vehicle(v, F.upper("vin")))
    return met.where(~own).select("claim", "document", "page", F.get("vins", F.lit(0)).alias("vin"))


def field_findings(pages: DataFrame, claims: DataFrame | None = None, read: DataFrame | None = None) -> DataFrame:
    """CROSS_<field>_MISMATCH for each cluster but the largest, where it crosses a kind of document or a document.

    With claims (claim, vin): pages of another car are set aside, and noted. Pages that couldn't be classified take part;
    what they say is a note but for the numbers of cars, and they are noted. read: what the pages' fields are, if known.
    """
    values = stored(page_fields(pages if read is None else read))  # used for sizes, pairs and findings
    notes = None
    if claims is not None:
        aside = set_aside(pages, claims)
        values = values.join(aside.select("claim", "document", "page"), ["claim", "document", "page"], "left_anti")
        notes = aside.select("claim", "document", "page", F.lit("CROSS_OTHER_VEHICLE").alias("code"), F.lit("INFO").alias("severity"), F.lit(None).cast("string").alias("expected"), F.col("vin").alias("actual"))
    grouped = clusters(values)
    at = F.struct("document", "page", "value", "type")
    sizes = grouped.groupBy("claim", "field", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.collect_set("document").alias("documents"))
    place = Window.partitionBy("claim", "field").orderBy(F.desc("n"), "cluster")
    ranked = sizes.withColumn("rank", F.row_number().over(place)).withColumn("top", F.first(F.struct("first", "documents")).over(place))
    other = ranked.where("rank > 1").where((F.col("first.type") != F.col("top.first.type")) | ~F.expr("array_contains(top.documents, first.document)"))
    blind = (F.col("first.type") == "UNKNOWN") | (F.col("top.first.type") == "UNKNOWN")
    severity = F.when(F.col("field") == "ADDRESS", "WARNING").when(blind & ~F.col("field").isin(*SURE), "INFO").otherwise("ERROR")
    out = other.select("claim", "first.document", "first.page", F.concat(F.lit("CROSS_"), "field", F.lit("_MISMATCH")).alias("code"), severity.alias("severity"), F.col("top.first.value").alias("expected"), F.col("first.value").alias("actual"))
    unknown = values.where("type = 'UNKNOWN'").select("claim", "document", "page").distinct().select("*", F.lit("CROSS_UNCLASSIFIED").alias("code"), F.lit("INFO").alias("severity"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual"))
    out = out.unionByName(unknown)
    return out if notes is None else out.unionByName(notes)


def _finding(rows: DataFrame, code: str | Column, expected: Column, actual: Column, severity: str | Column = "ERROR") -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select("claim", "document", "page", lit(code).alias("code"), lit(severity).alias("severity"), expected.alias("expected"), actual.alias("actual"))


def imported_name_findings(pages: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims (claim, customer) whose imported customer isn't on the invoice: the first name that differs."""
    names = pages.where("type = 'INVOICE'").select("claim", "document", "page", F.posexplode(E.names(F.col("text"))).alias("k", "name"))
    met = names.join(claims.where(F.trim("customer") != "").select("claim", F.trim("customer").alias("customer")), "claim").where(~S.same_name(F.col("customer"), F.col("name")))
    first = met.withColumn("r", F.row_number().over(Window.partitionBy("claim").orderBy("document", "page", "k"))).where("r = 1")
    return _finding(first, "CROSS_DMS_NAME_MISMATCH", F.col("customer"), F.col("name"))


def invoice_owner_findings(pages: DataFrame, claims: DataFrame) -> DataFrame:
    """The invoice's customer against the owner on the old car's registration: a note if they are one, else an error."""
    buyer = pages.where("type = 'INVOICE'").select("claim", F.struct("document", "page", E.first(E.names(F.col("text"))).alias("name")).alias("b")).where("b.name is not null").groupBy("claim").agg(F.min("b").alias("b"))
    old = pages.where("type = 'RC'").join(claims.select("claim", "vin"), "claim")
    own = F.col("text").rlike(TEMPORARY) | F.exists(E.chassis_candidates(F.col("text")), lambda c: S.same_chassis(c, F.upper("vin")))
    owner = old.where(~own).select("claim", F.struct("document", "page", E.owner_of_rc(F.col("text")).alias("name")).alias("o")).where("o.name is not null").groupBy("claim").agg(F.min("o").alias("o"))
    met = buyer.join(owner, "claim").select("claim", "o.document", "o.page", F.col("b.name").alias("buyer"), F.col("o.name").alias("owner")).withColumn("same", S.same_name(F.col("buyer"), F.col("owner")))
    return _finding(met, F.when(F.col("same"), "CROSS_INVOICE_RC_SAME_NAME").otherwise("CROSS_INVOICE_RC_DIFF_NAME"), F.col("buyer"), F.col("owner"), F.when(F.col("same"), "INFO").otherwise("ERROR"))


def gst_findings(pages: DataFrame) -> DataFrame:
    """Certificates whose number is a GSTIN of the claim without its check character."""
    is_cert = F.col("text").rlike(K.GST_CERTIFICATE) & (F.col("card") == "GST")  # the cheaper one first
    certs = pages.where(is_cert).select("claim", "document", "page", E.certificate_gstin(F.col("text")).alias("c")).where("length(c) = 14").withColumn("key", T.id_form(F.col("c")))
    others = pages.where(~F.coalesce(is_cert, F.lit(False))).select("claim", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(r"\b[0-9]{2}[A-Z0-9]{13}\b"), 0))).alias("g")).where(I.gstin_verified(F.col("g")))
    whole = others.select("claim", "g", T.id_form(F.substring("g", 1, 14)).alias("key")).groupBy("claim", "key").agg(F.min("g").alias("g"))
    return _finding(certs.join(whole, ["claim", "key"]), "CROSS_GSTIN_MISMATCH", F.col("g"), F.col("c"))


def car_findings(pages: DataFrame, claims: DataFrame) -> DataFrame:
    """Policies for neither the claim's car nor an old one with a registration, and new registrations of another car."""
    cars = pages.where(F.col("type").isin("RC", "INSURANCE")).select("claim", "document", "page", "type", F.col("text").rlike(TEMPORARY).alias("temporary"), new_registration(F.col("text")).alias("new"), E.chassis_candidates(F.col("text")).alias("ids"))
    met = cars.join(claims.select("claim", F.upper("vin").alias("vin")), "claim").where(S.full_chassis(F.col("vin")))
    met = met.withColumn("own", F.exists("ids", lambda c: S.same_chassis(c, F.col("vin")))).withColumn("whole", F.get(F.filter("ids", S.full_chassis), F.lit(0)))
    rcs = met.where("type = 'RC'").groupBy("claim").agg(
        F.flatten(F.collect_list(F.when(~F.col("temporary") & ~F.col("own"), F.col("ids")))).alias("old"), F.min(F.when(~F.col("temporary") & ~F.col("own") & F.col("whole").isNotNull(), F.struct("page", "whole"))).alias("rc"), F.flatten(F.collect_list("ids")).alias("all")
    )
    policies = met.where("type = 'INSURANCE' and not own and whole is not null").join(rcs, "claim", "left")
    hits = lambda ids: F.exists("ids", lambda c: F.exists(F.coalesce(F.col(ids), F.array().cast("array<string>")), lambda r: S.same_chassis(c, r)))
    old = policies.where(F.col("rc").isNotNull() & ~hits("old"))
    new = policies.where(F.col("new") & ~hits("all")).join(old.select("claim", "document", "page"), ["claim", "document", "page"], "left_anti")
    return _finding(old, "CROSS_OLD_CAR_CHASSIS_MISMATCH", F.col("rc.whole"), F.col("whole")).unionByName(_finding(new, "CROSS_POLICY_OTHER_VEHICLE", F.col("vin"), F.col("whole")))


def new_registration(t: Column) -> Column:
    """The registration number says New, beside its label or in the row under it."""
    label = r"(?:\breg\w{0,3}tration\s*(?:no|number)\b|\bregn\.?\s*no\b)"
    return t.rlike(rf"(?im){label}[\s.,:\-]*new\b(?!\s*delhi)|{label}(?![^\n]*[A-Z]{{2}}[\s-]?[0-9]{{1,2}}[\s-]?[A-Z]{{0,3}}[\s-]?[0-9]{{1,4}})[^\n]*\n[\s.,:\-]*new\b(?!\s*delhi)")


def holder_findings(pages: DataFrame, claims: DataFrame) -> DataFrame:
    """Staff cards, payslips, policies and invoices of somebody who isn't the claim's customer (claim, customer)."""
    rows = pages.where(F.col("type").isin("STAFF_ID", "PAYSLIP", "INSURANCE", "INVOICE")).select("claim", "document", "page", E.holder(F.col("text"), F.col("type")).alias("holder")).where("holder is not null")
    met = rows.join(claims.where(F.trim("customer") != "").select("claim", "customer"), "claim")
    return _finding(met.where(~S.same_name(F.col("customer"), F.col("holder"))), "CROSS_HOLDER_NAME_MISMATCH", F.col("customer"), F.col("holder"))


def relative_findings(pages: DataFrame, claims: DataFrame) -> DataFrame:
    """Owners of old cars who aren't the customer and whose cards aren't in the claim."""
    met = pages.where("type = 'RC'").join(claims.select("claim", "vin", "customer"), "claim")
    other = ~F.exists(E.chassis_candidates(F.col("text")), lambda c: S.same_chassis(c, F.upper("vin"))) & ~F.col("text").rlike(TEMPORARY)
    owners = met.where(other).select("claim", "document", "page", "customer", E.owner_of_rc(F.col("text")).alias("owner")).where("owner is not null")
    owners = owners.withColumn("same", S.same_name(F.col("customer"), F.col("owner"))).where("not same").drop("same")
    cards = pages.where("card is not null").select("claim", F.explode(E.both(E.names(F.col("text")), F.array_compact(F.array(E.name_under(F.col("text"), r"(?<!father's |mother's )name"), E.name_above(F.col("text"), r"\bdob\b|date\s*of\s*birth"))))).alias("name")).distinct()
    met = owners.join(cards, "claim", "left").withColumn("same", S.same_name(F.col("owner"), F.col("name")) & F.col("name").isNotNull())
    unseen = met.groupBy("claim", "document", "page", "customer", "owner").agg(F.max("same").alias("seen")).where("not seen")
    return _finding(unseen, "CROSS_RELATION_KYC_MISMATCH", F.col("customer"), F.col("owner"))


def old_car_name_findings(pages: DataFrame, claims: DataFrame) -> DataFrame:
    """A registration and a policy of one old car that name different people."""
    read = pages.where(F.col("type").isin("RC", "INSURANCE")).join(claims.select("claim", F.upper("vin").alias("vin")), "claim")
    read = read.select("claim", "document", "page", "type", "vin", E.holder(F.col("text"), F.col("type")).alias("name"), F.get(F.filter(E.chassis_candidates(F.col("text")), S.full_chassis), F.lit(0)).alias("c")).where("name is not null and c is not null")
    old = read.where(~S.same_chassis(F.col("c"), F.col("vin")))
    rc, policy = old.where("type = 'RC'").select("claim", F.col("name").alias("owner"), F.col("c").alias("rc")), old.where("type = 'INSURANCE'")
    met = policy.join(rc, "claim").where(S.same_chassis(F.col("c"), F.col("rc"))).where(~S.same_name(F.col("owner"), F.col("name")))
    return _finding(met, "CROSS_OLD_CAR_NAME_MISMATCH", F.col("owner"), F.col("name"))
