"""Payloads of two-dimensional codes: decoding, fields, comparison with the page they stand on, and outcomes.

Decoded codes are rows (claim, document, page, value). Reading images is not done here.
"""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions import similarity as S
from ..functions import text as T
from ..sources.scratch import stored
from . import classification as K
from . import extraction as E

#: The order of the fields in a secure code, and how those that are shown are called.
SECURE_FIELDS = "emailMobilePresent referenceId name dob gender careOf district landmark house location pincode postOffice state street subDistrict vtc".split()
SHOWN = {"name": "Name", "dob": "DOB", "gender": "Gender", "careOf": "Care of", "house": "House", "street": "Street", "vtc": "Village/Town/City", "district": "District", "state": "State", "pincode": "PIN", "referenceId": "Reference Id"}
#: Which rows of a pane a key of a payload answers to, the first that the page has.
KEYS = {
    "name": ["Insured's Name", "Holder Name", "Customer Name"], "insuredname": ["Insured's Name", "Customer Name"], "nameofinsured": ["Insured's Name", "Customer Name"], "customername": ["Insured's Name", "Customer Name", "Holder Name"],
    "proposername": ["Insured's Name", "Customer Name"], "polno": ["Policy No"], "policyno": ["Policy No"], "policynumber": ["Policy No"], "chassisno": ["Chassis No"], "chassis": ["Chassis No"], "engineno": ["Engine No"], "engine": ["Engine No"],
    "model": ["Model"], "vehiclemodel": ["Model"], "makemodel": ["Model"], "modelname": ["Model"], "uid": ["Aadhaar Number"], "pan": ["PAN Number"], "panno": ["PAN Number"], "gender": ["Gender"], "dob": ["Date of Birth"], "invoiceno": ["Invoice No"],
}
NAMES = ["Insured's Name", "Holder Name", "Customer Name", "Father's Name"]
#: A text longer than this, packed, is none of these codes.
LONGEST = 1 << 20


def _secure(digits: str) -> str | None:
    number = int(digits)
    raw = number.to_bytes((number.bit_length() + 7) // 8, "big")
    if raw[:2] != b"\x1f\x8b":
        return None
    try:
        text = zlib.decompressobj(31).decompress(raw, LONGEST)
    except zlib.error:
        return None
    parts = text.split(b"\xff")[:-1]
    if len(parts) < 5:
        return None
    parts = [p.decode("latin-1").strip() for p in parts]
    if len(parts[0]) == 2 and parts[0][0] == "V" and parts[0][1].isdigit():
        parts = parts[1:]
    found = dict(zip(SECURE_FIELDS, parts, strict=False))
    found["gender"] = {"M": "MALE", "F": "FEMALE"}.get(found.get("gender", ""), found.get("gender", ""))
    return "|".join(f"{label}:{found[k]}" for k, label in SHOWN.items() if found.get(k)) or None


@pandas_udf(StringType())
def _secure_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else _secure(v))


_secure_udf = _secure_udf.asNondeterministic()  # so that it stays out of join conditions


def secure_payload(digits: list[str]) -> str:
    """Fields as the digits of a secure code, for tests and fixtures."""
    return str(int.from_bytes(gzip.compress("\xff".join([*digits, ""]).encode("latin-1"), mtime=0), "big"))


def shown_value(raw: Column) -> Column:
    """Bytes of a code as text if they print, else binary: and their base64."""
    text = F.try_validate_utf8(raw.cast("string")) if hasattr(F, "try_validate_utf8") else raw.cast("string")
    return F.when(text.rlike(r"\A[\x09\x0A\x0D\x20-\x7E -�]+\z"), text).otherwise(F.concat(F.lit("binary:"), T.base64(raw)))


def readable(value: Column) -> Column:
    """The value in labels and values: long digits as what a secure code says, null for what can't be read."""
    digits = value.rlike(r"\A[0-9]{200,}\z")
    return F.when(digits, _secure_udf(F.when(digits, value))).when(~F.startswith(value, F.lit("binary:")), value)


def payload(value: Column) -> Column:
    """A readable value as an array of (key, value): attributes of XML, or lines, else parts between bars, else between commas.

    A key ends at the first colon that doesn't stand between digits; of one key the first value with text holds.
    """
    entry = lambda k, v: F.struct(T.normalized(k).alias("key"), F.trim(v).alias("value"))
    attributes = F.transform(F.regexp_extract_all(value, F.lit(r'[A-Za-z_][\w-]*="[^"]*"'), 0), lambda a: entry(F.substring_index(a, "=", 1), F.regexp_extract(a, r'="([^"]*)"', 1)))
    parts = F.when(value.rlike(r"[\r\n]"), F.split(value, r"[\r\n]+")).when(F.contains(value, F.lit("|")), F.split(value, r"\|")).otherwise(F.split(value, ","))
    colon = r"(?s)\A(.*?)(?:(?<![0-9]):|:(?![0-9]))(.*)\z"
    pairs = F.transform(parts, lambda p: entry(F.regexp_extract(p, colon, 1), F.regexp_extract(p, colon, 2)))
    all_ = F.filter(F.when(value.rlike(r"\A\s*<"), attributes).otherwise(pairs), lambda e: (e["key"] != "") & (e["value"] != ""))
    return F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda x: x["key"] == e["key"]))


def compared(codes: DataFrame, pages: DataFrame) -> DataFrame:
    """Codes against the fields of their page's own kind of document: claim, document, page, label, code_value, page_value, matches.

    Only what both have is compared; of the rows a key answers to the first that the page has. Pages may have card and
    type, as classified; then they aren't classified again.
    """
    keys = codes.sparkSession.createDataFrame([(k, i, label) for k, labels in KEYS.items() for i, label in enumerate(labels)], "key string, place int, label string")  # fixed
    # only documents with codes are looked at, and of these only pages of the kinds that codes stand on are read
    known = {"card", "type"} <= set(pages.columns)
    near = pages.select("claim", "document", "page", "text", *(["card", "type"] if known else [])).join(codes.select("claim", "document").distinct(), ["claim", "document"], "left_semi")
    pane = K.pane_of(F.col("text"), F.col("type"), F.col("card")) if known else K.pane_type(F.col("text"))
    typed = stored(E.dealt(near).withColumn("type", pane).drop("card").where("type is not null"))
    kinds = typed.drop("text").join(codes.select("claim", "document", "page").distinct(), ["claim", "document", "page"], "left_semi")
    codes = codes if "readable" in codes.columns else codes.withColumn("readable", readable(F.col("value")))
    entries = codes.select("claim", "document", "page", F.posexplode(payload(F.col("readable"))).alias("k", "e")).select("claim", "document", "page", "k", "e.key", F.col("e.value").alias("code_value"))
    fields = E.typed_panes(typed.join(kinds.select("claim", "document", "type").distinct(), ["claim", "document", "type"], "left_semi")).where("value is not null").withColumnRenamed("value", "page_value")
    met = entries.join(kinds, ["claim", "document", "page"]).join(F.broadcast(keys), "key").join(fields, ["claim", "document", "type", "label"])
    one = met.withColumn("r", F.row_number().over(Window.partitionBy("claim", "document", "page", "key").orderBy("place"))).where("r = 1")
    one = one.withColumn("r", F.row_number().over(Window.partitionBy("claim", "document", "page", "label").orderBy("k"))).where("r = 1")
    a, b, label = F.col("code_value"), F.col("page_value"), F.col("label")
    same = F.when(label.isin(*NAMES), S.same_name(a, b)).when(label == "Gender", S.same_gender(a, b)).when(label == "Model", S.same_model_in_code(a, b)).otherwise(S.same_identifier(a, b))
    return one.select("claim", "document", "page", "label", F.regexp_replace(a, r"\s+", " ").alias("code_value"), "page_value", same.alias("matches"))


def foreign_chassis(value: Column, vin: Column) -> Column:
    """The chassis of a new car's readable code that isn't the claim's; null else. The last six must agree exactly."""
    entries = payload(value)
    get = lambda *keys: F.get(F.filter(entries, lambda e: e["key"].isin(*keys)), F.lit(0))["value"]
    chassis, registration = get("chassisno", "chassis"), get("regno", "regnno", "registrationno", "registrationnumber")
    own = (F.right(T.id_form(chassis), F.lit(6)) == F.right(T.id_form(vin), F.lit(6))) & S.same_id(chassis, vin)
    return F.when(registration.rlike(r"(?i)\A\s*new\b") & vin.rlike(r"(?i)\A[A-HJ-NPR-Z0-9]{17}\z") & ~own, chassis)


def findings(codes: DataFrame, pages: DataFrame, claims: DataFrame, scans: DataFrame) -> DataFrame:
    """claim, document, page, code, severity, value.

    scans: documents that were searched (claim, document, pages_cut, retries_spent, expects): expects is true where a
    document prints a code. Their pages without one are QR_MISSING: a note on a card, an error where nothing was found.
    """
    t = F.lit(None).cast("string")
    row = lambda rows, code, severity, value=t: rows.select("claim", "document", "page", F.lit(code).alias("code"), F.lit(severity).alias("severity"), value.alias("value"))
    codes = stored(codes.withColumn("readable", readable(F.col("value"))))  # read in Python, and used by every rule below
    opaque = F.col("readable").isNull()
    out = row(codes.where(~opaque), "QR_FOUND", "INFO", F.col("value")).unionByName(row(codes.where(opaque), "QR_ENCRYPTED_PAYLOAD", "INFO"))
    out = out.unionByName(row(compared(codes, pages).where("not matches"), "QR_FIELD_MISMATCH", "ERROR", F.concat_ws(": ", "label", F.concat_ws(" / ", "code_value", "page_value"))))
    met = codes.join(claims.select("claim", "vin"), "claim").withColumn("foreign", foreign_chassis(F.col("readable"), F.upper("vin"))).where("foreign is not null")
    out = out.unionByName(row(met, "QR_FIELD_MISMATCH", "ERROR", F.col("foreign")))
    docs = scans.withColumn("page", F.lit(None).cast("int"))
    bare = docs.join(codes.select("claim", "document").distinct(), ["claim", "document"], "left_anti")
    any_code = codes.select("claim").distinct().withColumn("some", F.lit(True))
    missing = bare.where("expects").join(any_code, "claim", "left").select("claim", "document", "page", F.lit("QR_MISSING").alias("code"), F.when(F.col("some"), "INFO").otherwise("ERROR").alias("severity"), t.alias("value"))
    return out.unionByName(missing).unionByName(row(docs.where("pages_cut > 0"), "QR_PAGES_TRUNCATED", "ERROR")).unionByName(row(docs.where("retries_spent"), "QR_RETRY_BUDGET_EXHAUSTED", "ERROR"))


def online_record(html: Column) -> list[Column]:
    """Of an insurer's record page: valid, insurer, name, policy, chassis, engine."""
    span = lambda i: T.labelled_span(html, i)
    insurer = span("lblIC")
    return [(~span("lblmsg").rlike("(?i)invalid data") & (insurer != "")).alias("valid"), insurer.alias("insurer"), span("lblName").alias("name"), span("lblPolNo").alias("policy"), span("lblChesisNo").alias("chassis"), span("lblEngNo").alias("engine")]


def online_findings(policies: DataFrame, records: DataFrame) -> DataFrame:
    """Policy pages (claim, document, page, url, text) against records (url, html) that were fetched before; html is null where the site didn't answer."""
    met = policies.join(records, "url", "left").withColumn("unreached", F.col("html").isNull()).select("claim", "document", "page", "text", "unreached", *online_record(F.coalesce("html", F.lit(""))))
    printed = E.printed_insurers(F.col("text"))
    other = (F.size(printed) > 0) & ~F.exists(printed, lambda p: S.same_insurer(F.col("insurer"), p))
    code = F.when(F.col("unreached"), "QR_ONLINE_UNVERIFIED").when(~F.col("valid"), "QR_POLICY_NOT_FOUND_ONLINE").when(other, "QR_INSURER_MISMATCH")
    return met.select("claim", "document", "page", code.alias("code"), F.when(F.col("unreached"), "INFO").otherwise("ERROR").alias("severity"), F.col("insurer").alias("value")).where("code is not null")


def outcomes(found: DataFrame, codes: DataFrame, scans: DataFrame) -> DataFrame:
    """Of each claim the outcome of its codes: MISMATCH, UNREADABLE, NO_QR or OK."""
    kinds = found.groupBy("claim").agg(F.count_if(F.col("code").isin("QR_FIELD_MISMATCH", "QR_POLICY_NOT_FOUND_ONLINE", "QR_INSURER_MISMATCH")).alias("mismatches"), F.count_if(F.col("code").isin("QR_ENCRYPTED_PAYLOAD", "QR_PAGES_TRUNCATED", "QR_RETRY_BUDGET_EXHAUSTED")).alias("unreadable"))
    decoded = codes.groupBy("claim").agg(F.count(F.lit(1)).alias("decoded"))
    one = scans.groupBy("claim").agg(F.count(F.lit(1)).alias("scannable")).join(kinds, "claim", "left").join(decoded, "claim", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return one.select("claim", K.qr_outcome(n("mismatches"), n("unreadable"), n("decoded"), n("scannable")).alias("outcome"))
