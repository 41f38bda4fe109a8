"""Queries of workbooks: written by tasks, read back through the workbook source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sheets, workbooks
from ..sources.scratch import own_folder
from .registry import query, table

c = F.col
#: Rows of a written workbook, about: workbooks are written and read by a task each, so their number goes by rows.
BOOK_ROWS = 200_000


def in_books(rows: DataFrame, most: int = BOOK_ROWS) -> DataFrame:
    """Rows dealt evenly to as many workbooks as keep each below `most` rows."""
    return rows.repartition(rows.count() // most + 1)


def read_back(spark: SparkSession, path: str, headers: dict[str, str], **options) -> DataFrame:  # noqa: ANN003
    """All sheets of written workbooks: a full sheet goes on in another."""
    return workbooks.read_workbooks(spark, path, headers, sheet="all", **options)


@query(
    "SELECT o_orderkey::VARCHAR AS orderkey, o_orderstatus AS status, o_totalprice AS price, o_orderdate::DATE AS day, o_orderpriority AS priority, CASE WHEN o_orderkey % 3 > 0 THEN '=<' || o_custkey || '> & \"é\"' END AS note FROM orders"
)
def s5_workbook(spark: SparkSession, d: str) -> DataFrame:
    """A table written as workbooks and read back; prices and days are cells of their own kinds."""
    note = F.when(c("o_orderkey") % 3 > 0, F.concat(F.lit("=<"), c("o_custkey").cast("string"), F.lit('> & "é"')))
    rows = table(spark, d, "orders").select("o_orderkey", c("o_orderstatus").alias("Order Status"), c("o_totalprice").alias("Price"), c("o_orderdate").cast("date").alias("Day"), c("o_orderpriority").alias("Priority"), note.alias("Note"))
    path = f"{own_folder(spark)}/orders"
    workbooks.write_workbooks(in_books(rows), path)
    # headers are found in another writing and order
    back = read_back(spark, path, {"note": "NOTE", "priority": "priority", "price": "price.", "orderkey": "O-OrderKey", "status": "order status", "day": "Day"}, permissive=False)
    return back.select("orderkey", "status", c("price").cast("double").alias("price"), c("day").cast("date").alias("day"), "priority", "note")


@query(
    "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN DATE '2024-01-05' WHEN 1 THEN DATE '2024-01-05' WHEN 2 THEN DATE '2024-01-05' END AS invoice, "
    "CASE WHEN c_custkey % 10 = 0 THEN 'Claim Id is empty' WHEN c_custkey % 4 = 3 THEN 'Invoice Date is no date' END AS problem FROM customer"
)
def s6_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observation workbooks with dates as days, serials and texts, and bad rows; one workbook a partition."""
    k = c("c_custkey")
    date = F.when(k % 4 == 0, "5/1/2024").when(k % 4 == 1, "45296").when(k % 4 == 2, "2024-01-05").otherwise("soon")
    text = lambda name: F.lit("x").alias(name)
    rows = table(spark, d, "customer").select(text("REMARKS "), date.alias("Invoice date"), F.when(k % 10 != 0, F.concat(F.lit("C"), k.cast("string"))).alias("claim-id"), text("Dealer Name"), text("Dealer Code"), text("VIN no."), k.cast("string").alias("Customer Name"), text("Scheme Type"))
    path = f"{own_folder(spark)}/observations"
    workbooks.write_workbooks(in_books(rows, sheets.MOST_ROWS // 2), path)  # an import takes so many rows of a sheet
    return sheets.observations(spark, path).select(c("customerName").cast("long").alias("k"), sheets.cell_date(c("invoiceDate")).alias("invoice"), "problem")


@query(
    "SELECT c_custkey::VARCHAR AS claim, CASE c_custkey % 3 WHEN 0 THEN '''=1' WHEN 2 THEN 'x' END AS note, '2024-01-02' AS day FROM customer"
)
def s19_claims_workbook(spark: SparkSession, d: str) -> DataFrame:
    """The claims report as workbooks; cells that a spreadsheet would work out are guarded."""
    k = c("c_custkey")
    rows = table(spark, d, "customer").select(k, F.when(k % 3 == 0, "=1").when(k % 3 == 2, "x").alias("note"), F.lit("2024-01-02").cast("date").alias("day"))
    path = f"{own_folder(spark)}/claims"
    workbooks.write_workbooks(in_books(sheets.claims_report(rows, {"c_custkey": "Claim", "note": "Note", "day": "Day"})), path, "Claims")
    return read_back(spark, path, {"claim": "Claim", "note": "Note", "day": "Day"}).select("claim", "note", "day")


@query(
    "SELECT row_number() OVER (ORDER BY c_nationkey, c_custkey)::VARCHAR AS number, c_custkey::VARCHAR AS claim, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'Forged' ELSE 'OK' END AS status, "
    "nullif(concat_ws(', ', CASE WHEN c_custkey % 5 = 0 THEN 'Spell Check' END, CASE WHEN c_custkey % 7 = 0 THEN 'Duplicate' END), '') AS failed FROM customer"
)
def s20_observations_workbook(spark: SparkSession, d: str) -> DataFrame:
    """The export of observations, in the order of its numbers, which the import reads again."""
    k = c("c_custkey")
    text = {name: F.lit(None).cast("string").alias(name) for name in ("dealerName", "dealerCode", "vinNo", "customerName", "schemeType", "remarks")}
    checks = [F.when(k % 5 == 0, "FAILED").otherwise("PASSED").alias(x) if x == "spell" else F.when(k % 7 == 0, "FAILED").otherwise("PENDING").alias(x) if x == "duplicate" else F.lit("PASSED").alias(x) for x in sheets.CHECKS.values()]
    rows = table(spark, d, "customer").select(k.alias("claimId"), c("c_nationkey").alias("createdAt"), F.lit("2024-01-02").cast("date").alias("invoiceDate"), *text.values(), *checks)
    path = f"{own_folder(spark)}/export"
    workbooks.write_workbooks(sheets.observation_report(rows), path, "Observations")
    return read_back(spark, path, {"number": "S No", "claim": "Claim Id", "status": "Status", "failed": "Failed Checks"}, key="claim").select("number", "claim", "status", "failed")


@query(
    "SELECT user_id::VARCHAR AS claim, CASE event_type WHEN 'error' THEN 'Red Flags' ELSE event_type END AS \"check\", event_id::VARCHAR AS document, '''=' || event_id AS message FROM events WHERE value > 90"
)
def s21_findings_workbook(spark: SparkSession, d: str) -> DataFrame:
    """A row for each error."""
    rows = table(spark, d, "events").select(c("user_id").alias("claim"), c("event_type").alias("validator"), F.when(c("value") > 90, "ERROR").otherwise("INFO").alias("severity"), c("event_id").alias("document"), F.lit(1).alias("page"), F.concat(F.lit("="), c("event_id").cast("string")).alias("message"))
    path = f"{own_folder(spark)}/findings"
    workbooks.write_workbooks(sheets.findings_report(rows, {"error": "Red Flags"}), path, "Findings")
    return read_back(spark, path, {x: x for x in ("claim", "check", "document", "message")}).select("claim", "check", "document", "message")
