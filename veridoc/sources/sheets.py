"""Observation sheets and reports as CSV: reading by header, checks of rows, dates of spreadsheets, and safe writing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R

MOST_ROWS = 5000
#: What the columns of an observation sheet are called.
HEADERS = {"claimId": "Claim Id", "dealerName": "Dealer Name", "dealerCode": "Dealer Code", "invoiceDate": "Invoice Date", "vinNo": "VIN No", "customerName": "Customer Name", "schemeType": "Scheme Type", "remarks": "Remarks"}
CHECKS = {"Spell Check": "spell", "QR Code": "qr", "Meta": "meta", "Intra Claim": "intra", "Missing Docs": "full", "Red Flags": "redFlag", "Duplicate": "duplicate", "Data Compare": "dataCompare"}


def read_sheet(spark: SparkSession, path: str, headers: Mapping[str, str] = HEADERS) -> DataFrame:
    """A CSV by its headers, in any order and writing; a missing one is an error. Rows keep their number in the sheet."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    key = lambda x: "".join(ch for ch in x.lower() if ch.isalnum() and ch.isascii())
    found = {key(c): c for c in raw.columns}
    missing = [h for h in headers.values() if key(h) not in found]
    if missing:
        raise ValueError(f"the sheet has no column {', '.join(missing)}")
    # rows of one multi-line file are read by one task, so they keep their order; at most MOST_ROWS count
    numbered = raw.withColumn("row", F.monotonically_increasing_id() + 2)
    return numbered.select("row", *[cell_text(F.col(f"`{found[key(h)]}`")).alias(c) for c, h in headers.items()])


def observations(spark: SparkSession, path: str, headers: Mapping[str, str] = HEADERS) -> DataFrame:
    """Observation workbooks below a path: file, row, problem and the columns of headers; at most MOST_ROWS rows of a sheet.

    A file that is no workbook, lacks a column or has too many rows gives a row 0 that says so. A claim's first row of a
    workbook counts, in the order of the sheet.
    """
    from pyspark.sql import Window

    from . import workbooks

    rows = workbooks.read_workbooks(spark, path, dict(headers), key="claimId", most=MOST_ROWS)
    again = F.row_number().over(Window.partitionBy("file", "claimId").orderBy("row")) > 1
    dated = F.col("invoiceDate").isNotNull() & cell_date(F.col("invoiceDate")).isNull()
    more = F.when(dated, f"{headers['invoiceDate']} is no date").when(F.col("claimId").isNotNull() & again, f"{headers['claimId']} stands in an earlier row")
    return rows.withColumn("problem", F.coalesce("problem", more))


def cell_text(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"[ \s]+", " ")), F.lit(""))


def cell_date(c: Column) -> Column:
    """A date as text, day first or year first, or the serial number of a spreadsheet (1 is 1900-01-01); null for anything else."""
    serial = F.regexp_extract(c, r"\A([0-9]{1,7})(?:\.[0-9]+)?\z", 1).try_cast("int")
    day_first = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(c, r"\A([0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{4})\z", 1), r"[.\-]", "/"), F.lit("d/M/yyyy"))
    year_first = F.try_to_timestamp(F.regexp_extract(c, r"\A([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("yyyy-MM-dd"))
    return F.when(serial.between(1, 2958465), F.date_add(F.lit("1899-12-30").cast("date"), serial)).otherwise(F.coalesce(day_first, year_first).cast("date"))


def problems(rows: DataFrame) -> DataFrame:
    """rows with problem: null, or why a row can't be taken: no claim id, a date that is none, a claim id that stood before, too many rows."""
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy("claimId").orderBy("row")) > 1
    dated = F.col("invoiceDate").isNotNull() & cell_date(F.col("invoiceDate")).isNull()
    out = F.when(F.col("claimId").isNull(), "Claim Id is empty").when(dated, "Invoice Date is no date").when(again, "Claim Id stands in an earlier row").when(F.col("row") > MOST_ROWS + 1, "too many rows")
    return rows.withColumn("problem", out)


def observation_report(rows: DataFrame) -> DataFrame:
    """Claims (business columns and check statuses) as an export: numbered, with the verdict, the failed checks and each check's outcome."""
    statuses = [F.col(c) for c in CHECKS.values()]
    numbered = R.serial_numbers(rows, ["createdAt", "claimId"], "S No", chunks=8)
    text = lambda c: T.guarded(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return numbered.select(
        "S No", *[(F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")) if c == "invoiceDate" else text(c)).alias(h) for c, h in HEADERS.items() if c != "remarks"],
        R.forgery_status(list(CHECKS.values())).alias("Status"), text("remarks").alias("Remarks"), R.failed_names(CHECKS).alias("Failed Checks"), *[R.collapsed(s).alias(h) for h, s in zip(CHECKS, statuses, strict=True)],
    )


def claims_report(rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Rows with readable headers, null as empty, times as days, and no cell that a spreadsheet would work out."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    cell = lambda c: F.date_format(c, "yyyy-MM-dd") if kind[c] in ("date", "timestamp") else F.col(c).cast("string")
    return rows.select(*[T.guarded(F.coalesce(cell(c), F.lit(""))).alias(h) for c, h in columns.items()])


def findings_report(findings: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """One row for each error: claim, check by its label, document, page, message."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    rows = findings.where("severity = 'ERROR'")
    return rows.select("claim", F.coalesce(F.try_element_at(names, F.col("validator")), F.col("validator")).alias("check"), "document", "page", T.guarded(F.substring("message", 1, 500)).alias("message"))


def write_report(df: DataFrame, path: str) -> None:
    """CSV with headers; parts are written by tasks, in the order of their ranges."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Access rows (at, ...) appended, by day."""
    rows.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(path)


def retained(log: DataFrame, today: Column, days: int = 90) -> DataFrame:
    """Rows of a log that are at most so many days old."""
    return log.where(F.col("at") >= F.date_sub(today, days).cast("timestamp"))


def dumped(tables: Mapping[str, DataFrame], path: str, only_schema: set[str] = frozenset({"sessions", "audit_logs"})) -> dict[str, int]:
    """Every table written as Parquet under a folder; of some the columns alone. The rows written, as read back."""
    out = {}
    for name, df in tables.items():
        (df.limit(0) if name in only_schema else df).write.mode("overwrite").parquet(f"{path}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{path}/{name}").count()
    return out
