"""Queries of sources, sinks and the queue: they write small tables or files to a folder of their own and read them back."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction as E
from ..operators import relational as R
from ..sources import files as S
from ..sources import sheets, workbooks
from ..sources.scratch import own_folder
from ..streaming import queue
from .registry import query, table

c = F.col


#: Files of a customer k by k % 6: a claim's folder, one below another folder, a loose file there, files of the root with
#: and without room for an id, and a folder that lies too deep.
TREE = ["'CLAIM{k}/' || CASE WHEN c_custkey % 12 = 0 THEN 'invoice.pdf' ELSE 'panCard.png' END", "'batch/CLAIM{k}/a.txt'", "'batch/LOOSE{k}.pdf'", "'CLAIM{k}.pdf'", "'s{k}.pdf'", "'a/b/c/d/e/f/CLAIM{k}/x.pdf'"]
_NUMBER = "lpad(CAST(c_custkey AS STRING), 6, '0')"
_PATH = "CASE c_custkey % 6 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(TREE)) + " END"


def tree(spark: SparkSession, d: str) -> DataFrame:
    """A folder with a small file for each customer, made by tasks and then listed."""
    root = own_folder(spark, "tree")
    path = _PATH.replace("{k}", f"' || {_NUMBER} || '")

    def make(rows) -> None:  # noqa: ANN001
        store, base = workbooks.opened(root)
        folder_made = lru_cache(1000)(lambda folder: store.create_dir(folder, recursive=True))  # many files lie in a few folders
        for r in rows:
            folder_made(f"{base}/{r[0]}".rpartition("/")[0])
            with store.open_output_stream(f"{base}/{r[0]}") as f:
                f.write(r[0].encode())

    # a file each is much work for little data, and the table may be one file
    table(spark, d, "customer").selectExpr(f"{path} AS path").repartition(E.tasks(spark)).foreachPartition(make)
    return S.listed(spark, root)


_K = "lpad(c_custkey::VARCHAR, 6, '0')"


@query(f"SELECT 'CLAIM' || {_K} || '.pdf' AS path, 'CLAIM' || {_K} AS claim, NULL AS problem FROM customer WHERE c_custkey % 6 = 3 UNION ALL SELECT 's' || {_K} || '.pdf', NULL, 'NAME_TOO_SHORT' FROM customer WHERE c_custkey % 6 = 4")
def s1_file_claims(spark: SparkSession, d: str) -> DataFrame:
    """Files of the root by name."""
    return S.file_claims(tree(spark, d), 1, 11)


@query(f"SELECT CASE c_custkey % 6 WHEN 0 THEN 'CLAIM' WHEN 1 THEN 'batch/CLAIM' WHEN 2 THEN 'batch/LOOSE' ELSE 'CLAIM' END || {_K} || CASE WHEN c_custkey % 6 > 1 THEN '.pdf' ELSE '' END AS path, CASE c_custkey % 6 WHEN 2 THEN 'LOOSE' ELSE 'CLAIM' END || {_K} AS claim, CASE WHEN c_custkey % 6 > 1 THEN 'FILE' ELSE 'FOLDER' END AS kind FROM customer WHERE c_custkey % 6 < 4")
def s2_folder_claims(spark: SparkSession, d: str) -> DataFrame:
    """Folders with an id, and loose files outside of them, down to a depth of five."""
    return S.folder_claims(tree(spark, d), 1, 11)


@query(f"SELECT 'CLAIM' || {_K} AS claim, CASE WHEN c_custkey % 6 = 1 THEN 'batch/CLAIM' || {_K} || '/a.txt' ELSE 'CLAIM' || {_K} || '/panCard.png' END AS path, CASE WHEN c_custkey % 6 = 0 THEN 'pan' END AS type, CASE WHEN c_custkey % 6 = 1 THEN 'text/plain' ELSE 'image/png' END AS mime FROM customer WHERE c_custkey % 6 = 1 OR c_custkey % 12 = 6")
def s4_documents(spark: SparkSession, d: str) -> DataFrame:
    """Files of claims' folders that aren't known yet."""
    files = tree(spark, d)
    known = files.where("path LIKE '%/invoice.pdf'").select(F.element_at(F.split("path", "/"), 1).alias("claim"), "path")
    types = [{"id": "pan", "name": "PAN Card", "code": "PAN", "order": 1}]
    return S.documents(files, S.folder_claims(files, 1, 11), types, known).select("claim", "path", "type", "mime")


_SHEET_DATE = "CASE k % 4 WHEN 0 THEN DATE '2024-01-05' WHEN 1 THEN DATE '2024-01-05' WHEN 2 THEN DATE '2024-01-05' END"


@query(f"SELECT k, {_SHEET_DATE} AS invoice, CASE WHEN k % 10 = 0 THEN 'Claim Id is empty' WHEN k % 4 = 3 THEN 'Invoice Date is no date' END AS problem FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey < 200)")
def s5_sheet(spark: SparkSession, d: str) -> DataFrame:
    """A sheet whose columns stand in another order, with dates of all kinds and bad rows."""
    k = c("c_custkey")
    date = F.when(k % 4 == 0, "5/1/2024").when(k % 4 == 1, "45296").when(k % 4 == 2, "2024-01-05").otherwise("soon")
    rows = table(spark, d, "customer").where("c_custkey < 200").select(F.lit("x").alias("REMARKS "), date.alias("Invoice date"), F.when(k % 10 != 0, F.concat(F.lit("C"), k.cast("string"))).alias("claim-id"), F.lit("d").alias("Dealer Name"), F.lit("1").alias("Dealer Code"), F.lit("v").alias("VIN no."), k.cast("string").alias("Customer Name"), F.lit("s").alias("Scheme Type"))
    path = f"{own_folder(spark)}/sheet"
    sheets.write_report(rows.coalesce(1), path)
    read = sheets.problems(sheets.read_sheet(spark, path))
    return read.select(c("customerName").cast("long").alias("k"), sheets.cell_date(c("invoiceDate")).alias("invoice"), "problem")


@query("SELECT DISTINCT lower(p_type) AS word FROM part")
def s17_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    path = f"{own_folder(spark)}/words"
    table(spark, d, "part").select(F.lower("p_type").alias("value")).union(spark.createDataFrame([("# a comment",), ("",)], "value string")).write.text(path)
    return S.vocabulary(spark, path)


@query("SELECT c_custkey::VARCHAR AS \"Claim\", CASE c_custkey % 3 WHEN 0 THEN '''=1' WHEN 1 THEN '' ELSE 'x' END AS \"Note\", '2024-01-02' AS \"Day\" FROM customer")
def s19_claims_report(spark: SparkSession, d: str) -> DataFrame:
    """Written as CSV and read back."""
    k = c("c_custkey")
    rows = table(spark, d, "customer").select(k, F.when(k % 3 == 0, "=1").when(k % 3 == 2, "x").alias("note"), F.lit("2024-01-02").cast("date").alias("day"))
    path = f"{own_folder(spark)}/report"
    sheets.write_report(sheets.claims_report(rows, {"c_custkey": "Claim", "note": "Note", "day": "Day"}), path)
    return spark.read.option("header", True).csv(path).fillna("")


@query("SELECT row_number() OVER (ORDER BY c_nationkey, c_custkey) AS \"S No\", c_custkey::VARCHAR AS \"Claim Id\", CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'Forged' ELSE 'OK' END AS \"Status\", concat_ws(', ', CASE WHEN c_custkey % 5 = 0 THEN 'Spell Check' END, CASE WHEN c_custkey % 7 = 0 THEN 'Duplicate' END) AS \"Failed Checks\" FROM customer")
def s20_observations(spark: SparkSession, d: str) -> DataFrame:
    k = c("c_custkey")
    text = {name: F.lit(None).cast("string").alias(name) for name in ("dealerName", "dealerCode", "vinNo", "customerName", "schemeType", "remarks")}
    checks = [F.when(k % 5 == 0, "FAILED").otherwise("PASSED").alias(x) if x == "spell" else F.when(k % 7 == 0, "FAILED").otherwise("PENDING").alias(x) if x == "duplicate" else F.lit("PASSED").alias(x) for x in sheets.CHECKS.values()]
    rows = table(spark, d, "customer").select(k.alias("claimId"), c("c_nationkey").alias("createdAt"), F.lit("2024-01-02").cast("date").alias("invoiceDate"), *text.values(), *checks)
    return sheets.observation_report(rows).select("S No", "Claim Id", "Status", "Failed Checks")


@query("SELECT user_id AS claim, CASE event_type WHEN 'error' THEN 'Red Flags' WHEN 'view' THEN 'Spell Check' ELSE event_type END AS \"check\", event_id AS document, '''=' || event_id AS message FROM events WHERE value > 90")
def s21_findings_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(c("user_id").alias("claim"), c("event_type").alias("validator"), F.when(c("value") > 90, "ERROR").otherwise("INFO").alias("severity"), c("event_id").alias("document"), F.lit(1).alias("page"), F.concat(F.lit("="), c("event_id").cast("string")).alias("message"))
    return sheets.findings_report(rows, {"error": "Red Flags", "view": "Spell Check"}).drop("page")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND event_id % 10 = 0")
def s23_access_log(spark: SparkSession, d: str) -> DataFrame:
    """Appended twice, then what is older than a number of days is left out."""
    path = f"{own_folder(spark)}/log"
    rows = table(spark, d, "events").where("event_id % 10 = 0").select("event_id", c("ts").alias("at"))
    for part in (0, 1):
        sheets.append_log(rows.where(c("event_id") % 20 == 10 * part), path)
    return sheets.retained(spark.read.parquet(path), F.lit("2024-01-13").cast("date"), 10).select("event_id")


@query("SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'sessions', 0")
def s25_dump(spark: SparkSession, d: str) -> DataFrame:
    counts = sheets.dumped({"orders": table(spark, d, "orders"), "sessions": table(spark, d, "events")}, own_folder(spark))
    return spark.createDataFrame(sorted(counts.items()), "name string, n long")


@query("SELECT user_id AS claim, count(*) AS requests, CASE WHEN count(*) FILTER (value > 99.5) = 0 THEN array_to_string(list_sort(list(DISTINCT upper(event_type))), ',') END AS checks FROM events WHERE user_id % 3 > 0 GROUP BY user_id")
def z_queue(spark: SparkSession, d: str) -> DataFrame:
    """Requests as a stream of files; claims that run already are left out."""
    root = own_folder(spark)
    rows = table(spark, d, "events").select(c("user_id").alias("claim"), c("ts").alias("at"), F.when(c("value") <= 99.5, F.upper("event_type")).alias("checks"))
    rows.coalesce(1).write.json(f"{root}/requests")
    running = rows.where("claim % 3 = 0").select("claim").distinct()
    queue.run_queue(spark, f"{root}/requests", f"{root}/queued", f"{root}/state", running).awaitTermination()
    done = spark.read.parquet(f"{root}/queued")
    return done.select("claim", "requests", "checks")


@query("SELECT DISTINCT l_orderkey AS claim, 'new' AS reason FROM lineitem WHERE l_orderkey % 100 = 0 UNION ALL SELECT DISTINCT o.l_orderkey, 'partner' FROM lineitem o JOIN lineitem n ON o.l_partkey = n.l_partkey AND o.l_orderkey % 2 = n.l_orderkey % 2 WHERE n.l_orderkey % 100 = 0 AND o.l_orderkey % 100 > 0")
def z_affected(spark: SparkSession, d: str) -> DataFrame:
    """Claims whose findings change when every hundredth is read again."""
    lines = table(spark, d, "lineitem").select(c("l_orderkey").alias("claim"), F.lit("PART").alias("field"), c("l_partkey").cast("string").alias("norm")).distinct()
    claims = table(spark, d, "orders").select(c("o_orderkey").alias("claim"), (c("o_orderkey") % 2).alias("scope"), F.lit("ACTIVE").alias("status"))
    return queue.affected(lines, lines.where("claim % 100 = 0"), claims)


@query("SELECT o_custkey, count(*) AS n_runs, bool_or(o_orderstatus = 'F') AS any_failed, coalesce(sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 END), 0)::BIGINT AS urgent FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey ORDER BY n_runs DESC, o_custkey LIMIT 20 OFFSET 20")
def y_claim_list(spark: SparkSession, d: str) -> DataFrame:
    """A list of claims as an endpoint gives it: filter, counts, sort, page."""
    rows = table(spark, d, "orders").where(R.not_in(c("o_orderstatus"), ["P"]))
    counted = rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_runs"), F.bool_or(c("o_orderstatus") == "F").alias("any_failed"), F.count_if(c("o_orderpriority").startswith("1")).alias("urgent"))
    return R.page(counted, [F.desc("n_runs"), c("o_custkey")], 2, 20)


@query("SELECT event_id, 'k=' || (props::JSON ->> '$.k') AS shown FROM events")
def h_json(spark: SparkSession, d: str) -> DataFrame:
    """Details written as JSON and read back."""
    rows = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.from_json("props", "k int").alias("d"), F.array("event_type").alias("kinds"))).alias("details"))
    back = rows.withColumn("x", F.from_json("details", "d struct<k: int>, kinds array<string>"))
    return back.select("event_id", F.concat(F.lit("k="), c("x.d.k").cast("string")).alias("shown"))
