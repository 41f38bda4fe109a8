"""Queries of whole runs: all checks at once, and payloads as rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payloads
from ..operators import checks as A
from ..sources.scratch import stored
from . import checks as H
from . import papers as P
from . import scalars as V
from .registry import ORACLE, query, table

c = F.col

_PAGE_ERRORS = [where for code, (_, where) in H._PAGE_FLAGS.items() if code not in ("REDFLAG_PAN_OK", "REDFLAG_PASSPORT_OK")]
_FLAGGED = " OR ".join(f"({x})" for x in [*_PAGE_ERRORS, "k % 8 = 4", "k % 12 = 6", "k % 47 = 14", "k % 53 = 15 AND k % 19 <> 7 AND k % 11 <> 5 AND k % 17 <> 6"])
_DIFFERS = "k % 23 = 8 OR k % 29 = 9 OR k % 53 = 15 OR k % 10 = 7"
_SCANNED = "k % 5 IN (1, 2, 4) OR k % 10 = 0 OR k % 15 = 9 OR k % 29 = 9 AND k % 5 = 0"


def inputs(spark: SparkSession, d: str) -> A.Inputs:
    codes, pages, _, scans = H.scanned(spark, d)
    return A.Inputs(stored(P.claims(spark, d).select("claim", "scope", "status", "vin", "customer")), pages, H.DAY, codes=codes, scans=scans)


@query(f"WITH {H.CLAIMS} SELECT k AS claim, v AS validator, CASE WHEN CASE v WHEN 'INTRA' THEN false WHEN 'QR' THEN {_SCANNED} WHEN 'REDFLAG' THEN {_FLAGGED} WHEN 'COMPARE' THEN {_DIFFERS} ELSE true END THEN 'FAILED' ELSE 'PASSED' END AS status FROM c, (VALUES ('INTRA'), ('QR'), ('REDFLAG'), ('COMPARE'), ('DUP')) AS t(v)")
def y_all_checks(spark: SparkSession, d: str) -> DataFrame:
    """2.12: every check that the papers have tables for, in one run, and each claim's verdicts."""
    x = inputs(spark, d)
    return A.verdicts(x, A.run_checks(x)).select("claim", "validator", "status")


@query("SELECT p_partkey, parsed FROM (" + ORACLE["c6_payloads"] + ")")
def c6_payload_rows(spark: SparkSession, d: str) -> DataFrame:
    """C6 through the table function, in SQL."""
    payloads.register(spark)
    codes = table(spark, d, "part").select("p_partkey", F.element_at(F.lit(V._PAYLOADS), (c("p_partkey") % 5).cast("int") + 1).alias("value"))
    text = "array_join(transform(array_sort(collect_list(struct(e.place, concat(e.key, '=', e.value) AS text))), x -> x.text), ';')"
    rows = f"SELECT c.p_partkey, {text} AS parsed FROM {{codes}} AS c, LATERAL payload_entries(c.value) AS e GROUP BY c.p_partkey"
    return spark.sql(f"SELECT c.p_partkey, coalesce(r.parsed, '') AS parsed FROM {{codes}} AS c LEFT JOIN ({rows}) AS r ON c.p_partkey = r.p_partkey", codes=codes)


_PRINTED = "k % 5 < 3"


@query(
    f"WITH {H.CLAIMS}, s AS (SELECT * FROM c WHERE {_PRINTED}) SELECT k AS claim, 'Insured''s Name' AS label, CASE WHEN k % 5 = 1 THEN 'NOBODY ELSE' ELSE name END AS code_value FROM s UNION ALL SELECT k, 'Policy No', CASE WHEN k % 5 = 2 THEN 'XX-99-999999' ELSE policy END FROM s "
    "UNION ALL SELECT k, 'Chassis No', 'WVE1RTY2UKP' || lpad((CASE WHEN k % 10 = 0 THEN k + 7 ELSE k END)::VARCHAR, 6, '0') FROM s"
)
def j11_payload_join(spark: SparkSession, d: str) -> DataFrame:
    """J11 through the table function: entries of codes met with the labels that their keys answer to."""
    from ..operators.codes import KEYS

    payloads.register(spark)
    codes, _, _, _ = H.scanned(spark, d)
    keys = spark.createDataFrame([(k, labels[0]) for k, labels in KEYS.items()], "key string, label string")
    return spark.sql("SELECT c.claim, k.label, e.value AS code_value FROM {codes} AS c, LATERAL payload_entries(c.value) AS e JOIN {keys} AS k ON e.key = k.key", codes=codes, keys=keys)
