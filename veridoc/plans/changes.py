"""Queries of changes: upserts, insert-ignore, rewrites, transitions, bulk reports, guards and access codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mutations as U
from .registry import query, table


@query("SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v, o.status, CASE WHEN o.k IS NULL THEN 'created' WHEN n.k IS NULL THEN 'kept' ELSE 'updated' END AS verdict FROM (SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS status FROM customer WHERE c_custkey % 3 > 0) o FULL JOIN (SELECT c_custkey AS k, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 2 = 0 AND c_acctbal >= 0) n ON o.k = n.k")
def u1_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the old table by key, business columns overwritten, the status untouched; bad new rows are set aside."""
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("status"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") + 1).alias("v"))
    good, _ = U.accepted(new, F.when(F.col("v") < 1, "negative balance"))
    return U.upserted(old, good, ["k"], ["v"])


@query("SELECT c_custkey AS k, 'old' AS origin FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT DISTINCT user_id, 'new' FROM events WHERE user_id % 5 <> 0 OR user_id NOT IN (SELECT c_custkey FROM customer)")
def u2_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("k"), F.lit("old").alias("origin"))
    return U.insert_ignored(old, table(spark, d, "events").select(F.col("user_id").alias("k"), F.lit("new").alias("origin")), ["k"])


@query("SELECT l_orderkey AS claim, l_partkey AS value FROM lineitem WHERE l_orderkey % 10 <> 0 UNION ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 20 = 0 AND l_quantity > 25")
def u3_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth claim is read again; what it doesn't have any more is gone."""
    old = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_partkey").alias("value"))
    new = table(spark, d, "lineitem").where("l_orderkey % 20 = 0 and l_quantity > 25").select(F.col("l_orderkey").alias("claim"), F.col("l_partkey").alias("value"))
    return U.rewritten(old, new, "claim", old.where("claim % 10 = 0"))


@query("WITH r AS (SELECT user_id AS claim, event_id AS seen, CASE event_type WHEN 'purchase' THEN 'CLOSED' WHEN 'click' THEN 'REVIEW' WHEN 'view' THEN 'SEEN' END AS s FROM events WHERE event_id % 50 = 0), e AS (SELECT claim, arg_min(s, seen) FILTER (s = 'CLOSED') AS ended, arg_max(s, seen) AS last FROM r WHERE s IS NOT NULL GROUP BY claim) SELECT c_custkey AS claim, CASE WHEN c_custkey % 9 = 0 THEN 'CLOSED' ELSE coalesce(ended, last, 'NEW') END AS status FROM customer LEFT JOIN e ON claim = c_custkey")
def u5_transitions(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "customer").select(F.col("c_custkey").alias("claim"), F.when(F.col("c_custkey") % 9 == 0, "CLOSED").otherwise("NEW").alias("status"))
    after = F.expr("CASE event_type WHEN 'purchase' THEN 'CLOSED' WHEN 'click' THEN 'REVIEW' WHEN 'view' THEN 'SEEN' END")
    remarks = table(spark, d, "events").where("event_id % 50 = 0").select(F.col("user_id").alias("claim"), F.col("event_id").alias("at"), after.alias("status_after"))
    return U.after_remarks(claims, remarks, spark.createDataFrame([("CLOSED",)], "status string"), "claim", ["at"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'REVIEW' ELSE 'VALIDATED' END ELSE o_orderstatus END AS status FROM orders")
def u6_advance(spark: SparkSession, d: str) -> DataFrame:
    moved = U.advanced(F.col("o_orderstatus"), "O", F.col("o_orderpriority") == "1-URGENT", "REVIEW", "VALIDATED")
    return table(spark, d, "orders").select("o_orderkey", moved.alias("status"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 > 0 THEN 'DELETED' ELSE 'ACTIVE' END AS status FROM customer")
def u7_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    """Deleted twice, which is as good as once, then some restored."""
    rows = table(spark, d, "customer").select("c_custkey", F.lit("ACTIVE").alias("status"))
    for _ in range(2):
        rows = rows.withColumn("status", U.soft_deleted(F.col("status"), F.col("c_custkey") % 4 == 0))
    return rows.withColumn("status", U.restored(F.col("status"), F.col("c_custkey") % 8 == 0))


@query("SELECT count(*) AS requested, count(*) FILTER (c_acctbal >= 0) AS succeeded, count(*) FILTER (c_acctbal < 0) AS failed, coalesce(string_agg(c_custkey::VARCHAR || ':NEGATIVE', ',' ORDER BY c_custkey) FILTER (c_acctbal < 0), '') AS failures FROM customer WHERE c_custkey < 400")
def u8_bulk_report(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "customer").where("c_custkey < 400")
    out = U.bulk_report(targets, F.when(F.col("c_acctbal") < 0, "NEGATIVE"), "c_custkey")
    return out.select("requested", "succeeded", "failed", F.array_join(F.transform("failures", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["problem"])), ",").alias("failures"))


@query("SELECT count(*) FILTER (n_nationkey = 4) AS defaults, true AS \"right\" FROM nation")
def u9_one_default(spark: SparkSession, d: str) -> DataFrame:
    return U.defaults_right(table(spark, d, "nation").select((F.col("n_nationkey") == 4).alias("is_default"), F.lit("ACTIVE").alias("status")))


_TERMS = "SELECT DISTINCT p_type AS term FROM part"


@query(f"WITH t AS (SELECT term, row_number() OVER (ORDER BY term) AS k FROM ({_TERMS})), o AS (SELECT term, 'old' AS expansion, CASE WHEN k % 3 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status FROM t WHERE k % 4 <> 1), n AS (SELECT term, CASE WHEN k % 2 = 0 THEN 'new' END AS expansion FROM t WHERE k % 5 <> 0) SELECT term, coalesce(n.expansion, o.expansion) AS expansion, CASE WHEN n.term IS NOT NULL THEN 'ACTIVE' ELSE o.status END AS status, CASE WHEN o.term IS NULL THEN 'created' WHEN n.term IS NULL THEN 'kept' WHEN o.status <> 'ACTIVE' THEN 'reactivated' ELSE 'updated' END AS verdict FROM o FULL JOIN n USING (term)")
def u10_glossary(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(_by_term())
    terms = table(spark, d, "part").select(F.col("p_type").alias("term")).distinct().withColumn("k", k)
    old = terms.where("k % 4 <> 1").select("term", F.lit("old").alias("expansion"), F.when(F.col("k") % 3 == 0, "INACTIVE").otherwise("ACTIVE").alias("status"))
    new = terms.where("k % 5 <> 0").select("term", F.when(F.col("k") % 2 == 0, "new").alias("expansion"))
    return U.glossary(old, new)


def _by_term():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.orderBy("term")  # a handful of terms


@query("SELECT user_id, least(900, CASE WHEN n >= 5 THEN 900 WHEN n = 0 THEN 0 ELSE (2 ** (n - 1))::BIGINT END)::BIGINT AS seconds FROM (SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 60) AS n FROM events GROUP BY user_id)")
def u11_lockout(spark: SparkSession, d: str) -> DataFrame:
    """Waiting time by the number of failures."""
    failures = table(spark, d, "events").groupBy("user_id").agg(F.count_if((F.col("event_type") == "error") & (F.col("value") > 60)).alias("n"))
    return failures.select("user_id", U.lockout_seconds(F.col("n")).alias("seconds"))


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'NO_USER' WHEN c_acctbal < 0 THEN 'BLOCKED' WHEN o_orderstatus <> 'O' THEN 'INACTIVE' WHEN n_regionkey <> 1 THEN 'WRONG_PROJECT' ELSE 'OK' END AS code FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def u12_access(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
    checks = [("NO_USER", F.col("c_custkey").isNotNull()), ("BLOCKED", F.col("c_acctbal") >= 0), ("INACTIVE", F.col("o_orderstatus") == "O"), ("WRONG_PROJECT", F.col("n_regionkey") == 1)]
    return rows.select("o_orderkey", U.access_code(checks).alias("code"))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def u13_purge_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a purge would delete, as its dry run prints it."""
    one, *more = [table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("orders", "lineitem", "events")]
    for rows in more:
        one = one.unionByName(rows)
    return one


@query("SELECT DISTINCT p_name AS term, CASE WHEN p_name NOT IN (SELECT p_name FROM part WHERE p_size > 45) THEN 'missing' ELSE 'dormant' END AS state FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 48)")
def u14_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    stored = part.where("p_size > 45").groupBy(F.col("p_name").alias("term")).agg(F.when(F.max("p_size") > 48, "ACTIVE").otherwise("INACTIVE").alias("status"))
    return U.vocabulary_gaps(part.select(F.col("p_name").alias("term")), stored)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax = l_discount")
def u15_columns_equal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where(F.col("l_tax") == F.col("l_discount")).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey IN (1, 2, 3, 5, 8, 13, 21, 34)")
def u16_revalidate(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    asked = table(spark, d, "orders").where(F.col("o_orderkey").isin(1, 2, 3, 5, 8, 13, 21, 34))
    return asked.join(lines, "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 4 THEN 'DEFAULT' WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) THEN 'IN_USE' END AS refusal FROM nation")
def u17_guards(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return U.may_go(table(spark, d, "nation").withColumn("is_default", F.col("n_nationkey") == 4), used, "n_nationkey")
