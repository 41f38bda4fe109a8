"""Queries of lists, joins, windows, sets and rules over the driver's tables: orders are claims, customers are people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import findings as V
from ..operators import relational as R
from .registry import query, table

# ---- filters -----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'urg')")
def f1_claim_filter(spark: SparkSession, d: str) -> DataFrame:
    wanted = R.claim_filter({"o_orderstatus": "O", "o_custkey": None}, {"o_orderpriority": "Urg"})
    return table(spark, d, "orders").where(wanted).select("o_orderkey")


@query("SELECT 'scoped' AS view, o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'all', o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def f2_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise(F.col("o_orderstatus")))
    views = [("scoped", R.lifecycle(F.col("status"), "F")), ("all", R.lifecycle(F.col("status"), "F", everything=True))]
    a, b = (orders.where(keep).select(F.lit(name).alias("view"), "o_orderkey") for name, keep in views)
    return a.unionByName(b)


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def f3_row_scope(spark: SparkSession, d: str) -> DataFrame:
    grants = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return R.scoped(table(spark, d, "customer"), grants, "c_nationkey").select("c_custkey", "c_nationkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1')")
def f5_substring(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(R.contains_any(["p_name", "p_brand"], "brand#1")).select("p_partkey")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-04 00:00:00'")
def f6_date_range(spark: SparkSession, d: str) -> DataFrame:
    """From the second to the third of January, the third as a whole day."""
    return table(spark, d, "events").where(R.within_days(F.col("ts"), "2024-01-02", "2024-01-03")).select("event_id")


@query("SELECT event_id FROM events WHERE contains('[\"' || event_type || '\",\"x\"]', '\"error\"') AND event_id % 5 <> 0")
def f7_json_containment(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "not json").otherwise(F.to_json(F.array("event_type", F.lit("x")))).alias("ids"))
    return rows.where(R.json_has(F.col("ids"), "error")).select("event_id")


@query("SELECT user_id FROM (SELECT user_id, max(CASE WHEN event_type = 'error' AND value > 98 THEN event_id END) AS a, max(CASE WHEN event_type = 'click' AND value > 99 THEN event_id END) AS b FROM events GROUP BY user_id) WHERE a IS NOT NULL OR b IS NOT NULL")
def f8_any_present(spark: SparkSession, d: str) -> DataFrame:
    of = lambda kind, least: F.max(F.when((F.col("event_type") == kind) & (F.col("value") > least), F.col("event_id")))
    rows = table(spark, d, "events").groupBy("user_id").agg(of("error", 98).alias("a"), of("click", 99).alias("b"))
    return rows.where(R.any_present(["a", "b"])).select("user_id")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 300000)")
def f9_some(spark: SparkSession, d: str) -> DataFrame:
    dear = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return R.with_some(table(spark, d, "customer"), dear, "c_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def f10_none(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return R.without(table(spark, d, "customer"), urgent, "c_custkey").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END NOT IN ('F', 'P')")
def f11_not_in(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").where(R.not_in(status, ["F", "P"])).select("o_orderkey")


@query("SELECT o_orderkey AS claim_id, strftime(o_orderdate, '%Y-%m-%d') AS claim_date, coalesce(c.c_name, 'Unassigned') AS assignee FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c.c_custkey")
def f12_projection(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").where("c_acctbal > 0")
    rows = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select(F.col("o_orderkey").alias("claim_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("claim_date"), F.coalesce("c_name", F.lit("Unassigned")).alias("assignee"))


STATUS = "CASE {0} WHEN '1-URGENT' THEN 'FAILED' WHEN '2-HIGH' THEN 'DOUBTFUL' WHEN '3-MEDIUM' THEN 'DOCS_NOT_AVAILABLE' WHEN '5-LOW' THEN 'PENDING' ELSE 'PASSED' END"


def statuses(spark: SparkSession, d: str) -> DataFrame:
    """Orders with three check statuses, the second of the next order of the list, the third of its own status."""
    raw = F.expr(STATUS.format("o_orderpriority"))
    third = F.expr("CASE o_orderstatus WHEN 'F' THEN 'FAILED' ELSE 'PASSED' END")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", raw.alias("spell"), third.alias("qr"), F.when(F.col("o_orderkey") % 3 == 0, "FAILED").otherwise("IN_PROGRESS").alias("meta"))


@query(f"SELECT o_orderkey, CASE s WHEN 'FAILED' THEN 'FAILED' WHEN 'DOCS_NOT_AVAILABLE' THEN 'DOCS N/A' WHEN 'DOUBTFUL' THEN 'DOUBTFUL' ELSE 'PASSED' END AS spell FROM (SELECT o_orderkey, {STATUS.format('o_orderpriority')} AS s FROM orders)")
def f13_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return statuses(spark, d).select("o_orderkey", R.collapsed(F.col("spell")).alias("spell"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' OR o_orderstatus = 'F' OR o_orderkey % 3 = 0 THEN 'Forged' ELSE 'OK' END AS verdict FROM orders")
def f14_forgery(spark: SparkSession, d: str) -> DataFrame:
    return statuses(spark, d).select("o_orderkey", R.forgery_status(["spell", "qr", "meta"]).alias("verdict"))


@query("SELECT o_orderkey, concat_ws(', ', CASE WHEN o_orderpriority = '1-URGENT' THEN 'Spell Check' END, CASE WHEN o_orderstatus = 'F' THEN 'QR Code' END, CASE WHEN o_orderkey % 3 = 0 THEN 'Meta' END) AS failed FROM orders")
def f15_failed_names(spark: SparkSession, d: str) -> DataFrame:
    return statuses(spark, d).select("o_orderkey", R.failed_names({"Spell Check": "spell", "QR Code": "qr", "Meta": "meta"}).alias("failed"))


RULES = [
    (1, "lines", "GTE", "4"), (2, "lines", "LT", "2"), (3, "lines", "EQ", "3"), (4, "price", "GT", "200000"), (5, "price", "LTE", "100000"), (6, "lines", "NEQ", "5"), (7, "state", "EQ", "O"), (8, "state", "NEQ", "F"),
    (9, "spell", "EQ", "passed"), (10, "spell", "NEQ", "DOCS_NOT_AVAILABLE"), (11, "kinds", "EQ", "R"), (12, "kinds", "NEQ", "N"), (13, "state", "GT", "A"), (14, "price", "EQ", "x"),
]
_FACTS = f"""
f AS (SELECT o_orderkey, count(l_orderkey) AS lines, any_value(o_totalprice) AS price, any_value(o_orderstatus) AS state, any_value({STATUS.format("o_orderpriority")}) AS raw,
  list(DISTINCT l_returnflag) FILTER (l_returnflag IS NOT NULL) AS kinds FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
g AS (SELECT *, CASE raw WHEN 'FAILED' THEN 'FAILED' WHEN 'DOCS_NOT_AVAILABLE' THEN 'DOCS N/A' WHEN 'DOUBTFUL' THEN 'DOUBTFUL' ELSE 'PASSED' END AS spell FROM f)"""


@query(
    f"WITH {_FACTS} "
    + " UNION ALL ".join(
        f"SELECT o_orderkey, {k} AS rule, {test} AS passed FROM g"
        for k, test in enumerate(["lines >= 4", "lines < 2", "lines = 3", "price > 200000", "price <= 100000", "lines <> 5", "state = 'O'", "state <> 'F'", "spell = 'PASSED'", "spell <> 'DOCS N/A'", "coalesce(list_contains(kinds, 'R'), false)", "NOT coalesce(list_contains(kinds, 'N'), false)", "false", "false"], 1)
    )
)
def f17_rule_table(spark: SparkSession, d: str) -> DataFrame:
    """Rules are rows of a table; each meets the facts of its field."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.collect_set("l_returnflag").alias("kinds"))
    facts = statuses(spark, d).join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("state"), "spell", "kinds")
    rules = spark.createDataFrame(RULES, "rule int, field string, operator string, value string")
    return R.evaluated(facts, rules, "o_orderkey", ["lines", "price"], ["state"], ["spell"], ["kinds"]).select("o_orderkey", "rule", "passed")


@query("SELECT l_orderkey, l_linenumber, (l_quantity >= 30)::INT + (l_extendedprice < 20000)::INT + (l_returnflag <> 'R')::INT AS n_passed FROM lineitem")
def f17_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = [("l_quantity", "GTE", 30.0), ("l_extendedprice", "LT", 20000.0), ("l_returnflag", "NEQ", "R")]
    passed = [R.rule_passes(F.col(c), op, v) for c, op, v in rules]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sum((p.cast("int") for p in passed), F.lit(0)).alias("n_passed"))


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def f19_nested_filter(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.where("n_regionkey = 2").select("c_custkey")


@query("SELECT 'customers' AS asked, count(DISTINCT o_custkey) AS wanted, bool_and(o_custkey IN (SELECT c_custkey FROM customer)) AS all_known FROM orders UNION ALL SELECT 'rich', count(DISTINCT o_custkey), bool_and(o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) FROM orders")
def f20_containment(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    people = table(spark, d, "customer")
    a, b = (R.all_known(wanted, known, "c_custkey").select(F.lit(name).alias("asked"), "*") for name, known in (("customers", people), ("rich", people.where("c_acctbal > 0"))))
    return a.unionByName(b)


# ---- joins -------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j1_enrich(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    dims = n.join(r, n["n_regionkey"] == r["r_regionkey"], "left").select("n_nationkey", "n_name", "r_name")
    c = table(spark, d, "customer")
    return c.join(dims, c["c_nationkey"] == dims["n_nationkey"], "left").select("c_custkey", "n_name", "r_name")


@query("SELECT u.user_id, u.uses, c.c_name FROM (SELECT user_id, count(*) AS uses FROM events GROUP BY user_id) u LEFT JOIN customer c ON c.c_custkey = u.user_id ORDER BY uses DESC, user_id")
def j2_merged(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("uses"))
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return used.join(names, "user_id", "left").select("user_id", "uses", "c_name").orderBy(F.desc("uses"), "user_id")


@query("WITH w AS (SELECT DISTINCT l_returnflag FROM lineitem) SELECT p.l_partkey, w.l_returnflag FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 35) p, w EXCEPT SELECT l_partkey, l_returnflag FROM lineitem WHERE l_quantity > 35")
def j5_missing(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_quantity")
    return R.missing_required(lines.where("l_quantity > 35"), lines.select("l_returnflag").distinct(), "l_partkey", "l_returnflag")


@query("""SELECT r_name, n_name, c_custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000""")
def j6_nested(spark: SparkSession, d: str) -> DataFrame:
    """Regions with their nations with their customers, empty ones dropped; unfolded again to compare."""
    people = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    nations = R.nested(table(spark, d, "nation"), people, "n_nationkey", "c_custkey", "people")
    tree = R.nested(table(spark, d, "region"), nations.select(F.col("n_regionkey").alias("r_regionkey"), "n_name", "people"), "r_regionkey", "n_name", "nations")
    flat = tree.select("r_name", F.explode("nations").alias("n")).select("r_name", "n.n_name", F.explode("n.people").alias("p"))
    return flat.select("r_name", "n_name", "p.c_custkey")


@query("SELECT DISTINCT a.conv_id, a.role AS low, b.role AS high FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) <= 1 AND a.role < b.role")
def j7_pairs_nearby(spark: SparkSession, d: str) -> DataFrame:
    return R.pairs_nearby(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS error_before FROM events")
def j8_last_seen(spark: SparkSession, d: str) -> DataFrame:
    error = F.when(F.col("event_type") == "error", F.col("event_id"))
    return table(spark, d, "events").select("event_id", R.last_seen(error, ["user_id"], [F.col("ts"), F.col("event_id")]).alias("error_before"))


@query("SELECT conv_id, turn, front FROM (SELECT conv_id, turn, CASE WHEN role <> 'assistant' THEN role END AS kind, lag(CASE WHEN role <> 'assistant' THEN role END) OVER w AS front, lag(turn) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE kind IS NULL AND front IS NOT NULL AND t = turn - 1")
def j9_back_sides(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") != "assistant", F.col("role")).alias("kind"))
    return R.back_sides(rows, ["conv_id"], "turn", "kind").select("conv_id", "turn", "front")


@query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS survivor FROM part")
def j14_survivors(spark: SparkSession, d: str) -> DataFrame:
    return R.survivors(table(spark, d, "part"), ["p_name", "p_brand"], "p_partkey")


@query("SELECT o_custkey, o_orderkey FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def j15_latest_by_subquery(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the latest time, ties included."""
    last = F.max("o_orderdate").over(Window.partitionBy("o_custkey"))
    return table(spark, d, "orders").withColumn("last", last).where("o_orderdate = last").select("o_custkey", "o_orderkey")


@query("SELECT event_id, i AS place, i * (props::JSON ->> '$.k')::BIGINT AS v FROM events, (SELECT unnest([0, 1, 2]) AS i) WHERE event_id % 10 = 3")
def j16_json_rows(spark: SparkSession, d: str) -> DataFrame:
    """An array in a JSON column, one row for each element."""
    k = F.get_json_object("props", "$.k")
    rows = table(spark, d, "events").where("event_id % 10 = 3").select("event_id", F.format_string('{"extracted":[{"v":0},{"v":%s},{"v":%s}]}', k, (k.cast("long") * 2).cast("string")).alias("details"))
    shape = "struct<extracted: array<struct<v: bigint>>>"
    return rows.select("event_id", F.posexplode(F.from_json("details", shape)["extracted"]).alias("place", "e")).select("event_id", "place", "e.v")


@query("SELECT c_custkey AS key, 'old' AS origin FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def j17_insert_missing(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.mutations import insert_ignored

    old = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.lit("old").alias("origin"))
    return insert_ignored(old, table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.lit("new").alias("origin")), ["key"])


# ---- aggregates --------------------------------------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total, (SELECT count(*) FROM customer WHERE c_nationkey = 3) AS refs")
def a1_counts(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "orders").where("o_orderstatus = 'P'").agg(F.count(F.lit(1)).alias("total"))
    refs = table(spark, d, "customer").where("c_nationkey = 3").agg(F.count(F.lit(1)).alias("refs"))
    return total.crossJoin(refs)  # one row each


@query("SELECT user_id, count(*) AS uses FROM events WHERE event_type IS NOT NULL GROUP BY user_id ORDER BY uses DESC, user_id LIMIT 5")
def a2_top_used(spark: SparkSession, d: str) -> DataFrame:
    return R.top_used(table(spark, d, "events").where("event_type is not null"), "user_id", 5)


@query("SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49) AS children FROM part")
def a3_child_counts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return R.child_counts(table(spark, d, "part").select("p_partkey"), lines, "p_partkey", "children")


@query("SELECT user_id AS claim, event_type AS code, count(*) AS n FROM events WHERE value > 50 GROUP BY user_id, event_type")
def a4_code_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("claim"), F.col("event_type").alias("code"), F.when(F.col("value") > 50, "ERROR").otherwise("INFO").alias("severity"))
    return V.code_counts(rows, "claim")


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n_returned, count(*) FILTER (l_linestatus = 'O') AS n_open, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey")
def a5_conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"), F.count(F.lit(1)).alias("n_lines"))


@query("SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY user_id, event_type")
def a6_distinct_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values with the place where each was first seen, which keeps their order."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_at"))


@query("SELECT l_partkey, count(*) AS n_owners, array_to_string(list_slice(list_sort(list(l_orderkey)), 1, 20), ',') AS owners FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) GROUP BY l_partkey HAVING count(*) > 1")
def a7_shared_values(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey")
    out = R.shared_values(lines, ["l_partkey"], "l_orderkey")
    return out.select("l_partkey", "n_owners", F.concat_ws(",", F.col("owners").cast("array<string>")).alias("owners"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS k FROM lineitem) SELECT l_orderkey, l_returnflag, max(CASE WHEN k = 1 THEN l_linenumber END) AS l_linenumber, coalesce(array_to_string(list_sort(list(DISTINCT l_linenumber) FILTER (k > 1)), ','), '') AS others FROM r GROUP BY l_orderkey, l_returnflag")
def a8_first_of(spark: SparkSession, d: str) -> DataFrame:
    out = R.first_of(table(spark, d, "lineitem"), ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey"], "l_linenumber")
    return out.select("l_orderkey", "l_returnflag", "l_linenumber", F.coalesce(F.array_join(F.col("other_l_linenumber").cast("array<string>"), ","), F.lit("")).alias("others"))


@query("SELECT user_id, round(avg((value > 50)::INT), 9) AS share, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def a10_ratio_a13_mean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg((F.col("value") > 50).cast("int")), 9).alias("share"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT l_orderkey, min(l_tax) AS x, min(l_discount) AS y, round(max(l_tax + l_quantity) - min(l_tax), 9) AS w, round(max(l_discount + l_linenumber) - min(l_discount), 9) AS h FROM lineitem GROUP BY l_orderkey")
def a11_union_box(spark: SparkSession, d: str) -> DataFrame:
    box = R.union_box(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity"), F.col("l_linenumber"))
    out = table(spark, d, "lineitem").groupBy("l_orderkey").agg(*box)
    return out.select("l_orderkey", "x", "y", F.round("w", 9).alias("w"), F.round("h", 9).alias("h"))


@query("SELECT p_name, p_brand, min(p_partkey) AS kept FROM part GROUP BY p_name, p_brand")
def a14_least_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("kept"))


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS docs FROM orders")
def a15_scalar_count(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.child_counts(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", "docs")


@query("SELECT user_id, CASE WHEN count(*) FILTER (value > 99.5) = 0 THEN array_to_string(list_sort(list(DISTINCT event_type)), ',') END AS checks FROM events GROUP BY user_id")
def a16_widened(spark: SparkSession, d: str) -> DataFrame:
    """Checks that are asked for, per user; an event of a high value asks for all, which is null."""
    chosen = F.when(F.col("value") > 99.5, None).otherwise(F.array("event_type"))
    out = table(spark, d, "events").groupBy("user_id").agg(R.widened(chosen).alias("checks"))
    return out.select("user_id", F.array_join("checks", ",").alias("checks"))


@query(f"WITH {_FACTS} SELECT o_orderkey, (lines >= 4)::BIGINT + (price > 200000)::BIGINT + (state = 'O')::BIGINT AS n_passed FROM g")
def a17_pass_count(spark: SparkSession, d: str) -> DataFrame:
    return f17_rule_table(spark, d).where("rule in (1, 4, 7)").groupBy("o_orderkey").agg(F.count_if("passed").alias("n_passed"))


# ---- windows -----------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def w1_latest(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT user_id, event_id, value FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w2_latest_of_kind(spark: SparkSession, d: str) -> DataFrame:
    errors = table(spark, d, "events").where("event_type = 'error'")
    return R.latest(errors, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "value")


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'RUNNING' WHEN bool_or(o_orderstatus = 'O') THEN 'QUEUED' END AS state FROM orders GROUP BY o_custkey")
def w3_precedence(spark: SparkSession, d: str) -> DataFrame:
    place = V.ranked_by(F.col("o_orderstatus"), ["P", "O"])
    best = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(place).alias("best"))
    return best.select("o_custkey", F.when(F.col("best") == 1, "RUNNING").when(F.col("best") == 2, "QUEUED").alias("state"))


_SEEN = "(SELECT o_orderdate AS a, o_orderkey AS k FROM orders WHERE o_orderkey = 4711)"


@query(
    f"SELECT 'next' AS side, o_orderkey FROM (SELECT o_orderkey FROM orders, {_SEEN} WHERE o_orderdate < a OR (o_orderdate = a AND o_orderkey < k) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 3) "
    f"UNION ALL SELECT 'before', o_orderkey FROM (SELECT o_orderkey FROM orders, {_SEEN} WHERE o_orderdate > a OR (o_orderdate = a AND o_orderkey > k) ORDER BY o_orderdate, o_orderkey LIMIT 3)"
)
def w4_keyset(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    seen = orders.where("o_orderkey = 4711").select("o_orderdate", "o_orderkey").first()
    after = tuple(seen) if seen else None
    a, b = (R.keyset_page(orders, "o_orderdate", "o_orderkey", after, 3, back).select(F.lit(name).alias("side"), "o_orderkey") for name, back in (("next", False), ("before", True)))
    return a.unionByName(b)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS s_no FROM orders")
def w5_serial(spark: SparkSession, d: str) -> DataFrame:
    return R.serial_numbers(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], chunks=8).select("o_orderkey", "s_no")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS rank FROM events")
def w6_fixed_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", V.ranked_by(F.col("event_type"), ["error", "purchase", "view"]).alias("rank"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def w7_last_three(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id")


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) <= 20")
def w8_first_children(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]
    return R.latest(table(spark, d, "lineitem"), ["l_partkey"], order, 20).select("l_partkey", "l_orderkey", "l_linenumber")


@query("WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'view'), b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'click') SELECT user_id, k AS kth, a.event_id AS view_id, b.event_id AS click_id FROM a JOIN b USING (user_id, k)")
def w9_kth(spark: SparkSession, d: str) -> DataFrame:
    of = lambda kind: table(spark, d, "events").where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{kind}_id"))
    return R.kth_matches(of("view"), of("click"), ["user_id"], "view_id", "click_id").withColumn("kth", F.col("kth").cast("long"))


@query("SELECT conv_id, turn, spent_before FROM (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM conversations) WHERE spent_before < 400")
def w10_prefix_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("size", F.length("text").cast("long"))
    return R.prefix_budget(rows, "conv_id", "turn", "size", 400).select("conv_id", "turn", "spent_before")


# ---- order and caps ----------------------------------------------------------------------------------------------


@query("SELECT 'price' AS sorted_by, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10) UNION ALL SELECT 'unknown', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10)")
def o1_sort_keys(spark: SparkSession, d: str) -> DataFrame:
    allowed = {"price": "o_totalprice", "id": "o_orderkey"}
    orders = table(spark, d, "orders")
    a, b = (R.page(orders, R.sort_order(key, False, allowed, "o_orderdate", "o_orderkey"), 1, 10).select(F.lit(key).alias("sorted_by"), "o_orderkey") for key in ("price", "unknown"))
    return a.unionByName(b)


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def o2_page(spark: SparkSession, d: str) -> DataFrame:
    return R.page(table(spark, d, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 25).select("o_orderkey")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_name, p_partkey) AS place FROM part")
def o3_many_keys(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_name", "p_partkey"))
    return table(spark, d, "part").select("p_partkey", place.cast("long").alias("place"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY lower(p_name), p_partkey) AS place FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS p_name FROM part)")
def o4_locale_order(spark: SparkSession, d: str) -> DataFrame:
    """Names in the order of a locale, where case comes after letters."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    place = F.row_number().over(Window.partitionBy("p_size").orderBy(F.collate(name, "UNICODE_CI"), "p_partkey"))
    return table(spark, d, "part").select("p_partkey", place.cast("long").alias("place"))


@query("SELECT 'few' AS asked, o_orderkey FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'many', o_orderkey FROM orders WHERE o_custkey < 0")
def o5_refusal(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    a, b = (R.capped(rows, 500).select(F.lit(name).alias("asked"), "o_orderkey") for name, rows in (("few", orders.where("o_custkey = 7")), ("many", orders)))
    return a.unionByName(b)


@query("SELECT user_id, event_id FROM events WHERE value > 20 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 200")
def o6_caps(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(table(spark, d, "events").where("value > 20"), ["user_id"], [F.desc("value"), F.col("event_id")], 200).select("user_id", "event_id")


@query("SELECT p_brand, arg_min(p_partkey, {'a': p_size, 'b': p_name, 'c': p_partkey}) AS p_partkey FROM part GROUP BY p_brand")
def o7_lowest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_size", "p_name", "p_partkey")).alias("p_partkey"))


@query("WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type), m AS (SELECT user_id, max(n) AS top FROM s GROUP BY user_id) SELECT user_id, CASE WHEN count(*) = 1 THEN min(event_type) END AS winner FROM s JOIN m USING (user_id) WHERE n = top GROUP BY user_id")
def o9_strict_winner(spark: SparkSession, d: str) -> DataFrame:
    """The kind of the highest score; a tie has no winner."""
    scores = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    ranked = scores.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("n", "event_type")), asc=False).alias("s"))  # a few kinds
    tie = (F.size("s") > 1) & (F.get("s", F.lit(1))["n"] == F.get("s", F.lit(0))["n"])
    return ranked.select("user_id", F.when(~tie, F.get("s", F.lit(0))["event_type"]).alias("winner"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY o_orderdate, o_orderkey LIMIT 1")
def o10_oldest(spark: SparkSession, d: str) -> DataFrame:
    """The oldest queued run of a claim that has none running."""
    orders = table(spark, d, "orders")
    idle = R.without(orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus = 'P'"), "o_custkey")
    return idle.orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


# ---- sets --------------------------------------------------------------------------------------------------------


@query("SELECT 0 AS part, user_id, event_id FROM events WHERE event_type = 'error' UNION ALL SELECT 1, user_id, event_id FROM events WHERE value > 50")
def x1_union_all(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return V.united(*[rows.select("user_id", "event_id") for rows in (e.where("event_type = 'error'"), e.where("value > 50"))])


@query("SELECT user_id FROM events WHERE event_type = 'error' AND value > 95 UNION SELECT user_id FROM events WHERE event_type = 'view' AND value > 95")
def x2_union(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value > 95")
    return e.where("event_type = 'error'").select("user_id").union(e.where("event_type = 'view'").select("user_id")).distinct()


@query("SELECT user_id FROM events EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 80")
def x3_except(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("user_id").subtract(e.where("event_type = 'error' and value > 80").select("user_id"))


@query("SELECT user_id FROM events WHERE event_type = 'error' AND value > 80 INTERSECT SELECT user_id FROM events WHERE event_type = 'view' AND value > 80")
def x4_intersect(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value > 80")
    return e.where("event_type = 'error'").select("user_id").intersect(e.where("event_type = 'view'").select("user_id"))


@query("SELECT a.l_orderkey FROM (SELECT l_orderkey, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY l_orderkey) a WHERE list_has_all(['A', 'R'], f)")
def x5_subset(spark: SparkSession, d: str) -> DataFrame:
    flags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return flags.where(F.size(F.array_except("f", F.lit(["A", "R"]))) == 0).select("l_orderkey")


@query("SELECT event_id FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'error' AND c.user_id = e.user_id AND date_trunc('day', c.ts) = date_trunc('day', e.ts))")
def x6_suppressed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    return V.suppressed(e.where("event_type = 'view'"), e.where("event_type = 'error'"), ["user_id", "day"]).select("event_id")


# ---- findings as the client shows them ----------------------------------------------------------------------------

_CODES = "CASE event_type WHEN 'error' THEN 'META' WHEN 'purchase' THEN 'REDFLAG' WHEN 'view' THEN 'SPELL' ELSE 'DUP' END"


def shown_findings(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("value") > 50, "ERROR").otherwise("INFO")
    return table(spark, d, "events").select("event_id", "user_id", F.expr(_CODES).alias("validator"), severity.alias("severity"), F.concat(F.lit("Value "), F.floor("value").cast("string")).alias("message"), (F.col("event_id") % 4).alias("page"))


@query(f"SELECT event_id, CASE {_CODES} WHEN 'REDFLAG' THEN 1 WHEN 'DUP' THEN 2 ELSE 3 END AS rank FROM events WHERE event_type <> 'error'")
def v1_shown(spark: SparkSession, d: str) -> DataFrame:
    return V.shown(shown_findings(spark, d)).select("event_id", V.ranked_by(F.col("validator"), ["REDFLAG", "DUP"]).alias("rank"))


@query(f"SELECT user_id, {_CODES} AS validator, count(*) AS n FROM events GROUP BY ALL")
def v2_counts(spark: SparkSession, d: str) -> DataFrame:
    return shown_findings(spark, d).groupBy("user_id", "validator").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN sum((event_id % 4 > 0)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) END::BIGINT AS number FROM events")
def v3_numbered(spark: SparkSession, d: str) -> DataFrame:
    return V.numbered(shown_findings(spark, d), ["user_id"], ["event_id"], F.col("page") > 0).select("event_id", "number")


@query("SELECT event_id FROM events WHERE event_type <> 'error' AND value > 50 AND contains('value ' || floor(value)::INT, 'ue 7')")
def v4_searched(spark: SparkSession, d: str) -> DataFrame:
    return V.shown(shown_findings(spark, d), severity="ERROR", text="ue 7").select("event_id")


@query("WITH m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT user_id, run::BIGINT AS run, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY ALL")
def v5_runs(spark: SparkSession, d: str) -> DataFrame:
    return V.runs(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", ["event_type"])


@query(f"SELECT {_CODES} AS validator, user_id, count(*) AS n FROM events WHERE value > 50 GROUP BY ALL")
def v6_two_levels(spark: SparkSession, d: str) -> DataFrame:
    """Errors by check and document, unfolded again to compare."""
    tree = V.grouped(shown_findings(spark, d).where("severity = 'ERROR'"), "validator", "user_id", "event_id")
    return tree.select("validator", F.explode("groups").alias("g")).select("validator", "g.user_id", F.size("g.items").cast("long").alias("n"))
