"""Queries of streams: the driver's tables cut into files that come one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.scratch import own_folder
from ..streaming import live_duplicates, runs, sessions
from .registry import query, table

c = F.col


#: Files that a stream takes at once, and so that a batch may have.
FILES = 1000


def in_batches(rows: list[DataFrame], path: str, stream: Callable[[], StreamingQuery]) -> None:
    """Each table as a batch of the stream, which takes all files that are there: they are written and read by many tasks."""
    for part in rows:
        part.repartition(min(FILES, int(part.sparkSession.conf.get("spark.sql.shuffle.partitions")))).write.mode("append").parquet(path)
        stream().awaitTermination()


@query(
    "WITH e AS (SELECT user_id, ts, event_type, event_type = 'purchase' AS starts, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_type = 'purchase', event_id) AS n FROM events) "
    "SELECT user_id AS claim, epoch_us(min(ts) FILTER (NOT starts)) AS at, epoch_us(max(ts) FILTER (starts)) AS started, count(*) FILTER (NOT starts) AS requests, "
    "CASE WHEN count(*) FILTER (event_type = 'signup') = 0 THEN array_to_string(list_sort(list(DISTINCT upper(event_type)) FILTER (NOT starts)), ',') END AS checks "
    "FROM e GROUP BY user_id, n - starts::INT HAVING count(*) FILTER (starts) > 0 AND count(*) FILTER (NOT starts) > 0"
)
def z_runs_over_time(spark: SparkSession, d: str) -> DataFrame:
    """Requests that wait over three batches, until a purchase starts their claim's run; a signup asks for all checks."""
    rows = table(spark, d, "events")
    starts = c("event_type") == "purchase"
    asked = F.when(~starts & (c("event_type") != "signup"), F.upper("event_type"))
    events = rows.select(c("user_id").alias("claim"), c("ts").alias("at"), F.when(starts, "START").otherwise("REQUEST").alias("kind"), asked.alias("checks"))
    ends = rows.where(starts).select(c("user_id").alias("claim"), (c("ts") + F.expr("INTERVAL 1 MICROSECOND")).alias("at"), F.lit("END").alias("kind"), F.lit(None).cast("string").alias("checks"))
    root = own_folder(spark, "runs")
    all_ = events.unionByName(ends)
    day = F.dayofmonth("at")
    parts = [all_.where(day <= 10), all_.where((day > 10) & (day <= 20)), all_.where(day > 20)]
    in_batches(parts, f"{root}/events", lambda: runs.run_stream(spark, f"{root}/events", f"{root}/runs", f"{root}/state", FILES))
    done = spark.read.parquet(f"{root}/runs")
    return done.select("claim", F.unix_micros("at").alias("at"), F.unix_micros("started").alias("started"), "requests", "checks")


@query(
    "WITH a AS (SELECT user_id, ((props::JSON ->> '$.k')::INT % 7)::VARCHAR AS token, ts FROM events), g AS (SELECT *, (coalesce(ts - lag(ts) OVER w >= INTERVAL 8 HOURS, true))::INT AS fresh FROM a WINDOW w AS (PARTITION BY user_id, token ORDER BY ts)), "
    "s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, token ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g), "
    "w AS (SELECT user_id, token, min(ts) AS created, max(ts) AS last, max(ts) + INTERVAL 8 HOURS AS expires, count(*) AS signs FROM s GROUP BY user_id, token, n) "
    "SELECT user_id, token, epoch_us(created) AS created, epoch_us(last) AS last, epoch_us(expires) AS expires, signs, CASE WHEN expires <= TIMESTAMP '2024-01-25 00:00:00' THEN 'EXPIRED' "
    "WHEN row_number() OVER (PARTITION BY user_id, expires > TIMESTAMP '2024-01-25 00:00:00' ORDER BY last DESC, created DESC, token) > 1 THEN 'EVICTED' ELSE 'ACTIVE' END AS status FROM w WHERE created <= TIMESTAMP '2024-01-25 00:00:00'"
)
def u11_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users' tokens that end after eight idle hours, and who is in at a time, one session a user."""
    activity = table(spark, d, "events").select("user_id", (F.get_json_object("props", "$.k").cast("int") % 7).cast("string").alias("token"), c("ts").alias("at"))
    found = sessions.standing(sessions.sessions(activity), F.lit("2024-01-25 00:00:00").cast("timestamp"), 1)
    micros = [F.unix_micros(c(x).cast("timestamp")).alias(x) for x in ("created", "last", "expires")]
    return found.select("user_id", "token", *micros, "signs", "status")


@query(
    "WITH v AS (SELECT o_orderkey AS claim, o_orderkey % 2 AS scope, 'C' || lpad((o_custkey + (o_orderkey % 50 = 0)::INT)::VARCHAR, 6, '0') AS value FROM orders WHERE o_orderkey % 50 <> 7), g AS (SELECT scope, value, list_sort(list(claim)) AS claims FROM v GROUP BY ALL) "
    "SELECT claim, 'DUP_CUST' AS code, value, len(claims) - 1 AS n_others, array_to_string(list_slice(list_filter(claims, lambda x: x <> claim), 1, 20), ',') AS others FROM v JOIN g USING (scope, value) WHERE len(claims) > 1"
)
def z_live_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """2.11: orders that share a customer, over four batches; the last sends some orders again with another customer, and some with none."""
    k = c("o_orderkey")
    orders = table(spark, d, "orders")

    def values(rows: DataFrame, customer, field: str | None = "CUST") -> DataFrame:  # noqa: ANN001
        norm = F.concat(F.lit("C"), F.lpad(customer.cast("string"), 6, "0"))
        return rows.select(k.alias("claim"), k.alias("document"), F.lit(1).alias("page"), F.lit(field).cast("string").alias("field"), norm.alias("value"), norm.alias("norm"))

    parts = [values(orders.where(k % 3 == i), c("o_custkey")) for i in range(3)]
    again = values(orders.where(k % 50 == 0), c("o_custkey") + 1).unionByName(values(orders.where(k % 50 == 7), c("o_custkey"), None))
    root = own_folder(spark, "live")
    claims = orders.select(k.alias("claim"), (k % 2).alias("scope"), F.lit("ACTIVE").alias("status"))
    in_batches([*parts, again], f"{root}/values", lambda: live_duplicates.duplicate_stream(spark, f"{root}/values", f"{root}/index", f"{root}/state", claims, FILES, 8))
    found = live_duplicates.LiveDuplicates(spark, f"{root}/index", 8).findings()
    return found.select("claim", "code", "value", "n_others", F.concat_ws(",", c("others").cast("array<string>")).alias("others"))


