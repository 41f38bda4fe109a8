"""A queue of check requests as a stream: pending requests of a claim become one, and new documents bring their duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import duplicates as U
from ..operators.relational import widened

REQUEST = "claim long, at timestamp, checks string"


def coalesced(requests: DataFrame) -> DataFrame:
    """Requests (claim, at, checks: names parted by commas, null for all) as one a claim: its first time, and all checks asked for; oldest first."""
    chosen = F.split("checks", ",")
    return requests.groupBy("claim").agg(F.min("at").alias("at"), F.array_join(widened(chosen), ",").alias("checks"), F.count(F.lit(1)).alias("requests")).orderBy("at", "claim")


def run_queue(spark, source: str, target: str, checkpoint: str, running: DataFrame | None = None) -> StreamingQuery:  # noqa: ANN001
    """Reads request files (JSON lines) as they come; each batch appends its coalesced requests of claims that don't run yet to target.

    A batch that is done again writes to its own folder again, so nothing is lost or doubled.
    """

    def batch(rows: DataFrame, number: int) -> None:
        free = rows if running is None else rows.join(running.select("claim"), "claim", "left_anti")
        coalesced(free).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(REQUEST).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def affected(index: DataFrame, fresh: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims that new values touch: fresh (claim, field, norm, ...) of some claims replaces what index has of them.

    claim, reason: those that came, and their partners of before and now, whose findings change.
    """
    touched = fresh.select("claim").distinct()
    kept = index.join(touched, "claim", "left_anti")
    of_scope = lambda rows: rows.join(claims.where("status = 'ACTIVE'").select("claim", "scope"), "claim")
    keys = of_scope(fresh.select("claim", "field", "norm").unionByName(index.join(touched, "claim", "left_semi").select("claim", "field", "norm"))).select("scope", "field", "norm").distinct()
    partners = of_scope(kept.select("claim", "field", "norm")).join(keys, ["scope", "field", "norm"], "left_semi").select("claim").distinct().withColumn("reason", F.lit("partner"))
    return touched.withColumn("reason", F.lit("new")).unionByName(partners)


def updated_index(index: DataFrame, values: DataFrame) -> DataFrame:
    """The index after the values of some claims were read again."""
    fresh = U.field_index(values)
    return index.join(values.select("claim").distinct(), "claim", "left_anti").unionByName(fresh.select(*index.columns))
