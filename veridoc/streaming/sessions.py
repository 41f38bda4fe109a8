"""Sessions from activity: created by the first sign, kept by each further one, expired after an idle time, evicted beyond a number.

A session is the activity of a user with one token whose gaps are shorter than the idle time. session_window groups it
with a merge of partial sessions in each task, in batch and in streams; in a stream the watermark says when one can't
grow any more, and it comes out then, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

IDLE = "8 hours"
MOST = 3
ACTIVITY = "user_id long, token string, at timestamp"


def sessions(activity: DataFrame, idle: str = IDLE, late: str | None = None) -> DataFrame:
    """Activity (user_id, token, at) as user_id, token, created, last, expires, signs. late: a watermark, for streams.

    created and expires come of the signs and not of the window: a filter on the window would be moved below it and take
    signs away.
    """
    rows = activity.where("user_id is not null and at is not null")
    if late is not None:
        rows = rows.withWatermark("at", late)
    out = rows.groupBy("user_id", "token", F.session_window("at", idle).alias("w")).agg(F.min("at").alias("created"), F.max("at").alias("last"), F.count(F.lit(1)).alias("signs"))
    return out.select("user_id", "token", "created", "last", (F.col("last") + F.expr(f"INTERVAL {idle}")).alias("expires"), "signs")


def standing(found: DataFrame, now: Column, most: int = MOST) -> DataFrame:
    """Sessions with status at a time: EXPIRED, EVICTED (not among the user's latest so many by last sign), or ACTIVE.

    Sessions that begin later aren't there yet. A user's sessions are numbered one by one, as a user has few.
    """
    here = found.where(F.col("created") <= now)
    alive = F.col("expires") > now
    newest = Window.partitionBy("user_id", alive).orderBy(F.desc("last"), F.desc("created"), "token")
    rank = F.row_number().over(newest)
    return here.withColumn("status", F.when(~alive, "EXPIRED").when(rank > most, "EVICTED").otherwise("ACTIVE"))


def session_stream(spark, source: str, target: str, checkpoint: str, idle: str = IDLE, late: str = IDLE, files_per_batch: int = 1000) -> StreamingQuery:  # noqa: ANN001
    """Activity files (Parquet) as they come; a session is appended to target when the watermark has passed its end."""
    rows = spark.readStream.schema(ACTIVITY).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return sessions(rows, idle, late).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
