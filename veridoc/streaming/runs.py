"""Runs of checks over time: one pending run per claim, whose checks widen while it waits.

Events are (claim, at, kind, checks): a REQUEST asks for checks (names parted by commas, null for all), a START takes
the claim's pending run if the claim doesn't run, and an END lets it be taken again. The state of a claim is its pending
run and whether it runs, so requests meet across batches, and a run comes out once, when it is taken. Within a batch a
claim's events are taken by time; at one time requests come first, then ENDs, then STARTs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "claim long, at timestamp, kind string, checks string"
RUN = "claim long, at long, started long, checks string, requests long"
STATE = "at long, checks string, everything boolean, requests long, running boolean"
ORDER = {"REQUEST": 0, "END": 1, "START": 2}


def advance(state: tuple, events: list[tuple[int, str, str | None]]) -> tuple[tuple, list[tuple]]:
    """State (at, checks, everything, requests, running) after events (at, kind, checks) in order, and the runs that started: at, started, checks, requests."""
    at, checks, everything, requests, running = state
    wanted = set(checks.split(",")) if checks else set()
    runs = []
    for when, kind, asked in events:
        if kind == "REQUEST":
            at = when if requests == 0 else min(at, when)
            requests += 1
            everything |= asked is None
            wanted |= {x.strip() for x in (asked or "").split(",")} - {""}
        elif kind == "END":
            running = False
        elif kind == "START" and requests and not running:
            runs.append((at, when, None if everything else ",".join(sorted(wanted)), requests))
            at, wanted, everything, requests, running = 0, set(), False, 0, True
    return (at, ",".join(sorted(wanted)), everything, requests, running), runs


def _stateful(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    events = sorted((int(e.at), ORDER.get(e.kind, 3), e.kind, e.checks) for chunk in chunks for e in chunk.replace({float("nan"): None}).itertuples())
    now, runs = advance(state.get if state.exists else (0, "", False, 0, False), [(at, kind, checks) for at, _, kind, checks in events])
    state.update(now)
    yield pd.DataFrame([(key[0], *r) for r in runs], columns=["claim", "at", "started", "checks", "requests"])


def started_runs(events: DataFrame) -> DataFrame:
    """Of a stream of events the runs that start: claim, at (of the first request), started, checks (null for all), requests.

    Events without a claim or time are left out; those of an unknown kind change nothing. State is one small row a claim.
    """
    rows = events.where("claim is not null and at is not null").select("claim", F.unix_micros("at").alias("at"), "kind", F.coalesce("checks", F.when(F.col("kind") != "REQUEST", "")).alias("checks"))
    runs = rows.groupBy("claim").applyInPandasWithState(_stateful, RUN, STATE, "append", GroupStateTimeout.NoTimeout)
    return runs.select("claim", F.timestamp_micros("at").alias("at"), F.timestamp_micros("started").alias("started"), "checks", "requests")


def run_stream(spark, source: str, target: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:  # noqa: ANN001
    """Event files (Parquet) as they come; started runs are appended to target, each once."""
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return started_runs(events).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
