"""Streams against the same work done at once: pending runs, sessions, duplicates; and joins and lists of hot values."""

import os
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veridoc.operators import duplicates, relational
from veridoc.streaming import live_duplicates, runs, sessions

START = datetime(2024, 1, 1)


def queued(events):
    """Runs by hand: claim, at, started, checks, requests."""
    out = []
    by = defaultdict(list)
    for claim, at, kind, checks in events:
        by[claim].append((at, {"REQUEST": 0, "END": 1, "START": 2}[kind], kind, checks))
    for claim, rows in by.items():
        pending, running = [], False
        for at, _, kind, checks in sorted(rows, key=lambda r: r[:2]):
            if kind == "REQUEST":
                pending.append((at, checks))
            elif kind == "END":
                running = False
            elif pending and not running:
                all_ = any(x is None for _, x in pending)
                names = sorted({y for _, x in pending if x for y in x.split(",")})
                out.append((claim, pending[0][0], at, None if all_ else ",".join(names), len(pending)))
                pending, running = [], True
    return sorted(out, key=str)


@pytest.mark.parametrize("cuts", [(), (100, 230), (5, 6)])
def test_runs_in_any_cut(spark, tmp_path, cuts):
    rng = random.Random(4)
    kinds = ["REQUEST"] * 5 + ["START", "START", "END"]
    events = [(rng.randrange(6), START + timedelta(seconds=i), rng.choice(kinds), rng.choice([None, "A", "B", "A,C"])) for i in range(300)]
    edges = [0, *cuts, len(events)]
    for a, b in zip(edges, edges[1:], strict=False):
        part = events[a:b]
        rng.shuffle(part)
        spark.createDataFrame(part, runs.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    runs.run_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", 1).awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("claim", "at", "started", "checks", "requests").collect()]
    assert sorted(got, key=str) == queued(events) and len(got) > 20


def test_runs_of_edge_events(spark, tmp_path):
    rows = [(None, START, "REQUEST", "A"), (1, None, "REQUEST", "A"), (1, START, "REQUEST", ""), (1, START, "OTHER", None), (1, START, "START", None), (2, START, "START", None), (2, START, "REQUEST", " B , A"), (3, START, None, "A")]
    spark.createDataFrame(rows, runs.EVENT).write.parquet(f"{tmp_path}/in")
    runs.run_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("claim", "checks", "requests").collect()
    assert sorted(map(tuple, got)) == [(1, "", 1), (2, "A,B", 1)]


def test_sessions_stream(spark, tmp_path):
    """What the stream has closed are the batch's sessions that end before the watermark of the last batch."""
    rng = random.Random(5)
    at = START
    rows = []
    for _ in range(400):
        at += timedelta(minutes=rng.randrange(120))
        rows.append((rng.randrange(5), rng.choice("ab"), at))
    for i in range(0, 400, 100):
        spark.createDataFrame(rows[i : i + 100], sessions.ACTIVITY).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    sessions.session_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", files_per_batch=1).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("user_id", "token", "created", "last", "expires", "signs").collect()}
    all_ = {tuple(r) for r in sessions.sessions(spark.createDataFrame(rows, sessions.ACTIVITY)).collect()}
    sure = {r for r in all_ if r[4] < rows[299][2] - timedelta(hours=8)}
    assert sure <= got <= all_ and len(sure) > 10


def test_standing(spark):
    hour = lambda h: START + timedelta(hours=h)
    rows = [(1, t, hour(h)) for t, h in (("a", 0), ("a", 7), ("b", 8), ("c", 9), ("d", 10), ("e", 30))] + [(2, "a", hour(0)), (None, "x", hour(1))]
    found = sessions.standing(sessions.sessions(spark.createDataFrame(rows, sessions.ACTIVITY)), F.lit(hour(12)), 3)
    assert {(r["user_id"], r["token"]): r["status"] for r in found.collect()} == {(1, "a"): "EVICTED", (1, "b"): "ACTIVE", (1, "c"): "ACTIVE", (1, "d"): "ACTIVE", (2, "a"): "EXPIRED"}


def value_rows(rng, claims, kinds=4):
    return [(k, k * 10 + rng.randrange(2), rng.randrange(3), f, v, v) for k in claims for f, v in {(rng.choice(["PAN", "NAME", "ADDRESS"]), f"value{rng.randrange(kinds)}") for _ in range(4)}]


def test_live_duplicates_are_those_of_a_batch(spark, tmp_path):
    rng = random.Random(6)
    claims = spark.createDataFrame([(k, k % 2, "DELETED" if k % 7 == 0 else "ACTIVE") for k in range(40)], "claim long, scope int, status string")
    live = live_duplicates.LiveDuplicates(spark, str(tmp_path), 4)
    known: dict[int, list] = {}
    key = lambda rows: sorted((r["claim"], r["document"], r["page"], r["code"], r["severity"], r["value"], tuple(r["others"]), r["n_others"]) for r in rows)
    for batch, some in enumerate([range(0, 20), range(15, 40), [5, 6]]):
        fresh = value_rows(rng, some, 30 if batch else 60)
        if batch == 2:  # nothing is left of these claims
            fresh = [(k, k, 1, None, None, None) for k in some]
        for k in some:
            known[k] = [r for r in fresh if r[0] == k and r[3] is not None]
        df = spark.createDataFrame(fresh, live_duplicates.VALUE)
        live.apply(df, claims, batch)
        if batch == 1:
            live.apply(df, claims, batch)  # done again
        expected = duplicates.findings(spark.createDataFrame([r for v in known.values() for r in v], live_duplicates.VALUE), claims)
        assert key(live.findings().collect()) == key(expected.collect())
    assert len(os.listdir(f"{tmp_path}/findings/lists")) >= 3


def test_hot_value(spark):
    """One value has nearly all claims: lists are bounded before the shuffle, and the join back spreads its rows."""
    rows = spark.range(20_000).select(F.col("id").alias("claim"), F.lit("ADDRESS").alias("field"), F.when(F.col("id") % 100 > 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") / 200).cast("int").cast("string"))).alias("norm")).repartition(8)
    owned = relational.owned_values(rows, ["field", "norm"], "claim", 21)
    plan = owned._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    hot = owned.where("norm = 'hot'").first()
    assert hot["n_owners"] == 19_800 and hot["owners"] == [i for i in range(40) if i % 100][:21]
    joined = relational.spread_join(rows, owned, ["field", "norm"], "n_owners")
    assert joined.count() == 20_000 and joined.columns == ["claim", "field", "norm", "n_owners", "owners"]
    # the shuffle by key and salt gives no task much more than its share
    salted = joined.select(F.when(F.col("norm") == "hot", F.xxhash64("claim", "field", "norm")).otherwise(0).alias("salt")).groupBy(F.pmod(F.hash("salt"), F.lit(8))).count().collect()
    assert max(r["count"] for r in salted) < 20_000 / 8 * 1.3


def test_serial_numbers(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    got = relational.serial_numbers(rows, ["x"], chunks=7).orderBy("x").collect()
    assert [(r["x"], r["s_no"]) for r in got] == [(i, i + 1) for i in range(1000)]


@pytest.mark.parametrize("few", [10_000, 5])
def test_values_and_owners_meet_in_one_pass(spark, tmp_path, monkeypatch, few):
    """Against plain Python, with values that have many rows apart and not; values are read once for each part of the findings."""
    monkeypatch.setattr(duplicates, "FEW", few)
    rows = value_rows(random.Random(7), range(60), 30) + [(k, k, 1, "ACCOUNT_NO", "hot", "hot") for k in range(60)] + [(k, k, None, "DOB", "x", None) for k in (1, 3)]
    of = {k: (None if k == 9 else k % 2, "DELETED" if k % 7 == 0 else None if k == 10 else "ACTIVE") for k in range(58)}
    spark.createDataFrame(rows, live_duplicates.VALUE).repartition(3).write.parquet(f"{tmp_path}/v")
    claims = spark.createDataFrame([(k, *v) for k, v in of.items()], "claim long, scope int, status string")
    found = duplicates.value_findings(spark.read.parquet(f"{tmp_path}/v"), claims)
    owners = defaultdict(set)
    for k, *_, f, _, n in rows:
        if k in of and of[k][0] is not None and of[k][1] == "ACTIVE" and n is not None:
            owners[of[k][0], f, n].add(k)
    others = {(k, f, n): sorted(owners[of[k][0], f, n] - {k}) for k, *_, f, _, n in rows if k in of}
    want = [(k, f"DUP_{f}", n, tuple(x[:20]), len(x)) for (k, f, n), x in others.items() if x]
    got = [(r["claim"], r["code"], r["norm"], tuple(r["others"]), r["n_others"]) for r in found.collect()]
    assert sorted(got) == sorted(want) and max(w[4] for w in want) > 20
    if few > 60:
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 3


def test_a_batch_is_written_by_many_tasks(spark, tmp_path):
    from veridoc.plans import streams

    sizes = []

    def stream():
        seen = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.foreachBatch(lambda df, _: sizes.append(df.count()))
        return seen.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()

    streams.in_batches([spark.range(1000), spark.range(500)], f"{tmp_path}/in", stream)
    assert sizes == [1000, 500]
    assert sum(f.endswith(".parquet") for f in os.listdir(f"{tmp_path}/in")) == 8  # four shuffle partitions
