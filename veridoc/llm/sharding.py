"""Consistent-hash ring with virtual nodes and bounded loads, as DataFrame operations.

Every row has a place on a ring of virtual nodes. It belongs to the first shard clockwise that is not full: all rows
propose to their first shard, a shard takes proposals in one fixed order up to its room, the others go on to the next
distinct shard. After as many rounds as there are shards every row has a place, as the shards' room covers all rows.

Rows are never walked one by one. They fall into cells (order chunk, ring arc, spread), whose number is fixed by the
parameters; the rounds run over the table of cell counts, and a row finds its shard by its rank within its cell.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITIONS = 4096
CHUNKS = 4
SPREAD = 32


def ring(shards: Sequence[int], replicas: int) -> tuple[list[int], list[list[int]]]:
    """The arc of each ring position, and of each arc the distinct shards clockwise (as indexes into shards)."""
    nodes = sorted((zlib.crc32(f"shard {s} replica {v}".encode()) % POSITIONS, i) for i, s in enumerate(shards) for v in range(replicas))
    arcs, a = [], 0
    for p in range(POSITIONS):
        while a < len(nodes) and nodes[a][0] < p:
            a += 1
        arcs.append(a % len(nodes))
    around = [[i for _, i in nodes[a:] + nodes[:a]] for a in range(len(nodes))]
    return arcs, [list(dict.fromkeys(x)) for x in around]


def bounded_ring(
    df: DataFrame, place: Column, spread: Column, order: Sequence[Column], shards: Sequence[int] = tuple(range(8)), replicas: int = 16, slack: float = 0.0
) -> DataFrame:
    """df with columns home_shard (first on the ring), shard and slot (gapless from 0 within a shard).

    place: 64-bit hash that sets the ring position; rows equal in it start at one position and stay together unless a
    shard's room ends among them. spread: 64-bit hash that differs between such rows. order: breaks ties within a cell.
    slack: a shard holds at most (1 + slack) of the mean, rounded up; 0: counts are at most one apart.
    Nulls hash like any value, repeated rows are placed one by one, an empty table gives an empty result. df must not
    have columns home_shard, shard, slot or names that begin with ring_.
    """
    n = len(shards)
    arcs, prefer = ring(shards, replicas)
    spark = df.sparkSession
    # POSITIONS rows and an arc for each virtual node, whatever the rows
    positions = spark.createDataFrame(list(enumerate(arcs)), "ring_position int, ring_arc int")
    known = spark.createDataFrame(list(enumerate(prefer)), "ring_arc int, ring_prefer array<int>")
    cells = (
        df.withColumn("ring_position", F.pmod(place, F.lit(POSITIONS)).cast("int"))
        .join(F.broadcast(positions), "ring_position")
        .drop("ring_position")
        .withColumn("ring_chunk", F.pmod(F.shiftright(place, 20), F.lit(CHUNKS)).cast("int"))
        .withColumn("ring_cell", (F.col("ring_chunk") * len(prefer) + F.col("ring_arc")) * SPREAD + F.pmod(spread, F.lit(SPREAD)).cast("int"))
    )
    # the walk, over CHUNKS * len(prefer) * SPREAD rows at most
    walk = cells.groupBy("ring_cell", "ring_arc").agg(F.count(F.lit(1)).alias("ring_left"))
    everyone = Window.partitionBy()
    walk = walk.withColumn("ring_total", F.sum("ring_left").over(everyone))
    room = [
        (F.floor(F.col("ring_total") / n) + F.when(F.lit(i) < F.col("ring_total") % n, 1).otherwise(0) if not slack else F.ceil(F.col("ring_total") * (1 + slack) / n)).cast("long")
        for i in range(n)
    ]
    walk = walk.join(F.broadcast(known), "ring_arc").withColumn("ring_from", F.lit(0).cast("long"))
    walk = walk.withColumns({f"ring_room{i}": room[i] for i in range(n)})
    rounds = []
    for r in range(n):
        walk = walk.withColumn("ring_to", F.element_at("ring_prefer", r + 1))
        before = Window.partitionBy("ring_to").orderBy("ring_cell").rowsBetween(Window.unboundedPreceding, -1)
        free = F.element_at(F.array(*[F.col(f"ring_room{i}") for i in range(n)]), F.col("ring_to") + 1)
        walk = walk.withColumn("ring_take", F.greatest(F.lit(0), F.least("ring_left", free - F.coalesce(F.sum("ring_left").over(before), F.lit(0)))))
        walk = walk.withColumns({f"ring_room{i}": F.col(f"ring_room{i}") - F.sum(F.when(F.col("ring_to") == i, F.col("ring_take")).otherwise(0)).over(everyone) for i in range(n)})
        walk = walk.withColumn(f"ring_part{r}", F.struct(F.lit(r).alias("round"), F.col("ring_to").alias("to"), F.col("ring_from").alias("from"), F.col("ring_take").alias("take")))
        walk = walk.withColumn("ring_from", F.col("ring_from") + F.col("ring_take")).withColumn("ring_left", F.col("ring_left") - F.col("ring_take"))
        rounds.append(f"ring_part{r}")
    parts = walk.select("ring_cell", F.element_at("ring_prefer", 1).alias("ring_home"), F.explode(F.array(*rounds)).alias("p")).where("p.take > 0")
    before = Window.partitionBy("p.to").orderBy("p.round", "ring_cell").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("ring_cell", "ring_home", "p.*", F.coalesce(F.sum("p.take").over(before), F.lit(0)).alias("ring_base"))
    ranked = cells.withColumn("ring_rank", F.row_number().over(Window.partitionBy("ring_cell").orderBy(place, *order)).cast("long") - 1)
    # the parts are bounded by the number of cells and rounds, whatever the rows
    out = ranked.alias("r").join(F.broadcast(parts.alias("q")), (F.col("r.ring_cell") == F.col("q.ring_cell")) & (F.col("ring_rank") >= F.col("q.from")) & (F.col("ring_rank") < F.col("q.from") + F.col("q.take")))
    names = F.lit([int(s) for s in shards])
    return out.select(
        *[F.col(f"r.`{c}`") for c in df.columns],
        F.element_at(names, F.col("ring_home") + 1).cast("int").alias("home_shard"),
        F.element_at(names, F.col("to") + 1).cast("int").alias("shard"),
        (F.col("ring_base") + F.col("ring_rank") - F.col("from")).alias("slot"),
    )


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """All documents into shards by the law `rows`: counts at most one apart.

    Equal texts share a ring position. Null and empty texts are equal in that, with sizes 1. Returns doc_id, size,
    text_crc32, law, shard, slot, grown_shard (null under this law) and home_shard.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    out = bounded_ring(rows, F.col("h"), F.xxhash64("doc_id", "h"), [F.col("doc_id")], tuple(range(n_shards)))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
