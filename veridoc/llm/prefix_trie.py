"""The trie of conversation prefixes, from polynomial rolling fingerprints with verified groups.

A node is a distinct sequence of first turns. Prefixes get the fingerprint sum(x_j * BASE**(j - 1)) mod 2**64, x_j being
a hash of turn j's role and text, from numpy scans; depth and fingerprint are the candidate group of a prefix. Then each
group is verified turn by turn: all members must have the last turn and the shorter prefix's group of its
representative, the member with the smallest conv_id. Members that don't are split off with a tag, which their longer
prefixes inherit, until all groups hold. By induction from the root the members of a group then have equal turns, and a
turn is its SHA-256 over role, length and text. Texts are read once and aren't shuffled.

Scale. Turns are dealt by range of (conversation, turn), so a conversation may span tasks; each task scans what it has,
and the pieces meet through one row per task. What a conversation's turns need of others (its head's first turns) is
joined by conversation and piece. Groups are aggregated with a partial sum in each task, so a first turn that a third of
all conversations share is a row per task. Sums over subtrees use that a node's subtree holds each node below it once
on the path of that node's representative: suffix sums along conversations, in blocks, then one sum per node; there is
no job per depth. The ids that end in a node come in pieces sorted by range, and one task at a time reads a node's
pieces in order, since SHA-256 is sequential; it keeps nothing but the digest's state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, stored

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
#: Turns of a conversation whose suffix sums are taken in one group.
BLOCK = 4096
#: Ids in one piece of a node's sorted list.
IDS = 1024
#: Heads are shorter than this.
HEAD = 9
NODE = ["depth", "print", "tag"]
ABOVE = ["above_depth", "above_print", "above_tag"]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def scanned(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, digest, x, n_bytes) in order, written down: conv_id, part, nth (in the piece of its
    conversation in this part, from 0), before and print (the piece's fingerprint up to the turn, without and with it)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, many, print_ = None, 0, 0  # of the open piece
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column(0).to_numpy()
            x = batch.column(1).to_numpy().view(np.uint64)
            first = np.flatnonzero(np.diff(conv, prepend=conv[0] - 1))
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
            nth = np.arange(n) - first[run]
            term = x * _powers(n)[nth]
            sums = np.cumsum(term, dtype=np.uint64)
            value = sums - (sums[first] - term[first])[run]
            if last is not None and conv[0] == last:  # the first piece goes on
                head = run == 0
                value[head] = value[head] * np.uint64(pow(BASE, many, 2**64)) + np.uint64(print_)
                term[head] *= np.uint64(pow(BASE, many, 2**64))
                nth[head] += many
            last, many, print_ = conv[-1], int(nth[-1]) + 1, int(value[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part)), pa.array(nth), _long(value - term), _long(value), batch.column(2), batch.column(3)], ["conv_id", "part", "nth", "before", "print", "digest", "n_bytes"])

    by = ["conv_id", F.asc_nulls_first("turn"), "role", "digest", "_id"]
    dealt = turns.withColumn("_id", F.monotonically_increasing_id()).repartitionByRange(partitions(turns.sparkSession), *by).sortWithinPartitions(*by)
    return stored(dealt.select("conv_id", "x", "digest", "n_bytes").mapInArrow(scan, "conv_id long, part long, nth long, before long, print long, digest binary, n_bytes long"))


def placed(turns: DataFrame) -> DataFrame:
    """The turns of whole conversations: conv_id, part, pos (from 1), before, print, digest, n_bytes.

    Only the first piece of a part can continue a conversation, so what goes before it comes to the driver as one row per
    part and goes back as one entry per part.
    """
    rows = scanned(turns)
    piece = rows.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("many"), F.max_by("print", "nth").alias("print"))
    edge = F.struct("conv_id", "many", "print")
    edges = piece.groupBy("part").agg(F.min_by(edge, "conv_id").alias("first"), F.max_by(edge, "conv_id").alias("last")).orderBy("part").collect()
    moved: dict[int, tuple[int, int, int]] = {}
    conv, many, print_ = None, 0, 0
    for e in edges:
        goes_on = conv is not None and e["first"]["conv_id"] == conv
        if goes_on:
            moved[e["part"]] = conv, many, print_
        only = e["first"]["conv_id"] == e["last"]["conv_id"]
        if goes_on and only:
            print_ = (print_ + e["last"]["print"] * pow(BASE, many, 2**64)) % 2**64
            many += e["last"]["many"]
        else:
            conv, many, print_ = e["last"]["conv_id"], e["last"]["many"], e["last"]["print"] % 2**64

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            pos = batch.column(2).to_numpy() + 1
            before, print_ = (batch.column(i).to_numpy().view(np.uint64).copy() for i in (3, 4))
            for p in np.unique(part).tolist():
                if p in moved:
                    to, many, base = moved[p]
                    at = np.flatnonzero((part == p) & (conv == to))
                    for v in (before, print_):
                        v[at] = v[at] * np.uint64(pow(BASE, many, 2**64)) + np.uint64(base)
                    pos[at] += many
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(pos), _long(before), _long(print_), *batch.columns[5:]], ["conv_id", "part", "pos", "before", "print", "digest", "n_bytes"])

    return rows.mapInArrow(move, "conv_id long, part long, pos long, before long, print long, digest binary, n_bytes long")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, x, n_bytes of each row with a conv_id; null role or text is empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.col("role"), F.lit("\n"), F.length("role"), F.lit("\n"), F.col("text")), 256))
    return rows.select("conv_id", "turn", "role", digest.alias("digest"), F.xxhash64("role", "text").alias("x"), F.octet_length("text").cast("long").alias("n_bytes"))


def head_of(conv_id: Column) -> Column:
    return conv_id - conv_id % 5


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEAD


def rebuilt(conversations: DataFrame, bits: int = 64) -> DataFrame:
    """Prefixes of conversations rebuilt from heads: conv_id, length, depth, print, above_print, digest and n_bytes of the last turn.

    A conversation has its head conversation's first turns, so many as head_length says (all if it has fewer, none if it
    is absent), then its own turns after as many. Depth 0 is there for each conversation, also for one without turns.
    bits: of fingerprints, fewer than 64 to try collisions.
    """
    mask = (1 << bits) - 1
    rows = placed(turns_of(conversations))
    early = F.when(F.col("pos") < HEAD, F.struct("pos", "print", "digest", "n_bytes"))
    # one row per conversation; only the eight first turns are kept in it
    convs = stored(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"), F.array_sort(F.collect_list(early)).alias("first"), F.min("part").alias("from_part"), F.max("part").alias("to_part")))
    heads = convs.select(F.col("conv_id").alias("head"), F.col("first").alias("head_first"))
    h = head_length(F.col("conv_id"))
    convs = convs.withColumn("head", head_of(F.col("conv_id"))).join(heads, "head", "left").withColumn("h", h)
    convs = convs.withColumn("k", F.least("h", F.coalesce(F.size("head_first"), F.lit(0)))).withColumn("length", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    at = lambda turns, n: F.coalesce(F.get(turns, (n - 1).cast("int"))["print"], F.lit(0))
    kept = F.slice("head_first", 1, F.col("k").cast("int"))
    convs = convs.withColumns({"shared": F.when(F.col("k") > 0, kept), "base": at("head_first", F.col("k")), "off": at("first", F.least("h", "own"))})
    convs = stored(convs.select("conv_id", "length", "h", "k", "shared", "base", "off", "from_part", "to_part"))

    root = convs.select("conv_id", "length", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("print"), F.lit(None).cast("long").alias("above_print"), F.unhex(F.lit("")).alias("digest"), F.lit(0).cast("long").alias("n_bytes"))
    cut = lambda c: F.lit(mask if bits < 64 else -1).cast("long").bitwiseAND(c)
    shared = convs.select("conv_id", "length", F.posexplode("shared").alias("nth", "t"), "shared")
    above = F.when(F.col("nth") == 0, 0).otherwise(F.get("shared", F.col("nth") - 1)["print"])
    shared = shared.select("conv_id", "length", (F.col("nth") + 1).cast("long").alias("depth"), cut(F.col("t.print")).alias("print"), cut(above).alias("above_print"), "t.digest", "t.n_bytes")

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = np.array([pow(INVERSE, i, 2**64) for i in range(HEAD)], np.uint64)
        for batch in batches:
            h, k = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            base, off, before, print_ = (batch.column(i).to_numpy().view(np.uint64) for i in (4, 5, 6, 7))
            by = back[h - k]
            out = [_long((base + (v - off) * by) & np.uint64(mask)) for v in (print_, before)]
            depth = pa.array(batch.column(8).to_numpy() - h + k)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], depth, *out, *batch.columns[9:]], ["conv_id", "length", "depth", "print", "above_print", "digest", "n_bytes"])

    # a conversation's row goes to each part that has turns of it: no key of the join is larger than a part
    pieces = convs.select("conv_id", F.explode(F.sequence("from_part", "to_part")).alias("part"), "length", "h", "k", "base", "off")
    own = rows.where(F.col("pos") > head_length(F.col("conv_id"))).join(pieces, ["conv_id", "part"]).select("conv_id", "length", F.col("h").cast("long").alias("h"), F.col("k").cast("long").alias("k"), "base", "off", "before", "print", "pos", "digest", "n_bytes")
    own = own.mapInArrow(shift, "conv_id long, length long, depth long, print long, above_print long, digest binary, n_bytes long")
    return root.unionByName(shared).unionByName(own)


def grouped(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefixes with their group's tag, nodes): groups verified against their representatives and collisions split."""
    rows = stored(prefixes.withColumns({"tag": F.lit(0).cast("long"), "above_tag": F.when(F.col("depth") > 0, 0).cast("long")}))
    while True:
        last = [F.col("above_print"), F.col("above_tag"), F.col("digest")]
        kinds = stored(
            rows.groupBy(*NODE, *last).agg(
                F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count(F.when(F.col("length") == F.col("depth"), 1)).alias("n_ends"), F.max("n_bytes").alias("n_bytes")
            )
        )
        clash = kinds.groupBy(*NODE).agg(F.count(F.lit(1)).alias("_kinds")).where("_kinds > 1").drop("_kinds")
        if clash.isEmpty():
            return rows, kinds
        # all but the representative's kind; a group that has more is small, or fingerprints would be no use
        rank = F.row_number().over(Window.partitionBy(*NODE).orderBy("conv_id")) - 1
        others = kinds.join(clash, NODE, "left_semi").withColumn("rank", rank).where("rank > 0").select(*NODE, *last, "rank")
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*NODE, "above_print", "above_tag", "digest"]]
        hit = rows.alias("r").join(others.alias("o"), [*same], "inner").select("r.conv_id", "r.depth", "o.rank")
        split = hit.groupBy("conv_id").agg(F.min("depth").alias("_depth"), F.min_by("rank", "depth").alias("_rank"))
        new = F.xxhash64("_depth", "_rank")
        tag = F.when(F.col("depth") >= F.col("_depth"), F.col("tag").bitwiseXOR(new)).otherwise(F.col("tag"))
        above = F.when(F.col("depth") > F.col("_depth"), F.col("above_tag").bitwiseXOR(new)).otherwise(F.col("above_tag"))
        rows = stored(rows.join(split, "conv_id", "left").withColumns({"tag": tag, "above_tag": above}).drop("_depth", "_rank"))


def subtree_sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """NODE, n_leaves, saved_tokens: each node's worth stands on the path of its representative, and a subtree's sum is that of its members' suffix sums."""
    worth = (F.col("n_convs") - 1) * F.col("n_bytes")
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("long")
    block = F.floor(F.col("depth") / BLOCK).alias("block")
    given = nodes.select("conv_id", "depth", block, worth.alias("saved"), leaf.alias("leaf")).where("saved > 0 or leaf > 0")
    path = rows.select("conv_id", "depth", block, "print", "tag", F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaf"), F.lit(True).alias("is_row"))
    both = path.unionByName(given.withColumn("is_row", F.lit(False)), allowMissingColumns=True)
    down = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    within = both.select("conv_id", "block", *NODE, "is_row", F.sum("saved").over(down).alias("saved"), F.sum("leaf").over(down).alias("leaf")).where("is_row")
    # only conversations of several blocks get something from later ones
    spans = rows.where(F.col("length") >= BLOCK).select("conv_id", block).distinct()
    totals = spans.join(given.groupBy("conv_id", "block").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")), ["conv_id", "block"], "left")
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = totals.select("conv_id", "block", F.sum("saved").over(after).alias("more_saved"), F.sum("leaf").over(after).alias("more_leaf"))
    all_ = within.join(later, ["conv_id", "block"], "left")
    more = lambda c: F.sum(F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0)))
    return all_.groupBy(*NODE).agg(more("leaf").alias("n_leaves"), more("saved").alias("saved_tokens"))


def end_digests(ends: DataFrame) -> DataFrame:
    """Of rows NODE, conv_id: for each node the SHA-256 of its ids in ascending order, comma-joined."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            ids = batch.column(3).to_numpy()
            cut = np.flatnonzero((np.diff(keys, axis=1) != 0).any(0)) + 1
            edges = np.concatenate(([0], cut, [len(ids)])).tolist()
            start = [a for x, y in zip(edges, edges[1:], strict=False) for a in range(x, y, IDS)]
            stop = [*start[1:], len(ids)]
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(start, stop, strict=True)]
            at = np.array(start, np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(k[at]) for k in keys), pa.array(ids[at]), pa.array(texts, pa.string())], [*NODE, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        names = [*NODE, "ends_sha256"]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([r[0][i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[1] for r in rows], pa.string())], names)

        for batch in batches:
            done = []
            for *k, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done:
                yield out(done)
        if key is not None:
            yield out([(key, state.hexdigest())])

    kind = "depth long, print long, tag long"
    by = [*NODE, "conv_id"]
    dealt = ends.select(*by).repartitionByRange(partitions(ends.sparkSession), *by).sortWithinPartitions(*by).mapInArrow(pieces, f"{kind}, first long, ids string")
    by = [*NODE, "first"]
    return dealt.repartition(partitions(ends.sparkSession), *NODE).sortWithinPartitions(*by).mapInArrow(digest, f"{kind}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, bits: int = 64) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the node's fingerprint.

    Turns are ordered by turn, null first, then by role and content. Null role or text is empty; rows without a conv_id
    are in no conversation; repeated rows are turns of their own; other columns aren't looked at. An empty table has no
    conversation and so not even a root. Remainders of negative ids are SQL's, which have the id's sign.
    """
    rows, nodes = grouped(rebuilt(conversations, bits))
    above = [F.when(F.col("depth") > 0, F.col("depth") - 1).alias(ABOVE[0]), F.col("above_print"), F.col("above_tag")]
    nodes = nodes.select(*NODE, *above, "conv_id", "n_convs", "n_ends", "n_bytes")
    key = [F.col(a).alias(b) for a, b in zip(ABOVE, NODE, strict=True)]
    children = nodes.where("depth > 0").groupBy(*key).agg(F.count(F.lit(1)).alias("n_children"))
    ends = end_digests(rows.where(F.col("depth") == F.col("length")))
    full = nodes.join(children, NODE, "left").join(subtree_sums(rows, nodes), NODE).join(ends, NODE, "left")
    full = stored(full.select(*NODE, *ABOVE, "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
    # parents' ids: parents with over a thousandth of all nodes, under a thousand of them, are broadcast
    total = full.count()
    parents = full.where("n_children > 0").select(*(F.col(b).alias(a) for a, b in zip(ABOVE, NODE, strict=True)), F.col("conv_id").alias("parent_conv_id"), "n_children")
    often = F.col("n_children") * 1000 > total
    large, small = parents.where(often).drop("n_children"), parents.where(~often).drop("n_children")
    out = full.join(F.broadcast(large), ABOVE).unionByName(full.join(F.broadcast(large), ABOVE, "left_anti").join(small, ABOVE, "left"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", F.col("print").alias("fingerprint"))
