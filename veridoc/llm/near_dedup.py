"""Circulant MinHash near-duplicate detection with exact verification.

Signature. A document is the set of its word shingles as 32-bit numbers. One permutation of the 32-bit universe, S, is
applied once; coordinate k is the least P((S(x) + k * STRIDE) mod 2^32) over the set, the second permutation P with its
argument shifted circularly. The coordinates are cut into BANDS bands of ROWS; documents that agree in a band meet in a
bucket. A pair of likeness 0.8 misses all buckets with a probability of (1 - 0.8^5)^40, some 1 in 10^7.

Scale. Documents with equal sets are one class, and only its representative goes on. A bucket is never paired out:
first each member meets the least member of its chunk of the bucket, and those meet the bucket's least member (stars).
Verified links give components. Then only buckets whose members lie in different components are looked at again, and
there only members outside the bucket's largest component meet the members of other components, chunk by chunk and in
neighbouring size bands: pairs inside a component can't change it. Whatever is compared, the sizes alone and then a
bound from the parities of BITS counts (the sets' numbers by their low bits) turn most pairs away before whole sets are
fetched and intersected. A bucket of many texts that are alike by less than the threshold still has all its pairs
looked at by these bounds, as there is no other way to lose none; the chunks spread them over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .textvec import Texts, give_back, mix, over

BANDS = 40
ROWS = 5
STRIDE = 0x9E3779B1
BITS = 2048
#: Members of a bucket in a chunk, on average: a bucket's comparisons are dealt to tasks chunk by chunk.
CHUNK = 1000


def signature(x: np.ndarray, size: int) -> np.ndarray:
    """The first `size` coordinates of a set of 64-bit hashes, as 32-bit numbers."""
    s = (x >> np.uint64(32)).astype(np.uint32)
    # S: a bijection of the 32-bit numbers
    s = (s ^ (s >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    s ^= s >> np.uint32(13)
    shift = np.arange(size, dtype=np.uint32) * np.uint32(STRIDE)
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(s), 256):
        # P, of a block of the set and all shifts
        v = s[k : k + 256, None] + shift
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(12)
        v *= np.uint32(0x297A2D39)
        np.minimum(least, v.min(0), out=least)
    return least


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, the band's number in it."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h.view(np.int64)


def parity(x: np.ndarray) -> np.ndarray:
    """Whether the elements in each of BITS places are odd in number, 64 places to a long."""
    odd = np.bincount((x & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, shingle: int, lower: bool) -> DataFrame:
    """Of each row (doc_id, text): doc_id, n_shingles, a and b (128-bit name of the set), bands, parity."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, at = Texts(batch.column(1), lower).shingles(shingle)
        n = np.diff(at)
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values * np.uint64(k)), dtype=np.uint64))) for k in (3, 5)]
        names = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
        bands = [band_keys(signature(values[a:b], BANDS * ROWS)) if b > a else np.zeros(0, np.int64) for a, b in zip(at, at[1:], strict=False)]
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in bands]))).astype(np.int32))
        listed = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
        odd = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([parity(values[a:b]) for a, b in zip(at, at[1:], strict=False)])), BITS // 64).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(names[0]), pa.array(names[1]), listed, odd], ["doc_id", "n_shingles", "a", "b", "bands", "parity"])

    return docs.mapInArrow(over(work), f"doc_id {kind}, n_shingles long, a long, b long, bands array<long>, parity array<long>")


def sets(docs: DataFrame, shingle: int, lower: bool) -> DataFrame:
    """Of each row (id, text): id and the sorted set as bytes."""
    kind = docs.schema["id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, at = Texts(batch.column(1), lower).shingles(shingle)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([values[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["id", "items"])

    return docs.mapInArrow(over(work), f"id {kind}, items binary")


def verified(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets have 100 * intersection >= percent * union; items: (id, items)."""
    kind = pairs.schema["x"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            on = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                a, b = np.frombuffer(left[k].as_buffer(), np.uint64), np.frombuffer(right[k].as_buffer(), np.uint64)
                at = np.searchsorted(a, b)
                shared = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                on[k] = 100 * shared >= percent * (len(a) + len(b) - shared)
            yield batch.select(["x", "y"]).filter(pa.array(on))
        give_back()

    one = items.select(F.col("id").alias("x"), F.col("items").alias("xs"))
    two = items.select(F.col("id").alias("y"), F.col("items").alias("ys"))
    return pairs.join(one, "x").join(two, "y").select("x", "y", "xs", "ys").mapInArrow(work, f"x {kind}, y {kind}")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for all ids in the links (x, y): the least id that can be reached.

    Hooking to least neighbours and pointer jumping; each round is a written table. The rounds grow with the logarithm
    of the longest path.
    """
    both = stored(links.select("x", "y").union(links.select(F.col("y"), F.col("x"))).where("x <> y").distinct())
    state = stored(both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.first("x")).alias("component")))
    while True:
        # the least component among the neighbours goes to the node and to the node its own component names
        near = both.join(state.select(F.col("id").alias("y"), F.col("component").alias("c")), "y").groupBy(F.col("x").alias("id")).agg(F.min("c").alias("c"))
        seen = state.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("c", "component")).alias("c"))
        hook = seen.groupBy(F.col("component").alias("root")).agg(F.min("c").alias("h"))
        hooked = seen.join(hook.withColumnRenamed("root", "r1"), F.col("component") == F.col("r1"), "left").select("id", "component", F.least("c", "h").alias("c"))
        jump = hooked.select(F.col("id").alias("j"), F.col("c").alias("jc"))
        fresh = stored(hooked.join(jump, F.col("c") == F.col("j"), "left").select("id", F.least("c", F.coalesce("jc", "c")).alias("component"), F.col("component").alias("old")))
        changed = fresh.where("component <> old").limit(1).count()
        state = fresh.select("id", "component")
        if not changed:
            return state


def classes(docs: DataFrame, shingle: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """Of each row of docs: doc_id, n_shingles, component_id (least doc_id reachable by links).

    Rows whose text has no words have no links: null and empty texts. Null doc_ids can't be named by others: such rows
    are left alone, with a null component. Rows with one doc_id share its component. Texts of any length count whole;
    an empty table gives an empty result; other columns of docs are not looked at.
    """
    rows = docs.select("doc_id", "text")
    base = stored(sketches(rows, shingle, lower))
    linked = base.where("n_shingles > 0 and doc_id is not null")
    reps = stored(linked.groupBy("a", "b", "n_shingles").agg(F.min("doc_id").alias("rep")))
    # a representative's row may be repeated; one is enough
    found = linked.join(reps.select("a", "b", "n_shingles", F.col("rep").alias("doc_id")), ["a", "b", "n_shingles", "doc_id"]).groupBy("doc_id", "n_shingles", "a", "b").agg(F.first("bands").alias("bands"), F.first("parity").alias("parity"))
    found = found.withColumnRenamed("doc_id", "id")
    keyed = found.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    crowd = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("id", "n")).alias("least")).where("size > 1")
    # a bucket is dealt to chunks of some CHUNK members; each chunk has a hub, which meets the bucket's least member
    members = keyed.join(crowd, "bucket").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    members = stored(members.select("bucket", "id", "n", "least", "chunks", "chunk"))
    hubs = members.where("chunks > 1").groupBy("bucket", "chunk").agg(F.min(F.struct("id", "n")).alias("hub"))
    near = lambda p, q: 100 * F.least(p, q) >= percent * F.greatest(p, q)
    centred = members.join(hubs, ["bucket", "chunk"], "left").select("id", "n", F.when(F.col("id") == F.col("hub.id"), F.col("least")).otherwise(F.coalesce("hub", "least")).alias("centre"))
    stars = centred.where((F.col("id") != F.col("centre.id")) & near(F.col("n"), F.col("centre.n")))
    stars = stored(stars.select(F.least("centre.id", "id").alias("x"), F.greatest("centre.id", "id").alias("y")).distinct())
    ids = members.select("id").distinct()
    items = stored(sets(rows.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi"), shingle, lower).dropDuplicates(["id"]))
    links = stored(verified(stars, items, percent))
    comp = components(links)
    # buckets whose members are not all in one component yet
    named = members.join(comp, "id", "left").select("bucket", "id", "n", "chunks", "chunk", F.coalesce("component", "id").alias("c"))
    groups = named.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("k"))
    largest = groups.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("k", "c")).alias("top")).where("parts > 1").select("bucket", F.col("top.c").alias("top"))
    odd = found.select("id", "parity")
    # sizes of a ratio of percent are in one size band or in neighbouring ones
    mixed = named.join(largest, "bucket").join(odd, "id").withColumn("band", F.floor(F.log("n") / F.lit(log(100 / percent) + 1e-9)).cast("int"))
    mixed = stored(mixed)
    # those outside the bucket's largest component go to every chunk of it, in their size band and its neighbours
    out = mixed.where("c <> top").select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("to_chunk"))
    out = out.select("*", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("to_band")).alias("p")
    all_ = mixed.alias("q")
    apart = F.aggregate(F.zip_with("p.parity", "q.parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    can = apart * (100 + percent) <= (F.col("p.n") + F.col("q.n")) * (100 - percent)
    meet = (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.to_chunk") == F.col("q.chunk")) & (F.col("p.to_band") == F.col("q.band"))
    # of two members outside the largest component the lesser looks for the other
    once = (F.col("q.c") == F.col("q.top")) | (F.col("p.id") < F.col("q.id"))
    pairs = out.join(all_, meet & (F.col("p.c") != F.col("q.c")) & once & near(F.col("p.n"), F.col("q.n")) & can)
    pairs = pairs.select(F.least("p.id", "q.id").alias("x"), F.greatest("p.id", "q.id").alias("y")).distinct().join(stars, ["x", "y"], "left_anti")
    more = stored(verified(stored(pairs), items, percent))
    if more.limit(1).count():
        comp = components(links.union(more))
    final = reps.join(comp, reps["rep"] == comp["id"], "left").select("a", "b", F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("component"))
    joined = base.join(final, (base["a"] == final["a"]) & (base["b"] == final["b"]) & (base["n_shingles"] == final["n"]) & base["doc_id"].isNotNull(), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 2) -> DataFrame:
    """Of each document: doc_id, n_shingles, component_id, kept (it is the least of its component)."""
    out = classes(docs, shingle)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of each class, with all its columns: of those with its least doc_id any one. Rows without doc_id stay.

    A row without words is a class of its own, but for rows that repeat its doc_id.
    """
    named = classes(docs, shingle).where("doc_id is not null")
    flags = stored(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("many"), F.max(F.col("doc_id") != F.col("component_id")).alias("out")).where("out or many > 1"))
    again = flags.where("not out").select("doc_id")
    whole = docs.join(flags.select("doc_id"), "doc_id", "left_anti")
    return whole.unionByName(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*[F.col(f"`{c}`") for c in docs.columns])
