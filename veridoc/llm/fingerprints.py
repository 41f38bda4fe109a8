"""One-permutation MinHash fingerprints with optimal densification and b-bit packing, as DataFrame operations.

A text's five-word shingles are hashed once. The high bits of a hash choose one of BINS bins, which keeps its smallest
hash. An empty bin takes the value of the first filled bin in its own random order of bins, the same for all texts, so
that equal sets fill alike. The low 8 bits of each bin, eight bins to a long, are the fingerprint, shown in hex. Of two
fingerprints, the share m of equal bins gives the likeness (m - 2^-8) / (1 - 2^-8), not below 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, words

BINS = 256
BITS = 8
WORDS = 5
PER_CHUNK = 50
_SHIFT = 63 - (BINS.bit_length() - 1)
#: An empty bin's first probes are random bins, tried in these runs (a later one only if those before found nothing);
#: after them come all bins, at an odd step.
RUNS = ((1, 2), (3, 5), (6, 11), (12, 23), (24, 64))


def probe(i: Column, t: Column) -> Column:
    """The bin that empty bin i looks at in its try t."""
    return F.pmod(F.xxhash64(i, t), F.lit(BINS)).cast("int")


def fingerprint(df: DataFrame, text: str, out: str, size: int = WORDS) -> DataFrame:
    """df with out, the fingerprint of a text column as longs; none for a text without words.

    Fewer words than a shingle has are one shingle of the whole sequence. Columns that begin with fp_ are in use.
    """
    df = df.withColumn("fp_w", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    n = F.size("fp_w")
    shingle = lambda i: F.xxhash64(*[F.get(F.col("fp_w"), i + k) for k in range(size)])
    # hashes of 63 bits: the order of the longs is the order of the bins
    hashes = (
        F.when(n == 0, F.array().cast("array<long>"))
        .when(n < size, F.array(F.shiftrightunsigned(F.xxhash64("fp_w"), 1)))
        .otherwise(F.sort_array(F.transform(F.sequence(F.lit(0), n - size), lambda i: F.shiftrightunsigned(shingle(i), 1))))
    )
    df = df.withColumn("fp_h", hashes)
    least = F.filter(F.col("fp_h"), lambda h, i: (i == 0) | (F.shiftright(h, _SHIFT) != F.shiftright(F.get(F.col("fp_h"), i - 1), _SHIFT)))
    df = df.withColumn("fp_m", least).withColumn("fp_b", F.transform(F.col("fp_m"), lambda h: F.shiftright(h, _SHIFT).cast("int")))
    # of each bin the place of its value among the minima, 0 if it is empty
    gap = lambda t, b: F.array_repeat(F.lit(0), F.coalesce(F.get(F.col("fp_b"), t + 1), F.lit(BINS)) - b - 1)
    runs = F.transform(F.col("fp_b"), lambda b, t: F.concat(F.array(t + 1), gap(t, b)))
    df = df.withColumn("fp_p", F.concat(F.array_repeat(F.lit(0), F.coalesce(F.get(F.col("fp_b"), F.lit(0)), F.lit(0))), F.flatten(runs)))
    place = lambda j: F.get(F.col("fp_p"), j)
    found = lambda run, of: F.aggregate(F.sequence(*map(F.lit, run)), F.lit(0), lambda got, t: F.when(got > 0, got).otherwise(of(t)))
    some = lambda run, of: F.nullif(found(run, of), F.lit(0))
    every = lambda i: found((1, BINS), lambda t: place(F.pmod(i + t * 101, F.lit(BINS))))
    source = lambda i: F.coalesce(*[some(run, lambda t: place(probe(i, t))) for run in RUNS], every(i))
    low = lambda at: F.element_at(F.col("fp_m"), at).bitwiseAND(2**BITS - 1)
    values = F.transform(F.col("fp_p"), lambda at, i: F.when(at > 0, low(at)).otherwise(low(source(i))))
    df = df.withColumn("fp_v", F.when(F.size("fp_m") > 0, values))
    byte = lambda k, j: F.shiftleft(F.get(F.col("fp_v"), k * 8 + j), 8 * (7 - j))
    longs = F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), lambda k: reduce(lambda a, b: a.bitwiseOR(b), [byte(k, j) for j in range(8)]))
    return df.withColumn(out, F.when(F.col("fp_v").isNull(), F.array().cast("array<long>")).otherwise(longs)).drop("fp_w", "fp_h", "fp_m", "fp_b", "fp_p", "fp_v")


def as_hex(fp: Column) -> Column:
    """2 * BINS hex digits, bin 0 first; empty for no words."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1. Both without words: 1; one of them: 0."""

    def differing(x: Column) -> Column:
        for k in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(x.bitwiseAND(0x0101010101010101))

    apart = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    noise = 2.0**-BITS
    estimate = F.greatest(F.lit(0.0), (1 - apart / BINS - noise) / (1 - noise))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(estimate)


def below(value: Column, cuts: list[Column]) -> Column:
    """How many of the ascending cuts are less than value, by binary search."""
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    table = F.array(*cuts)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when(F.coalesce(F.get(table, at + s - 1) < value, F.lit(False)), at + s).otherwise(at))


def with_next(df: DataFrame, key: str, tie: str, columns: list[str], chunks: int) -> DataFrame:
    """df with next_<column> of the row that follows by key and tie; after the last row comes the first.

    Rows are dealt out once, to chunks of ranges of (key, tie), cut at the quantiles of a random sample of some PER_CHUNK
    of these per chunk, which only the balance depends on. A copy of the first row of each chunk goes along to the end
    of the chunk before, as the follower of that chunk's last row. Null keys come first; keys may be of any type that
    has an order. Rows equal in key and tie are in one chunk.
    """
    place = F.struct(F.col(key).alias("a"), F.col(tie).alias("b"))
    cuts: list = []
    if chunks > 1:
        many = df.count()
        of = max(1, many // (PER_CHUNK * chunks))
        drawn = df.select(place.alias("at")).where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(of)) == 0).limit(4 * PER_CHUNK * chunks)
        ranked = drawn.select("at", F.row_number().over(Window.orderBy("at")).alias("k"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))  # a bounded sample
        cuts = [r["at"] for r in ranked.where(F.floor(F.col("k") * chunks / F.col("n")) > F.floor((F.col("k") - 1) * chunks / F.col("n"))).select("at").distinct().orderBy("at").collect()]
    types = df.select(place.alias("at")).schema["at"].dataType
    edges = [F.struct(*[F.lit(c[f.name]).cast(f.dataType).alias(f.name) for f in types.fields]) for c in cuts]
    df = df.withColumn("nx_place", place).withColumn("nx_chunk", (below(F.col("nx_place"), edges) if edges else F.lit(0)).cast("int"))
    # one row per chunk, at most as many as chunks
    every = Window.orderBy("nx_at")
    heads = df.groupBy(F.col("nx_chunk").alias("nx_at")).agg(F.min("nx_place").alias("nx_first"))
    heads = heads.withColumn("nx_to", F.coalesce(F.lag("nx_at").over(every), F.max("nx_at").over(Window.partitionBy())))
    here = lambda at, copy: F.struct(at.alias("at"), F.lit(copy).alias("copy"))
    both = F.when(F.col("nx_place").eqNullSafe(F.col("nx_first")), F.array(here(F.col("nx_chunk"), 0), here(F.col("nx_to"), 1))).otherwise(F.array(here(F.col("nx_chunk"), 0)))
    dealt = df.join(F.broadcast(heads), F.col("nx_chunk") == F.col("nx_at")).select(*df.columns, F.explode(both).alias("nx"))
    inside = Window.partitionBy("nx.at").orderBy("nx.copy", key, tie)
    led = dealt.withColumns({f"next_{c}": F.lead(c).over(inside) for c in columns})
    return led.where("nx.copy = 0").drop("nx", "nx_chunk", "nx_place")


def edited_fingerprints(docs: DataFrame, chunks: int | None = None) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, whose last half is the beginning of the next document.

    Null text is empty; texts of any length count whole. An empty table gives an empty result; other columns of docs are
    not looked at. A null doc_id comes before all others. Documents with one doc_id follow each other by the hash of their text. A single document
    follows itself. Texts without words have empty fingerprints, alike only to each other. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = fingerprint(rows, "text", "fp").withColumn("tie", F.xxhash64("text"))
    rows = with_next(rows, "doc_id", "tie", ["text", "fp"], chunks or 4 * partitions(docs.sparkSession))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)))
    rows = fingerprint(rows.select("doc_id", "n_chars", "fp", "next_fp", "edited"), "edited", "edited_fp")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
