"""Mixing sources to target weights by Pareto order sampling, as DataFrame operations.

Each source has a target in words. A document first gets the whole copies that are certain, floor(target / size of the
source). What is left is a sample of the source's documents without replacement, of a fixed size in words: documents
are ranked by random odds divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order until the
words are there. Inclusion probabilities are unequal, p = min(1, c * lean): lean is a document's length against its
source's mean, held between LEAN, and c is solved for, so that the expected words of the sample, the sum of p * size,
are the words that are left of the target. Where p is 1 the document is certain and comes before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, partitions, stored

LEAN = (0.5, 2.0)
#: Bins of the Pareto rank within a source, and as many for certain documents: the running sum goes bin by bin.
BINS = 4096


def targets(sizes: DataFrame, share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """Of the rows (no_source, source, source_size, docs), one per source: the target in words of each.

    Sources by code point, null last, take the weights in turn. The budget, share of all words, goes out by weight; a
    target stops at most times its source and the excess is reshared. That is the level L at which the sum of
    min(L * weight, most * size) is the budget, found by the order in which sources fill up.
    """
    turn = F.row_number().over(Window.orderBy("no_source", "source")) - 1
    w = sizes.withColumn("weight", F.element_at(F.lit([float(x) for x in weights]), (turn % len(weights)).cast("int") + 1))
    w = w.withColumn("top", F.col("source_size") * F.lit(float(most)))
    filling = Window.orderBy(F.col("top") / F.col("weight"), "no_source", "source")
    upto, everyone = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = F.coalesce(F.sum("top").over(upto), F.lit(0.0))
    open_weight = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    budget = F.sum("source_size").over(everyone) * F.lit(float(share))
    w = w.withColumn("level", (budget - filled) / open_weight).withColumn("fits", F.col("level") * F.col("weight") <= F.col("top"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("top") / F.col("weight"), "level"))).over(everyone)["level"]
    return w.select("no_source", "source", "source_size", "docs", F.when(level.isNull(), F.col("top")).otherwise(F.least(level * F.col("weight"), F.col("top"))).alias("target"))


def lean(size: Column, docs: Column, source_size: Column) -> Column:
    return F.greatest(F.lit(LEAN[0]), F.least(F.lit(LEAN[1]), F.when(source_size > 0, size * docs / source_size).otherwise(1.0)))


def solved(sizes: DataFrame, aim: DataFrame) -> DataFrame:
    """aim with scale, the c of p = min(1, c * lean): sizes has no_source, name, size, many (documents of that size).

    By lean, descending, documents become certain as c grows. If those before a step are, c is what is left of the words
    by the sum of lean * words from that step on; the first step whose own documents aren't certain then is the one.
    """
    steps = sizes.join(aim, (F.col("no_source") == F.col("aim_none")) & (F.col("name") == F.col("aim_name")))
    words = (F.col("many") * F.col("size")).cast("double")
    steps = steps.groupBy("no_source", "name", "rest", lean(F.col("size"), F.col("docs"), F.col("source_size")).alias("lean")).agg(F.sum(words).alias("words"))
    down = Window.partitionBy("no_source", "name").orderBy(F.desc("lean"))
    certain = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    pull = F.sum(F.col("lean") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    steps = steps.withColumn("c", F.when(pull > 0, (F.col("rest") - certain) / pull).otherwise(0.0))
    c = steps.where(F.col("c") * F.col("lean") < 1).groupBy(F.col("no_source").alias("c_none"), F.col("name").alias("c_name")).agg(F.max_by("c", "lean").alias("scale"))
    out = aim.join(c, (F.col("aim_none") == F.col("c_none")) & (F.col("aim_name") == F.col("c_name")), "left")
    return out.withColumn("scale", F.coalesce("scale", F.lit(0.0))).drop("c_none", "c_name")


def pareto_mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), most: float = 2.0, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """Of each document: doc_id, source, size (words), source_size, target, taken (words), copies.

    Null texts have size 0. A null source is a source of its own, the last. The random number comes from the seed,
    doc_id and text: rows equal in both tie, and are taken one by one. keep: further columns of docs to carry along;
    others are not looked at. An empty table gives an empty result, and a source without words takes none. The seed
    fixes the result.
    """
    token = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    rows = docs.select("doc_id", "source", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name"), n_words(F.col("text")).cast("long").alias("size"), F.substring(token, 1, 12).alias("token"), *keep)
    # a row for each length of a source: few tasks write it
    few = max(8, partitions(docs.sparkSession) // 16)
    sizes = stored(rows.groupBy("no_source", "name", "size").agg(F.count(F.lit(1)).alias("many")).coalesce(few))
    # one row per source
    sources = sizes.groupBy("no_source", F.col("name").alias("source")).agg(F.sum(F.col("size") * F.col("many")).alias("source_size"), F.sum("many").alias("docs"))
    aim = targets(sources, share, weights, most).select(
        F.col("no_source").alias("aim_none"), F.col("source").alias("aim_name"), "source_size", "docs", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
    )
    # written, so that its size is known: few sources are broadcast, more are joined by a shuffle
    aim = stored(solved(sizes, aim.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))).coalesce(few))
    joined = rows.join(aim, (F.col("no_source") == F.col("aim_none")) & (F.col("name") == F.col("aim_name")))
    u = (F.conv("token", 16, 10).cast("double") + 0.5) / F.lit(float(16**12))
    ranked = joined.withColumn("u", u).withColumn("p", F.least(F.lit(1.0), F.col("scale") * lean(F.col("size"), F.col("docs"), F.col("source_size"))))
    odds = F.col("u") / (1 - F.col("u"))
    ranked = ranked.withColumn("rank", F.when(F.col("p") >= 1, F.col("u") - 1).when(F.col("p") > 0, odds / (F.col("p") / (1 - F.col("p")))).otherwise(1e300 * F.col("u")))
    spread = F.when(F.col("rank") < 0, F.col("rank")).otherwise(F.col("rank") / (1 + F.col("rank")))
    ranked = ranked.withColumn("bin", F.when(F.col("p") > 0, F.floor(spread * BINS)).otherwise(BINS + F.floor(F.col("u") * BINS)).cast("int"))
    # words before each bin of its source, then before each row of its bin
    bins = ranked.groupBy("no_source", "name", "bin").agg(F.sum("size").alias("bin_size"))
    before = Window.partitionBy("no_source", "name").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(F.col("no_source").alias("bin_none"), F.col("name").alias("bin_name"), F.col("bin").alias("bin_no"), F.coalesce(F.sum("bin_size").over(before), F.lit(0)).alias("bins_before"))
    within = Window.partitionBy("no_source", "name", "bin").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("rows_before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bins, (F.col("no_source") == F.col("bin_none")) & (F.col("name") == F.col("bin_name")) & (F.col("bin") == F.col("bin_no")))
    # the sample ends where its words are nearest to what is left of the target
    more = F.when(2 * (F.col("bins_before") + F.col("rows_before")) + F.col("size") <= 2 * F.col("rest"), 1).otherwise(0)
    copies = (F.col("whole") + F.least(more, F.lit(float(most)) - F.col("whole"))).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *keep)


def repeated(docs: DataFrame, **options: object) -> DataFrame:
    """docs with all its columns, each row as often as the mix takes it."""
    rows = docs.withColumn("mix_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    mixed = pareto_mix(rows.select("doc_id", "source", "text", "mix_row"), keep=("mix_row",), **options)
    return mixed.where("copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("mix_row.*")
