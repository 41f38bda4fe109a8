"""Boxes on pages as Column expressions: structs x, y, w, h in 0 to 1 from the top left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T

#: Words that a value may run over.
MOST_WORDS = 8


def clamped(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def unrotated(b: Column, degrees: Column) -> Column:
    """A box read on a page turned counter-clockwise, on the page as it is."""
    x, y, w, h = (b[c] for c in "xywh")
    return F.when(degrees == 90, box(1 - y - h, x, h, w)).when(degrees == 180, box(1 - x - w, 1 - y - h, w, h)).when(degrees == 270, box(y, 1 - x - w, h, w)).otherwise(b)


def rotated(b: Column, degrees: Column) -> Column:
    return unrotated(b, (360 - degrees) % 360)


def clipped(b: Column) -> Column:
    """The part of a box that lies on the page."""
    left, top = clamped(b["x"]), clamped(b["y"])
    return box(left, top, clamped(b["x"] + b["w"]) - left, clamped(b["y"] + b["h"]) - top)


def union(boxes: Column) -> Column:
    """The least box around an array of boxes; null for none."""
    left, top = F.array_min(F.transform(boxes, lambda b: b["x"])), F.array_min(F.transform(boxes, lambda b: b["y"]))
    right, bottom = F.array_max(F.transform(boxes, lambda b: b["x"] + b["w"])), F.array_max(F.transform(boxes, lambda b: b["y"] + b["h"]))
    return F.when(F.size(boxes) > 0, box(left, top, right - left, bottom - top))


def raster_scale(width: Column, height: Column, scale: float, least: float, most: float = 8192.0) -> Column:
    """The scale at which a page's long side has at least `least` pixels and at most `most`."""
    long = F.greatest(width, height)
    return F.least(F.greatest(F.lit(scale), F.lit(least) / long), F.lit(most) / long)


def reread_adds(reread: Column, image: Column, measured: Column, first_look: Column) -> Column:
    """Whether another rendering shows more pixels than the first look: vector print does at any size, an image as far as it has them."""
    return F.when(~measured | (reread <= first_look), False).otherwise(F.coalesce(image > first_look, F.lit(True)))


def located(words: DataFrame, values: DataFrame) -> DataFrame:
    """Where values (document, page, value) stand among words (document, page, k, text, x, y, w, h): the box around the shortest run of at most MOST_WORDS words that begins with a value; the first of a page.

    Both are compared without case and separators.
    """
    run = Window.partitionBy("document", "page").orderBy("k").rowsBetween(0, MOST_WORDS - 1)
    runs = words.select("document", "page", "k", F.collect_list(F.struct(T.normalized(F.col("text")).alias("t"), F.struct("x", "y", "w", "h").alias("b"))).over(run).alias("run"))
    # by page alone, as the runs are made and the found ones grouped: words are shuffled once, before they are repeated in runs
    wanted = values.select("document", "page", "value", T.normalized(F.col("value")).alias("key")).where("key <> ''").repartition("document", "page").distinct()
    # one of the first word and the value begins with the other; not an equality, which would shuffle the runs by it
    begin = F.element_at("run", 1)["t"]
    met = runs.where(begin != "").join(wanted.withColumnsRenamed({"document": "d", "page": "p"}), (F.col("document") == F.col("d")) & (F.col("page") == F.col("p")) & (F.startswith("key", begin) | F.startswith(begin, F.col("key"))))
    joined = lambda n: F.array_join(F.transform(F.slice("run", 1, n), lambda w: w["t"]), "")
    length = F.array_min(F.filter(F.sequence(F.lit(1), F.size("run")), lambda n: F.startswith(joined(n), F.col("key"))))
    found = met.withColumn("n", length).where("n is not null")
    first = found.groupBy("document", "page", "value").agg(F.min_by(F.struct("run", "n"), "k").alias("f"))
    return first.select("document", "page", "value", F.col("f.n").alias("n_words"), union(F.transform(F.slice(F.col("f.run"), F.lit(1), F.col("f.n")), lambda w: w["b"])).alias("box"))
