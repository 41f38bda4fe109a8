"""License scans: an exact set-similarity join of text blocks with license templates, as DataFrame operations.

A document's words fall into overlapping blocks, so that a template that stands anywhere lies whole in one of them. A
block matches a template if it holds at least THRESHOLD of the template's distinct words. Words are put in one global
order, the rarest in the corpus first. For a template of n words of which it needs r:

* prefix: a match shares one of the template's first n - r + 1 words with the block's first m - r + 1;
* length: the block has at least r words of the templates;
* position: from the first shared word at places i and j, 1 + min(n - i - 1, m - j - 1) must reach r.

Blocks are cut to the words that occur in templates, which changes no overlap. What passes is verified on whole sets.

Licenses of one family differ in a word or two, which a share of words alone doesn't ask for. So the templates of names
are such that THRESHOLD needs the naming words, and a match must also have what NAMING asks of its label in the block,
word by word: "gnu general public" is not in a notice of the lesser license.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Words in a block, and from one block to the next, for templates of up to BLOCK - STEP words; both are doubled until
#: a longer template fits.
BLOCK, STEP = 64, 32
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Names of well-known licenses as notices give them, with the notice's own words.
TEMPLATES = {
    "mit": ["under mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "apache-2": ["licensed under the apache license version 2 0"],
    "gpl-3": ["this work is licensed under the gnu general public license version 3"],
    "lgpl-3": ["gnu lesser general public license lgpl"],
    "agpl-3": ["gnu affero general public license agpl"],
    "mpl-2": ["subject to the terms of the mozilla public license v 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike"],
}
_V2, _V3 = (["version " + v, "v " + v, "v" + v, "license " + v] for v in "23")
#: Phrases that name a license: of each list one must stand in the block. Labels that aren't here need none.
NAMING = {
    "mit": [["mit license", "mit licence", "permission is hereby granted"]],  # mit is a German word, too
    "apache-2": [["apache"], _V2],
    "gpl-3": [["gnu general public"], _V3],
    "lgpl-3": [["lesser general public"], _V3],
    "agpl-3": [["affero general public"], _V3],
    "mpl-2": [["mozilla"], _V2],
    "cc-by-nc": [["by nc"]],
    "cc-by-sa": [["by sa", "attribution sharealike"]],
}


def scan_words(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits and all other characters.

    lower() also changes letters beyond A-Z, which neither splits nor joins words. Only the Kelvin sign would become
    an ASCII letter, so it is put aside first.
    """
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(low, SEPARATORS), "")


def global_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template words by the number of documents that have them, ascending, then by name: a list as long as vocabulary."""
    here = docs.select(F.explode(F.array_intersect(F.lit(vocabulary), scan_words(F.col("text")))).alias("word"))
    counted = {r["word"]: r["n"] for r in here.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))


def matches(docs: DataFrame, key: str, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every (key, block, label, template, containment) of docs (key, text) at the threshold.

    Blocks of templates of one size are numbered by themselves.
    """
    by_size: dict[int, list[tuple[str, int, list[str]]]] = {}
    for label, texts in sorted(templates.items()):
        for k, t in enumerate(texts):
            times = 1
            while len(t.split()) > times * (BLOCK - STEP):
                times *= 2
            by_size.setdefault(times, []).append((label, k, list(dict.fromkeys(t.split()))))
    out = [matches_of(docs, key, sets, threshold, times * BLOCK, times * STEP) for times, sets in sorted(by_size.items())]
    return reduce(DataFrame.unionByName, out)


def named(words: Column) -> Column:
    """The labels whose phrases of NAMING stand in a block."""
    s = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    some = lambda phrases: reduce(Column.__or__, [F.contains(s, F.lit(f" {p} ")) for p in phrases])
    return F.array_compact(F.array(*[F.when(reduce(Column.__and__, map(some, lists)), F.lit(label)) for label, lists in NAMING.items()]))


def matches_of(docs: DataFrame, key: str, sets: list[tuple[str, int, list[str]]], threshold: float, size: int, step: int) -> DataFrame:
    """Matches with templates (label, template, distinct words), none of more than size - step words, in blocks of size words."""
    order = global_order(docs, sorted({w for *_, t in sets for w in t}))
    place = {w: i for i, w in enumerate(order)}
    spark = docs.sparkSession
    rows, index = [], []
    for t, (label, k, tokens) in enumerate(sets):
        tokens = sorted(tokens, key=place.__getitem__)
        needed = ceil(threshold * len(tokens) - 1e-9)
        rows.append((t, label, k, tokens, len(tokens), needed))
        index += [(w, t, i) for i, w in enumerate(tokens[: len(tokens) - needed + 1])]
    # both tables hold what the templates hold, whatever the documents
    known = spark.createDataFrame(rows, "t int, label string, template int, tokens array<string>, n int, needed int")
    prefixes = spark.createDataFrame(index, "word string, t int, i int").join(known.select("t", "n", "needed"), "t")
    least = min(r[5] for r in rows)
    all_words = scan_words(F.col("text"))
    some = docs.select(key, all_words.alias("w")).where(F.arrays_overlap(F.col("w"), F.lit(sorted({x[0] for x in index}))))
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - (size - step)) / step).cast("int") - 1)
    blocks = some.select(key, "w", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    # array_intersect keeps the order of its first argument, here the global one
    blocks = blocks.select(key, "block", F.slice("w", F.col("block") * step + 1, size).alias("w"))
    blocks = blocks.select(key, "block", "w", F.array_intersect(F.lit(order), "w").alias("tokens")).where(F.size("tokens") >= least)
    m = F.size("tokens")
    pairs = blocks.select(key, "block", "tokens", named(F.col("w")).alias("named"), m.alias("m"), F.posexplode("tokens").alias("j", "word")).join(F.broadcast(prefixes), "word")
    pairs = pairs.where((F.col("m") >= F.col("needed")) & (F.col("j") <= F.col("m") - F.col("needed")))
    # the first shared word of a pair is its earliest in both orders, so it alone decides by position
    first = pairs.groupBy(key, "block", "t").agg(F.min_by(F.struct("i", "j", "tokens", "m", "named"), "i").alias("f"), F.first("n").alias("n"), F.first("needed").alias("needed"))
    first = first.where(1 + F.least(F.col("n") - F.col("f.i") - 1, F.col("f.m") - F.col("f.j") - 1) >= F.col("needed"))
    both = first.select(key, "block", "t", F.col("f.tokens").alias("found"), F.col("f.named").alias("named")).join(F.broadcast(known), "t")
    shared = F.size(F.array_intersect("tokens", "found"))
    name_stands = ~F.col("label").isin(list(NAMING)) | F.array_contains("named", F.col("label"))
    return both.where((shared >= F.col("needed")) & name_stands).select(key, "block", "label", "template", (shared / F.col("n")).alias("containment"))


def license_labels(docs: DataFrame) -> DataFrame:
    """Of each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels come from phrases that stand word by word, the others from the join. The score is the best containment
    of a template, 1 where a base phrase stands, 0 where nothing is found. Null text is empty; repeated rows count one
    by one, rows with a null doc_id too. A text of any length is scanned whole. Strings of labels are sorted and empty
    where there are none. An empty table gives an empty result; other columns of docs are not looked at.
    """
    # rows of one doc_id and one text have the same labels, so they may share a key
    rows = docs.select("doc_id", "text", F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("key"))
    found = matches(rows.select("key", "text"), "key").groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best")).withColumnRenamed("key", "found_key")
    base = rows.select("doc_id", "key", scan_words(F.col("text")).alias("w"))
    anchors = F.arrays_overlap(F.col("w"), F.lit(["license", "cc"]))
    # every word has a space of its own on both sides, so places of one phrase never share one
    base = base.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), F.when(anchors, F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" "))).alias("s"))
    spaced = {label: " " + phrase.replace(" ", "  ") + " " for label, phrase in PHRASES.items()}
    s = F.col("s")
    count = lambda p: F.coalesce(((F.length(s) - F.length(F.replace(s, F.lit(p)))) / len(p)).cast("long"), F.lit(0).cast("long"))
    words_in = lambda x: ((F.length(x) - F.length(F.replace(x, F.lit("  ")))) / 2).cast("long")
    has = lambda p: F.coalesce(F.contains(s, F.lit(p)), F.lit(False))
    # "a  b" before a place ends with the space of the word before it: one pair of spaces for each word
    first = lambda p: words_in(F.concat(F.substring_index(s, p, 1), F.lit(" ")))
    last = lambda p: F.col("n_words") - words_in(F.concat(F.lit(" "), F.substring_index(s, p, -1))) - len(p.split())
    base = base.select(
        "doc_id", "key", "n_words", sum((count(p) for p in spaced.values()), F.lit(0).cast("long")).alias("n_base"),
        F.array_min(F.array(*[F.when(has(p), first(p)) for p in spaced.values()])).alias("first_word"), F.array_max(F.array(*[F.when(has(p), last(p)) for p in spaced.values()])).alias("last_word"),
        F.array_compact(F.array(*[F.when(has(p), F.lit(label)) for label, p in spaced.items()])).alias("base"),
    )
    out = base.join(found, F.col("key") == F.col("found_key"), "left")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
