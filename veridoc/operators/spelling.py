"""Misspelt form words: near misses of a vocabulary, that are no words themselves.

Distinct tokens meet the vocabulary through keys that a token and a term within two edits share: each form of a term
with up to two letters left out. So no token is compared with the whole vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T

SHORTEST = 4
#: Words below which a document isn't judged, and the share of real words that a readable one has.
FEWEST, READABLE = 12, 0.35
#: Confidence of a reading below which it is doubtful, and from which it is trusted.
LOW, HIGH = 70, 85


def tokens(documents: DataFrame) -> DataFrame:
    """Candidates with their places: claim, document, k, raw, token."""
    return documents.select("claim", "document", F.posexplode(T.word_candidates(F.col("text"))).alias("k", "raw")).withColumn("token", F.lower("raw"))


def with_real(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """words with real: the dictionary (word) has a token as it is printed or in lower case."""
    known = dictionary.select("word").distinct()
    a = known.select(F.col("word").alias("raw"), F.lit(True).alias("as_printed"))
    b = known.select(F.col("word").alias("token"), F.lit(True).alias("as_lower"))
    return words.join(a, "raw", "left").join(b, "token", "left").withColumn("real", F.coalesce("as_printed", "as_lower", F.lit(False))).drop("as_printed", "as_lower")


def unreadable(words: DataFrame) -> DataFrame:
    """Documents of FEWEST words or more of which less than READABLE are real: claim, document, n_words, n_real."""
    counts = words.groupBy("claim", "document").agg(F.count(F.lit(1)).alias("n_words"), F.count_if("real").alias("n_real"))
    return counts.where((F.col("n_words") >= FEWEST) & (F.col("n_real") < READABLE * F.col("n_words")))


def shortened(word: Column) -> Column:
    """The word and what is left of it without one letter, or two."""
    n = F.length(word)
    cut = lambda w, i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w)))
    one = F.transform(F.sequence(F.lit(1), n), lambda i: cut(word, i))
    two = F.flatten(F.transform(one, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: cut(w, i))))
    return F.array_distinct(F.concat(F.array(word), one, two))


def near_misses(words: DataFrame, terms: DataFrame) -> DataFrame:
    """Of each distinct token that is no word its closest term: token, term, d, doubtful.

    terms: (term, place), place for names of places. Terms of six letters or more are met at two edits, shorter ones and
    places at one. Of terms at one distance one with the same first letter goes first, then the first by name. A plural
    of its term is right.
    """
    odd = words.where("not real").where(F.length("token") >= SHORTEST).select("token").distinct()
    vocabulary = terms.where(F.length("term") >= SHORTEST).select("term", "place").distinct()
    keyed = lambda rows, c: rows.select("*", F.explode(shortened(F.col(c))).alias("key"))
    met = keyed(odd, "token").join(keyed(vocabulary, "term"), "key").select("token", "term", "place").distinct().where("token <> term")
    edge = F.substring("token", 1, 1) != F.substring("term", 1, 1)
    fits = ~F.col("place") | ((F.length("term") >= 6) & (F.length("token") >= 5) & (~edge | (F.length("token") >= 7)))
    cap = F.when(F.col("place"), 1).when(F.length("term") >= 6, 2).otherwise(1)
    scored = met.where(fits).withColumn("d", S.edit_distance(F.col("token"), F.col("term"), cap)).where(F.col("d").between(1, cap))
    best = scored.groupBy("token").agg(F.min(F.struct("d", edge.alias("edge"), "place", "term")).alias("b")).select("token", "b.term", "b.d", "b.place")
    kept = best.where(~F.array_contains(T.plural_stems(F.col("token")), F.col("term")))
    return kept.select("token", "term", "d", (S.is_doubtful(F.col("token"), F.col("term"), F.col("d")) | F.col("place")).alias("doubtful"), "place")


def findings(documents: DataFrame, dictionary: DataFrame, terms: DataFrame, boxes: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """claim, document, code, severity, token, term, page.

    boxes: (document, token, page, conf), the readings of words. A reading of HIGH confidence makes a near miss of a form
    word sure unless glyphs explain it, one below LOW makes it doubtful. names: (claim, token), words of people's names,
    are doubtful. A document that can't be read isn't searched.
    """
    words = with_real(tokens(documents), dictionary)
    bad = unreadable(words)
    hits = words.join(bad.select("claim", "document"), ["claim", "document"], "left_anti").join(near_misses(words, terms), "token").groupBy("claim", "document", "token", "term", "d", "doubtful", "place").agg(F.min("k").alias("k"))
    if boxes is None:
        hits = hits.withColumn("page", F.lit(None).cast("int")).withColumn("conf", F.lit(None).cast("double"))
    else:
        seen = boxes.groupBy("document", "token").agg(F.min(F.struct("page", "conf")).alias("b")).select("document", "token", "b.page", "b.conf")
        hits = hits.join(seen, ["document", "token"], "left")
    trusted = F.coalesce((F.col("conf") >= HIGH) & S.near_form_word(F.col("token"), F.col("term"), F.col("place")) & ~S.same_print(F.col("token"), F.col("term")), F.lit(False))
    soft = (F.col("doubtful") & ~trusted) | F.coalesce(F.col("conf") < LOW, F.lit(False))
    if names is not None:
        hits = hits.join(names.select("claim", "token", F.lit(True).alias("is_name")).distinct(), ["claim", "token"], "left")
        soft = soft | F.coalesce("is_name", F.lit(False))
    hits = hits.withColumn("soft", soft)
    out = hits.select("claim", "document", F.when(F.col("soft"), "SPELL_DOUBTFUL").otherwise("SPELL_SUSPECT").alias("code"), F.when(F.col("soft"), "WARNING").otherwise("ERROR").alias("severity"), "token", "term", "page")
    unread = bad.select("claim", "document", F.lit("SPELL_UNREADABLE").alias("code"), F.lit("ERROR").alias("severity"), F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("int").alias("page"))
    return out.unionByName(unread)


def second_looks(hits: DataFrame, boxes: DataFrame) -> DataFrame:
    """Doubtful hits (document, token) that another reading (document, token, conf) confirms: its confidence is HIGH or more."""
    return hits.join(boxes.where(F.col("conf") >= HIGH).select("document", "token").distinct(), ["document", "token"], "left_semi")
