"""Words that are asked for before a pattern change no result and spare most of the work."""

import time

import pytest
from pyspark.sql import functions as F

from veridoc.operators import classification as K
from veridoc.operators import extraction as E
from veridoc.operators import labels as L
from veridoc.plans import checks, scalars

TEXTS = [*scalars._PAGES, *checks._LABELS, *checks._CERTIFICATES, *[x for a, b, _ in checks._PAPER_PAIRS for x in (a, b)], None, ""]


@pytest.mark.parametrize("case", [str.upper, str.lower, str])
def test_patterns_find_nothing_without_their_words(spark, case):
    t = F.col("t")
    rows = spark.createDataFrame([(x and case(x),) for x in TEXTS], "t string")
    pairs = [((word,), f"(?i){p}") for markers in K.BUSINESS.values() for word, p in markers]
    pairs += [(E.EVENTS, E.CIVIL), (("policy", "certifica"), E.POLICY), (E.RATION.words, E.RATION_TITLE), (("gst", "registration", "legal"), K.GST_CERTIFICATE), (("pen",), E.PEN)]
    pairs += [(x.words, x.pattern) for x in [*E.LABELLED.values(), *E.CARD_LABELS.values(), *E.FIELD_LABELS.values(), E.RATION, E.KEY] if x.words]
    low = F.lower(t)
    missed = [t.rlike(p) & ~F.exists(F.lit(list(words)), lambda w: F.contains(low, w)) for words, p in pairs]
    counts = rows.select(*[F.count_if(m).alias(str(i)) for i, m in enumerate(missed)]).first()
    assert not any(counts)


def test_labels_of_initials_have_no_word():
    assert L.Label(("PF", "pension"), "x").words == () and L.Label(("emp. no", "staff id"), "x").words == ("emp.", "staff")


def test_pages_without_the_words_are_not_searched(spark):
    """Titles of civil certificates are some twenty phrases; pages that name no event are passed over."""
    rows = spark.range(30_000).select(F.concat(F.repeat(F.lit("Invoice number and date of the dealer, "), 8), F.col("id").cast("string")).alias("t")).cache()
    rows.count()

    def seconds(found):
        times = []
        for _ in range(3):
            start = time.time()
            rows.select(F.count_if(found)).first()
            times.append(time.time() - start)
        return min(times)

    assert seconds(E.is_civil(F.col("t"))) * 3 < seconds(F.col("t").rlike(E.CIVIL))
