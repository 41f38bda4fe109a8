"""Edits, names, labels, payload entries and the registry of checks."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from veridoc.functions import payloads, similarity
from veridoc.operators import checks, classification, codes, compare, duplicates, extraction, labels


def edits(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_counts():
    rng = random.Random(1)
    word = lambda signs, least, most: "".join(rng.choice(signs) for _ in range(rng.randint(least, most)))
    pairs = [(word("abé", 0, 8), word("abé", 0, 8)) for _ in range(2000)] + [(word("abc", 60, 70), word("abc", 60, 70)) for _ in range(40)] + [("", ""), ("a" * 64, "a" * 63 + "b"), ("ca", "abc")]
    assert similarity.edit_counts(*map(list, zip(*pairs, strict=True))).tolist() == [edits(a, b) for a, b in pairs]
    assert similarity.edit_counts([], []).tolist() == []


def test_edit_distance_columns(spark):
    rows = [("name", "nmae", 1), (None, "a", None), ("abcdef", "badcfe", 2), ("x", "x", 0), ("signature", "sig", 3)]
    got = spark.createDataFrame(rows, "a string, b string, want int").select("want", similarity.edit_distance(F.col("a"), F.col("b"), 2).alias("d")).collect()
    assert [r["d"] for r in got] == [1, None, 3, 0, 3]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("asha rao", "rao asha", True), ("asha rao", "a rao", True), ("asha rao", "lata rao", False), ("asha rao", "asha rao kumar", True), ("saikiran rao", "rao sai kiran", True), ("rao sai kiran", "saikiran rao m", True),
        ("asha rao", "", True), ("ramesh shah", "suresh shah", False), ("harisunder", "hari sunder mishra", True), ("rameshkumar", "suresh ramesh gupta", False), ("kumar das", "kumari das", True), ("rajesh soni", "rajesh son", True),
        ("son rajesh", "soni rajesh", True), ("son amar", "soni ramesh", False), ("jignabhai patel", "jigna patel", True), ("rohit", "amit rohit shah", True), ("rohit", "amit rohid shah", False), ("rohid", "rohit amit shah", True), ("anil kumar sh", "anil kumar sharma gupta", True), ("anil kumar sh", "anil kumar sharma", False),
        ("meera iyer", "meera iyengar", False), ("venkatesan", "venkatseam", True), ("asha asha", "asha rao", False), ("a b", "asha bala", True),
    ],
)
def test_names(a, b, same):
    assert similarity.names_agree(a.split(), b.split()) is same
    assert similarity.names_agree(b.split(), a.split()) is same


def test_labels():
    import re

    find = lambda label, text: re.findall(label.pattern.replace("(?i)", "", 1), text, re.IGNORECASE)
    pf = labels.Label(("PF", "PF a/c"), labels.run(labels.CODE, 6, 31, labels.PLAIN_CODE), number=True)
    assert find(pf, "P.F. No: MH/BAN/12345") == ["MH/BAN/12345"] and find(pf, "PF A/c Number MH123456") == ["MH123456"] and find(pf, "PF MH123456") == [] and find(pf, "RPF No: MH123456") == []
    key = labels.Label(("key",), labels.run(labels.DIGITS, 11, 25, "[A-Z]"), number=True, whole=True)
    assert find(key, "Key No. K1234567890") == ["K1234567890"] and find(key, "Key No: AB12") == [] and find(key, "Key No. K123456789") == []
    uan = labels.Label(("UAN",), labels.grouped(4, 4, 4))
    assert find(uan, "UAN: 1012 3456 7890") == ["1012 3456 7890"] and find(uan, "UAN 1012-3456-7890-1") == []
    assert re.search(labels.phrases(["birth certificate"]), "birth  certificates")


def test_payload_entries_as_in_columns(spark):
    texts = ["Name:Asha Rao|PolNo:12-3|Time:1:30PM", '<x uid="12" name="Asha" name="B"/>', "GSTIN:27A\nLegal Name: A, B\n\r\nGSTIN:other", "invoiceno:7,amount: 5,:x,y:", "plain text", "", None, " | a : b | 1:2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    want = {r["i"]: [tuple(e) for e in r["e"] or []] for r in df.select("i", codes.payload(F.col("value")).alias("e")).collect()}
    assert {i: list(payloads.entries(t)) for i, t in enumerate(texts)} == want
    payloads.register(spark)
    rows = spark.sql("SELECT c.i, e.place, e.key, e.value FROM {codes} AS c, LATERAL payload_entries(c.value) AS e", codes=df).collect()
    assert sorted(map(tuple, rows)) == [(i, k, *e) for i, found in sorted(want.items()) for k, e in enumerate(found)]


def test_registry(spark):
    claims = spark.createDataFrame([(1, 0, "ACTIVE", "WVE1RTY2UKP000001", "ASHA RAO"), (2, 0, "ACTIVE", "WVE1RTY2UKP000002", "LATA DAS"), (3, 0, "ACTIVE", "WVE1RTY2UKP000003", "X")], "claim long, scope int, status string, vin string, customer string")
    pages = spark.createDataFrame([(1, 10, 1, "Tax invoice\nBill To: Asha Rao\nChassis No: WVE1RTY2UKP000001\nA/c No: 123456789"), (2, 20, 1, "Tax invoice\nBill To: Lata Das\nA/c No: 123456789")], "claim long, document long, page int, text string")
    x = checks.Inputs(claims, pages)
    assert checks.chosen(x) == ["INTRA", "REDFLAG", "COMPARE", "DUP"]
    found = checks.run_checks(x, ["INTRA", "DUP"])
    got = {(r["claim"], r["validator"]): r["status"] for r in checks.verdicts(x, found, ["INTRA", "DUP"]).collect()}
    assert got == {(1, "DUP"): "FAILED", (2, "DUP"): "FAILED", (3, "DUP"): "DOCS_NOT_AVAILABLE", (1, "INTRA"): "PASSED", (2, "INTRA"): "FAILED", (3, "INTRA"): "DOCS_NOT_AVAILABLE"}
    with pytest.raises(ValueError, match="SPELL"):
        checks.chosen(x, ["SPELL"])
    with pytest.raises(ValueError, match="nothing"):
        checks.check("NEW", "nothing")


def test_pages_are_read_and_classified_once(spark, monkeypatch):
    """COMPARE and DUP share one reading of a page, and QR takes the kind that a page was given."""
    texts = [(1, 10, 1, "TAX INVOICE\nInvoice No: 5\nBill To : ASHA RAO\nChassis No: WVE1RTY2UKP000001"), (1, 11, 2, "PAY SLIP\nEmployee Name: ASHA RAO\nBank A/C No 501000123456\nNet Pay 9000"), (2, 20, 1, "CERTIFICATE OF REGISTRATION\nRegn. Number: MH12AB1234\nOwner Name: LATA RAO"), (2, 21, 2, None)]
    pages = spark.createDataFrame(texts, "claim long, document long, page int, text string")
    x = checks.Inputs(spark.createDataFrame([(1, "WVE1RTY2UKP000001"), (2, None)], "claim long, vin string"), pages)
    plain = lambda df: sorted(map(str, df.collect()))
    want = plain(duplicates.page_values(x.classified)), plain(compare.page_fields(x.classified))
    read_once, real = [], extraction.fields
    monkeypatch.setattr(extraction, "fields", lambda t: read_once.append(1) or real(t))
    assert (plain(x.values), plain(compare.page_fields(x.read))) == want
    assert want[0] and want[1] and len(read_once) == 1
    found = spark.createDataFrame([(1, 10, 1, "ChassisNo: WVE1RTY2UKP000009")], "claim long, document long, page int, value string")
    slow = plain(codes.compared(found, pages))
    monkeypatch.setattr(classification, "pane_type", None)
    assert plain(codes.compared(found, x.classified)) == slow != []


def test_kinds_of_pages_are_not_worked_out_again(spark, monkeypatch):
    """Plates stand on registrations and policies; where a page's type is known, it isn't looked for in its text."""
    texts = [(1, 10, 1, "CERTIFICATE OF REGISTRATION\nRegn. Number: MH12AB1234\nOwner Name: LATA RAO"), (1, 11, 2, "POLICY SCHEDULE\nPolicy No: OG-26-1\nKA 05 MN 0042"), (2, 20, 1, "PAN MH12AB1234"), (2, 21, 2, None)]
    pages = classification.classified(spark.createDataFrame(texts, "claim long, document long, page int, text string"))
    plates = lambda df: sorted((r["document"], tuple(r["read"]["PLATES"])) for r in df.collect())
    want = plates(extraction.read(pages.drop("type")))
    monkeypatch.setattr(classification, "business_type", None)
    assert plates(extraction.read(pages)) == want == [(10, ("MH12AB1234",)), (11, ("KA 05 MN 0042",)), (20, ()), (21, ())]


def test_rules_run_at_the_same_time(spark, monkeypatch):
    """Rules that wait for each other end, what they share is worked out once, and an error of one is the run's."""
    met = threading.Barrier(2, timeout=60)
    pages = spark.createDataFrame([(1, 10, 1, "x")], "claim long, document long, page int, text string")
    x = checks.Inputs(pages.select("claim"), pages)
    once, real = [], classification.classified
    monkeypatch.setattr(classification, "classified", lambda p: once.append(1) or real(p))

    def rule():
        met.wait()
        return x.classified.select("claim", "document", "page", F.lit("SOME").alias("code"))

    monkeypatch.setitem(checks.CHECKS, "PAIR", checks.Check("PAIR", (), lambda _: [rule, rule]))
    got = checks.run_checks(x, ["PAIR"])
    assert [(r["claim"], r["code"], r["severity"], r["validator"]) for r in got.collect()] == [(1, "SOME", None, "PAIR")] * 2 and once == [1]

    def broken():
        raise ZeroDivisionError

    monkeypatch.setitem(checks.CHECKS, "PAIR", checks.Check("PAIR", (), lambda _: [lambda: pages, broken]))
    with pytest.raises(ZeroDivisionError):
        checks.run_checks(x, ["PAIR"])


def test_normal_values_are_worked_out_once(spark):
    """A filter on the normal form would be moved before the column and work it out again."""
    pages = spark.createDataFrame([(1, 10, 1, "Bank A/C No 501000123456\nDOB: 05/11/1994\nUAN: 1012 0000 0001\nMH12AB1234")], "claim long, document long, page int, text string")
    values = duplicates.page_values(pages)
    plan = values._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan.split("Generate explode")[0]
    assert sorted((r["field"], r["norm"]) for r in values.collect()) == [("ACCOUNT_NO", "501000123456"), ("DOB", "5-11-1994"), ("UAN", "101200000001")]
