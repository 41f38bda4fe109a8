"""Edge cases of functions and operators: nulls, empty and odd values, ties, repeated rows, clashing columns."""

import pytest
from pyspark.sql import functions as F

from veridoc.functions import dates, geometry, identifiers, similarity, text
from veridoc.operators import classification, compare, duplicates, extraction, findings, mutations, redflags, relational
from veridoc.sources import sheets


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def nothing(kind="string"):
    return F.lit(None).cast(kind)


def test_nulls_stay_null(spark):
    n = nothing()
    for f in (text.normalized, text.without_separators, text.id_form, text.claim_form, text.code_form, text.print_form, text.gstin_form, text.plate, text.sorted_words, text.without_honorific, dates.pdf_date, dates.moment, text.url_token, text.registrable_domain):
        assert one(spark, f(n)) == (None,), f.__name__
    assert one(spark, identifiers.verhoeff_ok(n, 3), identifiers.gstin_ok(n), identifiers.mrz(n), classification.card(n), classification.business_type(n)) == (None,) * 5
    assert one(spark, classification.page_type(n), text.mime_type(n), similarity.same_name(n, F.lit("a")), dates.same_day(n, F.lit("1/1/2020"))) == ("UNKNOWN", "application/octet-stream", True, True)
    for values in {**extraction.identifiers(n), **extraction.fields(n)}.values():
        assert one(spark, F.size(values))[0] in (0, -1)


def test_a_last_newline_counts(spark):
    """A value with a newline after it is another value."""
    bad = lambda v: F.lit(v + "\n")
    assert one(spark, identifiers.pan_ok(bad("AAAPA0000A")), identifiers.verhoeff_ok(bad("236"), 3), identifiers.gstin_ok(bad("27AAPFU0939F1ZV")), text.has_shape(bad("ABCPE1234F"), text.SHAPES["PAN"])) == (False,) * 4
    assert one(spark, identifiers.pan_ok(F.lit("AAAPA0000A")), identifiers.pan_ok(F.lit("AAAXA0000A")), identifiers.verhoeff_ok(F.lit("236"), 3), identifiers.gstin_ok(F.lit("27AAPFU0939F1ZV"))) == (True, False, True, True)


def test_known_check_digits(spark):
    digits = spark.createDataFrame([("520727",), ("L898902C3",), ("",)], "f string").select(identifiers.mrz_digit(F.col("f"))).collect()
    assert [r[0] for r in digits] == [3, 6, 0]
    # any one digit of a right number changed makes it wrong
    right = "234567890124"
    wrong = [right[:i] + str((int(right[i]) + 1) % 10) + right[i + 1 :] for i in range(12)]
    rows = spark.createDataFrame([(right,), *[(w,) for w in wrong]], "n string").select(identifiers.verhoeff_ok(F.col("n"))).collect()
    assert [r[0] for r in rows] == [True] + [False] * 12


def test_matchers_are_symmetric_and_reflexive(spark):
    names = ["Asha Rao", "A. Rao", "Rao Asha Kumar", "Md Ali", "Mohammed Ali", "Harisunder", "Hari Sunder Mishra", "", None, "Lata"]
    rows = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for matcher in (similarity.same_name, similarity.same_id, similarity.same_model, similarity.same_address):
        got = {(r["a"], r["b"]): r["x"] for r in rows.select("a", "b", matcher(F.col("a"), F.col("b")).alias("x")).collect()}
        assert all(got[a, b] == got[b, a] for a, b in got) and all(got[a, a] for a in names if a), matcher.__name__


@pytest.mark.parametrize(("a", "b", "cap", "want"), [("nmae", "name", 2, 1), ("ca", "abc", 2, 3), ("ca", "abc", 3, 3), ("", "", 1, 0), ("", "ab", 1, 2), ("abcdef", "abcdef", 2, 0), ("signature", "sginatrue", 2, 2)])
def test_edit_distance(spark, a, b, cap, want):
    assert one(spark, similarity.edit_distance(F.lit(a), F.lit(b), cap)) == (want,)


def test_normal_forms_are_idempotent(spark):
    rows = spark.createDataFrame([("MH-12 ab 1234",), ("O'Brien & Söhne",), ("",), (" x\ty ",)], "v string")
    for f in (text.normalized, text.id_form, text.claim_form, text.code_form, text.print_form, text.sorted_words):
        assert all(r[0] == r[1] for r in rows.select(f(F.col("v")), f(f(F.col("v")))).collect()), f.__name__


def test_boxes(spark):
    box = geometry.box(F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.1))
    for turn in (0, 90, 180, 270):
        back = one(spark, geometry.rotated(geometry.unrotated(box, F.lit(turn)), F.lit(turn)))[0]
        assert tuple(back) == pytest.approx((0.1, 0.2, 0.3, 0.1))
    assert one(spark, geometry.union(F.array().cast("array<struct<x:double,y:double,w:double,h:double>>"))) == (None,)


def test_empty_tables(spark):
    pages = classification.classified(spark.createDataFrame([], "claim long, document long, page int, text string"))
    claims = spark.createDataFrame([], "claim long, scope long, status string, vin string, customer string")
    values = duplicates.page_values(pages)
    for df in (redflags.page_flags(pages), redflags.date_flags(pages), redflags.number_flags(pages), redflags.checksum_flags(pages), redflags.mismatch_flags(pages), redflags.signature_flags(pages), duplicates.findings(values, claims), compare.field_findings(pages, claims), compare.car_findings(pages, claims)):
        assert df.count() == 0


def test_duplicates_are_symmetric(spark):
    """Both claims of a pair have a finding; repeated pages make no more; a deleted claim sees others and isn't seen."""
    text_ = "PAN ABCPE1234F\nPolicy No: OG-123456"
    pages = spark.createDataFrame([(1, 10, 1, text_), (1, 10, 1, text_), (2, 20, None, text_), (3, 30, 1, text_), (4, 40, 1, None), (5, 50, 1, text_)], "claim long, document long, page int, text string")
    claims = spark.createDataFrame([(1, 0, "ACTIVE"), (2, 0, "ACTIVE"), (3, 0, "DELETED"), (4, 0, "ACTIVE"), (5, 1, "ACTIVE")], "claim long, scope long, status string")
    got = {(r["claim"], r["code"]): r["others"] for r in duplicates.findings(duplicates.page_values(pages), claims).collect()}
    assert got == {(c, k): o for k in ("DUP_PAN", "DUP_POLICY_NO") for c, o in ((1, [2]), (2, [1]), (3, [1, 2]))}


def test_shared_values_lists_the_first(spark):
    rows = spark.createDataFrame([("v", i) for i in range(50)] + [("v", 1), ("w", None), ("w", 7), (None, 1), (None, 2)], "value string, owner long")
    got = {r["value"]: (r["n_owners"], r["owners"]) for r in relational.shared_values(rows, ["value"], "owner", 3).collect()}
    assert got == {"v": (50, [0, 1, 2]), None: (2, [1, 2])}


def test_missing_required_ignores_null_kinds(spark):
    present = spark.createDataFrame([(1, "b"), (1, None), (2, "a"), (2, "a")], "owner long, kind string")
    required = spark.createDataFrame([("a",), ("b",), (None,)], "kind string")
    assert sorted(map(tuple, relational.missing_required(present, required, "owner", "kind").collect())) == [(1, "a"), (2, "b")]


def test_rules_on_nulls(spark):
    v = nothing("int")
    assert one(spark, *[relational.rule_passes(v, op, 1) for op in ("EQ", "NEQ", "GT", "LTE")]) == (False, True, False, False)
    with pytest.raises(ValueError, match="unknown operator"):
        relational.rule_passes(v, "LIKE", 1)


def test_serial_numbers(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), F.lit("x").alias("serial"))
    assert [r["s_no"] for r in relational.serial_numbers(rows, ["a"], chunks=7).orderBy("a").collect()] == list(range(1, 1001))
    assert relational.serial_numbers(rows.limit(0), ["a"]).count() == 0


def test_runs_keep_nulls_apart(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, None), (2, 1, "a")], "g int, at int, v string")
    assert sorted(map(str, findings.runs(rows, ["g"], "at", ["v"]).collect())) == sorted(map(str, findings.runs(rows.repartition(3), ["g"], "at", ["v"]).collect()))
    assert findings.runs(rows, ["g"], "at", ["v"]).count() == 4


def test_upsert_keeps_what_is_not_business(spark):
    old = spark.createDataFrame([(1, "a", "KEEP"), (2, None, None)], "k long, v string, status string")
    new = spark.createDataFrame([(2, "b"), (3, None)], "k long, v string")
    got = {r["k"]: tuple(r)[1:] for r in mutations.upserted(old, new, ["k"], ["v"]).collect()}
    assert got == {1: ("a", "KEEP", "kept"), 2: ("b", None, "updated"), 3: (None, None, "created")}


def test_bulk_refusal_and_access(spark):
    many = spark.range(501)
    row = mutations.bulk_report(many, F.when(F.col("id") == 3, "BAD"), "id").first()
    assert (row["requested"], row["succeeded"], row["failed"], row["failures"]) == (501, 0, 501, None)
    assert one(spark, mutations.access_code([("A", nothing("boolean")), ("B", F.lit(True))]), mutations.access_code([("A", F.lit(True))])) == ("A", "OK")


def test_sheet_dates(spark):
    got = one(spark, *[sheets.cell_date(F.lit(v)) for v in ("45296", "0", "05-01-2024", "2024-01-05T10:00", "31/02/2024", "x", "2958466")])
    assert [str(v) for v in got] == ["2024-01-05", "None", "2024-01-05", "2024-01-05", "None", "None", "None"]


def test_partitions_are_rewritten_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "claim long, v string")
    mutations.write_partitions(old, path, "claim")
    mutations.write_partitions(old.where("claim = 2").withColumn("v", F.lit("c")), path, "claim")
    assert sorted(map(tuple, spark.read.parquet(path).select("claim", "v").collect())) == [(1, "a"), (2, "c")]
