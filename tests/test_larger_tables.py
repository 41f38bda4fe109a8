"""What holds only for few claims, short texts or one sheet doesn't do for larger tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from veridoc.functions import geometry
from veridoc.functions import similarity as S
from veridoc.functions import text as T
from veridoc.plans import books, queries
from veridoc.sources import sheets, workbooks


def against_sql(spark, folder, name, keys):
    """A query over customers of these keys, and its SQL."""
    path = f"{folder}/customer.parquet"
    con = duckdb.connect()
    con.sql(f"COPY (SELECT unnest({list(keys)})::BIGINT AS c_custkey, 1 AS c_nationkey) TO '{path}' (FORMAT parquet)")
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{path}'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, str(folder)).select(*want.columns).collect()
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(got) == plain(want.fetchall())
    return got


@pytest.mark.parametrize(
    ("name", "keys"),
    [
        ("d_duplicates", [8, 10_008, 270_008, 18, 10_018]),  # two claims whose numbers differ by 10,000
        ("r3_file_and_claim_flags", [17_686, 27_791, 13]),  # a specimen and a misspelt signatory in one file
        ("x_cars_and_holders", [128_713, 128_774, 250_002, 250_000, 899_997, 1_125_001, 1_125_002]),  # serials beyond six digits
    ],
)
def test_keys_of_larger_tables(spark, tmp_path, name, keys):
    assert against_sql(spark, tmp_path, name, keys)


def test_more_observations_than_one_sheet_takes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "MOST_ROWS", 40)
    assert len(against_sql(spark, tmp_path, "s6_observations", range(1, 201))) == 200


def test_workbooks_of_several_sheets_come_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "SHEET_ROWS", 4)
    with open(f"{tmp_path}/a.xlsx", "wb") as f:
        workbooks.write_workbook(f, ((i,) for i in range(8)), ["n"], "S")
    got = books.read_back(spark, str(tmp_path), {"n": "N"}, permissive=False).select(F.col("n").cast("int")).collect()
    assert sorted(r[0] for r in got) == list(range(8))


def test_long_addresses_have_tokens_of_one_line(spark):
    token = spark.range(1).select(T.url_token(F.lit("https://example.com/" + "a?b" * 60))).first()[0]
    assert "\n" not in token and "\r" not in token and len(token) == 267


def test_misread_claim_ids_against_all_places(spark):
    """Each place of the text in turn, also where the last six overlap themselves."""
    fold = str.maketrans(*T.CLAIM_GLYPHS)
    plain = lambda x: "".join(c for c in x.lower() if c.isalnum() and c.isascii())

    def one_slip(a, b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1

    def slow(text, claim):
        key, raw = plain(claim).translate(fold), plain(text)
        folded, n = raw.translate(fold), len(key)
        at = [i for i in range(len(folded) - n + 1) if n >= 10 and folded[i + n - 6 : i + n] == key[-6:] and one_slip(folded[i : i + n], key)]
        return raw[at[0] : at[0] + n].upper() if at else None

    rows = [("no WVEIR7Y2UKP000123 here", "WVE1RTY2UKP000123"), ("a 1111111111111111 b", "X1111111111"), ("111111111111x11111111111", "2111111111"), ("000000 WVE1RTY2UKP000000", "WVE1RTX2UKP000000"), ("000123", "WVE1RTY2UKP000123"), ("A1B2C3D4E5", "A1B2C3D4E"), ("", "WVE1RTY2UKP000123"), ("x ABCDE1234567 ABCDF1234567", "ABCDG1234567")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, c string").select("i", S.misread_claim_id(F.col("t"), F.col("c"))).collect()
    assert [r[1] for r in sorted(got)] == [slow(*r) for r in rows]
    assert sum(slow(*r) is not None for r in rows) >= 4


def test_check_characters_are_those_that_fit(spark):
    """Computed, not tried out; each body has one."""
    from veridoc.functions import identifiers as I

    k = F.col("id")
    uid = F.lpad((20_000_000_000 + k * 7919).cast("string"), 11, "0")
    gstin = F.concat(F.lit("27AAPFU"), F.lpad((k % 10_000).cast("string"), 4, "0"), F.lit("F1Z"))
    bad = spark.range(3000).where(~I.verhoeff_ok(F.concat(uid, I.verhoeff_digit(uid))) | ~I.gstin_ok(F.concat(gstin, I.gstin_digit(gstin))))
    assert bad.count() == 0


def test_facts_are_not_gathered_by_their_field(spark):
    """All rules of an order are tried in one task: fields are few, so a task of one would have every order."""
    rows = queries.QUERIES["f17_rule_table"](spark, "/root/testdata/sf0.001").select("o_orderkey", F.spark_partition_id().alias("task"))
    assert rows.distinct().count() == rows.select("o_orderkey").distinct().count()


def test_folders_of_files_are_made_by_many_tasks(spark):
    from veridoc.plans import stores

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("tree", "tree")
    try:
        stores.tree(spark, "/root/testdata/sf0.001")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for job in tracker.getJobIdsForGroup("tree") for s in tracker.getJobInfo(job).stageIds]
    assert max(info.numTasks for s in stages if (info := tracker.getStageInfo(s))) >= 8


def test_runs_of_words_are_not_shuffled(spark):
    """Words go through a shuffle one by one; the runs made of them, eight times as much, go through none."""
    rows = [(1, 1, k, t) for k, t in enumerate(["--", "Asha", "Ra", "o", "asha", "rao", None, "12", "MG"])] + [(1, 2, 0, "rao"), (2, 1, 0, "Asharaokumar")]
    words = spark.createDataFrame(rows, "document long, page int, k int, text string").select("*", (F.col("k") / 10).alias("x"), F.lit(0.5).alias("y"), F.lit(0.1).alias("w"), F.lit(0.1).alias("h"))
    values = spark.createDataFrame([(1, 1, "ASHA RAO"), (1, 1, "ASHA RAO"), (1, 1, "12 MG Road"), (1, 1, "--"), (1, 1, "MG"), (1, 2, "asha"), (2, 1, "asha rao"), (3, 1, "rao")], "document long, page int, value string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = geometry.located(words, values)
        got = sorted((r["document"], r["page"], r["value"], r["n_words"], round(r["box"]["x"], 6), round(r["box"]["w"], 6)) for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == [(1, 1, "ASHA RAO", 3, 0.1, 0.3), (1, 1, "MG", 1, 0.8, 0.1), (2, 1, "asha rao", 1, 0.0, 0.1)]
    plan = plan.split("Initial Plan")[-1]
    assert "Exchange" not in plan[: plan.index("Window")] and "Exchange" in plan[plan.index("Window") :]
