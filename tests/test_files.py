"""Folders of files are listed by tasks, and whose files they are is told by their names."""

import os

import pytest

from veridoc.sources import files


@pytest.fixture
def tree(tmp_path):
    """Deep, wide and odd names, links, and what Spark's readers leave out."""
    names = [f"a/b/c/d/CLAIM{i:06}/x.pdf" for i in range(12)] + [f"CLAIM{i:06}.pdf" for i in range(9)] + ["s p/ü+%20=1.txt", "k=v/_x=1", "_hidden/a", ".git/b", "_m", "x._COPYING_", "_metadata", "a/.c", "a/b/CLAIM000077/CLAIM000078.pdf", "a/b/LOOSE000079.pdf"]
    for n in names:
        os.makedirs(tmp_path / "t" / os.path.dirname(n), exist_ok=True)
        (tmp_path / "t" / n).write_text(n)
    os.makedirs(tmp_path / "t" / "empty")
    os.symlink(tmp_path / "t" / "nowhere", tmp_path / "t" / "broken")
    return str(tmp_path / "t")


def rows(df):
    return sorted(map(tuple, df.select("path", "name", "folder", "depth", "size", "modified").collect()))


@pytest.mark.parametrize("rounds", [(1,), (3, 5), files.ROUNDS])
def test_listing_as_by_spark(spark, tree, monkeypatch, rounds):
    by_spark = files.files_by_spark(spark, tree, True).collect()
    monkeypatch.setattr(files, "files_by_spark", None)  # it has all files' statuses on the driver
    monkeypatch.setattr(files, "ROUNDS", rounds)
    got = rows(files.listed(spark, tree))
    assert sorted((r[0], r[4], r[5]) for r in got) == sorted((r["path"], r["size"], r["modified"]) for r in by_spark)
    assert len(got) == 25 and ("s p/ü+%20=1.txt", "ü+%20=1.txt", "s p", 1) in {r[:4] for r in got}
    assert rows(files.listed(spark, f"file://{tree}/")) == got
    assert {r[0] for r in rows(files.listed(spark, tree, recursive=False))} == {r[0] for r in got if r[3] == 0}


def test_empty_and_missing_folders(spark, tree):
    assert rows(files.listed(spark, f"{tree}/empty")) == []
    with pytest.raises(Exception, match="nothing_here"):
        files.listed(spark, f"{tree}/nothing_here")


def test_loose_files_meet_no_folders(spark, tree):
    """Most files lie in the root or in one folder, which as a join's key would put them all in one task."""
    found = files.folder_claims(files.listed(spark, tree), 1, 11)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    want = [(f"a/b/c/d/CLAIM{i:06}", f"CLAIM{i:06}", "FOLDER") for i in range(12)] + [(f"CLAIM{i:06}.pdf", f"CLAIM{i:06}", "FILE") for i in range(9)] + [("a/b/CLAIM000077", "CLAIM000077", "FOLDER"), ("a/b/LOOSE000079.pdf", "LOOSE000079", "FILE")]
    got = sorted(tuple(r) for r in found.select("path", "claim", "kind").collect())
    assert [r for r in got if r[1][:5] in ("CLAIM", "LOOSE")] == sorted(want)
