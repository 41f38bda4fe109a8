"""Every registered relational query against its SQL, and the entry module without the corpus operators."""

import duckdb
import pytest

from veridoc.plans import queries

DIR = "/root/testdata/sf0.01"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"]
#: Queries whose right answer may be no rows.
MAY_BE_EMPTY: set[str] = set()


def printed(value):
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DIR)
    if name not in queries.ORACLE:
        assert got.count() > 0
        return
    want = con.sql(queries.ORACLE[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda found: sorted(tuple(map(printed, r)) for r in found)
    have = rows(got.select(columns).collect())
    assert have == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())
    assert have or name in MAY_BE_EMPTY, "no rows prove nothing"


def test_entry_without_corpus_operators(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def blocked(name, *args, **kwargs):
        if name.startswith("corpus_pipeline"):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", blocked)
    sys.modules.pop("__spark_entry__", None)
    module = importlib.import_module("__spark_entry__")
    assert set(module.queries()) == set(queries.QUERIES) and set(module.oracle_sql()) == set(queries.ORACLE)
    sys.modules.pop("__spark_entry__", None)
