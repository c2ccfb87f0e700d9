"""Queries over records, graphs, axes and doubles give what their SQL gives (DuckDB, sf0.001)."""

import os

import duckdb
import pytest

from paramloom import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in catalog.queries().items() if f.__module__ in ("paramloom.catalog_records", "paramloom.catalog_live", "paramloom.catalog_values", "paramloom.catalog_sources", "paramloom.catalog_access") or n.split("_")[0] in ("grid", "order", "sample", "domain", "binding", "plan", "trial"))


def _value(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return str([_value(y) for y in x])
    return str(x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x)


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(_value(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", [*NAMES, "wiring_match", "wiring_classify"])
def test_query_equals_sql(spark, oracle, name):
    got = catalog.queries()[name](spark, SF)
    want = oracle.execute(catalog.oracle_sql()[name])
    assert _rows([tuple(r) for r in got.collect()], got.columns) == _rows(want.fetchall(), [c[0] for c in want.description])
