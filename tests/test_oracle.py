"""Every registered query equals its DuckDB oracle (rows, columns, values)."""

from __future__ import annotations

import hashlib

import pandas as pd
import pytest

import __spark_entry__ as entry
from strata.plans import catalog
from tests.conftest import SF_SMALL

SQL = {k: v for k, v in entry.oracle_sql().items() if k in catalog.queries()}
NAMES = sorted(SQL)


def _norm(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False, name=None):
        rows.append("|".join(repr(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else repr(v) for v in r))
    return sorted(rows)


def test_every_query_has_oracle_or_is_listed():
    rows_only = {"threshold_simplex", "threshold_compare_all", "fit_multilabel", "run_pipeline", "run_seeds"}
    missing = set(catalog.queries()) - set(SQL) - rows_only
    assert not missing, missing


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    s = entry.queries()[name](spark, SF_SMALL).toPandas()
    d = duck(SF_SMALL).execute(SQL[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert len(s) == len(d)
    a, b = _norm(s), _norm(d)
    if a != b:
        diff = [x for x in a if x not in set(b)][:5]
        pytest.fail(f"{name}: value mismatch, e.g. {diff}")
    assert hashlib.sha1("\n".join(a).encode()).hexdigest() == hashlib.sha1("\n".join(b).encode()).hexdigest()


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 22
    assert df.columns == ["section", "name", "value"]
