import pandas as pd
import pytest

from glyphtrace.plans import audits, corpus, text
from tests.conftest import DATA, duck

QUERIES, SQL = {**text.QUERIES, **corpus.QUERIES, **audits.QUERIES}, {**text.ORACLE_SQL, **corpus.ORACLE_SQL, **audits.ORACLE_SQL}


def plain(frame):
    number = lambda v: None if pd.isna(v) else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
    item = lambda v: number(v.item() if hasattr(v, "item") else v)
    return sorted(str(tuple(item(v) for v in r)) for r in zip(*(frame[c].tolist() for c in sorted(frame.columns)), strict=True))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    got, want = QUERIES[name](spark, f"{DATA}/sf0.001").toPandas(), duck(SQL[name])
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0
