import os
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    if not isinstance(v, (list, tuple, dict, set)) and pd.isna(v):
        return None
    return round(float(v), 5) if isinstance(v, float) else str(v)


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in entry.engine.SQL))
def test_query_equals_sql(spark, duck, name):
    got = entry.engine.QUERIES[name](spark, DIR).toPandas()
    want = duck.sql(entry.engine.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_quota_query_against_a_sequential_pass(spark):
    from tidemark.operators.rules import quota_order
    from tidemark.queries.ranking import shortlist

    before = shortlist(spark, DIR).select("request_id", "item", "brand", "rank").toPandas().sort_values(["request_id", "rank"])
    after = entry.engine.QUERIES["rule_quota"](spark, DIR).toPandas().sort_values(["request_id", "rank"])
    for request, group in before.groupby("request_id"):
        want = [group["item"].iloc[i] for i in quota_order(group["brand"].tolist(), 2, 10)]
        assert after[after.request_id == request]["item"].tolist() == want


def test_the_rest_does_not_import_the_training_data_operators():
    root = Path(entry.__file__).parent
    for path in (root / "tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tidemark.llm" not in path.read_text(), path
