"""A sample of registered queries against their SQL at the smallest scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
          " labels conversations").split()
SAMPLE = ["feature_table", "recipient_network", "agent_terminal", "sketch_admission", "profile_view",
          "policy_outcome", "mode_timeline", "audit_verify", "lifecycle_validate", "roc_auc",
          "recipient_reputation_asof", "drift_report", "reconcile_rescore"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    df = df.reindex(sorted(df.columns), axis=1)

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
            return ""
        return f"{float(v):.6f}" if not isinstance(v, (str, bool)) and hasattr(v, "__float__") else str(v)

    return sorted("|".join(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
