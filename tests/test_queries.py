"""Each query against its SQL in DuckDB, on the smallest data; a few by default, all with PANELLOOM_ALL=1."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from panelloom import queries as panel

DATA = Path(os.environ.get("PANELLOOM_DATA", "/root/testdata/sf0.001"))
SOME = ["lag_local", "rolling_local", "seasonal_local", "pooled_groupby", "pooled_partition_global", "time_agg_count", "ewm_global", "preprocess", "predict_recursive_naive", "cross_validation", "conformal_error"]
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="needs the shared test tables")


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v != v:
            return ""
        if hasattr(v, "strftime"):
            return v.strftime("%F %T")
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(panel.oracle_sql()) if os.environ.get("PANELLOOM_ALL") else SOME)
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = panel.queries()[name](spark, str(DATA)).toPandas()
    assert plain(got) == plain(db.execute(panel.oracle_sql()[name]).fetchdf())


def test_names_match():
    assert set(panel.oracle_sql()) <= set(panel.queries())
