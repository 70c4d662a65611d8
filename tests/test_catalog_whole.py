import datetime as dt
import glob
import os
from collections import Counter

import pytest

from tidemark.plans import catalog

WHOLE = ["resample_linear_all", "resample_ffill_all", "resample_bfill_all", "resample_downsample_2min_all", "resample_subset_columns_all", "lag_hour_all", "lag_day_all", "lag_forward_all", "null_check_all", "continuity_gaps_all"]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """No row of the user group SOME; minutes 00:00, 00:01, 00:05, 01:00 and 03:01 of a day, and one a day later."""
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(minutes=m, seconds=7 * i), 1 + i, "view", 10.25 * (i + 1)) for i, m in enumerate([0, 0, 1, 5, 60, 181, 1440])]
    out = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{out}/events.parquet")
    return out


def cell(v):
    return round(v, 3) if isinstance(v, float) else v


@pytest.mark.parametrize("name", WHOLE)
def test_query_takes_all_events_and_matches_its_sql(spark, events, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet({sorted(glob.glob(os.path.join(events, 'events.parquet', '*.parquet')))})")
    want = Counter(tuple(map(cell, r)) for r in con.execute(catalog.ORACLE_SQL[name]).fetchall())
    got = Counter(tuple(map(cell, r)) for r in catalog.QUERIES[name](spark, events).collect())
    assert want and got == want


def test_gaps_of_all_events(spark, events):
    assert sorted(r["duration"] for r in catalog.QUERIES["continuity_gaps_all"](spark, events).collect()) == [240, 3300, 7260, 75540]


def test_lasso_uses_the_whole_grid_and_all_test_days(spark, events, monkeypatch):
    seen = []
    monkeypatch.setattr(catalog.models.LassoCVModel, "run", lambda self, frame, *a: seen.append((self.n_alphas, a)) or frame.limit(0).withColumn("coefficients", catalog.F.lit(0)))
    catalog.QUERIES["rolling_lasso_cv"](spark, events)
    assert seen == [(100, ("2024-01-20", "2024-01-24", "price", 2))]
