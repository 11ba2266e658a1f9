"""A sample of the catalog against its SQL on the smallest tables (the driver runs all of it)."""

import glob
import math
import os

import duckdb
import pytest

from dispatchlake import registry

SF = "/root/testdata/sf0.001"
SAMPLE = ["prj_05_reported_full", "prj_18_incident_corridors", "agg_01_episodes_full", "agg_03_hot_spots", "agg_08_digest", "agg_15_merge_hours", "agg_18_hour_week_matrix", "agg_27_weather_effect", "agg_29_follow_on_share", "agg_47_road_stats", "jn_01_filter_new", "jn_13_near_path", "flt_facet_sweep"]
SAMPLE += [n for n in registry.ORACLES if n not in SAMPLE and n.startswith(("flt_", "src_", "str_", "agg_2", "agg_4", "agg_5", "snk_", "sql_", "jn_02_a", "jn_15", "jn_16"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    value = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.columns, df.collect()) == plain(names, found.fetchall())
