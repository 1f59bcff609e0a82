"""Queries and their SQL belong together; a few are run against DuckDB (all are, by the driver)."""

import glob
import os
import random

import duckdb
import pytest

from plaitwork import registry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert len(registry.QUERIES) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["rel_join", "bag_fold", "expl_flat_map", "trace_join_agg", "gr_triangles", "ml_auc", "st_active_users"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, SF)
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    place = [want.columns.index(c) for c in order]
    assert sorted(str([r[c] for c in order]) for r in got.collect()) == sorted(str([r[k] for k in place]) for r in want.fetchall())


def test_guarded_sums_in_the_order_of_rows(spark, tmp_path):
    """Keys whose rows lie in several files and whose sums are 0.30 up to the order of their terms, against one thread of DuckDB."""
    rng = random.Random(4)
    terms = [[t / 100 for t in (rng.choices(range(9), k=6))] for _ in range(20_000)]
    ties = [t for t in terms if round(sum(t), 6) == 0.3]
    assert len(ties) > 100
    for part in range(3):
        rows = [(key, tax) for key, t in enumerate(ties) for tax in t[2 * part : 2 * part + 2]]
        made = spark.createDataFrame(rows, "l_orderkey long, l_tax double").coalesce(1)
        made.write.parquet(str(tmp_path / f"made{part}"))
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / f"made{part}").glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"part-{part}.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(registry.ORACLES["expl_aggregation_guard"]).fetchall()
    assert 0 < len({key for key, _ in want}) < len(ties)
    got = registry.QUERIES["expl_aggregation_guard"](spark, str(tmp_path))
    assert got.columns == ["l_orderkey", "l_tax"] and sorted(map(tuple, got.collect())) == sorted(want)
