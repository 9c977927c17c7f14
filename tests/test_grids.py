"""Every grid query against its DuckDB equivalent, and plans against known figures."""

import math
from decimal import Decimal

import pytest

import __spark_entry__
from gridloom import catalog
from gridloom.operators import structure
from gridloom.plans import construction
from gridloom.sources import grids

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def test_each_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = __spark_entry__.queries()[name](spark, SF_DIR)
    names = sorted(found.columns)
    cursor = duck.execute(catalog.ORACLES[name])
    places = [d[0] for d in cursor.description]
    assert sorted(places) == names
    expected = sorted(tuple(plain(r[places.index(c)]) for c in names) for r in cursor.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in found.select(*names).collect()) == expected


#: pieces, cuts, seams, strip sets, difficulty and minutes of the benchmark grid's plans.
KNOWN = {"historical": (2479, 2488, 2487, 0, 56, 3718), "strip": (2479, 633, 607, 25, 16, 3968), "modern": (997, 1006, 1005, 0, 24, 1496)}


@pytest.mark.parametrize("strategy", sorted(KNOWN))
def test_benchmark_metrics(spark, strategy):
    row = construction.metrics(construction.plan(grids.benchmark(spark), strategy)).first()
    assert tuple(row[c] for c in ("piece_count", "cut_count", "seam_count", "strip_set_count", "difficulty", "time_minutes")) == KNOWN[strategy]


def test_unknown_strategies_are_refused(spark):
    with pytest.raises(NotImplementedError):
        construction.plan(grids.benchmark(spark), "fpp")
    with pytest.raises(KeyError):
        construction.plan(grids.benchmark(spark), "none")


def test_cover_takes_the_largest_rectangle_first():
    grid = [list("aab"), list("aab"), list("ccb")]
    assert construction.cover(grid) == [(0, 0, 2, 2, "a"), (0, 2, 3, 1, "b"), (2, 0, 1, 2, "c")]


def test_models_are_dealt_by_key_and_never_broadcast(spark):
    """A table that is exploded from a small file is large, whatever Spark takes it for."""
    suppliers = spark.createDataFrame([(k, k % 25) for k in range(50)], "s_suppkey long, s_nationkey int").coalesce(1)
    m = grids.from_suppliers(suppliers)
    both = m.quilts.join(m.cells, "model_id")
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert m.cells.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    # nothing is shuffled but the rows of the suppliers, before they are exploded
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 2


@pytest.mark.parametrize("name", ["areas_reconciled", "metrics_modern", "assembly_strip", "assembly_historical"])
def test_plans_broadcast_nothing(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(8 * 10**18))  # whatever may be broadcast is
    try:
        plan = __spark_entry__.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastExchange" not in plan


def test_block_layouts_shuffle_cells_once(spark):
    cells = spark.range(400).selectExpr("'m' || id div 100 as model_id", "int(id % 100 div 10) as r", "int(id % 10) as c", "'f' || id % 3 as fabric_id")
    plan = structure.block_layout(cells)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_tasks_of_models_follow_the_suppliers(spark, monkeypatch):
    monkeypatch.setattr(grids, "TASK_MODELS", 10)
    m = grids.from_suppliers(spark.range(100).selectExpr("id as s_suppkey", "int(id % 5) as s_nationkey"))
    assert m.cells.rdd.getNumPartitions() == 10 and m.quilts.count() == 100
