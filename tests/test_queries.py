"""Every graph query against its SQL over the small tables, and the plans of the heavy ones."""

import glob
import os
import re

import pytest
from conftest import SF
from harness import compare, duck

import __spark_entry__ as entry_module
from strandline import queries as graph_queries
from strandline.operators import relational
from strandline.plans.tables import graph

QUERIES, SQL = graph_queries.queries(), graph_queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) == ""


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_entry_module_lists_the_graph_queries():
    assert set(QUERIES) <= set(entry_module.queries()) and set(SQL) <= set(entry_module.oracle_sql())


def test_trace_path_and_cycles_have_rows(spark):
    assert QUERIES["trace_path"](spark, SF).count() > 1
    size = QUERIES["find_cycles"](spark, SF).orderBy("size", ascending=False).first().size
    assert 2 <= size <= graph(spark, SF).nodes.filter("kind IN ('method', 'constructor')").count()


def test_edge_filters_reach_the_scan(spark):
    plan = spark.sql("SELECT l_partkey FROM parquet.`%s/lineitem.parquet` WHERE l_returnflag = 'R'" % SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan and "ReadSchema: struct<l_partkey" in plan


def test_hotspots_plan_has_no_cross_join(spark):
    plan = QUERIES["hotspots"](spark, SF)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "TakeOrderedAndProject" in plan


def test_a_query_derives_only_the_kinds_it_reads(spark):
    """No other table is read or shuffled, and no graph written, for a few kinds of edges; a graph is built at once, whatever its size."""
    plan = QUERIES["build_channel_edges"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "n_regionkey" in plan and "c_nationkey" in plan
    assert not any(c in plan for c in ("l_orderkey", "l_suppkey", "s_suppkey", "o_orderkey", "event_id"))
    plan = QUERIES["find_routes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate [l_" not in plan


def test_repeated_rows_of_tables_stay_as_in_sql(spark, tmp_path):
    """Two customers of one key: the SQL has no key either."""
    for path in glob.glob(f"{SF}/*.parquet"):
        os.symlink(path, tmp_path / os.path.basename(path))
    os.remove(tmp_path / "customer.parquet")
    con = duck(SF)
    con.execute(f"COPY (SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey < 9) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    con = duck(str(tmp_path))
    for name in ("edge_counts_by_kind", "confidence_histogram"):
        assert compare(QUERIES[name](spark, str(tmp_path)), con, SQL[name]) == ""


def test_every_inherited_member_of_the_name_is_found(spark, tmp_path):
    """Three nations of each name in a region, and one of them twice: no limit takes a single one of them."""
    for path in glob.glob(f"{SF}/*.parquet"):
        os.symlink(path, tmp_path / os.path.basename(path))
    os.remove(tmp_path / "nation.parquet")
    con = duck(SF)
    con.execute(f"COPY (SELECT CAST(n_nationkey + 25 * i AS INT) AS n_nationkey, n_name, n_regionkey FROM nation, range(3) r(i) UNION ALL SELECT * FROM nation WHERE n_nationkey = 17) TO '{tmp_path}/nation.parquet' (FORMAT parquet)")
    found = QUERIES["find_inherited"](spark, str(tmp_path))
    assert {r.member for r in found.collect()} == {"nation:17", "nation:42", "nation:67"}
    assert compare(found, duck(str(tmp_path)), SQL["find_inherited"]) == ""


def test_pairs_of_users_do_not_travel(spark):
    """EMITS pairs are grouped where they arise, and the first of each key is found before anything is dealt out."""
    edges = graph(spark, SF).edges_of("EMITS").select("source", "target", "channel")
    plan = edges._jdf.queryExecution().executedPlan().toString()
    upper = plan[re.search(r"Aggregate\(keys?=\[user_id", plan).start() : plan.index("Generate explode")]
    assert "Exchange" not in upper
    plan = QUERIES["keep_first"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


def test_wiring_of_a_symbol_filters_below_the_join(spark):
    """Pairs of classes and suppliers are not formed before one end is known."""
    plan = QUERIES["wiring_edges"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Filter [^\n]*\(concat\(ext:supplier[^\n]* = ext:supplier3\)[^\n]*\n[^\n]*Relation", plan)


def test_proxied_calls_leave_out_other_sorts_before_they_are_derived(spark):
    """The calls of parts never meet the proxied orders; unlisted where the ids' first parts are many."""
    plan = QUERIES["proxy_call_info"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "Filter" in line and "l_linenumber" in line]
    assert any("substring_index(concat(part:" in line for line in scans)


def test_percentiles_count_equal_values_first(spark):
    df = spark.createDataFrame([("a", v) for v in (*range(1, 21), None)] + [("b", 7), ("c", None), (None, 3), (None, 4)], "k string, v int")
    found = relational.latency_percentiles(df, "k", "v")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("a", 10.0, 19.0), ("b", 7.0, 7.0), ("c", None, None), (None, 3.0, 4.0)], key=repr)
    assert [t for _, t in found.dtypes] == ["string", "double", "double"]
    assert "percentile" not in found._jdf.queryExecution().executedPlan().toString()
