import pytest
from support import DATA, same_rows

import __spark_entry__ as driver
from ambler.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, DATA), duck, catalog.ORACLES[name])


def test_alias_walks_agree_between_strategies(spark):
    a = catalog.walk_alias(spark, DATA).collect()
    b = catalog.walk_alias_join(spark, DATA).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    edges = {(r.src, r.dst) for r in catalog.graph_edges(spark, DATA).collect()}
    at = {(r.walker, r.step): r.node for r in a}
    assert all((at[w, s - 1], n) in edges for (w, s), n in at.items() if s)


def test_alias_samples_keep_the_take_all_rule(spark):
    deg = {r.id: r.deg for r in catalog.graph_edges(spark, DATA).groupBy("src").count().selectExpr("src as id", "count as deg").collect()}
    rows = catalog.khop_alias(spark, DATA).collect()
    at = {(r.instance, r.hop, r.slot): r.node for r in rows}
    counts = {}
    for r in rows:
        if r.hop:
            counts[r.instance, r.hop, r.parent_slot] = counts.get((r.instance, r.hop, r.parent_slot), 0) + 1
    for (i, hop, parent), n in counts.items():
        assert n == min((20, 5)[hop - 1], deg[at[i, hop - 1, parent]])


def test_hops_read_the_written_graph(spark):
    """No hop makes the graph from the tables again."""
    rows = catalog.khop_chain(spark, DATA)
    assert rows.inputFiles() and not any("lineitem" in f for f in rows.inputFiles())


def test_contract():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert callable(driver.entry)
