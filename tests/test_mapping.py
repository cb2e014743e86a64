"""Virtual graphs: the plans they give, and equality with the triples they stand for."""

import random

import pytest

from quadrille import Graph
from quadrille.sources.tables import NS, graph_of

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_star_is_one_scan(spark):
    df = graph_of(spark, SF).match("?o v:o_orderkey ?k ; v:o_orderstatus ?s ; v:o_totalprice ?p ; v:o_orderpriority '1-URGENT'").frame()
    text = physical(df)
    assert text.count("FileScan") == 1 and "Join" not in text
    assert "o_totalprice" in text and "o_custkey" not in text and "o_orderdate" not in text


def test_joins_compare_keys(spark):
    df = graph_of(spark, SF).query("SELECT ?n WHERE { ?o v:o_customer ?c . ?c v:c_name ?n }").frame()
    text = plan(df)
    assert text.count("Join Inner") == 1 and "concat" not in text.split("Join Inner")[1].split("\n")[0]
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in physical(df)


def test_terms_of_different_templates_never_join(spark):
    sols = graph_of(spark, SF).match("?x v:c_name ?a . ?y v:o_customer ?x . ?x v:n_name ?b").solutions()
    assert sols.df.count() == 0


def test_row_keyed_tables_are_sets(spark):
    g = graph_of(spark, SF, "lineitem")
    raw = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert g.match("?l v:l_quantity ?q ; v:l_tax ?t").count() == raw.distinct().count()


PATTERNS = ["?c v:c_custkey ?k", "?c v:c_nation ?n", "?n v:n_name ?m", "?n v:n_region ?r", "?r v:r_name ?q", "?s v:s_nation ?n", "?c a v:Customer", "?c v:c_mktsegment 'BUILDING'", "nation:3 v:n_region ?r", "?n ?p region:1"]


@pytest.mark.parametrize("seed", range(6))
def test_random_patterns_agree_with_the_triples(spark, seed):
    rnd = random.Random(seed)
    text = " . ".join(rnd.sample(PATTERNS, rnd.randint(1, 3)))
    virtual = graph_of(spark, SF, "customer", "nation", "region", "supplier")
    held = Graph.from_triples(virtual.triples(), ns=NS)
    a, b = virtual.match(text).projected().terms(), held.match(text).projected().terms()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
