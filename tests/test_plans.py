"""Plans that must hold at scale: joins on keys, not nested loops."""

import pytest

from quadrille.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["q_13_subquery", "q_9_minus", "m_2_bgp_chain", "q_7_optional_filter"])
def test_joins_have_keys(spark, name):
    df = catalogue.queries()[name](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ["q_7_join_after_optional", "b_6_table_bindings"])
def test_bound_parts_join_on_keys(spark, name):
    """A variable that may be unbound: no join on an alternative with IS NULL, but parts."""
    text = plan(catalogue.queries()[name](spark, SF))
    joins = [line for line in text.splitlines() if "Join " in line]
    assert joins and not any("OR isnull" in line or " OR isnull" in line for line in joins)
    assert any("=" in line for line in joins)


def test_minus_after_optional(spark):
    from quadrille import Graph, Namespaces

    ns = Namespaces({"ex": "http://example.org/"})
    g = Graph.empty(spark, ns=ns).add("ex:{?s} ex:p ?p ; ex:q ?q", spark.createDataFrame([("a", 1, 2), ("b", 1, None), ("c", 3, 4)], "s string, p int, q int"))
    got = g.query("SELECT ?s ?q WHERE { ?s ex:p ?p OPTIONAL { ?s ex:q ?q } MINUS { ?x ex:q ?q FILTER(?q = 4) } }").solutions
    assert sorted((r.s.v, r.q and r.q.v) for r in got.terms().collect()) == [("http://example.org/a", "2"), ("http://example.org/b", None)]
    assert not any("OR isnull" in line for line in plan(got.df).splitlines() if "Join " in line)


def test_distinct_with_an_order_that_is_not_projected(spark):
    from quadrille import Graph, Namespaces

    ns = Namespaces({"ex": "http://example.org/"})
    g = Graph.empty(spark, ns=ns).add("ex:{?s} ex:p ?p ; ex:q ?q", spark.createDataFrame([("a", 1, 5), ("b", 2, 4), ("c", 1, 3)], "s string, p int, q int"))
    rows = g.query("SELECT DISTINCT ?p WHERE { ?s ex:p ?p ; ex:q ?q } ORDER BY ?q").frame(p="int").collect()
    assert [r.p for r in rows] == [1, 2]


@pytest.mark.parametrize("name", ["q_10_exists_bind", "q_10_exists_nested", "q_10_exists_outer_filter"])
def test_exists_meets_outer_values_on_keys(spark, name):
    """Outer values that a tested group reads join it on the variables it shares with the outer solutions."""
    joins = [line for line in plan(catalogue.queries()[name](spark, SF)).splitlines() if "Join " in line]
    assert joins and all("= __r_c" in line for line in joins)


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("?c ex:bal ?b FILTER EXISTS { ?o ex:by ?c ; ex:price ?p BIND(?b * 2 AS ?y) FILTER(?p > ?y) }", "ae"),
        ("?c ex:bal ?b FILTER NOT EXISTS { ?o ex:by ?c ; ex:price ?p FILTER(?p > ?b) }", "ce"),
        ("?c ex:bal ?b FILTER EXISTS { ?o ex:by ?c MINUS { ?o ex:by ?c ; ex:price ?p FILTER(?p > ?b) } }", "abce"),
        ("?c ex:bal ?b FILTER EXISTS { { SELECT ?c (MAX(?p) AS ?m) WHERE { ?o ex:by ?c ; ex:price ?p } GROUP BY ?c } FILTER(?m > ?b + 20) }", "a"),
        ("?c ex:is 1 OPTIONAL { ?c ex:bal ?b } FILTER EXISTS { ?o ex:by ?c ; ex:price ?p FILTER(?p > ?b) }", "ab"),
    ],
)
def test_exists_reads_the_values_of_its_own_solution(spark, where, want):
    from pyspark.sql import functions as F

    from quadrille import Graph, Namespaces

    ns = Namespaces({"ex": "http://example.org/"})
    customers = spark.createDataFrame([("a", 10), ("b", 60), ("c", 10), ("d", None), ("e", -5)], "s string, b int").coalesce(1)
    orders = spark.createDataFrame([("o1", "a", 50), ("o2", "a", 5), ("o3", "b", 50), ("o4", "c", 5), ("o5", "d", 50), ("o6", "b", 70), ("o7", "e", -9)], "o string, c string, p int").coalesce(1)
    g = Graph.empty(spark, ns=ns).add("ex:{?s} ex:is 1 ; ex:bal ?b", customers).add("ex:{?o} ex:by ex:{?c} ; ex:price ?p", orders)
    rows = g.query(f"SELECT ?c WHERE {{ {where} }}").solutions.terms().select(F.substring_index("c.v", "/", -1).alias("c")).collect()
    assert sorted(r.c for r in rows) == list(want)
