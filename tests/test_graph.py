import datetime

import pytest
from pyspark.sql import functions as F

from quadrille import ANY, Bindings, Blank, Coercion, Dataset, Graph, Iri, Literal, Namespaces, Prepared, Template
from quadrille.operators.isomorphism import isomorphic
from quadrille.terms import DECIMAL, INTEGER

EX = "http://example.org/"
NS = Namespaces({"ex": EX})
SENSORS = """@prefix ex: <http://example.org/> .
ex:a a ex:Sensor ; ex:v 1 ; ex:label "A" . ex:b a ex:Sensor ; ex:v 2 . ex:c a ex:Autre ; ex:v 3 ."""


def one(v):
    return Literal(str(v), INTEGER)


@pytest.fixture(scope="module")
def g(spark):
    return Graph.parse(spark, SENSORS)


def names(rows, key="s"):
    return sorted(r[key].value.removeprefix(EX) for r in rows)


# -- match


def test_projection_and_arity(g):
    assert names(g.match("?s a ex:Sensor ; ex:v ?v")) == ["a", "b"]
    m = g.match("?v ex:unused ?s")
    assert m.names == ["v", "s"] and not m
    with pytest.raises(TypeError):
        len(m)


def test_first_one_count(g):
    assert g.match("?s ex:v 3").one() == Iri(EX + "c")
    assert g.match("?s ex:v 9").first("none") == "none"
    for text in ("?s ex:v 9", "?s ex:v ?v"):
        with pytest.raises(ValueError):
            g.match(text).one()
    assert g.match("?s ex:v ?v").count() == 3
    assert g.match("ex:a ex:v 1") and not g.match("ex:a ex:v 2")
    assert g.match("ex:a ex:v 1").count() == 1


def test_shared_repeated_and_crossed_variables(spark):
    k = Graph.parse(spark, "@prefix ex: <http://example.org/> . ex:a ex:k ex:b . ex:b ex:k ex:c . ex:d ex:k ex:d .")
    assert names(k.match("?s ex:k ?m . ?m ex:k ?o"), "o") == ["c", "d"]
    assert list(k.match("?s ex:k ?s")) == [Iri(EX + "d")]
    assert k.match("?a ex:k ?b . ?c ex:k ?d").count() == 9


def test_hidden_variables_keep_duplicates(spark):
    t = Graph.parse(spark, "@prefix ex: <http://example.org/> . ex:t ex:pom [ ex:n 1 ], [ ex:n 1 ] .")
    assert list(t.match("?s ex:pom [ ex:n ?x ]")) == [{"s": Iri(EX + "t"), "x": one(1)}] * 2
    assert "x" in t.match("?s ex:pom _:b . _:b ex:n ?x").solutions().names


def test_initial_bindings_and_wildcards(g):
    assert names(g.match("?s ex:v ?v", bindings={"v": 2})) == ["b"]
    assert g.match("?s ex:v ?v", bindings={"v": None}).count() == 3
    assert g.match("{{x}} ex:v {{x}}", x=ANY).count() == 3
    assert names(g.match("?s ex:v ?v")(bindings=[{"v": 1}, {"v": 3}])) == ["a", "c"]
    with pytest.raises(TypeError):
        g.match("{{x}} ex:v ?v", x=None).count()


def test_text_that_looks_like_an_iri_stays_a_literal(g):
    assert not g.match("{{x}} ex:v ?v", x=EX + "a")
    assert g.match("{{x}} ex:v ?v", x=Iri(EX + "a"))


def test_filtered_match(g):
    found = g.match("?s ex:v ?v").where("?v > 1").frame(s="string", v="int").collect()
    assert sorted((r.s.removeprefix(EX), r.v) for r in found) == [("b", 2), ("c", 3)]


# -- algebra and changes


def test_set_algebra(spark, g):
    other = Graph.parse(spark, "@prefix ex: <http://example.org/> . ex:a ex:v 1 . ex:n ex:v 7 .")
    assert (g + other).count() == 8 and (g - other).count() == 6 and (g * other).count() == 1
    assert sum([g, other, other]).count() == 8
    h = Graph.empty(spark, ns=NS)
    assert not h
    h += other
    h -= Graph.parse(spark, "@prefix ex: <http://example.org/> . ex:n ex:v 7 .")
    assert list(h) == [(Iri(EX + "a"), Iri(EX + "v"), one(1))]
    assert (Iri(EX + "a"), None, one(1)) in h and (ANY, Iri(EX + "q"), None) not in h
    assert g.value(Iri(EX + "a"), Iri(EX + "label")) == Literal("A") and g.value(Iri(EX + "zz")) is None


def test_removal_rules(spark):
    def fresh():
        return Graph.parse(spark, "@prefix ex: <http://example.org/> . ex:a ex:p 1, 2 ; ex:q 3 . ex:b ex:p 4 .")

    assert fresh().remove("?x ex:p ?x").count() == 1  # one pattern: each variable is a wildcard
    assert fresh().remove("ex:a {{any}} {{any}}", any=ANY).count() == 1
    assert fresh().remove("?x ex:p ?y ; ex:q ?z").count() == 1
    assert fresh().remove("?x ex:p 1 . ?y ex:q 99").count() == 4  # a join, if nothing is shared too
    assert fresh().remove("ex:a ex:p 1 . ex:zz ex:p 1").count() == 3
    assert fresh().remove("?x ex:p e{ 1 + 3 }").count() == 3


def test_a_failing_change_leaves_the_graph(spark):
    h = Graph.parse(spark, "@prefix ex: <http://example.org/> . ex:a ex:p 1 .")
    for text in ("ex:s ex:p ?unbound", "'x' ex:p 1", "ex:s 'x' 1"):
        with pytest.raises(ValueError):
            h.add(text)
    with pytest.raises(TypeError):
        h.add("ex:s ex:p {{x}}", x=ANY)
    assert h.count() == 1


def test_many_changes_keep_the_plan_short(spark):
    h = Graph.empty(spark, ns=NS)
    for i in range(20):
        h.add("ex:s ex:p {{i}}", i=i)
    assert h.count() == 20
    assert str(h.triples()._jdf.queryExecution().analyzed().toString()).count("Union") < 10


def test_prefixes_of_one_graph_do_not_touch_another(spark):
    a, b = Graph.empty(spark, ns=NS), Graph.empty(spark, ns=NS)
    a.bind("ex", "http://other/").designate(Namespaces({"ex": "http://third/", "q": "http://q/"}))
    assert a.ns.prefixes["ex"] == "http://other/" and a.ns.prefixes["q"] == "http://q/" and b.ns.prefixes["ex"] == EX


# -- templates and bindings


def test_unbound_drops_only_its_triples(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "id string, v int")
    made = Template("ex:{?id} ex:id ?id ; ex:v ?v ; ex:w e{ ?v * 2 }", NS)(rows)
    assert made.count() == 4


def test_fresh_blanks_per_row_shared_within(spark):
    rows = spark.createDataFrame([("x",), ("x",)], "a string")
    made = Template("_:n ex:a ?a . _:n ex:b _:m", NS)(rows)
    assert made.count() == 4 and made.triples().select("s").distinct().count() == 2
    assert Template("_:{?a} ex:a ?a", NS)(rows).count() == 1
    again = Template("_:n ex:a ?a", NS)
    assert not set(again(rows)) & set(again(rows))


def test_blank_keys_match_the_host(spark):
    import decimal

    from quadrille.terms import blank_label

    cells = ("it's x", "c", 5, 2.5e-7, decimal.Decimal("1.50"), True, 1e20, 0.1)
    rows = spark.createDataFrame([cells], "a string, b string, n int, x double, d decimal(9,2), t boolean, y double, z double")
    made = list(Template("_:{?a} ex:p _:{?a, ?b} . _:{?b} ex:q _:{?n} . _:{?x} ex:q _:{?d} . _:{?t} ex:q _:{?y} . _:{?z} ex:q 1", NS)(rows))
    labels = {t.label for x in made for t in x if isinstance(t, Blank)}
    assert labels == {blank_label(v) for v in (*cells, cells[:2])}


def test_collections_and_encoding(spark):
    rows = spark.createDataFrame([("a b/é~*", 1)], "id string, v int")
    made = Template("e<http://e/{?id}> ex:l (?v (2) ())", NS)(rows)
    assert Iri("http://e/a%20b%2Fé~%2A") in {s for s, _, _ in made}
    text = made.turtle()
    assert '("1"' in text or "(" in text
    assert isomorphic(list(made), list(Graph.parse(made.spark, text)))


def test_bindings_forms(spark):
    from collections import namedtuple

    row = namedtuple("R", "id v")
    for rows in ([{"id": "a", "v": 1}], [row("a", 1)], spark.createDataFrame([("a", 1)], "id string, v int"), Bindings.from_rows(spark, {"id": "a", "v": 1})):
        assert Graph.empty(spark, ns=NS).add("ex:{?id} ex:v ?v", rows).count() == 1
    with pytest.raises(TypeError):
        Bindings.from_rows(spark, [3])
    b = Bindings.from_df(spark.createDataFrame([("a", ""), ("b", "n")], "id string, note string"))
    assert Graph.empty(spark, ns=NS).add("ex:{?id} ex:note ?note", b.where(b.raw("note") != "")).count() == 1
    assert Graph.empty(spark, ns=NS).add("ex:{?id} ex:x ?x", b.set("x", 5).drop("note")).count() == 2


def test_coercion(spark):
    rows = spark.createDataFrame([("http://x/a", "42", datetime.date(2020, 1, 2))], "id string, age string, d date")
    with Coercion({"id": Iri, "age": Iri(INTEGER), datetime.date: lambda c: F.date_format(c, "yyyy")}):
        made = list(Template("?id ex:age ?age ; ex:d ?d", NS)(rows))
        assert Coercion({str: Iri(DECIMAL)}).rule("x", str) == Iri(DECIMAL)
    assert set(made) == {(Iri("http://x/a"), Iri(EX + "age"), one(42)), (Iri("http://x/a"), Iri(EX + "d"), Literal("2020"))}
    with Coercion({str: Iri(DECIMAL)}), Coercion({"q": Iri(INTEGER)}):
        from quadrille.operators.coercion import to_node

        assert to_node("1", "q") == one(1) and to_node("1", "other") == Literal("1", DECIMAL)


# -- SPARQL on dynamic terms


def rows(result):
    return sorted(tuple(t.n3() if t else "" for t in r.values()) for r in result)


def test_optional_then_join_on_possibly_unbound(g):
    q = "SELECT ?s ?l WHERE { ?s ex:v ?v OPTIONAL { ?s ex:label ?l } OPTIONAL { ?s ex:v ?l } }"
    assert rows(g.query(q)) == [("<http://example.org/a>", '"A"'), ("<http://example.org/b>", '"2"^^<%s>' % INTEGER), ("<http://example.org/c>", '"3"^^<%s>' % INTEGER)]


def test_minus_without_shared_variables_keeps_all(g):
    assert len(rows(g.query("SELECT ?s WHERE { ?s ex:v ?v MINUS { ?x ex:label ?y } }"))) == 3


def test_aggregates_over_dynamic_terms(g):
    found = list(g.query("SELECT ?c (AVG(?v) AS ?m) (SUM(?v) AS ?t) (MAX(?v) AS ?x) (COUNT(*) AS ?n) WHERE { ?s a ?c ; ex:v ?v } GROUP BY ?c ORDER BY ?c"))
    assert [(r["m"].lexical, r["t"].lexical, r["x"].lexical, r["n"].lexical) for r in found] == [("3.0", "3", "3", "1"), ("1.5", "3", "2", "2")]
    empty = list(g.query("SELECT (SUM(?v) AS ?t) (AVG(?v) AS ?a) (COUNT(?v) AS ?n) WHERE { ?s ex:none ?v }"))[0]
    assert (empty["t"].lexical, empty["a"].lexical, empty["n"].lexical) == ("0", "0", "0")


def test_a_sum_over_a_non_number_is_an_error(spark):
    h = Graph.parse(spark, "@prefix ex: <http://example.org/> . ex:a ex:v 1, 'x' .")
    assert list(h.query("SELECT (SUM(?v) AS ?t) WHERE { ?s ex:v ?v }", NS)) == [{"t": None}]


def test_order_of_kinds(spark):
    h = Graph.parse(spark, "@prefix ex: <http://example.org/> . ex:a ex:v 10, 9, 'x', ex:i, _:b .")
    got = [r["v"] for r in h.query("SELECT ?v WHERE { ?s ex:v ?v } ORDER BY ?v", NS)]
    assert isinstance(got[0], Blank) and got[1] == Iri(EX + "i") and {got[2], got[3], got[4]} == {Literal("x"), one(9), one(10)}
    assert got.index(one(9)) < got.index(one(10))


def test_construct_ask_describe(g):
    assert bool(g.query("ASK { ex:a ex:v 1 }")) and not g.query("ASK { ex:a ex:v 5 }")
    assert g.query("CONSTRUCT { ?s ex:w ?v } WHERE { ?s ex:v ?v }").graph.count() == 3
    assert g.query("CONSTRUCT WHERE { ?s ex:v ?v }").graph.count() == 3
    assert g.query("DESCRIBE ex:a").graph.count() == 3


def test_describe_follows_blanks(spark):
    h = Graph.parse(spark, "@prefix ex: <http://example.org/> . ex:a ex:p [ ex:q [ ex:r 1 ] ] . ex:b ex:p 1 .")
    assert h.query("DESCRIBE ex:a", NS).graph.count() == 3


def test_prepared_queries_take_other_parameters(g):
    p = Prepared("SELECT ?s WHERE { ?s ex:v {{v}} }", NS)
    assert rows(p(g, v=1)) == [("<http://example.org/a>",)] and rows(p(g, v=3)) == [("<http://example.org/c>",)]
    assert rows(g.query("SELECT ?s ?v WHERE { ?s ex:v ?v }", bindings={"v": 2})) == [("<http://example.org/b>", '"2"^^<%s>' % INTEGER)]


def test_filters_see_initial_bindings(g):
    assert len(rows(g.query("SELECT ?s WHERE { ?s ex:v ?v FILTER(?v > ?least) }", bindings={"least": 1}))) == 2


def test_formatted_parameters(g):
    found = g.query("CONSTRUCT { f<http://x/{{n:03d}}/{{s!r}}> ex:p 1 } WHERE {}", n=7, s="a").graph
    assert [s for s, _, _ in found] == [Iri("http://x/007/'a'")]


def test_bind_of_a_bound_variable_is_refused(g):
    with pytest.raises(ValueError):
        g.query("SELECT ?s WHERE { ?s ex:v ?v BIND(1 AS ?v) }").frame()


# -- paths

PATHS = "@prefix ex: <http://example.org/> . ex:a ex:p ex:b . ex:b ex:q ex:c . ex:d ex:p ex:b . ex:c ex:p ex:e . ex:e ex:p ex:c ."


def ends(spark, path, start="ex:a"):
    h = Graph.parse(spark, PATHS)
    return sorted(r["x"].value.removeprefix(EX) for r in h.query(f"SELECT ?x WHERE {{ {start} {path} ?x }}", NS))


@pytest.mark.parametrize(
    "path, want",
    [
        ("ex:p/ex:q", ["c"]),
        ("(ex:p|ex:q)+", ["b", "c", "e"]),
        ("ex:p*", ["a", "b"]),
        ("ex:p?", ["a", "b"]),
        ("ex:p/^ex:p", ["a", "d"]),
        ("!ex:q", ["b"]),
        ("!(ex:p|^ex:q)", []),
        ("(ex:p/ex:q)/ex:p+", ["c", "e"]),
    ],
)
def test_paths(spark, path, want):
    assert ends(spark, path) == want


def test_closures_on_a_cycle_end(spark):
    h = Graph.parse(spark, PATHS)
    assert h.query("SELECT ?x ?y WHERE { ?x ex:p+ ?y }", NS).solutions.df.count() == 6
    assert h.match("?x ex:p+ ex:c").count() == 2
    assert h.match("ex:zz ex:p* ?x").count() == 1


# -- datasets and updates


def test_update_sees_a_snapshot(spark):
    h = Graph.parse(spark, "@prefix ex: <http://example.org/> . ex:a ex:v 1 . ex:b ex:v 2 .")
    h.update("DELETE { ?s ex:v ?v } INSERT { ?s ex:v ?w } WHERE { ?s ex:v ?v BIND(?v + 1 AS ?w) }", NS)
    assert sorted(o.lexical for _, _, o in h) == ["2", "3"]
    h.update("INSERT DATA { ex:n ex:v {{x}} } ; DELETE WHERE { ex:a ?p ?o }", NS, x=7)
    assert h.count() == 2


def test_dataset_operations(spark):
    d = Dataset(spark, Graph.parse(spark, SENSORS))
    d.update("INSERT DATA { GRAPH ex:g { ex:x ex:v 1 } } ; ADD DEFAULT TO ex:g ; MOVE ex:g TO ex:h", NS)
    assert list(d.named) == [EX + "h"] and d.named[EX + "h"].count() == 8 and d.quads().count() == 15
    d.update("WITH ex:h DELETE { ?s ex:v ?v } WHERE { ?s ex:v ?v } ; CLEAR DEFAULT", NS)
    assert d.named[EX + "h"].count() == 4 and d.default.count() == 0
    assert [r["g"] for r in d.query("SELECT DISTINCT ?g WHERE { GRAPH ?g { ?s a ?t } }", NS)] == [Iri(EX + "h")]
    with pytest.raises(ValueError):
        d.query("SELECT * FROM <http://nowhere> WHERE { ?s ?p ?o }", NS)


def test_templates_may_name_graphs_by_variable(spark):
    d = Dataset(spark, named={EX + n: Graph.parse(spark, f"@prefix ex: <{EX}> . ex:{n} ex:v 1 .") for n in "gh"})
    d.update("DELETE { GRAPH ?g { ?s ex:v ?v } } INSERT { GRAPH ?g { ?s ex:w ?g } GRAPH ex:new { ?s ex:was ?v } } WHERE { GRAPH ?g { ?s ex:v ?v } }", NS)
    assert list(d.named[EX + "g"]) == [(Iri(EX + "g"), Iri(EX + "w"), Iri(EX + "g"))] and d.named[EX + "new"].count() == 2


def test_random_values_are_one_per_occurrence(spark):
    made = Template("e{ UUID() } ex:a 1 ; ex:b 2 . e{ UUID() } ex:c 3", NS)(spark.range(3))
    assert made.triples().select("s").distinct().count() == 6


def test_a_path_as_parameter(spark):
    from quadrille import parse_path

    h = Graph.parse(spark, PATHS)
    assert h.match("ex:a {{p}} ?x", p=parse_path("ex:p/ex:q", NS)).one() == Iri(EX + "c")


# -- files


def test_ntriples_files(spark, tmp_path):
    h = Graph.parse(spark, SENSORS + ' ex:t ex:s "tab\\t q\\" b\\\\ nl\\n é"@fr-CA, _:x .')
    h.write_ntriples(str(tmp_path / "nt"))
    back = Graph.read_ntriples(spark, str(tmp_path / "nt"))
    assert isomorphic(list(h), list(back))


def test_a_bad_line_is_an_error(spark):
    from quadrille.sources.rdf_text import parse_lines

    with pytest.raises(Exception, match="not an N-Triples line"):
        parse_lines(spark.createDataFrame([("<a> <b> .",)], "value string")).collect()


def test_stored_graph_prunes_predicates(spark, g, tmp_path):
    g.save(str(tmp_path / "g"))
    back = Graph.load(spark, str(tmp_path / "g"), NS)
    assert back.count() == g.count()
    m = back.match("?s ex:v ?v")
    assert m.count() == 3
    assert "PartitionFilters: [isnotnull(p_key" in m.frame()._jdf.queryExecution().executedPlan().toString()
