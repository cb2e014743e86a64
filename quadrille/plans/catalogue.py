"""One query or more per operator of the inventory, each with the SQL that gives the same rows.

Queries read the tables' virtual graph unless they say otherwise. Sums of doubles are made
over decimals, so that their order does not show in the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators.bindings import Bindings
from ..operators.coercion import Coercion
from ..operators.graph import Dataset, Graph
from ..operators.template import Template
from ..sources.rdf_text import n3, ntriples, parse_lines
from ..sources.shared import folder
from ..sources.tables import NS, VOCAB, graph_of, read, read_csv
from ..terms import ANY, DECIMAL, Iri, blank_label

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def sparql(name: str, text: str, sql: str, tables: str, casts: dict[str, str] | None = None, **params) -> None:
    """A SELECT over the virtual graph of some tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graph_of(spark, sf_dir, *tables.split()).query(text, **params).frame(**(casts or {}))

    run.__doc__ = text
    _queries[name], _sql[name] = run, sql


def stored(name: str, text: str, sql: str, tables: str, /, **casts: str) -> None:
    """The same over materialised triples: no scan is fused, every value is dynamic."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = Graph.from_triples(graph_of(spark, sf_dir, *tables.split()).triples(), ns=NS, distinct=True)
        return graph.query(text).frame(**casts)

    run.__doc__ = text
    _queries[name], _sql[name] = run, sql


def query(name: str, sql: str | None = None):
    def register(run: Query) -> Query:
        _queries[name] = run
        if sql is not None:
            _sql[name] = sql
        return run

    return register


def expression(name: str, text: str, sql: str, table: str = "orders", casts: dict[str, str] | None = None, where: str = "") -> None:
    """?r is an expression over one table's columns; SQL names them by their columns."""
    pattern = {
        "orders": "?s v:o_orderkey ?k ; v:o_totalprice ?p ; v:o_orderstatus ?st ; v:o_orderpriority ?pr ; v:o_orderdate ?d .",
        "nation": "?s v:n_nationkey ?k ; v:n_name ?n ; v:n_region ?reg .",
        "customer": "?s v:c_custkey ?k ; v:c_name ?n ; v:c_acctbal ?b ; v:c_mktsegment ?m .",
        "part": "?s v:p_partkey ?k ; v:p_name ?n ; v:p_size ?z ; v:p_brand ?br ; v:p_type ?ty .",
        "documents": "?s v:doc_id ?k ; v:text ?t ; v:n_chars ?c .",
    }[table]
    column = {"orders": "o_orderkey", "nation": "n_nationkey", "customer": "c_custkey", "part": "p_partkey", "documents": "doc_id"}[table]
    sparql(
        name,
        f"SELECT ?k ({text} AS ?r) WHERE {{ {pattern} {where} }}",
        f"SELECT CAST({column} AS BIGINT) AS k, {sql} AS r FROM {table}",
        table,
        casts,
    )


DEC = "CAST(CAST({} AS DECIMAL(38,12)) AS DOUBLE)"

# -- flagship ------------------------------------------------------------------

FLAGSHIP = """SELECT ?nation (COUNT(?o) AS ?orders) (xsd:double(SUM(xsd:decimal(?price))) AS ?total)
WHERE { ?o a v:Order ; v:o_customer ?c ; v:o_totalprice ?price . ?c v:c_nation ?n . ?n v:n_name ?nation }
GROUP BY ?nation ORDER BY DESC(?orders) ?nation LIMIT 10"""
FLAGSHIP_SQL = """SELECT n_name AS nation, count(*) AS orders, CAST(CAST(sum(CAST(o_totalprice AS DECIMAL(38,12))) AS DECIMAL(38,2)) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY orders DESC, nation LIMIT 10"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to triples, a pattern over three tables, groups and top-k."""
    return graph_of(spark, sf_dir, "orders", "customer", "nation").query(FLAGSHIP).frame()


query("flagship", FLAGSHIP_SQL)(flagship)

# -- sources, sinks and context --------------------------------------------------

ORDER_TEMPLATE = """e<http://example.org/orders/{?o_orderkey}> a v:Order ; v:o_customer e<http://example.org/customer/{?o_custkey}> ;
 v:o_totalprice ?o_totalprice ; v:o_orderstatus ?o_orderstatus ; v:o_orderdate ?o_orderdate ."""


@query(
    "s_1_rows_to_triples_count",
    "SELECT p, count(*) AS n FROM orders, (VALUES ('type'), ('o_customer'), ('o_totalprice'), ('o_orderstatus'), ('o_orderdate')) AS t(p) GROUP BY p",
)
def _rows_to_triples(spark, sf_dir):
    rows = Template(ORDER_TEMPLATE, NS).instantiate(read(spark, sf_dir, "orders"))
    return rows.groupBy(F.regexp_extract("p.v", r"[^#]*$", 0).alias("p")).agg(F.count("*").alias("n"))


@query("s_2_csv_strings", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name FROM nation")
def _csv(spark, sf_dir):
    path = f"{folder(spark)}/nation-{uuid.uuid4().hex}.csv"
    read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).write.option("header", True).csv(path)
    cells = read_csv(spark, path)
    return Graph.empty(spark, ns=NS).add("_:{?k} v:k ?k ; v:name ?name", cells).query("SELECT ?k ?name WHERE { ?s v:k ?k ; v:name ?name }").frame(k="string", name="string")


@query("s_3_rows_of_host", "SELECT 'a' AS id, 1::BIGINT AS v UNION ALL SELECT 'b', 2::BIGINT")
def _host_rows(spark, sf_dir):
    graph = Graph.empty(spark, ns=NS).add("ex:{?id} v:v ?v ; v:id ?id", [{"id": "a", "v": 1}, {"id": "b", "v": 2}, {"id": "c", "v": None}])
    return graph.query("SELECT ?id ?v WHERE { ?s v:id ?id ; v:v ?v }").frame(id="string", v="bigint")


@query("s_5_single_mapping", "SELECT 3::BIGINT AS v")
def _single(spark, sf_dir):
    return Graph.empty(spark, ns=NS).add("ex:x v:v ?v ; v:missing ?nothing", {"v": 3}).query("SELECT ?v WHERE { ?s ?p ?v }").frame(v="bigint")


@query("s_6_named_graph", "SELECT 'http://example.org/g' AS g, count(*) AS n FROM nation")
def _named(spark, sf_dir):
    data = Dataset(spark, named={"http://example.org/g": graph_of(spark, sf_dir, "nation")})
    return data.query("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s v:n_name ?x } } GROUP BY ?g", NS).frame()


@query("s_11_ntriples_roundtrip", "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def _ntriples(spark, sf_dir):
    lines = ntriples(graph_of(spark, sf_dir, "nation", "region").triples())
    graph = Graph.from_triples(parse_lines(lines), ns=NS)
    return graph.query("SELECT ?name ?region WHERE { ?n v:n_name ?name ; v:n_region/v:r_name ?region }").frame(name="string", region="string")


@query("s_12_ntriples_lines", """SELECT '<http://example.org/region/' || r_regionkey || '> <http://example.org/vocab#r_name> "' || r_name || '" .' AS line FROM region""")
def _lines(spark, sf_dir):
    rows = graph_of(spark, sf_dir, "region").triples().where("p.v = 'http://example.org/vocab#r_name'")
    return ntriples(rows).select(F.col("value").alias("line"))


@query("s_14_full_scan", "SELECT 3 * (SELECT count(*) FROM region) + 4 * (SELECT count(*) FROM nation) AS n")
def _scan(spark, sf_dir):
    return graph_of(spark, sf_dir, "region", "nation").triples().agg(F.count("*").alias("n"))


@query("s_15_n3_form", """SELECT '"' || o_totalprice_text || '"^^<http://www.w3.org/2001/XMLSchema#integer>' AS t FROM (SELECT CAST(o_orderkey AS VARCHAR) AS o_totalprice_text FROM orders)""")
def _n3(spark, sf_dir):
    rows = graph_of(spark, sf_dir, "orders").triples().where("p.v = 'http://example.org/vocab#o_orderkey'")
    return rows.select(n3(F.col("o")).alias("t"))


# -- terms -----------------------------------------------------------------------

sparql("t_2_relative_iri", "BASE <http://example.org/nation/> SELECT ?n WHERE { <7> v:n_name ?n }", "SELECT n_name AS n FROM nation WHERE n_nationkey = 7", "nation")
sparql("t_3_prefixed_name", "SELECT ?n WHERE { nation:3 v:n_name ?n }", "SELECT n_name AS n FROM nation WHERE n_nationkey = 3", "nation")


@query("t_7_format_spec", "SELECT 'http://example.org/p/' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS iri FROM nation")
def _formatted(spark, sf_dir):
    rows = read(spark, sf_dir, "nation")
    made = Template("f<http://example.org/p/{{k:04d}}> v:name ?n_name", NS, k=F.col("n_nationkey")).instantiate(rows)
    return made.select(F.col("s.v").alias("iri"))


def _template(name: str, text: str, table: str, select: str, sql: str, /, **casts: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        graph = Graph.empty(spark, ns=NS).add(text, read(spark, sf_dir, table))
        return graph.query(select).frame(**casts)


_template("t_5_deferred_name", "nation:{?n_nationkey} v:name ?n_name", "nation", "SELECT ?s ?n WHERE { ?s v:name ?n }", "SELECT 'http://example.org/nation/' || n_nationkey AS s, n_name AS n FROM nation", s="string", n="string")
_template(
    "t_9_interpolated_literal",
    "nation:{?n_nationkey} v:name e{ STRLANG(?n_name, 'en') }",
    "nation",
    "SELECT (STR(?n) AS ?x) (LANG(?n) AS ?l) WHERE { ?s v:name ?n }",
    "SELECT n_name AS x, 'en' AS l FROM nation",
)
_template(
    "t_15_keyed_bnode",
    "_:{?c_mktsegment, ?c_nationkey} v:seg ?c_mktsegment",
    "customer",
    "SELECT (COUNT(DISTINCT ?b) AS ?n) WHERE { ?b v:seg ?s }",
    "SELECT count(*) AS n FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)",
)


@query("t_15_host_and_column", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def _host_and_column(spark, sf_dir):
    made = Template("_:{?c_mktsegment, ?c_nationkey} v:holds ?c_custkey", NS)(read(spark, sf_dir, "customer"))
    key = blank_label(("BUILDING", 3))
    return made.match("?b v:holds ?k").solutions().terms().where(F.col("b.v") == key).select(F.col("k.v").cast("int").alias("k"))


_template("t_16_fresh_bnode", "[] v:of ?c_mktsegment", "customer", "SELECT (COUNT(DISTINCT ?b) AS ?n) WHERE { ?b v:of ?s }", "SELECT count(*) AS n FROM customer")
_template(
    "t_18_collection_len",
    "nation:{?n_nationkey} v:list (?n_name ?n_regionkey (?n_nationkey))",
    "nation",
    "SELECT (COUNT(*) AS ?n) WHERE { ?c rdf:first ?x }",
    "SELECT 4 * count(*) AS n FROM nation",
)
_template(
    "t_19_property_list",
    "nation:{?n_nationkey} v:in [ v:key ?n_regionkey ; v:of nation:{?n_nationkey} ]",
    "nation",
    "SELECT ?k (COUNT(?s) AS ?n) WHERE { ?s v:in [ v:key ?k ] } GROUP BY ?k",
    "SELECT CAST(n_regionkey AS BIGINT) AS k, count(*) AS n FROM nation GROUP BY 1",
    k="bigint",
)
_template(
    "t_21_turtle_numbers",
    "nation:{?n_nationkey} v:x 4, 4.5, 4e0, true",
    "nation",
    "SELECT ?t (COUNT(*) AS ?n) WHERE { ?s v:x ?x BIND(STRAFTER(STR(DATATYPE(?x)), '#') AS ?t) } GROUP BY ?t",
    "SELECT t, count(*) AS n FROM nation, (VALUES ('integer'), ('decimal'), ('double'), ('boolean')) AS x(t) GROUP BY t",
)
_template(
    "t_24_encoded_iri",
    "e<http://example.org/p/{?p_name}> v:name ?p_name",
    "part",
    "SELECT (STR(?s) AS ?iri) WHERE { ?s v:name ?n }",
    "SELECT DISTINCT 'http://example.org/p/' || replace(replace(p_name, '%', '%25'), ' ', '%20') AS iri FROM part",
)


@query("t_13_coercion", "SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(38,12))) AS DOUBLE) AS total, 'decimal' AS kind FROM customer")
def _coercion(spark, sf_dir):
    with Coercion({"c_acctbal": Iri(DECIMAL)}):
        graph = Graph.empty(spark, ns=NS).add("customer:{?c_custkey} v:bal ?c_acctbal", Bindings.from_df(read(spark, sf_dir, "customer")))
    return graph.query("SELECT (xsd:double(SUM(?b)) AS ?total) (STRAFTER(STR(DATATYPE(SAMPLE(?b))), '#') AS ?kind) WHERE { ?s v:bal ?b }").frame()


# -- graphs ------------------------------------------------------------------------


@query("g_2_drop_unbound", "SELECT p, count(*) AS n FROM (SELECT 'name' AS p FROM nation UNION ALL SELECT 'reg' FROM nation WHERE n_regionkey <> 2) GROUP BY p")
def _drop(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").withColumn("reg", F.nullif("n_regionkey", F.lit(2)))
    made = Template("nation:{?n_nationkey} v:name ?n_name ; v:reg ?reg", NS).instantiate(rows)
    return made.groupBy(F.regexp_extract("p.v", r"[^#]*$", 0).alias("p")).agg(F.count("*").alias("n"))


@query("g_5_expression_error_drops", "SELECT CAST(p_partkey AS BIGINT) AS k, CAST(CAST(100 AS DECIMAL(22,8)) / (p_size - 10) AS DOUBLE) AS q FROM part WHERE p_size <> 10")
def _error_drops(spark, sf_dir):
    graph = Graph.empty(spark, ns=NS).add("part:{?p_partkey} v:k ?p_partkey ; v:q e{ xsd:double(100.0) / (?p_size - 10) }", read(spark, sf_dir, "part"))
    return graph.query("SELECT ?k ?q WHERE { ?s v:k ?k ; v:q ?q }").frame(k="bigint", q="double")


def _two(spark, sf_dir) -> tuple[Graph, Graph]:
    """Segments of customers with a low and with a high balance, as two graphs."""
    rows = read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal")
    text = "nation:{?c_nationkey} v:seg ?c_mktsegment"
    return Graph.empty(spark, ns=NS).add(text, rows.where("c_acctbal < 3000")), Graph.empty(spark, ns=NS).add(text, rows.where("c_acctbal > 6000"))


_PAIR = "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal {}"


def _set(name: str, op: str, do) -> None:
    @query(name, f"SELECT 'http://example.org/nation/' || c_nationkey AS n, c_mktsegment AS seg FROM ({_PAIR.format('< 3000')} {op} {_PAIR.format('> 6000')})")
    def run(spark, sf_dir):
        return do(*_two(spark, sf_dir)).triples().select(F.col("s.v").alias("n"), F.col("o.v").alias("seg"))


_set("g_6_union_distinct", "UNION", lambda a, b: a + b)
_set("g_8_difference", "EXCEPT", lambda a, b: a - b)
_set("g_9_intersection", "INTERSECT", lambda a, b: a * b)


@query("g_7_in_place_union", f"SELECT count(*) AS n FROM ({_PAIR.format('< 3000')} UNION {_PAIR.format('> 6000')})")
def _in_place(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    a += b
    return a.triples().agg(F.count("*").alias("n"))


@query("g_10_set_cardinality", "SELECT count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)")
def _cardinality(spark, sf_dir):
    return Template("nation:{?c_nationkey} v:seg ?c_mktsegment", NS)(read(spark, sf_dir, "customer")).triples().agg(F.count("*").alias("n"))


@query("g_11_membership", "SELECT count(*) > 0 AS found FROM nation WHERE n_nationkey = 3 AND n_regionkey = 1")
def _member(spark, sf_dir):
    return graph_of(spark, sf_dir, "nation").query("ASK { nation:3 v:n_region region:1 }").ask_frame("found")


def _removal(name: str, do, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        graph = Graph.from_triples(graph_of(spark, sf_dir, "nation").triples(), ns=NS, distinct=True)
        do(graph)
        return graph.triples().groupBy(F.regexp_extract("p.v", r"[^#]*$", 0).alias("p")).agg(F.count("*").alias("n"))


_BY = "SELECT p, n FROM (VALUES ('type'), ('n_nationkey'), ('n_name'), ('n_region')) AS t(p), (SELECT count(*) AS n FROM nation) {}"
_removal("g_13_remove_wildcard", lambda g: g.remove("?x v:n_region ?x"), _BY.format("WHERE p <> 'n_region'"))
_removal(
    "g_14_delete_where",
    lambda g: g.remove("?n v:n_region region:1 ; v:n_name ?name"),
    "SELECT p, count(*) AS n FROM nation, (VALUES ('type'), ('n_nationkey'), ('n_name'), ('n_region')) AS t(p) WHERE NOT (n_regionkey = 1 AND p IN ('n_region', 'n_name')) GROUP BY p",
)
_removal(
    "g_15_remove_ground",
    lambda g: g.remove("nation:1 a v:Nation . nation:2 a v:Nation . nation:99999 a v:Nation"),
    "SELECT p, count(*) AS n FROM nation, (VALUES ('type'), ('n_nationkey'), ('n_name'), ('n_region')) AS t(p) WHERE NOT (p = 'type' AND n_nationkey IN (1, 2)) GROUP BY p",
)
_removal("m_7_any_wildcard", lambda g: g.remove("{{any}} v:n_name {{any}}", any=ANY), _BY.format("WHERE p <> 'n_name'"))

# -- pattern matching ----------------------------------------------------------------

sparql("m_1_bound_positions", "SELECT ?s WHERE { ?s v:c_mktsegment 'BUILDING' ; v:c_nation nation:5 }", "SELECT 'http://example.org/customer/' || c_custkey AS s FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 5", "customer")


def pattern(name: str, text: str, sql: str, tables: str, bindings=None, /, **casts: str) -> None:
    """The solutions of a match."""

    @query(name, sql)
    def run(spark, sf_dir):
        return graph_of(spark, sf_dir, *tables.split()).match(text, bindings=bindings).frame(**casts)


pattern(
    "m_2_bgp_chain",
    "?c v:c_name ?name ; v:c_nation ?n . ?n v:n_name ?nation ; v:n_region ?r . ?r v:r_name ?region",
    "SELECT 'http://example.org/customer/' || c_custkey AS c, c_name AS name, 'http://example.org/nation/' || n_nationkey AS n, n_name AS nation, 'http://example.org/region/' || r_regionkey AS r, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "customer nation region",
)
pattern(
    "m_2_bgp_star",
    "?o v:o_orderkey ?k ; v:o_orderstatus ?st ; v:o_totalprice ?p ; v:o_orderpriority '1-URGENT'",
    "SELECT 'http://example.org/orders/' || o_orderkey AS o, o_orderkey AS k, o_orderstatus AS st, o_totalprice AS p FROM orders WHERE o_orderpriority = '1-URGENT'",
    "orders",
)

@query("m_2_bgp_lineitem", "SELECT 'http://example.org/orders/' || l_orderkey AS o, l_quantity AS q, o_orderkey AS k FROM (SELECT DISTINCT * FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_orderstatus = 'F'")
def _lineitem(spark, sf_dir):
    text = "?l a v:LineItem ; v:l_order ?o ; v:l_quantity ?q ; v:l_returnflag 'R' . ?o v:o_orderstatus 'F' ; v:o_orderkey ?k"
    return graph_of(spark, sf_dir, "lineitem", "orders").match(text).frame().drop("l")


pattern("m_3_repeated_var", "?n v:n_nationkey ?x ; v:n_name ?name . ?r v:r_regionkey ?x", "SELECT 'http://example.org/nation/' || n_nationkey AS n, CAST(n_nationkey AS BIGINT) AS x, n_name AS name, 'http://example.org/region/' || r_regionkey AS r FROM nation JOIN region ON n_nationkey = r_regionkey", "nation region")
pattern("m_4_cross", "?a v:r_name ?x . ?b v:n_name ?y", "SELECT 'http://example.org/region/' || r_regionkey AS a, r_name AS x, 'http://example.org/nation/' || n_nationkey AS b, n_name AS y FROM region, nation", "region nation")
pattern("m_6_hidden_var", "?n v:n_name ?name ; v:n_region [ v:r_name ?region ]", "SELECT 'http://example.org/nation/' || n_nationkey AS n, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey", "nation region")
pattern("m_8_initial_bindings", "?c v:c_mktsegment ?seg ; v:c_custkey ?k", "SELECT 'http://example.org/customer/' || c_custkey AS c, c_mktsegment AS seg, c_custkey AS k FROM customer WHERE c_mktsegment = 'MACHINERY'", "customer", {"seg": "MACHINERY"})


@query("m_5_ground_pattern", "SELECT count(*) > 0 AS found FROM nation WHERE n_nationkey = 4")
def _ground(spark, sf_dir):
    return graph_of(spark, sf_dir, "nation").query("ASK { nation:4 a v:Nation }").ask_frame("found")


@query("m_13_count", "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def _count(spark, sf_dir):
    return graph_of(spark, sf_dir, "orders", "customer").match("?o v:o_customer ?c . ?c v:c_mktsegment 'BUILDING'").solutions().df.agg(F.count("*").alias("n"))


@query("m_19_filter_solutions", "SELECT 'http://example.org/part/' || p_partkey AS s, CAST(p_size AS BIGINT) AS z FROM part WHERE p_size * 2 > 90")
def _filtered(spark, sf_dir):
    return graph_of(spark, sf_dir, "part").match("?s v:p_size ?z").where("?z * 2 > 90").frame()


@query("m_20_construct", "SELECT 'http://example.org/nation/' || c_nationkey AS n, c_mktsegment AS seg FROM customer GROUP BY ALL")
def _construct(spark, sf_dir):
    sols = graph_of(spark, sf_dir, "customer").match("?c v:c_nation ?n ; v:c_mktsegment ?seg").projected()
    return Template("?n v:serves ?seg", NS)(sols, spark).triples().select(F.col("s.v").alias("n"), F.col("o.v").alias("seg"))


@query("m_21_distinct", "SELECT DISTINCT c_mktsegment AS seg FROM customer")
def _distinct(spark, sf_dir):
    return graph_of(spark, sf_dir, "customer").query("SELECT DISTINCT ?seg WHERE { ?c v:c_mktsegment ?seg }").frame()


@query("m_22_objects", "SELECT DISTINCT o_orderstatus AS o FROM orders")
def _objects(spark, sf_dir):
    return graph_of(spark, sf_dir, "orders").objects(p=Iri(VOCAB + "o_orderstatus")).select(F.col("o.v").alias("o"))


@query("m_23_minted_join", "SELECT c_name AS name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name")
def _minted(spark, sf_dir):
    """Two tables written apart meet on equal IRIs."""
    graph = Graph.empty(spark, ns=NS)
    graph.add("orders:{?o_orderkey} v:by e<http://example.org/customer/{?o_custkey}>", read(spark, sf_dir, "orders"))
    graph.add("customer:{?c_custkey} v:name ?c_name", read(spark, sf_dir, "customer"))
    return graph.query("SELECT ?name (COUNT(?o) AS ?n) WHERE { ?o v:by ?c . ?c v:name ?name } GROUP BY ?name").frame(name="string")


# -- expressions -----------------------------------------------------------------------

expression("e_2_effective_boolean", "IF(?z - 10, 'yes', 'no')", "CASE WHEN p_size - 10 <> 0 THEN 'yes' ELSE 'no' END", "part")
expression("e_4_bound", "BOUND(?x)", "p_size > 25", "part", where="OPTIONAL { ?s v:p_size ?x FILTER(?x > 25) }")
expression("e_7_promotion_integer", "?z * 3 + ?k - 1", "CAST(p_size * 3 + p_partkey - 1 AS BIGINT)", "part")
expression("e_7_promotion_decimal", "xsd:double(?z * 1.5 + 0.25)", "CAST(p_size * 1.5 + 0.25 AS DOUBLE)", "part")
expression("e_7_promotion_double", "?p * 2 + 1", "o_totalprice * 2 + 1")
expression("e_8_division", "xsd:double(?z / 4)", "CAST(p_size AS DOUBLE) / 4", "part")
expression("e_8_division_by_zero", "COALESCE(?z / (?z - ?z), 'error')", "'error'", "part", casts={"r": "string"})
expression("e_9_unary", "IF(!(?z > 10), -?z, +?z)", "CAST(CASE WHEN p_size > 10 THEN p_size ELSE -p_size END AS BIGINT)", "part")
expression("e_10_compare", "?p > 100000.5", "o_totalprice > 100000.5")
expression("e_10_compare_date", "?d < '1996-01-01T00:00:00'^^xsd:dateTime", "o_orderdate < TIMESTAMP '1996-01-01 00:00:00'")
expression("e_10_incomparable", "COALESCE(?st < 5, 'error')", "'error'", casts={"r": "string"})
expression("e_11_equal_value", "?z = 10.0", "p_size = 10", "part")
expression("e_12_not_equal", "?st != 'F'", "o_orderstatus <> 'F'")
expression("e_13_in", "?pr IN ('1-URGENT', '2-HIGH')", "o_orderpriority IN ('1-URGENT', '2-HIGH')")
expression("e_13_not_in", "?z NOT IN (1, 2, 3)", "p_size NOT IN (1, 2, 3)", "part")
expression("e_14_three_valued", "COALESCE((?z / 0 > 1) || ?z > 25, 'error')", "CASE WHEN p_size > 25 THEN 'true' ELSE 'error' END", "part", casts={"r": "string"})
expression("e_14_and_false", "COALESCE((?z / 0 > 1) && ?z > 25, 'error')", "CASE WHEN p_size > 25 THEN 'error' ELSE 'false' END", "part", casts={"r": "string"})
expression("e_15_if", "IF(?p > 100000, 'big', 'small')", "CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END")
expression("e_15_if_error", "COALESCE(IF(1 / (?z - 7) > 0, 'up', 'down'), 'error')", "CASE WHEN p_size = 7 THEN 'error' WHEN p_size > 7 THEN 'up' ELSE 'down' END", "part")
expression("e_15_ternary", "'big' IF ?p > 100000 ELSE 'small'", "CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END")
expression("e_16_coalesce", "COALESCE(?nothing, 1 / 0, ?z)", "CAST(p_size AS BIGINT)", "part", casts={"r": "bigint"})
expression("e_17_str", "STR(?reg)", "'http://example.org/region/' || n_regionkey", "nation")
expression("e_18_lang", "LANG(?t)", "lang", "documents")
expression("e_19_datatype", "STR(DATATYPE(?t))", "'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString'", "documents")
expression("e_20_strlang", "LANG(STRLANG(?n, 'en-GB'))", "'en-GB'", "nation")
expression("e_20_strdt", "STRDT(STR(?k), xsd:integer) + 1", "CAST(n_nationkey + 1 AS BIGINT)", "nation", casts={"r": "bigint"})
expression("e_21_iri", "STR(IRI(CONCAT('http://x/', ?n)))", "'http://x/' || n_name", "nation")
expression("e_23_concat", "CONCAT(?st, '/', ?pr)", "o_orderstatus || '/' || o_orderpriority")
expression("e_24_case", "CONCAT(UCASE(?n), LCASE(?m))", "upper(c_name) || lower(c_mktsegment)", "customer")
expression("e_24_keeps_lang", "LANG(UCASE(?t))", "lang", "documents")
expression("e_25_strlen", "STRLEN(?t)", "CAST(length(text) AS BIGINT)", "documents")
expression("e_26_substr", "SUBSTR(?n, 3, 4)", "substr(n_name, 3, 4)", "nation")
expression("e_26_substr_from_zero", "SUBSTR(?n, 0, 2)", "substr(n_name, 1, 1)", "nation")
expression("e_26_substr_rest", "SUBSTR(?n, 3)", "substr(n_name, 3)", "nation")
expression("e_27_starts", "STRSTARTS(?pr, '1')", "starts_with(o_orderpriority, '1')")
expression("e_27_ends", "STRENDS(?n, 'A')", "suffix(n_name, 'A')", "nation")
expression("e_27_contains", "CONTAINS(?t, 'the')", "contains(text, 'the')", "documents")
expression("e_28_before", "STRBEFORE(?pr, '-')", "split_part(o_orderpriority, '-', 1)")
expression("e_28_after", "STRAFTER(?pr, '-')", "substr(o_orderpriority, strpos(o_orderpriority, '-') + 1)")
expression("e_28_not_found", "CONCAT('[', STRBEFORE(?pr, '@'), STRAFTER(?pr, '@'), ']')", "'[]'")
expression("e_29_replace", "REPLACE(?n, '([aeiou])', '<$1>', 'i')", "regexp_replace(n_name, '([aeiouAEIOU])', '<\\1>', 'g')", "nation")
expression("e_30_regex", "REGEX(?pr, '^[12]-(urgent|high)$', 'i')", "regexp_matches(o_orderpriority, '^[12]-(URGENT|HIGH)$')")
expression("e_31_abs", "ABS(?b)", "abs(c_acctbal)", "customer")
expression("e_31_ceil", "CEIL(?b)", "ceil(c_acctbal)", "customer")
expression("e_31_floor", "FLOOR(?b)", "floor(c_acctbal)", "customer")
expression("e_31_round", "ROUND(?b)", "floor(c_acctbal + 0.5::DOUBLE)", "customer")
expression("e_31_round_decimal", "xsd:double(ROUND(?z * -0.5))", "CAST(floor(p_size * -0.5 + 0.5) AS DOUBLE)", "part")
expression("e_32_sameterm", "SAMETERM(?z, 10)", "p_size = 10", "part")
expression("e_33_kinds", "CONCAT(STR(ISIRI(?reg)), STR(ISLITERAL(?n)), STR(ISBLANK(?s)))", "'truetruefalse'", "nation")
expression("e_34_isnumeric", "ISNUMERIC(?z) && !ISNUMERIC(?n)", "true", "part")
expression("e_35_langmatches", "LANGMATCHES(LANG(?t), 'EN')", "lang = 'en'", "documents")
expression("e_36_encode", "ENCODE_FOR_IRI(?n)", "replace(replace(p_name, '%', '%25'), ' ', '%20')", "part")
expression("q_35_encode_for_uri", "ENCODE_FOR_URI(CONCAT('é ', ?n))", "'%C3%A9%20' || replace(replace(p_name, '%', '%25'), ' ', '%20')", "part")
expression("e_37_nested_iri", "STR(e<http://x/{CONCAT(?st, ' ', ?pr)}>)", "'http://x/' || o_orderstatus || '%20' || replace(o_orderpriority, ' ', '%20')")
expression("q_36_dates", "YEAR(?d) * 10000 + MONTH(?d) * 100 + DAY(?d)", "CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS BIGINT)")
expression("q_36_times", "HOURS(?d) * 60 + MINUTES(?d)", "CAST(hour(o_orderdate) * 60 + minute(o_orderdate) AS BIGINT)")
expression("q_38_md5", "MD5(?n)", "md5(n_name)", "nation")
expression("q_38_sha1", "SHA1(?n)", "sha1(n_name)", "nation")
expression("q_38_sha256", "SHA256(?n)", "sha256(n_name)", "nation")
stored("e_7_dynamic", "SELECT ?k (?z * 2 + 1 AS ?r) WHERE { ?s v:p_partkey ?k ; v:p_size ?z }", "SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size * 2 + 1 AS BIGINT) AS r FROM part", "part", k="bigint", r="bigint")
stored("e_10_dynamic", "SELECT ?k WHERE { ?s v:p_partkey ?k ; v:p_size ?z FILTER(?z >= 40.0 || ?z < 3) }", "SELECT CAST(p_partkey AS BIGINT) AS k FROM part WHERE p_size >= 40 OR p_size < 3", "part", k="bigint")
stored("q_14_dynamic_aggregate", "SELECT ?b (SUM(?z) AS ?t) (MAX(?n) AS ?m) (COUNT(*) AS ?c) WHERE { ?s v:p_brand ?b ; v:p_size ?z ; v:p_name ?n } GROUP BY ?b", "SELECT p_brand AS b, CAST(sum(p_size) AS BIGINT) AS t, max(p_name) AS m, count(*) AS c FROM part GROUP BY 1", "part", b="string", t="bigint", m="string")
stored("m_2_stored_chain", "SELECT ?name ?region WHERE { ?c v:c_name ?name ; v:c_nation ?n . ?n v:n_region ?r . ?r v:r_name ?region }", "SELECT c_name AS name, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "customer nation region", name="string", region="string")

# -- SPARQL ----------------------------------------------------------------------------

sparql("q_1_select_as", "SELECT ?name (?b * 2 AS ?twice) WHERE { ?c v:c_name ?name ; v:c_acctbal ?b }", "SELECT c_name AS name, c_acctbal * 2 AS twice FROM customer", "customer")


@query("q_2_ask", "SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 400000")
def _ask(spark, sf_dir):
    return graph_of(spark, sf_dir, "orders").query("ASK { ?o v:o_totalprice ?p FILTER(?p > 400000) }").ask_frame("found")


@query("q_3_construct", "SELECT DISTINCT 'http://example.org/nation/' || c_nationkey AS s, c_mktsegment AS o FROM customer")
def _q_construct(spark, sf_dir):
    rows = graph_of(spark, sf_dir, "customer").query("CONSTRUCT { ?n v:has ?m } WHERE { ?c v:c_nation ?n ; v:c_mktsegment ?m }").frame()
    return rows.select(F.col("s.v").alias("s"), F.col("o.v").alias("o"))


@query("q_4_describe", "SELECT p FROM nation, (VALUES ('type'), ('n_nationkey'), ('n_name'), ('n_region')) AS t(p) WHERE n_nationkey = 3")
def _describe(spark, sf_dir):
    return graph_of(spark, sf_dir, "nation").query("DESCRIBE nation:3").frame().select(F.regexp_extract("p.v", r"[^#]*$", 0).alias("p"))


sparql("q_5_bgp", "SELECT ?o ?seg WHERE { ?o v:o_customer ?c ; v:o_orderstatus 'P' . ?c v:c_mktsegment ?seg }", "SELECT 'http://example.org/orders/' || o_orderkey AS o, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'", "orders customer")
sparql("q_6_filter", "SELECT ?k WHERE { ?o v:o_orderkey ?k ; v:o_totalprice ?p ; v:o_orderstatus ?s FILTER(?p > 150000 && ?s != 'O') }", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 150000 AND o_orderstatus <> 'O'", "orders")
sparql("q_7_optional", "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?c a v:Customer OPTIONAL { ?o v:o_customer ?c ; v:o_orderstatus 'P' } } GROUP BY ?c", "SELECT 'http://example.org/customer/' || c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1", "customer orders")
sparql("q_7_optional_filter", "SELECT ?k ?z WHERE { ?c v:c_custkey ?k ; v:c_acctbal ?b OPTIONAL { ?o v:o_customer ?c ; v:o_orderkey ?z ; v:o_totalprice ?p FILTER(?p > ?b * 40) } }", "SELECT c_custkey AS k, o_orderkey AS z FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40", "customer orders")
sparql("q_7_optional_chain", "SELECT ?k ?a ?b WHERE { ?s v:p_partkey ?k OPTIONAL { ?s v:p_size ?a FILTER(?a > 25) } OPTIONAL { ?s v:p_size ?a ; v:p_brand ?b } }", "SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS a, p_brand AS b FROM part", "part")
sparql("q_8_union", "SELECT ?n ?x WHERE { { ?s v:c_name ?n ; v:c_nation nation:1 } UNION { ?s v:s_name ?n ; v:s_acctbal ?x ; v:s_nation nation:1 } }", "SELECT c_name AS n, NULL::DOUBLE AS x FROM customer WHERE c_nationkey = 1 UNION ALL SELECT s_name, s_acctbal FROM supplier WHERE s_nationkey = 1", "customer supplier")
sparql("q_9_minus", "SELECT ?c WHERE { ?c a v:Customer MINUS { ?o v:o_customer ?c } }", "SELECT 'http://example.org/customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", "customer orders")
sparql("q_9_minus_disjoint", "SELECT ?r WHERE { ?r a v:Region MINUS { ?n a v:Nation } }", "SELECT 'http://example.org/region/' || r_regionkey AS r FROM region", "region nation")
sparql("q_10_exists", "SELECT ?k WHERE { ?c v:c_custkey ?k FILTER EXISTS { ?o v:o_customer ?c ; v:o_orderpriority '1-URGENT' } }", "SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", "customer orders")
sparql("q_10_not_exists", "SELECT ?k WHERE { ?c v:c_custkey ?k FILTER NOT EXISTS { ?o v:o_customer ?c ; v:o_orderpriority '1-URGENT' } }", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", "customer orders")
sparql("q_10_exists_outer_filter", "SELECT ?k WHERE { ?c v:c_custkey ?k ; v:c_acctbal ?b FILTER EXISTS { ?o v:o_customer ?c ; v:o_totalprice ?p FILTER(?p > ?b * 40) } }", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)", "customer orders")
sparql("q_10_exists_in_expression", "SELECT ?k WHERE { ?c v:c_custkey ?k ; v:c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?o v:o_customer ?c ; v:o_orderstatus 'P' }) }", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", "customer orders")
sparql("q_10_exists_nested", "SELECT ?k WHERE { ?c v:c_custkey ?k ; v:c_acctbal ?b FILTER EXISTS { { ?o v:o_customer ?c ; v:o_totalprice ?p FILTER(?p > ?b * 40) } UNION { ?o v:o_customer ?c ; v:o_orderpriority '1-URGENT' FILTER(?b < 0) } } }", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_totalprice > c_acctbal * 40 OR (o_orderpriority = '1-URGENT' AND c_acctbal < 0)))", "customer orders")
sparql("q_10_exists_bind", "SELECT ?k WHERE { ?c v:c_custkey ?k ; v:c_acctbal ?b FILTER EXISTS { ?o v:o_customer ?c ; v:o_totalprice ?p BIND(?b * 40 AS ?y) FILTER(?p > ?y) } }", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)", "customer orders")


@query("b_6_table_bindings", "SELECT c_custkey AS k, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def _table_bindings(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("http://example.org/nation/"), F.col("n_nationkey").cast("string")).alias("x"), "n_name")
    given = Bindings.from_df(nations.select(F.col("n_name").alias("n"), "x")).set("x", V.iri(F.col("x")))
    found = graph_of(spark, sf_dir, "customer").match("?c v:c_nation ?x ; v:c_custkey ?k", bindings=given)
    return found.solutions().frame().select("k", "n")


sparql("q_7_join_after_optional", "SELECT ?k ?n WHERE { ?s v:s_suppkey ?k ; v:s_acctbal ?b OPTIONAL { ?s v:s_nation ?x FILTER(?b > 0) } ?x v:n_name ?n }", "SELECT s_suppkey AS k, n_name AS n FROM supplier JOIN nation ON NOT s_acctbal > 0 OR s_nationkey = n_nationkey", "supplier nation")
sparql("q_11_bind", "SELECT ?k ?x WHERE { ?s v:p_partkey ?k ; v:p_size ?z BIND(?z * 2 AS ?x) FILTER(?x > 60) }", "SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size * 2 AS BIGINT) AS x FROM part WHERE p_size * 2 > 60", "part")
sparql("q_12_values", "SELECT ?k ?seg WHERE { VALUES ?seg { 'BUILDING' 'MACHINERY' } ?c v:c_mktsegment ?seg ; v:c_custkey ?k }", "SELECT c_custkey AS k, c_mktsegment AS seg FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", "customer")
sparql("q_12_values_undef", "SELECT ?k WHERE { ?c v:c_custkey ?k ; v:c_mktsegment ?seg ; v:c_nation ?n } VALUES (?seg ?n) { ('BUILDING' nation:1) (UNDEF nation:2) }", "SELECT c_custkey AS k FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_nationkey = 1) OR c_nationkey = 2", "customer")
sparql("q_13_subquery", "SELECT ?k ?m WHERE { ?o v:o_orderkey ?k ; v:o_customer ?c ; v:o_totalprice ?m { SELECT ?c (MAX(?p) AS ?m) WHERE { ?x v:o_customer ?c ; v:o_totalprice ?p } GROUP BY ?c } }", "SELECT o_orderkey AS k, o_totalprice AS m FROM orders QUALIFY o_totalprice = max(o_totalprice) OVER (PARTITION BY o_custkey)", "orders")
sparql("q_14_group_agg", "SELECT ?s (COUNT(*) AS ?n) (MIN(?p) AS ?lo) (MAX(?p) AS ?hi) (xsd:double(SUM(xsd:decimal(?p))) AS ?t) WHERE { ?o v:o_orderstatus ?s ; v:o_totalprice ?p } GROUP BY ?s", "SELECT o_orderstatus AS s, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(sum(CAST(o_totalprice AS DECIMAL(38,12))) AS DOUBLE) AS t FROM orders GROUP BY 1", "orders")
sparql("q_14_avg", "SELECT ?b (xsd:double(ROUND(AVG(?z) * 1000)) AS ?m) WHERE { ?s v:p_brand ?b ; v:p_size ?z } GROUP BY ?b", "SELECT p_brand AS b, CAST(floor(sum(p_size) * 1000 / count(*) + 0.5) AS DOUBLE) AS m FROM part GROUP BY 1", "part")
sparql("q_14_group_concat", "SELECT ?r (GROUP_CONCAT(?n ; SEPARATOR=', ') AS ?names) WHERE { ?s v:n_region ?r ; v:n_name ?n } GROUP BY ?r", "SELECT 'http://example.org/region/' || n_regionkey AS r, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1", "nation")
sparql("q_14_count_distinct", "SELECT ?n (COUNT(DISTINCT ?m) AS ?c) WHERE { ?s v:c_nation ?n ; v:c_mktsegment ?m } GROUP BY ?n", "SELECT 'http://example.org/nation/' || c_nationkey AS n, count(DISTINCT c_mktsegment) AS c FROM customer GROUP BY 1", "customer")
sparql("q_14_sample", "SELECT ?k (SAMPLE(?n) AS ?x) WHERE { ?s v:n_nationkey ?k ; v:n_name ?n } GROUP BY ?k", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS x FROM nation", "nation")
sparql("q_14_group_expression", "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o v:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1", "orders")
sparql("q_14_no_group", "SELECT (COUNT(?s) AS ?n) (MAX(?z) AS ?m) WHERE { ?s v:p_size ?z }", "SELECT count(*) AS n, CAST(max(p_size) AS BIGINT) AS m FROM part", "part")
sparql("q_15_having", "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o v:o_customer ?c } GROUP BY ?c HAVING (COUNT(?o) > 12)", "SELECT 'http://example.org/customer/' || o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12", "orders")
sparql("q_16_topk", "SELECT ?k ?p WHERE { ?o v:o_orderkey ?k ; v:o_totalprice ?p } ORDER BY DESC(?p) ?k LIMIT 20", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 20", "orders")
sparql("q_17_distinct", "SELECT DISTINCT ?m ?n WHERE { ?c v:c_mktsegment ?m ; v:c_nation ?n }", "SELECT DISTINCT c_mktsegment AS m, 'http://example.org/nation/' || c_nationkey AS n FROM customer", "customer")
sparql("q_18_offset", "SELECT ?k WHERE { ?o v:o_orderkey ?k ; v:o_totalprice ?p } ORDER BY ?p ?k LIMIT 7 OFFSET 5", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7 OFFSET 5", "orders")


@query("q_19_graph", "SELECT 'http://example.org/c' AS g, count(*) AS n FROM customer UNION ALL SELECT 'http://example.org/s', count(*) FROM supplier")
def _graphs(spark, sf_dir):
    data = Dataset(spark, named={"http://example.org/c": graph_of(spark, sf_dir, "customer"), "http://example.org/s": graph_of(spark, sf_dir, "supplier")})
    return data.query("SELECT ?g (COUNT(?x) AS ?n) WHERE { GRAPH ?g { ?x a ?t } } GROUP BY ?g", NS).frame()


@query("q_19_from", "SELECT count(*) AS n FROM (SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier)")
def _from(spark, sf_dir):
    data = Dataset(spark, named={"http://example.org/c": graph_of(spark, sf_dir, "customer"), "http://example.org/s": graph_of(spark, sf_dir, "supplier")})
    return data.query("SELECT (COUNT(?x) AS ?n) FROM ex:c FROM ex:s WHERE { ?x a ?t }", NS).frame()


sparql("q_20_path_seq", "SELECT ?k ?r WHERE { ?c v:c_custkey ?k ; v:c_nation/v:n_region/v:r_name ?r }", "SELECT c_custkey AS k, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "customer nation region")
sparql("q_21_alt", "SELECT ?n ?x WHERE { ?x (v:c_nation|v:s_nation) ?n }", "SELECT 'http://example.org/nation/' || c_nationkey AS n, 'http://example.org/customer/' || c_custkey AS x FROM customer UNION ALL SELECT 'http://example.org/nation/' || s_nationkey, 'http://example.org/supplier/' || s_suppkey FROM supplier", "customer supplier nation")
sparql("q_22_inverse", "SELECT ?r (COUNT(?c) AS ?n) WHERE { ?r a v:Region ; ^v:n_region/^v:c_nation ?c } GROUP BY ?r", "SELECT 'http://example.org/region/' || n_regionkey AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", "customer nation region")
sparql("q_26_negated", "SELECT (COUNT(*) AS ?n) WHERE { nation:3 !(a|v:n_name) ?x }", "SELECT 2 * count(*) AS n FROM nation WHERE n_nationkey = 3", "nation")


_NODE = "'http://example.org/customer/' || {} AS {}"


def _halves(spark, sf_dir) -> Graph:
    """Each customer of the whole table points to the one of half its number: a closure of n log n pairs."""
    keys = read(spark, sf_dir, "customer").select("c_custkey", F.expr("c_custkey div 2").alias("b"))
    return Graph.empty(spark, ns=NS).add("customer:{?c_custkey} v:half customer:{?b}", keys)


_HALVES = "WITH RECURSIVE h AS (SELECT c_custkey AS x, c_custkey // 2 AS y FROM customer)"


def _path(name: str, text: str, sql: str) -> None:
    @query(name, _HALVES + sql)
    def run(spark, sf_dir):
        return _halves(spark, sf_dir).query(text).frame(x="string", y="string")


_path("q_23_optional_path", "SELECT ?x ?y WHERE { ?x v:half? ?y }", f" SELECT {_NODE.format('x', 'x')}, {_NODE.format('y', 'y')} FROM (SELECT x, y FROM h UNION SELECT x, x FROM h UNION SELECT y, y FROM h)")
_path("q_24_plus", "SELECT ?x ?y WHERE { ?x v:half+ ?y }", f", r AS (SELECT x, y FROM h UNION SELECT r.x, h.y FROM r JOIN h ON r.y = h.x) SELECT {_NODE.format('x', 'x')}, {_NODE.format('y', 'y')} FROM r")
_path("q_24_plus_bound", "SELECT ?y (customer:149 AS ?x) WHERE { customer:149 v:half+ ?y }", f", r AS (SELECT y FROM h WHERE x = 149 UNION SELECT h.y FROM r JOIN h ON r.y = h.x) SELECT 'http://example.org/customer/149' AS x, {_NODE.format('y', 'y')} FROM r")
_path("q_24_plus_to_bound", "SELECT ?x (customer:1 AS ?y) WHERE { ?x v:half+ customer:1 }", f", r AS (SELECT x FROM h WHERE y = 1 UNION SELECT h.x FROM r JOIN h ON r.x = h.y) SELECT {_NODE.format('x', 'x')}, 'http://example.org/customer/1' AS y FROM r")
_path("q_25_star", "SELECT ?x ?y WHERE { ?x v:half* ?y }", f", r AS (SELECT x, x AS y FROM (SELECT x FROM h UNION SELECT y FROM h) UNION SELECT r.x, h.y FROM r JOIN h ON r.y = h.x) SELECT {_NODE.format('x', 'x')}, {_NODE.format('y', 'y')} FROM r")
sparql("q_27_parameter", "SELECT ?k WHERE { ?c v:c_mktsegment {{seg}} ; v:c_custkey ?k ; v:c_nation {{nation}} }", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_nationkey = 2", "customer", seg="FURNITURE", nation=Iri("http://example.org/nation/2"))
sparql("q_28_computed_parameter", "SELECT ?n WHERE { f<http://example.org/nation/{{k}}> v:n_name ?n }", "SELECT n_name AS n FROM nation WHERE n_nationkey = 6", "nation", k=6)


def _update(name: str, text: str, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        graph = Graph.from_triples(graph_of(spark, sf_dir, "nation").triples(), ns=NS, distinct=True)
        graph.update(text)
        return graph.query("SELECT ?n ?p ?o WHERE { ?n ?p ?o FILTER(?p != rdf:type) }").solutions.terms().select(F.col("n.v").alias("n"), F.regexp_extract("p.v", r"[^#]*$", 0).alias("p"), F.col("o.v").alias("o"))


_ALL = "SELECT 'http://example.org/nation/' || n_nationkey AS n, p, CASE p WHEN 'n_name' THEN n_name WHEN 'n_nationkey' THEN CAST(n_nationkey AS VARCHAR) ELSE 'http://example.org/region/' || n_regionkey END AS o FROM nation, (VALUES ('n_name'), ('n_nationkey'), ('n_region')) AS t(p)"
_update("q_32_insert_data", "INSERT DATA { nation:900 v:n_name 'NEWLAND' . nation:1 v:n_nationkey 1 }", _ALL + " UNION ALL SELECT 'http://example.org/nation/900', 'n_name', 'NEWLAND'")
_update("q_32_delete_data", "DELETE DATA { nation:1 v:n_nationkey 1 . nation:900 v:n_name 'NEWLAND' }", f"SELECT * FROM ({_ALL}) WHERE NOT (p = 'n_nationkey' AND o = '1')")
_update(
    "q_33_delete_insert",
    "DELETE { ?n v:n_region ?r } INSERT { ?n v:moved ?r ; v:n_region region:0 } WHERE { ?n v:n_region ?r ; v:n_nationkey ?k FILTER(?k < 10) }",
    f"SELECT * FROM ({_ALL}) WHERE NOT (p = 'n_region' AND CAST(split_part(n, '/', 5) AS INT) < 10) UNION ALL SELECT n, 'moved', o FROM ({_ALL}) WHERE p = 'n_region' AND CAST(split_part(n, '/', 5) AS INT) < 10 UNION ALL SELECT n, 'n_region', 'http://example.org/region/0' FROM ({_ALL}) WHERE p = 'n_region' AND CAST(split_part(n, '/', 5) AS INT) < 10",
)
_update("q_33_delete_where", "DELETE WHERE { ?n v:n_region region:1 ; v:n_name ?x }", f"SELECT a.* FROM ({_ALL}) a JOIN nation ON a.n = 'http://example.org/nation/' || n_nationkey WHERE NOT (n_regionkey = 1 AND p IN ('n_region', 'n_name'))")


@query("q_34_copy_clear", "SELECT 'a' AS g, 0::BIGINT AS n UNION ALL SELECT 'b', 4 * count(*) FROM nation")
def _copy(spark, sf_dir):
    data = Dataset(spark, graph_of(spark, sf_dir, "nation"))
    data.update("COPY DEFAULT TO ex:a ; ADD ex:a TO ex:b ; CLEAR GRAPH ex:a", NS)
    parts = [data.named["http://example.org/" + g].triples().agg(F.lit(g).alias("g"), F.count("*").alias("n")) for g in "ab"]
    return parts[0].unionAll(parts[1])


sparql("v_url_iris", "SELECT ?k ?u WHERE { ?p v:page_id ?k ; v:url ?u FILTER(CONTAINS(STR(?u), 'http')) }", "SELECT page_id AS k, url AS u FROM pages WHERE contains(url, 'http')", "pages")
sparql("v_events_by_user", "SELECT ?u ?t (COUNT(*) AS ?n) (SUM(?k) AS ?s) WHERE { ?e v:user ?u ; v:event_type ?t ; v:k ?k } GROUP BY ?u ?t", "SELECT 'http://example.org/user/' || user_id AS u, event_type AS t, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS s FROM events GROUP BY 1, 2", "events")
sparql("v_lineitem_revenue", "SELECT ?f ?st (COUNT(*) AS ?n) (xsd:double(SUM(xsd:decimal(?q))) AS ?qty) WHERE { ?l v:l_returnflag ?f ; v:l_linestatus ?st ; v:l_quantity ?q } GROUP BY ?f ?st", "SELECT l_returnflag AS f, l_linestatus AS st, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(38,12))) AS DOUBLE) AS qty FROM (SELECT DISTINCT * FROM lineitem) GROUP BY 1, 2", "lineitem")


@query("stream_template_batch", "SELECT p, count(*) AS n FROM events, (VALUES ('type'), ('user'), ('value')) AS t(p) GROUP BY p")
def _stream(spark, sf_dir):
    """The template that streams use, here over the table as a batch."""
    from ..streaming.templates import stream_triples

    made = stream_triples(Template("ex:{?event_id} a v:Event ; v:user ex:{?user_id} ; v:value ?value", NS), read(spark, sf_dir, "events"))
    return made.groupBy(F.regexp_extract("p.v", r"[^#]*$", 0).alias("p")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
