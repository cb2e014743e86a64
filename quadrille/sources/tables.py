"""The data folder's tables as a virtual graph.

Subjects are http://example.org/{table}/{key}; predicates http://example.org/vocab#{column};
foreign keys are IRIs of the other table. Line items have no key of their own: their blank
nodes are keyed on the whole row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..namespaces import Namespaces
from ..operators.graph import Graph
from .mapping import Property, Table

BASE, VOCAB = "http://example.org/", "http://example.org/vocab#"
NS = Namespaces({"v": VOCAB, "ex": BASE, **{t: f"{BASE}{t}/" for t in "region nation customer supplier part orders event user document source page".split()}})

#: table: (class, key, literal columns, {predicate: (column, table)})
_TABLES = {
    "region": ("Region", "r_regionkey", ["r_regionkey", "r_name"], {}),
    "nation": ("Nation", "n_nationkey", ["n_nationkey", "n_name"], {"n_region": ("n_regionkey", "region")}),
    "customer": ("Customer", "c_custkey", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"], {"c_nation": ("c_nationkey", "nation")}),
    "supplier": ("Supplier", "s_suppkey", ["s_suppkey", "s_name", "s_acctbal"], {"s_nation": ("s_nationkey", "nation")}),
    "part": ("Part", "p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], {}),
    "orders": ("Order", "o_orderkey", ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], {"o_customer": ("o_custkey", "customer")}),
    "lineitem": (
        "LineItem",
        None,
        ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
        {"l_order": ("l_orderkey", "orders"), "l_part": ("l_partkey", "part"), "l_supplier": ("l_suppkey", "supplier")},
    ),
    "events": ("Event", "event_id", ["event_id", "ts", "event_type", "value"], {"user": ("user_id", "user")}),
    "documents": ("Document", "doc_id", ["doc_id", "lang", "n_chars"], {"source": ("source", "source")}),
    "pages": ("Page", "page_id", ["page_id"], {}),
}
_NAMES = {"events": "event", "documents": "document", "pages": "page"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header: every cell a string, empty ones the empty string."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def graph_of(spark: SparkSession, sf_dir: str, *names: str) -> Graph:
    """The virtual graph of some tables (all by default)."""
    tables = []
    for name in names or _TABLES:
        cls, key, columns, links = _TABLES[name]
        df = read(spark, sf_dir, name)
        props = {VOCAB + c: Property(c) for c in columns}
        props |= {VOCAB + p: Property(c, prefix=f"{BASE}{t}/") for p, (c, t) in links.items()}
        if name == "events":
            props[VOCAB + "k"] = Property(F.get_json_object("props", "$.k").try_cast("bigint"))
        if name == "documents":
            props[VOCAB + "text"] = Property("text", lang=F.col("lang"))
        if name == "pages":
            props[VOCAB + "url"] = Property("url", prefix="")
        row_key = key is None
        if row_key:
            key = F.md5(F.concat_ws("\x1f", *(F.col(c).cast("string") for c in df.columns)))
        prefix = "l" if row_key else f"{BASE}{_NAMES.get(name, name)}/"
        tables.append(Table(name, df, prefix, key, VOCAB + cls, props, blank=row_key, unique=not row_key, row_key=row_key))
    return Graph.from_tables(tables, NS)
