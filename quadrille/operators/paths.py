"""Transitive property paths by semi-naive iteration.

Each round joins only the pairs that the last round found with all so far, and writes what is new to the
shared folder, so the plan stays short and a lost executor costs one round at most. With
one end constant, the search starts there and only nodes are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import Val
from ..plans.solutions import Solutions, quoted
from ..sources.shared import settle


def reach(edges: DataFrame, first: DataFrame) -> DataFrame:
    """Distinct y that a path of ``edges`` (x, y) leads to from the rows of ``first`` (y), those included."""
    new = settle(first.distinct(), "reach")
    found = new
    while not new.isEmpty():
        step = new.select(F.col("y").alias("x")).join(edges, "x").select("y").distinct()
        new = settle(step.join(found, "y", "left_anti"), "reach")
        found = found.unionAll(new)
    return found


def all_pairs(edges: DataFrame) -> DataFrame:
    """The transitive closure of ``edges`` (x, y), in rounds that double the length of the paths.

    A shortest path of up to twice the length begins with one that the last round found.
    """
    new = edges
    found = new
    while not new.isEmpty():
        hop = found.select(F.col("x").alias("y"), F.col("y").alias("z"))
        step = new.join(hop, "y").select("x", F.col("z").alias("y")).distinct()
        new = settle(step.join(found, ["x", "y"], "left_anti"), "pairs")
        found = found.unionAll(new)
    return found


def closure(ev, path, start: str, stop: str, s=None, o=None) -> Solutions:
    """(start, stop) of path?, path+ or path*, without repeats; ``s`` and ``o`` are the constant ends."""
    one = ev.pairs(path.parts[0], start, stop)
    spec, (x, y) = V.same_spec([one.value(start), one.value(stop)])
    consts = [V.const(t) for t in (s, o) if t is not None]
    if path.op in "?*" or any(c.spec != spec for c in consts):
        spec, x, y = V.ANY_SPEC, one.value(start).term(), one.value(stop).term()
    as_spec = lambda v: v.term() if spec.kind == "any" else v.text()
    if spec.kind != "any" and spec.prefix and consts:
        spec, x, y = V.Spec(spec.kind), one.value(start).text(), one.value(stop).text()
    edges = one.df.select(x.alias("x"), y.alias("y")).distinct()
    if path.op == "?":
        found = edges
    else:
        edges = settle(edges, "edges")
        if s is not None:
            here = as_spec(V.const(s))
            ends = reach(edges, edges.where(F.col("x") == here).select("y"))
            found = ends.select(here.alias("x"), "y")
        elif o is not None:
            here = as_spec(V.const(o))
            back = edges.select(F.col("y").alias("x"), F.col("x").alias("y"))
            starts = reach(back, back.where(F.col("x") == here).select("y"))
            found = starts.select(F.col("y").alias("x"), here.alias("y"))
        else:
            found = all_pairs(edges)
    if path.op in "?*":
        if s is not None or o is not None:
            here = V.const(s if s is not None else o).term()
            same = ev.spark.range(1).select(here.alias("x"), here.alias("y"))
        else:
            rows = ev.graph.triples()
            nodes = rows.select(F.col("s").alias("x")).unionAll(rows.select(F.col("o").alias("x"))).distinct()
            same = nodes.select("x", F.col("x").alias("y"))
        found = found.unionAll(same).distinct()
    return Solutions.of(found, {start: Val(spec, F.col("x")), stop: Val(spec, F.col(quoted("y")))})
