"""Candidate pairs from band keys, and connected components: DataFrame operations only.

Both work on long ids of distinct contents, so copies cost nothing here.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, release


#: Leaders of a bucket in the second election, members of a block.
WIDTH, BLOCK = 16, 2048


class Election(NamedTuple):
    """What the first election of leaders leaves, and the paths that it reads."""

    pairs: DataFrame
    shared: DataFrame
    leaders: DataFrame
    paths: list[str]


def candidate_pairs(members: DataFrame) -> tuple[DataFrame, list[str]]:
    """Pairs (a < b) of the first election, from rows (key, id), and the paths to discard after them."""
    first = elect(members)
    return first.pairs, first.paths


def elect(members: DataFrame) -> Election:
    """The first pairs (a < b) to verify, from rows (key, id).

    A bucket's members are all compared with one or two of them, its leaders, so the pairs grow
    with the members and not with their square: the smallest id, and the member that shares the
    most places in buckets overall (in a group of near copies, the one closest to the rest).
    ``linked`` compares the rest.
    """
    counted = members.select("key", "id", F.count("*").over(Window.partitionBy("key")).alias("n"))
    shared, at_shared = materialise(counted.where("n > 1"), "shared")
    centre = shared.groupBy("id").agg(F.sum("n").alias("places"))
    led = shared.join(centre, "id").groupBy("key").agg(
        F.min("id").alias("first"),
        F.max(F.struct("places", "id")).alias("central"),
    )
    leaders, at_leaders = materialise(
        led.select("key", F.array_distinct(F.array("first", "central.id")).alias("leaders")), "leaders"
    )
    each = shared.join(leaders, "key").select("id", F.explode("leaders").alias("leader")).where("id <> leader")
    pairs = each.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    found, at_pairs = materialise(pairs, "pairs")
    return Election(found, shared, leaders, [at_pairs, at_shared, at_leaders])


def linked(
    first: Election,
    confirm: Callable[[DataFrame], DataFrame],
    marks: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    possible: Callable[[str, str], Column] | None = None,
) -> tuple[DataFrame, list[str]]:
    """(id, root) as of ``components`` over all pairs of bucket members that ``confirm`` keeps.

    Members that have led are through with their bucket. What is left of a bucket is in one
    component, or elects ``WIDTH`` further leaders that meet all members of other components; then
    all that are still in several components meet: each pair was verified or its ends are in one
    component, so the components are those of all pairs of each bucket. Large buckets meet block by
    block. With ``marks`` (id, mark), or what makes them for the ids (id) of the first meeting, a
    meeting makes a row only where ``possible`` holds for the marks, which must be false for none
    that ``confirm`` keeps.
    """
    spark = first.pairs.sparkSession
    table, at_table = components(confirm(first.pairs))
    others = first.shared.where("n > 2").join(first.leaders, "key").where("NOT array_contains(leaders, id)")
    rest, at_rest = materialise(others.select("key", "id"), "rest")
    tested, at_tested, at_marks, turn = first.pairs, [], [], 0
    while True:
        lot = F.xxhash64("id", "key", F.lit(turn))
        rooted, at_rooted = materialise(rest.join(table, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"), lot.alias("lot")), "rooted")
        sizes = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.min("lot").alias("least"))
        leads = F.lit(True) if turn else (F.col("lot") == F.col("least")) | (F.pmod("lot", "n") < WIDTH)
        still = rooted.join(sizes.where("low < high"), "key").select("key", "id", "root", "n", leads.alias("leads"))
        members, at_members = materialise(still, "members")
        for path in (at_rest, at_rooted):
            discard(spark, path)
        if members.isEmpty():
            break
        if callable(marks):  # later meetings are between members of the first
            marks, at = materialise(marks(members.select("id").distinct()), "marks")
            at_marks.append(at)
        blocks = F.ceil(F.col("n") / BLOCK)
        marked = members if marks is None else members.join(marks, "id")
        own, its = ([F.col(c).alias(f"{of}_{c}") for c in (marks.columns if marks is not None else ()) if c != "id"] for of in ("own", "its"))
        # A block is met by blocks of leaders, each of the two in a task of its own: no key is left to be split as the join finds it.
        cell, backs = ("key", "front", "back"), blocks if turn else F.lit(1).cast("long")
        place, each = (lambda n: F.pmod(F.xxhash64("id"), n)), (lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
        dealt = marked.select("key", place(blocks).alias("front"), each(backs).alias("back"), "id", "root", "leads", *own).repartition(*cell)
        leaders = marked.where("leads").select("key", each(blocks).alias("front"), place(backs).alias("back"), F.col("id").alias("leader"), F.col("root").alias("other"), *its).repartition(*cell)
        meet = (F.col("root") != F.col("other")) & (~F.col("leads") | (F.col("id") < F.col("leader")))
        met = dealt.join(leaders, list(cell)).where(meet if possible is None else meet & possible("own_", "its_"))
        pairs = met.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
        fresh, at_fresh = materialise(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        edges, at_edges = materialise(confirm(fresh), "edges")
        if not edges.isEmpty():
            known = table.select(F.col("id").alias("a"), F.col("root").alias("b"))
            wider, at_wider = components(known.unionByName(edges))
            for path in at_table:
                discard(spark, path)
            table, at_table = wider, at_wider
        rest, at_rest = materialise(members.where("NOT leads").select("key", "id"), "rest")
        for path in (at_members, at_edges):
            discard(spark, path)
        tested, at_tested = tested.unionByName(fresh), [*at_tested, at_fresh]
        release(spark)
        turn += 1
    for path in (*at_tested, *at_marks, at_members):
        discard(spark, path)
    return table, at_table


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(id, root) for every id in ``edges`` (a, b): root is the smallest id of its component.

    Each round links every node to the smallest neighbour of its parent, then every node and
    its parents to the smallest parent, until each node has one parent and no parent has one:
    rounds grow with the logarithm of a component's width. Each half is written to the shared
    folder, so lineage stays short.
    """
    spark = edges.sparkSession
    links, path = materialise(edges.select(F.greatest("a", "b").alias("c"), F.least("a", "b").alias("p")).where("c <> p").distinct(), "links")
    before = None
    while True:
        state = _state(links)
        if state.unsettled == 0 or state == before:
            break
        before = state
        up = links.groupBy(F.col("c").alias("p")).agg(F.min("p").alias("m"))
        jumped, at_jumped = materialise(links.join(up, "p", "left").select("c", F.coalesce("m", "p").alias("p")).distinct(), "jumped")
        lowest = jumped.groupBy("c").agg(F.min("p").alias("m"))
        joined = jumped.join(lowest, "c").select(F.explode(F.array(F.struct("c", F.col("m").alias("p")), F.struct(F.col("p").alias("c"), F.col("m").alias("p")))).alias("x"))
        following, at_following = materialise(joined.select("x.c", "x.p").where("c <> p").distinct(), "links")
        for old in (path, at_jumped):
            discard(spark, old)
        links, path = following, at_following
        release(spark)
    roots = links.select(F.col("p").alias("id")).distinct()
    table = links.select(F.col("c").alias("id"), F.col("p").alias("root")).unionByName(roots.select("id", F.col("id").alias("root")))
    return table, [path]


def _state(links: DataFrame):
    """How many nodes have two parents or are parent and child both, and a checksum of ``links`` (c, p)."""
    ends = F.array(
        F.struct(F.col("c").alias("node"), F.lit(1).alias("parents"), F.lit(0).alias("leads"), F.xxhash64("c", "p").cast("decimal(20,0)").alias("sum")),
        F.struct(F.col("p").alias("node"), F.lit(0).alias("parents"), F.lit(1).alias("leads"), F.lit(0).cast("decimal(20,0)").alias("sum")),
    )
    nodes = links.select(F.explode(ends).alias("x")).select("x.*").groupBy("node").agg(F.sum("parents").alias("parents"), F.max("leads").alias("leads"), F.sum("sum").alias("sum"))
    return nodes.agg(F.count_if((F.col("parents") + F.col("leads")) > 1).alias("unsettled"), F.sum("parents").alias("links"), F.sum("sum").alias("sum")).first()
