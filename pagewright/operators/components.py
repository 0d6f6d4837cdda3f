"""Connected components by alternating large-star and small-star rounds.

Nodes with one neighbour are set aside before the rounds, so that stars cost nothing there. No more than ``IN_A_TASK`` edges
are joined in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.operators.skew import PLAIN, lookup
from pagewright.session import checkpointed, gathered

#: Edges (a few MB) that one task may join; rounds of shuffles cost more there than they spread.
IN_A_TASK = 200_000
#: Edges are set aside where at least one in so many leads to a node without other neighbours.
LEAVES = 4


def _stats(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], int(row["h"] or 0)


def _in_a_task(edges: DataFrame) -> DataFrame:
    """``node, component`` of few edges (``hi, lo``), joined one after another."""
    kind = edges.schema["hi"].dataType
    names = T.StructType([T.StructField("node", kind), T.StructField("component", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[x]
            return x

        made = None
        for batch in batches:
            made = batch.schema.field(0).type
            for one, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one, other = root(one), root(other)
                if one != other:
                    parent[max(one, other)] = min(one, other)
        if parent:
            yield pa.RecordBatch.from_arrays([pa.array(x, made) for x in (list(parent), [root(x) for x in parent])], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, names)


def _trimmed(edges: DataFrame, n: int, max_rounds: int) -> DataFrame | None:
    """``node, component`` by way of the edges whose nodes both have other neighbours; None where that leaves most edges."""
    ends = edges.select(F.col("hi").alias("node")).unionByName(edges.select(F.col("lo").alias("node")))
    alone = checkpointed(ends.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("node", F.lit(True).alias("_alone")))
    if alone.count() * LEAVES < n:
        return None
    for end in ("hi", "lo"):
        edges = checkpointed(lookup(edges, end, alone.toDF(end, f"_{end}"), n))
    high, low = F.col("_hi").isNotNull(), F.col("_lo").isNotNull()
    pairs = edges.where(high & low)
    core = connected_components(edges.where(~high & ~low).select("hi", "lo"), "hi", "lo", max_rounds, trim=False)
    hung = edges.where(high != low).select(F.when(high, F.col("hi")).otherwise(F.col("lo")).alias("leaf"), F.when(high, F.col("lo")).otherwise(F.col("hi")).alias("at"))
    hung = checkpointed(hung)
    core = checkpointed(core)
    rooted = checkpointed(lookup(hung, "at", core.toDF("at", "_root"), n).select("leaf", "at", "_root", F.coalesce("_root", "at").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("leaf").alias("_least"))
    centres = rooted.where("_root is null").select(F.col("at").alias("node"), F.col("at").alias("root")).distinct()
    every = core.toDF("node", "root").union(centres).union(rooted.select("leaf", "root"))
    named = lookup(checkpointed(every), "root", lowest, n).select("node", F.least("root", "_least").alias("component"))
    return named.union(pairs.select("hi", "lo")).union(pairs.select("lo", F.col("lo").alias("component")))


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60, trim: bool = True, most: int | None = None) -> DataFrame:
    """Label every node of an undirected edge list with the smallest node it can reach.

    Nodes may be of any orderable type; null endpoints and self loops are ignored; repeated edges are harmless.
    Returns ``(node, component)`` for the nodes that have an edge to another node; an empty edge list gives no rows.
    ``most``, where it is known, is how many edges there are at most: few are kept in few files from the start.

    Every round re-hangs neighbours under the smallest one seen, so path lengths shrink geometrically and a hub never
    gathers its neighbours into one row or one task: minima are partial aggregates, and the join back sends the minima of
    hot nodes to where their edges are. State per round is one row per edge, checkpointed to the shared folder.
    """
    current = (
        edges.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("hi") != F.col("lo")))
        .distinct()
    )
    current = checkpointed(current if most is None else gathered(current, most))
    stats = _stats(current)
    if 0 < stats[0] <= IN_A_TASK and isinstance(current.schema["hi"].dataType, (T.IntegralType, T.StringType)):
        return _in_a_task(current)
    if trim and stats[0] > IN_A_TASK and (found := _trimmed(current, stats[0], max_rounds)) is not None:
        return found
    for _ in range(max_rounds):
        if stats[0] == 0:
            break
        # large star: a node moves under the smallest neighbour of its smaller neighbour
        below = current.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("m"))
        large = lookup(current, "lo", below, stats[0]).select("hi", F.coalesce("m", "lo").alias("lo")).distinct()
        if stats[0] >= PLAIN:
            large = checkpointed(large)  # read four times below
        # small star: smaller neighbours, and the node itself, move under the smallest one
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            lookup(large, "hi", lowest, stats[0])
            .where(F.col("lo") != F.col("m"))
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(lowest.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        # few edges are kept in few files; the number follows the count of the round before
        current, before = checkpointed(gathered(small, stats[0])), stats
        stats = _stats(current)
        if stats == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
