"""Connected components: edges are reduced to a forest, which is then flattened."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.llm.store import partitions, settle, tidy


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


#: Nodes of the forest that a task holds.
FLUSH = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[pa.RecordBatch]:
    """Edges of a partition as a forest of stars; ``met``: whether some node had several edges.

    Above ``flush`` nodes the forest is given and another begun, as if the
    partition ended there; that is never between edges of one larger node that
    are next to each other.
    """
    forest = Forest()
    first: dict[int, int] = {}
    met = False
    last = None

    def rows() -> pa.RecordBatch:
        nodes = [x for x in forest.up if forest.find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64()), pa.array([met] * len(nodes), pa.bool_())], names=["a", "b", "met"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if len(forest.up) > flush and a != last:
                yield rows()
                forest, first = Forest(), {}
            met = met or first.setdefault(a, b) != b
            forest.union(a, b)
            last = a
    if forest.up:
        yield rows()


def connected_components(edges: DataFrame, flush: int = FLUSH) -> DataFrame:
    """(node, component) of every node of an undirected edge; component is the least node.

    ``edges`` has two long columns; loops and repeated edges don't matter, an
    edge with a null end is left out.  Each partition reduces its edges to
    stars, then edges meet by their larger node, where those of one node are
    joined into one, until each node has a single edge to a smaller one.  As
    stars were reduced first, a node brings one edge from each partition at
    most, however large its group is.  Edges that meet are sorted by that node,
    so that all of one node are in one forest.  What is left is a forest, whose depth
    is halved until all point at their roots; both sides of that join are
    plain shuffles, so Spark can split the partition of a large root.
    """
    a, b = edges.columns
    kind = "a long, b long, met boolean"
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    e = edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter(x.isNotNull() & y.isNotNull() & (x != y))
    contract = lambda batches: _contract(batches, flush)
    many = -(-partitions(edges.sparkSession) // 4)  # edges are few beside texts
    e = e.coalesce(many).mapInArrow(tidy(contract), kind)
    while True:
        e = settle(e.select("a", "b").repartition("a").coalesce(many).sortWithinPartitions("a").mapInArrow(tidy(contract), kind))
        if e.filter("met").isEmpty():
            break
    e = e.select("a", "b")
    while True:
        e = settle(e.join(e.toDF("b", "c"), "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("met")))
        if e.filter("met").isEmpty():
            break
        e = e.select("a", "b")
    e = e.select("a", "b")
    return e.toDF("node", "component").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
