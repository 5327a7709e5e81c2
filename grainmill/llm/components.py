"""Connected components of links, distributed: large-star and small-star steps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm._common import discard, stored

MAX_ROUNDS = 60
HUB_SHARE, FEW_EDGES = 64, 5000


def _beside_least(both: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """both(a, b) with the m of each a. Rows of hubs, nodes with more than one in HUB_SHARE of the edges, meet theirs by a
    broadcast of fewer than 2 * HUB_SHARE rows, and do not gather in one task."""
    if edges <= FEW_EDGES:
        return both.join(least, "a")
    hubs = least.where(F.col("n") * HUB_SHARE > edges).select("a", F.col("m").alias("hub"))
    marked = both.join(F.broadcast(hubs), "a", "left")
    rest = marked.where("hub IS NULL").select("a", "b").join(least.select("a", "m"), "a")
    return marked.where("hub IS NOT NULL").select("a", "b", F.col("hub").alias("m")).unionAll(rest)


def _star(edges: DataFrame, large: bool, count: int) -> DataFrame:
    """Large star: each node links its larger neighbours to the least of its neighbourhood; small star: its smaller
    neighbours and itself. The least neighbour comes from a partial aggregate, so a hub is never gathered."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    out = _beside_least(both, least, count)
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of any comparable type -> (node, root): the least node each node reaches, for nodes with links."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    scratch: list[str] = []
    edges = stored(edges, scratch)
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        # settled when every node has one neighbour that is smaller, and that is nobody's larger one
        old, before = scratch, state
        scratch = []
        edges = stored(_star(_star(edges, True, state[0]), False, state[0]), scratch)
        discard(links.sparkSession, old)
        state = _state(edges)
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("the components did not settle")
