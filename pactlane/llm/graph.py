"""Connected components of a link table by star contraction, first within tasks and then across them, with written tables between rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_PARTS, dropped, gathered, lookup, ship, written


def _star(edges: DataFrame, larger: bool, n: int) -> DataFrame:
    """One contraction: tie every larger (or smaller) neighbour of a node to the least of its neighbourhood.

    n is the number of edges at most: a node with over a thousandth of them is resolved by a broadcast
    of at most two thousand such nodes, so the neighbours of a hub stay where they are.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not larger:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), (F.col("n") * HOT_PARTS > n).alias("hot"))
    joined = lookup(both, least, "u", "hot")
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


#: Links that a task contracts at once.
LINKS_AT_ONCE = 1 << 20


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component) of some links."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components with fewer links: each task replaces its links, a bounded number at a time, by (node, root) of their own components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, LINKS_AT_ONCE):
            node, root = _forest(b.column("u").to_numpy(zero_copy_only=False), b.column("v").to_numpy(zero_copy_only=False))
            own = node != root
            yield pa.RecordBatch.from_arrays([pa.array(x[own], b.schema.field("u").type) for x in (node, root)], ["u", "v"])

    ship(edges.sparkSession)
    return edges.mapInArrow(run, edges.schema)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links -> (node, root): one row for each linked node but the root itself; root is its component's least node.

    Links with a null end and loops are ignored; an empty link table gives an empty result. Minima are
    pre-aggregated, and a hub's links are never gathered: hubs are looked up by broadcast (see _star).
    """
    now = written(_contracted(edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), "links")
    state = _state(now)
    for _ in range(max_rounds):
        before = state
        wide = written(_star(now, True, before[0]), "links")
        new = written(_contracted(_star(wide, False, wide.count())), "links")
        state = _state(new)
        dropped(wide)
        dropped(now)
        now = new
        if state == before:
            break
    else:
        raise RuntimeError("components did not converge")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._pactlane_path = now._pactlane_path
    return out
