"""Connected components by repeated contraction, all in DataFrames.

Each round every node points to its smallest neighbour, pointers are followed to their ends, and edges
are rewritten between the ends. A round at least halves the nodes that still have edges. The smallest
node of a component never points anywhere, so it names the component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_path, drop_tables, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Self loops, repeated and reversed edges are fine; rows with a null end are ignored. Of no edges
    the result is empty. The result is a table in shared storage.
    """
    lo, hi = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    e = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(lo, hi).distinct(), "edges")
    roots = None
    while not e.isEmpty():
        up = materialize(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "up")
        while True:  # follow pointers, two steps at a time
            nxt = up.select(F.col("node").alias("up"), F.col("up").alias("further"))
            longer = materialize(up.join(nxt, "up", "left").select("node", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "up")
            moved = longer.where("moved").limit(1).count()
            drop_tables(up)
            up = at_path(longer.select("node", "up"), longer._tidemark_table)
            if not moved:
                break
        ends = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))
        moved = e.join(ends("a"), "a", "left").join(ends("b"), "b", "left").select(F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b"))
        left = materialize(moved.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if roots is None:
            known = up
        else:
            known = roots.join(up.select(F.col("node").alias("component"), F.col("up").alias("further")), "component", "left").select("node", F.coalesce("further", "component").alias("up")).unionByName(up.join(roots, "node", "left_anti"))
        new = materialize(known.select("node", F.col("up").alias("component")), "roots")
        drop_tables(e, up, *([roots] if roots is not None else []))
        e, roots = left, new
    drop_tables(e)
    if roots is None:
        kind = edges.schema[a].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    own = roots.select(F.col("component").alias("node"), F.col("component")).distinct()
    return at_path(roots.unionByName(own), roots._tidemark_table)
