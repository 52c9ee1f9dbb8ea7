"""Connected components of an edge table as rounds of hooking, pointer jumping and contraction.

Nothing is gathered on the driver or in one task: a round takes minima by key (combined
map-side, so a node with a third of all edges is no hot spot), joins against tables with one
row a node, and at least halves the number of nodes that still have edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import is_empty, stage, unstage


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(src, dst)``, undirected, loops and repeats allowed -> ``(node, root)``.

    One row for each node that an edge names; two nodes share a root exactly if a path joins
    them. Rows with a null end are ignored; an empty table gives an empty result. The root is
    some node of the component; callers aggregate by it for a smallest member.
    """
    live = stage(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    done = edges.where("src = dst").select(F.col("src").alias("node"))
    mapping = None
    while not is_empty(live):
        hooks = _root_of_each(live)
        step = hooks.select(F.col("node").alias("at"), F.col("root").alias("to"))
        if mapping is None:
            moved = hooks
        else:
            moved = stage(mapping.join(step, mapping.root == step["at"], "left").select("node", F.coalesce("to", "root").alias("root")), "mapping")
            unstage(mapping)
        left = step.select(F.col("at").alias("src"), F.col("to").alias("a"))
        right = step.select(F.col("at").alias("dst"), F.col("to").alias("b"))
        nxt = stage(live.join(left, "src").join(right, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
        unstage(live, *([hooks] if mapping is not None else []))
        live, mapping = nxt, moved
    unstage(live)
    loops = done.distinct().select("node", F.col("node").alias("root"))
    if mapping is None:
        return loops
    return mapping.unionByName(loops.join(mapping.select("node"), "node", "left_anti"))


def _root_of_each(live: DataFrame) -> DataFrame:
    """Hook every node to its smallest neighbour if that is smaller, then jump to the roots, two jumps a round."""
    both = live.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(live.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    tree = stage(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "hooks")
    while True:
        up = tree.select(F.col("node").alias("at"), F.col("root").alias("to"))
        further = tree.select(F.col("node").alias("then"), F.col("root").alias("end"))
        jumped = tree.join(up, tree.root == up["at"]).join(further, F.col("to") == F.col("then")).select("node", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved"))
        nxt = stage(jumped, "hooks")
        unstage(tree)
        tree = nxt.select("node", "root")
        if is_empty(nxt.where("moved")):
            return tree
