"""Connected components of a table of links, by hooking and pointer jumping.

Every round each node hooks on to its smallest neighbour below it, chains of hooks are halved until
they are flat, and links are carried over to the roots; links inside a tree fall away.  Rounds are
written to the shared folder, so a lost executor costs a round, and both sides of every join are
tables, so that adaptive execution can split the rows of a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node that isn't the smallest of its component.

    ``links`` has ``a`` and ``b``, two nodes of one type in either order; links of a node with itself
    and repeated links are allowed, null ends are passed over.
    """
    links = stored(_between(links, F.col("a"), F.col("b")), "links")
    roots = None
    while not links.isEmpty():
        hooks = stored(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "hooks")
        hooks = _flat(hooks)
        if roots is None:
            roots = hooks
        else:
            roots = stored(_relabelled(roots, "root", hooks).unionByName(hooks), "roots")
        moved = _relabelled(_relabelled(links, "a", hooks), "b", hooks)
        links = stored(_between(moved, F.col("a"), F.col("b")), "links")
    return links.selectExpr("a as node", "b as root") if roots is None else roots


def _between(links: DataFrame, a, b) -> DataFrame:
    ends = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (a != b).alias("apart"))
    return ends.where("apart").select("a", "b").distinct()


def _relabelled(rows: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """``rows`` with the nodes of a column replaced by their roots."""
    to = hooks.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = rows.join(to, rows[column] == to["_node"], "left")
    return joined.withColumn(column, F.coalesce("_root", column)).drop("_node", "_root")


def _flat(hooks: DataFrame) -> DataFrame:
    while True:
        to = hooks.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        further = hooks.join(to, hooks["root"] == to["_node"], "left")
        further = further.select("node", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved"))
        further = stored(further, "jumps")
        if further.where("moved").isEmpty():
            return hooks
        hooks = further.drop("moved")
