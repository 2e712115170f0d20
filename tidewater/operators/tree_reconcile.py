"""Reconciliation of hierarchies of any size: weighted least squares along the edges of a tree.

Of all forecasts that add up, the one with the smallest weighted squared distance to the given ones. No matrix of nodes by
nodes is formed: going up, each node joins its own forecast with the sum of its children, both by their precision; going
down, what a parent's final value differs from that sum is shared among the children by their variances. Each level is an
aggregation and a join over (keys, node) rows, so that work grows with nodes x times and jobs with the number of levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.schema import TIME
from tidewater.staging import staged, unstage


def tree_nodes(edges: DataFrame, node: str = "node", parent: str = "parent") -> tuple[DataFrame, int]:
    """(node, parent, depth, n_children) of every node, written, and the largest depth; roots have no parent and depth 0.

    ``edges`` are (node, parent) rows; rows without a parent are left out. A node with two parents or on a cycle is an error.
    """
    pairs = staged(edges.select(F.col(node).alias("node"), F.col(parent).alias("parent")).filter("node IS NOT NULL AND parent IS NOT NULL").distinct(), "edges")
    roots = pairs.select(F.col("parent").alias("node")).distinct().join(pairs.select("node"), "node", "left_anti").withColumn("parent", F.lit(None).cast(pairs.schema["parent"].dataType))
    levels, depth = [staged(roots, "level")], 0
    while True:
        below = staged(pairs.join(levels[-1].select(F.col("node").alias("parent")), "parent").select("node", "parent"), "level")
        if below.isEmpty():
            break
        levels.append(below)
        depth += 1
        if depth > 1000:
            raise ValueError("more than 1000 levels")
    every = levels[0].withColumn("depth", F.lit(0))
    for d, level in enumerate(levels[1:], 1):
        every = every.unionByName(level.withColumn("depth", F.lit(d)))
    n_children = pairs.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    out = staged(every.join(n_children, "node", "left").fillna({"n_children": 0}), "nodes")
    # each edge is met once, and no node twice, if and only if the edges are those of trees
    n, distinct = out.agg(F.count("*"), F.count_distinct("node")).first()
    whole = n == distinct and n - levels[0].count() == pairs.count()
    unstage(*levels, pairs, below)
    if not whole:
        raise ValueError("a node has two parents or lies on a cycle")
    return out, depth


def leaf_counts(nodes: DataFrame, depth: int) -> DataFrame:
    """(node, leaves): the number of leaves at or below each node of ``tree_nodes``."""
    below, out = None, None
    for d in range(depth, -1, -1):
        level = nodes.filter(F.col("depth") == d)
        if below is not None:
            level = level.join(below.groupBy(F.col("parent").alias("node")).agg(F.sum("leaves").alias("_below")), "node", "left")
        else:
            level = level.withColumn("_below", F.lit(None).cast("long"))
        below = level.select("node", "parent", F.coalesce("_below", F.lit(1)).cast("long").alias("leaves"))
        out = below if out is None else out.unionByName(below)
    return out.select("node", "leaves")


def residual_weights(actuals: DataFrame, forecasts: DataFrame, keys: Sequence[str] = (TIME,), value: str = "value", node: str = "node") -> DataFrame:
    """(node, w): one over a node's mean squared error, for nodes with any; nodes that are forecast without error have no row."""
    joined = actuals.select(*keys, node, F.col(value).alias("_a")).join(forecasts.select(*keys, node, F.col(value).alias("_f")), [*keys, node])
    return joined.groupBy(F.col(node).alias("node")).agg(F.avg((F.col("_a") - F.col("_f")) ** 2).alias("_mse")).filter("_mse > 0").select("node", (1 / F.col("_mse")).alias("w"))


def reconcile_tree(forecasts: DataFrame, edges: DataFrame, weights: str | DataFrame = "ols", keys: Sequence[str] = (TIME,), value: str = "value", node: str = "node", parent: str = "parent") -> DataFrame:
    """(keys, node, value): forecasts that add up, at the least weighted squared distance to the given ones.

    ``weights``: "ols" (all 1), "structural" (one over the number of leaves below), "bottom_up" (leaves alone count), or a
    table (node, w). Inner nodes without a forecast or a positive weight take what their children sum to; where a leaf has
    no forecast or no positive weight, all of its tree is null at that time. Nodes have a row at the keys at which they or nodes
    below them are given; nodes that ``edges`` lack are left out. One row per (keys, node) and no null key is expected. The
    result is a written table (``unstage`` deletes it).
    """
    keys = list(keys)
    nodes, depth = tree_nodes(edges, node, parent)
    given = forecasts.select(*keys, F.col(node).alias("node"), F.col(value).cast("double").alias("_y"))
    if isinstance(weights, DataFrame):
        weighted = nodes.join(weights.select("node", F.col("w").cast("double")), "node", "left")
    elif weights == "structural":
        weighted = nodes.join(leaf_counts(nodes, depth).select("node", (1 / F.col("leaves")).alias("w")), "node")
    elif weights in ("ols", "bottom_up"):
        weighted = nodes.withColumn("w", F.lit(1.0) if weights == "ols" else F.when(F.col("n_children") == 0, 1.0))
    else:
        raise ValueError(f"unknown weights {weights!r}")
    base = staged(given.join(weighted.select("node", "depth"), "node"), "base")
    up, sums = {}, {}
    for d in range(depth, -1, -1):
        level = base.filter(F.col("depth") == d).select(*keys, "node", "_y")
        if d == depth:
            level = level.withColumns({"_sum": F.lit(None).cast("double"), "_var": F.lit(None).cast("double"), "_n": F.lit(None).cast("long")})
        else:
            sums[d + 1] = staged(up[d + 1].groupBy(*keys, "parent").agg(F.sum("_m").alias("_sum"), F.sum("_v").alias("_var"), F.count("_m").alias("_n")), "sums")
            level = level.join(sums[d + 1].withColumnRenamed("parent", "node"), [*keys, "node"], "full_outer")
        level = level.join(weighted.filter(F.col("depth") == d).select("node", "parent", "n_children", "w"), "node")
        own = F.when((F.col("w") > 0) & F.col("_y").isNotNull(), F.col("w")).otherwise(0.0)
        precision = F.nullif(own + F.coalesce(1 / F.col("_var"), F.lit(0.0)), F.lit(0.0))
        mean = (own * F.coalesce("_y", F.lit(0.0)) + F.coalesce(F.col("_sum") / F.col("_var"), F.lit(0.0))) / precision
        # a sum counts only if no child lacks a value
        known = F.col("n_children") == F.coalesce("_n", F.lit(0))
        up[d] = staged(level.select(*keys, "node", "parent", F.when(known, mean).alias("_m"), F.when(known, 1 / precision).alias("_v")), "up")
    final = {0: up[0].select(*keys, "node", F.col("_m").alias("_x"))}
    for d in range(1, depth + 1):
        above = final[d - 1].withColumnRenamed("node", "parent").join(sums[d], [*keys, "parent"])
        shared = up[d].join(above, [*keys, "parent"])
        final[d] = staged(shared.select(*keys, "node", (F.col("_m") + F.col("_v") / F.col("_var") * (F.col("_x") - F.col("_sum"))).alias("_x")), "down")
    out = final[0]
    for d in range(1, depth + 1):
        out = out.unionByName(final[d])
    done = staged(out.select(*keys, F.col("node").alias(node), F.col("_x").alias(value)), "reconciled")
    unstage(nodes, base, *up.values(), *sums.values(), *final.values())
    return done
