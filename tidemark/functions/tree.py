"""Parent-id trees of any depth: every round doubles the step upward, so a tree of depth d takes log2(d) joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import checkpointed


def climb(nodes: DataFrame, root_value: int, separator: str = " ") -> DataFrame:
    """id and path of each node(id, parent, name) whose parents lead to root_value: the names from the root down.

    A node on a cycle, or below one or below a missing parent, leads to no root and has no row.
    Null and empty names are left out of a path.  Ids are unique.
    """
    n, step = nodes.count(), 1
    state = checkpointed(nodes.select("id", F.col("parent").alias("up"), F.coalesce("name", F.lit("")).alias("path")))
    while step <= n:
        climbing = state.where(F.col("up") != root_value)
        if climbing.isEmpty():
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        part = lambda c: F.when(F.col(c) != "", F.col(c))
        risen = climbing.join(above, "up").select("id", F.col("_up").alias("up"), F.concat_ws(separator, part("_path"), part("path")).alias("path"))
        state = checkpointed(state.where(F.col("up") == root_value).unionByName(risen))
        step *= 2
    return state.where(F.col("up") == root_value).select("id", "path")


def paths(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", name_col: str = "name", root_value: int = 0, separator: str = " ", skip: tuple[str, ...] = ()) -> DataFrame:
    """id and path (names from the root down, without those to skip) of each node that hangs on a root."""
    skipped = F.col(name_col).isin(*skip) if skip else F.lit(False)
    return climb(nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.when(~skipped, F.col(name_col)).alias("name")), root_value, separator)


def enabled_nodes(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", enabled: Column | None = None, root_value: int = 0) -> DataFrame:
    """Nodes that, like all their ancestors, are enabled and exist."""
    live = nodes.where(F.lit(True) if enabled is None else enabled)
    hanging = climb(live.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.lit("").alias("name")), root_value)
    return live.join(hanging.select(F.col("id").alias(id_col)), id_col, "left_semi").select(*nodes.columns)


def jumps(edges: DataFrame):
    """Yields (step, table of node and ancestor exactly step above) for steps 1, 2, 4, ... while there are any; raises on a cycle.  edges: node, parent."""
    n, step = edges.count(), 1
    jump = checkpointed(edges.where("node IS NOT NULL AND parent IS NOT NULL").select("node", F.col("parent").alias("above")))
    while not jump.isEmpty():
        if step > n:  # no path in a forest is as long
            raise ValueError("the tree has a cycle")
        yield step, jump
        jump = checkpointed(jump.join(jump.select(F.col("node").alias("above"), F.col("above").alias("_next")), "above").select("node", F.col("_next").alias("above")))
        step *= 2


def has_cycle(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> bool:
    """Whether some node is its own ancestor."""
    try:
        for _ in jumps(nodes.select(F.col(id_col).alias("node"), F.col(parent_col).alias("parent"))):
            pass
    except ValueError:
        return True
    return False
