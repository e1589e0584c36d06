"""What a user may see: tenant, soft-delete and department predicates, added where a table is resolved."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.tree import enabled_nodes, jumps
from tidemark.session import checkpointed

ALL, DEPT_CUSTOM, DEPT_ONLY, DEPT_AND_CHILD, SELF = 1, 2, 3, 4, 5


@dataclass
class DataScope:
    """Departments and, if ``self_only``, the user's own rows; ``everything`` lifts the limit."""

    everything: bool = False
    depts: frozenset = frozenset()
    user: int | None = None
    self_only: bool = False

    def predicate(self, dept_col: str | None, user_col: str | None) -> Column:
        """Rows in the departments or of the user; without either, none."""
        if self.everything:
            return F.lit(True)
        parts = []
        if self.depts and dept_col:
            parts.append(F.col(dept_col).isin(sorted(self.depts)))
        if self.self_only and user_col and self.user is not None:
            parts.append(F.col(user_col) == self.user)
        if not parts:
            return F.lit(False)
        out = parts[0]
        for p in parts[1:]:
            out = out | p
        return out


def scope_of(roles: list[tuple[int, frozenset]], dept: int | None, children: frozenset, user: int) -> DataScope:
    """The union of the roles' scopes (kind, custom departments)."""
    depts, own = set(), False
    for kind, custom in roles:
        if kind == ALL:
            return DataScope(everything=True)
        if kind == DEPT_CUSTOM:
            depts |= set(custom)
            depts |= {dept} - {None}
        elif kind == DEPT_ONLY:
            depts |= {dept} - {None}
        elif kind == DEPT_AND_CHILD:
            depts |= ({dept} - {None}) | set(children)
        elif kind == SELF:
            own = True
    return DataScope(depts=frozenset(depts), user=user, self_only=own)


@dataclass
class Resolver:
    """Resolves a table's name to the rows that the context may see; Catalyst pushes the predicates to the scan."""

    load: Callable[[str], DataFrame]
    tenant: int | None = None
    scope: DataScope = field(default_factory=lambda: DataScope(everything=True))
    #: table -> column; tables that are not named have no such predicate.
    tenant_cols: dict[str, str] = field(default_factory=dict)
    deleted_cols: dict[str, str] = field(default_factory=dict)
    dept_cols: dict[str, str] = field(default_factory=dict)
    user_cols: dict[str, str] = field(default_factory=dict)
    rules: dict[str, list[Callable[[], Column]]] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        df = self.load(name)
        if name in self.tenant_cols:
            if self.tenant is None:
                raise ValueError(f"{name} belongs to tenants, and no tenant is set")
            df = df.where(F.col(self.tenant_cols[name]) == self.tenant)
        if name in self.deleted_cols:
            df = df.where(F.coalesce(F.col(self.deleted_cols[name]).cast("int"), F.lit(0)) == 0)
        if name in self.dept_cols or name in self.user_cols:
            df = df.where(self.scope.predicate(self.dept_cols.get(name), self.user_cols.get(name)))
        for rule in self.rules.get(name, []):
            df = df.where(rule())
        return df

    def views(self, names: list[str]) -> None:
        """Temporary views of the resolved tables, for SQL."""
        for name in names:
            self.table(name).createOrReplaceTempView(name)


def descendants(nodes: DataFrame, roots: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(root, node, depth) for each root and all nodes below it, itself at depth 0, however deep; raises on a cycle.

    Each round joins what was reached with the nodes 1, 2, 4, ... levels below, so the number of
    joins grows with the logarithm of the depth.
    """
    reached = checkpointed(roots.select(F.col(id_col).alias("root"), F.col(id_col).alias("node"), F.lit(0).cast("long").alias("depth")).distinct())
    for step, jump in jumps(nodes.select(F.col(id_col).alias("node"), F.col(parent_col).alias("parent"))):
        below = jump.select(F.col("above").alias("node"), F.col("node").alias("_node"))
        reached = checkpointed(reached.unionByName(reached.join(below, "node").select("root", F.col("_node").alias("node"), (F.col("depth") + step).alias("depth"))))
    return reached.withColumn("depth", F.col("depth").cast("int"))


def enabled_tree(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", enabled: Column | None = None, root_value: int = 0) -> DataFrame:
    """Nodes that, like all their ancestors, are enabled and exist; from the enabled roots down."""
    return enabled_nodes(nodes, id_col, parent_col, enabled, root_value)
