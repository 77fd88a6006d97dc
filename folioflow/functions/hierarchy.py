"""Account groups and other parent/child tables, of any depth.

Every node points to its parent. In each round a pointer is replaced by the pointer of the node it points to, so it
covers twice the distance: a tree of depth d takes log2(d) joins of as many rows as it has nodes. A round is written
before the next one, which would otherwise repeat all rounds before it. Pointers that haven't ended when they cover more
steps than there are nodes are in a cycle or lead into one, which is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written


def _pointers(nodes: DataFrame) -> DataFrame:
    """(id, up) of ``id`` and ``parent_id``; a parent that is no node (0, NULL) marks a root."""
    pairs = nodes.filter("id IS NOT NULL").select("id", "parent_id")
    known = pairs.select(F.col("id").alias("up"))
    return pairs.join(known, pairs["parent_id"] == known["up"], "left").select("id", "up")


def _more(state: DataFrame, rounds: int) -> bool:
    """Whether any pointer is left. Raises if there are fewer nodes than steps that a pointer covers."""
    left = state.filter("up IS NOT NULL")
    some = [r.id for r in left.select("id").limit(10).collect()]
    if some and 2**rounds > state.count():
        raise ValueError(f"parents in a cycle, among others of the nodes {sorted(some)}")
    return bool(some)


def _next(state: DataFrame, **found: Column) -> DataFrame:
    """The state joined with what its pointers point to (columns after ``_``), its pointers moved on."""
    ahead = state.select(*[F.col(c).alias(f"_{c}") for c in state.columns])
    kept = [c for c in state.columns if c not in ("id", "up", *found)]
    joined = state.join(ahead, state["up"] == ahead["_id"], "left")
    return joined.select("id", F.col("_up").alias("up"), *kept, *[c.alias(name) for name, c in found.items()])


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor_id) for every node and each of its ancestors, itself included.

    As many rows as all nodes have ancestors; for sums over what is below a node ``rolled_up`` needs none of them.
    """
    state = written(_pointers(nodes), "pointers")
    pairs = state.select("id", F.col("id").alias("ancestor_id"))
    rounds = 0
    while _more(state, rounds):
        reached = pairs.select(F.col("id").alias("_at"), "ancestor_id")
        further = state.join(reached, state["up"] == reached["_at"]).select("id", "ancestor_id")
        pairs = written(pairs.union(further), "ancestors")
        state = written(_next(state), "pointers")
        rounds += 1
    return pairs


def below(nodes: DataFrame, roots: Sequence[int]) -> DataFrame:
    """(id) of ``roots`` and of every node below one of them; a root that is no node isn't among them."""
    hit = F.col("id").isin(*roots) if roots else F.lit(False)
    # A node that is found needs to look no further.
    state = _pointers(nodes).select("id", F.when(~hit, F.col("up")).alias("up"), hit.alias("hit"))
    state, rounds = written(state, "pointers"), 0
    while _more(state, rounds):
        found = F.col("hit") | F.coalesce(F.col("_hit"), F.lit(False))
        state = written(_next(state, hit=found), "pointers")
        rounds += 1
    return state.filter("hit").select("id")


def child_of(df: DataFrame, column: str, nodes: DataFrame, roots: Sequence[int]) -> DataFrame:
    """Rows whose ``column`` is one of ``roots`` or below one of them."""
    found = below(nodes, roots).select(F.col("id").alias("_below"))
    return df.join(found, df[column] == F.col("_below"), "left_semi")


def rolled_up(nodes: DataFrame, values: DataFrame, measures: Sequence[str]) -> DataFrame:
    """(id, measures): ``values`` (id, measures) summed over each node and all nodes below it.

    Nodes with no value below them aren't listed. After a round a node has the sums of all nodes nearer than its pointer
    reaches; those that point to it bring theirs. So there are never more rows than nodes.
    """

    def wide(name: str) -> Column:
        kind = values.schema[name].dataType
        return F.col(name).cast(T.DecimalType(38, kind.scale)) if isinstance(kind, T.DecimalType) else F.col(name)

    own = values.groupBy("id").agg(*[F.sum(m).alias(m) for m in measures])
    state = _pointers(nodes).join(own.select("id", *[wide(m).alias(m) for m in measures]), "id", "left")
    state, rounds = written(state, "sums"), 0
    while _more(state, rounds):
        brought = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("_to")).agg(*[F.sum(m).alias(f"_{m}") for m in measures])
        moved = _next(state)
        sums = {m: F.coalesce(F.col(m) + F.col(f"_{m}"), F.col(m), F.col(f"_{m}")) for m in measures}
        joined = moved.join(brought, moved["id"] == brought["_to"], "left")
        types = {m: state.schema[m].dataType for m in measures}
        state = written(joined.select("id", "up", *[c.cast(types[m]).alias(m) for m, c in sums.items()]), "sums")
        rounds += 1
    return state.filter(" OR ".join(f"`{m}` IS NOT NULL" for m in measures)).select("id", *measures)


def group_members(accounts: DataFrame, groups: DataFrame) -> DataFrame:
    """(account_id, group_id) where the account's code starts with the group's code.

    Each account code is exploded into its prefixes, so the match is an equi join.
    """
    prefixes = accounts.select(
        F.col("id").alias("account_id"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("code")), lambda n: F.substring("code", F.lit(1), n)
            )
        ).alias("_prefix"),
    ).filter(F.col("_prefix") != "")
    return prefixes.join(
        groups.select(F.col("id").alias("group_id"), F.col("code").alias("_prefix")), "_prefix"
    ).select("account_id", "group_id", F.length("_prefix").alias("prefix_length"))
