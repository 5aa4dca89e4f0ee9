"""Bayesian networks over columns of a table: structure and tables from counts, posteriors by joins.

The rows are read once, for the counts of their different configurations.  The
counts of all families that a round compares come from one aggregate over these,
and so do their scores; the driver gets one number for each family.  A factor is
a table of configurations with a weight: multiplying factors is a join on their
shared variables, summing a variable out an aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.order import staged


@dataclass
class Network:
    """A directed graph without cycles over named variables."""

    given: dict[str, list[str]] = field(default_factory=dict)

    def add_node(self, name: str) -> None:
        self.given.setdefault(name, [])

    def add_edge(self, parent: str, child: str) -> None:
        if parent not in self.given or child not in self.given:
            raise ValueError("both ends must be nodes")
        if parent == child or parent in self.descendants(child):
            raise ValueError(f"{parent} -> {child} would close a cycle")
        if parent not in self.given[child]:
            self.given[child].append(parent)

    @property
    def nodes(self) -> list[str]:
        return list(self.given)

    @property
    def edges(self) -> list[tuple[str, str]]:
        return [(p, c) for c, ps in self.given.items() for p in ps]

    def parents(self, name: str) -> list[str]:
        return list(self.given[name])

    def children(self, name: str) -> list[str]:
        return [c for c, ps in self.given.items() if name in ps]

    def _closure(self, names: Sequence[str], step) -> set[str]:
        seen, todo = set(), list(names)
        while todo:
            for other in step(todo.pop()):
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        return seen

    def descendants(self, name: str) -> set[str]:
        return self._closure([name], self.children)

    def ancestors(self, names: Sequence[str]) -> set[str]:
        return self._closure(names, self.parents) | set(names)

    def order(self) -> list[str]:
        """Parents before children, otherwise as added."""
        left, out = dict(self.given), []
        while left:
            ready = next(n for n, ps in left.items() if all(p in out for p in ps))
            out.append(ready)
            del left[ready]
        return out

    def separated(self, x: str, y: str, known: Sequence[str] = ()) -> bool:
        """Whether ``known`` separates x and y: no way between them in the moral graph of their ancestors without ``known``."""
        if x not in self.given or y not in self.given or any(k not in self.given for k in known):
            raise ValueError("all must be nodes")
        if x == y:
            return False
        kept = self.ancestors([x, y, *known])
        near: dict[str, set[str]] = {n: set() for n in kept}
        for child in kept:
            family = [child, *self.given[child]]
            for a in family:
                near[a] |= set(family) - {a}
        blocked = set(known) - {x, y}
        return y not in self._closure([x], lambda n: near[n] - blocked)


def configurations(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """The different rows of some columns, as text, with their number ``n``; rows with a null in one of them don't count."""
    rows = df.select(*[F.col(v).cast("string").alias(v) for v in variables]).dropna()
    return rows.groupBy(*variables).agg(F.count(F.lit(1)).alias("n"))


def family_scores(counts: DataFrame, families: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Rows (node, parents, score) from ``configurations``: log likelihood less half the log of n for each free parameter.

    All families are counted in one aggregate.  Parameters are the parents'
    configurations that occur times the node's values less one.
    """
    cell = [F.struct(F.lit(k).alias("k"), (F.array(*ps) if ps else F.array().cast("array<string>")).alias("above"), F.col(node).alias("value")) for k, (node, ps) in enumerate(families)]
    joint = counts.select("n", F.inline(F.array(*cell))).groupBy("k", "above", "value").agg(F.sum("n").alias("n"))
    above = joint.groupBy("k", "above").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("own"))
    fit = above.groupBy("k").agg(F.sum(F.col("own") - F.col("total") * F.ln("total")).alias("fit"), F.count(F.lit(1)).alias("q"), F.sum("total").alias("rows"))
    values = joint.select("k", "value").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("r"))
    names = counts.sparkSession.createDataFrame([(k, node, list(ps)) for k, (node, ps) in enumerate(families)], "k int, node string, parents array<string>")
    score = F.col("fit") - 0.5 * F.col("q") * (F.col("r") - 1) * F.ln("rows")
    return fit.join(values, "k").join(names, "k").select("node", "parents", score.alias("score"))


def learn_structure(df: DataFrame, order: Sequence[str], most: int = 3) -> tuple[Network, float]:
    """(network, score) by greedy parents in a given order of variables (K2): each node takes the earlier one that raises its score most.

    All nodes take their next parent in one round, so there are at most
    ``most + 1`` aggregates.  Ties go to the earlier variable.
    """
    counts = staged(configurations(df, order), "configurations")
    taken: dict[str, list[str]] = {v: [] for v in order}
    score = {r["node"]: r["score"] for r in family_scores(counts, [(v, []) for v in order]).collect()}
    open_ = list(order[1:])
    for _ in range(most):
        tries = [(v, [*taken[v], c]) for v in open_ for c in order[: order.index(v)] if c not in taken[v]]
        if not tries:
            break
        found = {(r["node"], tuple(r["parents"])): r["score"] for r in family_scores(counts, tries).collect()}
        still = []
        for v in open_:
            best = max(((found[v, tuple(ps)], -k, ps) for k, (w, ps) in enumerate(tries) if w == v and (v, tuple(ps)) in found), default=None)
            if best and best[0] > score[v]:
                score[v], taken[v] = best[0], best[2]
                still.append(v)
        open_ = still
    return Network(taken), sum(score.values())


def fit_tables(df: DataFrame, network: Network) -> DataFrame:
    """Rows (node, above, value, p): each node's chances under each configuration of its parents that occurs.

    ``above`` has the parents' values in the network's order.  All tables come
    from one aggregate over the configurations.
    """
    counts = configurations(df, network.nodes)
    cell = [F.struct(F.lit(v).alias("node"), (F.array(*ps) if ps else F.array().cast("array<string>")).alias("above"), F.col(v).alias("value")) for v, ps in network.given.items()]
    joint = counts.select("n", F.inline(F.array(*cell))).groupBy("node", "above", "value").agg(F.sum("n").alias("n"))
    total = joint.groupBy("node", "above").agg(F.sum("n").alias("total"))
    return joint.join(total, ["node", "above"]).select("node", "above", "value", (F.col("n") / F.col("total")).alias("p"))


def _multiply(a: tuple[DataFrame, set[str]], b: tuple[DataFrame, set[str]]) -> tuple[DataFrame, set[str]]:
    shared = sorted(a[1] & b[1])
    right = b[0].withColumnRenamed("p", "q")
    both = a[0].join(right, shared) if shared else a[0].join(F.broadcast(right))  # a factor without variables is one row
    return both.withColumn("p", F.col("p") * F.col("q")).drop("q"), a[1] | b[1]


def infer(network: Network, tables: DataFrame, query: str, evidence: Mapping[str, object] | None = None) -> DataFrame:
    """Rows (value, p): the distribution of a variable given others' values, by variable elimination.

    ``tables`` are those of ``fit_tables`` (or any with these columns).  Only
    ancestors of the query and the evidence take part; the variable whose
    elimination makes the smallest factor goes first.  Evidence of chance 0: no rows.
    """
    known = {v: str(x) for v, x in (evidence or {}).items()}
    if query not in network.given or any(v not in network.given for v in known):
        raise ValueError("all must be nodes")
    factors: list[tuple[DataFrame, set[str]]] = []
    for node in (n for n in network.order() if n in network.ancestors([query, *known])):
        ps = network.given[node]
        rows = tables.where(F.col("node") == node).select(*[F.col("above")[k].alias(p) for k, p in enumerate(ps)], F.col("value").alias(node), "p")
        scope = {node, *ps}
        for v in sorted(scope & set(known)):
            rows = rows.where(F.col(v) == known[v])
            if v != query:
                rows, scope = rows.drop(v), scope - {v}
        factors.append((rows, scope))
    hidden = {v for _, s in factors for v in s} - {query}
    while hidden:
        size = {v: len(set().union(*(s for _, s in factors if v in s))) for v in sorted(hidden)}
        v = min(size, key=size.get)
        hidden.discard(v)
        mine, rest = [f for f in factors if v in f[1]], [f for f in factors if v not in f[1]]
        one = mine[0]
        for other in mine[1:]:
            one = _multiply(one, other)
        scope = one[1] - {v}
        factors = [*rest, (one[0].groupBy(*sorted(scope)).agg(F.sum("p").alias("p")), scope)]
    with_query = [f for f in factors if query in f[1]]
    one = with_query[0]
    for other in [*with_query[1:], *[f for f in factors if query not in f[1]]]:
        one = _multiply(one, other)
    rows = one[0].groupBy(F.col(query).alias("value")).agg(F.sum("p").alias("p"))
    total = rows.agg(F.sum("p").alias("total"))
    return rows.join(F.broadcast(total)).where("total > 0").select("value", (F.col("p") / F.col("total")).alias("p"))
