"""Networks against enumeration."""

from collections import Counter
from itertools import combinations, product
from math import log

import numpy as np
import pytest

from statloom.operators import bayesnet as B


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(12)
    out = []
    for _ in range(3000):
        a, b = int(r.random() < 0.3), int(r.integers(0, 3))
        c = int(r.random() < (0.9 if a and b == 2 else 0.1 + 0.2 * b))
        d = int(r.random() < (0.8 if c else 0.15))
        out.append((a, b, c, d, int(r.random() < 0.5)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame([*rows, (None, 1, 1, 1, 1)], "a int, b int, c int, d int, e int").repartition(4).cache()


def score(rows, node, parents):
    at = {v: k for k, v in enumerate("abcde")}
    joint = Counter((tuple(r[at[p]] for p in parents), r[at[node]]) for r in rows)
    above = Counter()
    for (p, _), n in joint.items():
        above[p] += n
    values = len({v for _, v in joint})
    return sum(n * log(n / above[p]) for (p, _), n in joint.items()) - 0.5 * len(above) * (values - 1) * log(len(rows))


def test_scores_and_structure(df, rows):
    families = [(v, ps) for v in "abcde" for k in range(3) for ps in combinations([x for x in "abcde" if x != v], k)]
    got = {(r["node"], tuple(r["parents"])): r["score"] for r in B.family_scores(B.configurations(df, "abcde"), families).collect()}
    assert len(got) == len(families)
    for v, ps in families:
        assert abs(got[v, ps] - score(rows, v, ps)) < 1e-6
    network, total = B.learn_structure(df, list("abcde"))
    assert set(network.edges) == {("b", "c"), ("a", "c"), ("c", "d")}
    assert abs(total - sum(score(rows, v, network.parents(v)) for v in "abcde")) < 1e-6
    one, _ = B.learn_structure(df, list("abcde"), most=1)
    assert max(len(p) for p in one.given.values()) == 1


def test_inference_equals_enumeration(df, rows):
    network = B.Network()
    for v in "abcde":
        network.add_node(v)
    for p, c in ("ac", "bc", "cd", "bd"):
        network.add_edge(p, c)
    tables = B.fit_tables(df, network).cache()
    chance = {(r["node"], tuple(r["above"]), r["value"]): r["p"] for r in tables.collect()}

    def joint(x):
        p = 1.0
        for v, ps in network.given.items():
            p *= chance.get((v, tuple(str(x[q]) for q in ps), str(x[v])), 0.0)
        return p

    states = {"a": 2, "b": 3, "c": 2, "d": 2, "e": 2}
    for query, evidence in (("a", {}), ("a", {"d": 1}), ("a", {"d": 1, "b": 0}), ("d", {"a": 1, "e": 0}), ("b", {"c": 1}), ("c", {"c": 1}), ("e", {"a": 0})):
        want = Counter()
        for x in product(*(range(n) for n in states.values())):
            x = dict(zip(states, x))
            if all(x[k] == v for k, v in evidence.items()):
                want[str(x[query])] += joint(x)
        total = sum(want.values())
        got = {r["value"]: r["p"] for r in B.infer(network, tables, query, evidence).collect()}
        assert set(got) == {k for k, v in want.items() if v}
        for k, p in got.items():
            assert abs(p - want[k] / total) < 1e-12
    assert B.infer(network, tables, "a", {"b": 9}).collect() == []
    with pytest.raises(ValueError):
        B.infer(network, tables, "z")


def paths_open(network, x, y, known):
    """Separation by its definition: every undirected path is blocked."""
    edges = set(network.edges)
    near = {n: {c for p, c in edges if p == n} | {p for p, c in edges if c == n} for n in network.nodes}

    def walk(path):
        if path[-1] == y:
            for a, b, c in zip(path, path[1:], path[2:]):
                if (a, b) in edges and (c, b) in edges:
                    if b not in known and not network.descendants(b) & known:
                        return False
                elif b in known:
                    return False
            return True
        return any(walk([*path, n]) for n in near[path[-1]] if n not in path)

    return walk([x])


@pytest.mark.parametrize("seed", range(4))
def test_separation(seed):
    r = np.random.default_rng(seed)
    names = list("abcdef")
    network = B.Network({n: [] for n in names})
    for i, j in combinations(range(6), 2):
        if r.random() < 0.4:
            network.add_edge(names[i], names[j])
    assert all(network.order().index(p) < network.order().index(c) for p, c in network.edges)
    for x, y in combinations(names, 2):
        for k in range(3):
            for known in combinations([n for n in names if n not in (x, y)], k):
                assert network.separated(x, y, known) == (not paths_open(network, x, y, set(known)))


def test_network_edges():
    n = B.Network({"a": [], "b": []})
    n.add_edge("a", "b")
    n.add_edge("a", "b")
    assert n.edges == [("a", "b")] and n.children("a") == ["b"] and n.parents("b") == ["a"]
    for p, c in (("b", "a"), ("a", "a"), ("a", "z")):
        with pytest.raises(ValueError):
            n.add_edge(p, c)
