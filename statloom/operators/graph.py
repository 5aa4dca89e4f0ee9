"""Graphs as edge tables (src, dst), and spatial statistics on sparse weights.

An undirected graph has each edge once; loops and repeated edges are dropped.
Rank loops write each round's table to the shared folder, so lineage stays short
and a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..plans.order import staged, unstage
from . import bands
from .descriptive import beside, observed


def clean(edges: DataFrame, src: str = "src", dst: str = "dst", directed: bool = False) -> DataFrame:
    """Different edges without loops; undirected ones in both directions."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null and src != dst")
    if not directed:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return e.distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def edge_weights(edges: DataFrame, weight: str | None = None, directed: bool = False) -> DataFrame:
    """Rows (src, dst, weight): the sum of an edge's weights, 1 for each row without one.

    An undirected edge has the rows of both directions together and shows in
    both; loops and missing ends are left out.
    """
    w = F.coalesce(observed(weight), F.lit(1.0)) if weight else F.lit(1.0)
    rows = edges.select("src", "dst", w.alias("weight")).dropna(subset=["src", "dst"]).where("src != dst")
    if not directed:
        rows = rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def strength(edges: DataFrame, weight: str | None = None, directed: bool = False) -> DataFrame:
    """Rows (id, strength): the weights of the edges that leave a vertex, 0 where none does."""
    w = edge_weights(edges, weight, directed)
    out = w.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("strength"))
    all_ = w.select(F.col("src").alias("id")).unionByName(w.select(F.col("dst").alias("id"))).distinct()
    return all_.join(out, "id", "left").select("id", F.coalesce("strength", F.lit(0.0)).alias("strength"))


def degree_centrality(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Out-degree (degree if undirected) over the number of other vertices."""
    e = clean(edges, directed=directed)
    v = vertices(e)
    out = v.join(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "id", "left")
    out = beside(out, v.agg((F.count(F.lit(1)) - 1).alias("m")), [])
    d = F.coalesce("degree", F.lit(0))
    return out.select("id", d.alias("degree"), F.when(F.col("m") > 0, d / F.col("m")).otherwise(0.0).alias("centrality"))


def page_rank(edges: DataFrame, directed: bool = True, damping: float = 0.85, rounds: int = 100, tol: float = 1e-8) -> DataFrame:
    """Rank of each vertex; the mass of vertices without out-edges is spread over all."""
    e = clean(edges, directed=directed)
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    e = staged(e.join(out, "src"), "edges")
    v = staged(vertices(e).join(out.withColumnRenamed("src", "id"), "id", "left"), "vertices")
    n = v.count()
    if not n:
        return v.select("id", F.lit(0.0).alias("rank"))
    rank, old = v.select("id", "k", F.lit(1.0 / n).alias("rank")), []
    for _ in range(rounds):
        flow = e.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("k")).alias("flow"))
        lost = rank.agg(F.sum(F.when(F.col("k").isNull(), F.col("rank")).otherwise(0.0))).first()[0]
        base = (1 - damping) / n + damping * lost / n
        new = rank.join(flow, "id", "left").select("id", "k", (F.lit(base) + damping * F.coalesce("flow", F.lit(0.0))).alias("new"), F.col("rank").alias("old"))
        new = staged(new, "rank")
        moved = new.agg(F.sum(F.abs(F.col("new") - F.col("old")))).first()[0]
        rank = new.select("id", "k", F.col("new").alias("rank"))
        unstage(*old)
        old = [new]
        if moved < tol:
            break
    return rank.select("id", "rank")


def eigenvector_centrality(edges: DataFrame, rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """Power iteration on the undirected adjacency plus the identity, unit length."""
    e = staged(clean(edges), "edges")
    x = vertices(e).withColumn("x", F.lit(1.0))
    last = None
    for _ in range(rounds):
        y = e.join(x.select(F.col("id").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("x").alias("y"))
        y = staged(x.join(y, "id", "left").select("id", (F.coalesce("y", F.lit(0.0)) + F.col("x")).alias("y"), F.col("x").alias("old")), "vector")
        size = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0]
        if not size:
            return x.select("id", F.lit(0.0).alias("centrality"))
        moved = y.agg(F.max(F.abs(F.col("y") / size - F.col("old")))).first()[0]
        x = y.select("id", (F.col("y") / size).alias("x"))
        if last is not None and moved < tol:
            break
        last = moved
    return x.select("id", F.col("x").alias("centrality"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Unweighted modularity of a table (id, community) on an undirected graph."""
    e = clean(edges)
    c = communities.select(F.col("id").alias("__v"), F.col("community").alias("__c"))
    both = e.join(c.select(F.col("__v").alias("src"), F.col("__c").alias("a")), "src").join(c.select(F.col("__v").alias("dst"), F.col("__c").alias("b")), "dst")
    s = both.groupBy("a").agg(F.count(F.lit(1)).alias("deg"), F.count_if(F.col("a") == F.col("b")).alias("inside"))
    s = beside(s, e.agg(F.count(F.lit(1)).cast("double").alias("m2")), [])
    return s.agg(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("deg") / F.col("m2"), 2)).alias("modularity"))


def distances_from(edges: DataFrame, sources: DataFrame, directed: bool = False, limit: int | None = None) -> DataFrame:
    """Breadth-first distances (source, id, hops) from a table of sources (id), a join a round.

    All that can be reached; with ``limit``, what is at most so many hops away.
    """
    e = staged(clean(edges, directed=directed), "edges")
    seen = staged(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("hops")), "seen")
    edge = seen
    hop = 0
    while limit is None or hop < limit:
        hop += 1
        step = edge.join(e, edge["id"] == e["src"]).select("source", F.col("dst").alias("id")).distinct()
        edge = staged(step.join(seen, ["source", "id"], "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        if edge.isEmpty():
            break
        seen = staged(seen.unionByName(edge), "seen")
    return seen


def closeness(distances: DataFrame) -> DataFrame:
    """Reached vertices over the sum of distances, for each source of ``distances_from``."""
    return distances.groupBy(F.col("source").alias("id")).agg(F.when(F.sum("hops") > 0, F.count_if(F.col("hops") > 0) / F.sum("hops")).otherwise(0.0).alias("closeness"))


def band_weights(points: DataFrame, id_col: str, x: str, y: str, threshold: float) -> DataFrame:
    """Pairs (i, j, d) of points at most ``threshold`` apart, by grid cells of that size; what needs sums of them only is in ``band_sums`` and the others below."""
    return bands.near_pairs(bands.plane(points, id_col, x, y), threshold, 2)


def band_sums(points: DataFrame, id_col: str, x: str, y: str, threshold: float) -> DataFrame:
    """Rows (i, n, total): the number and the summed distances of a point's pairs of ``band_weights``, which are not made."""
    return bands.near_sums(bands.plane(points, id_col, x, y), threshold, 2)


def nearest_weights(weights: DataFrame, k: int) -> DataFrame:
    """The k nearest of each point's pairs, ties by the least id."""
    w = Window.partitionBy("i").orderBy("d", "j")
    return weights.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def _weighted(values: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs with both deviations, and n, m2, m4 of all values (id, v)."""
    s = values.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("v").alias("m"))
    dev = beside(values, s, []).select("id", (F.col("v") - F.col("m")).alias("z"), "n")
    e = weights.select("i", "j", (F.col("w") if "w" in weights.columns else F.lit(1.0)).alias("w"))
    e = e.join(dev.select(F.col("id").alias("i"), F.col("z").alias("zi")), "i").join(dev.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j")
    return e, dev.agg(F.max("n").alias("n"), F.sum(F.col("z") * F.col("z")).alias("m2"))


def moran(values: DataFrame, weights: DataFrame) -> DataFrame:
    """Moran's I of values (id, v) under weights (i, j, and w or 1): expected, variance under normality, z, p_value."""
    e, s = _weighted(values, weights)
    one = e.agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("c"))
    back = e.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("u"))
    both = e.select("i", "j", "w").join(back, ["i", "j"], "full")
    s1 = both.agg((F.sum(F.pow(F.coalesce("w", F.lit(0.0)) + F.coalesce("u", F.lit(0.0)), 2)) / 2).alias("s1"))
    rows = e.groupBy("i").agg(F.sum("w").alias("r")).select(F.col("i").alias("id"), "r")
    cols = e.groupBy("j").agg(F.sum("w").alias("c")).select(F.col("j").alias("id"), "c")
    s2 = rows.join(cols, "id", "full").agg(F.sum(F.pow(F.coalesce("r", F.lit(0.0)) + F.coalesce("c", F.lit(0.0)), 2)).alias("s2"))
    return _moran(beside(beside(beside(one, s, []), s1, []), s2, []))


def _moran(t: DataFrame) -> DataFrame:
    """I and its moments from n, m2 and the sums s0, s1, s2 of the weights and c of the products."""
    n, s0 = F.col("n"), F.col("s0")
    expected = -1 / (n - 1)
    var = (n * n * F.col("s1") - n * F.col("s2") + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - expected * expected
    t = t.select((n / s0 * F.col("c") / F.col("m2")).alias("i"), expected.alias("expected"), var.alias("variance"))
    t = t.withColumn("z", (F.col("i") - F.col("expected")) / F.sqrt("variance"))
    return t.withColumn("p_value", special.column("normal_two_sided", F.col("z")))


def geary(values: DataFrame, weights: DataFrame) -> DataFrame:
    """Geary's C."""
    e, s = _weighted(values, weights)
    t = beside(e.agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.pow(F.col("zi") - F.col("zj"), 2)).alias("q")), s, [])
    return t.select(((F.col("n") - 1) * F.col("q") / (2 * F.col("s0") * F.col("m2"))).alias("c"))


def variogram(values: DataFrame, weights: DataFrame, width: float) -> DataFrame:
    """Half the mean squared difference of pairs (i, j, d) by distance bins of ``width``; empty bins are absent."""
    v = values.select("id", "v")
    e = weights.where(F.col("i") < F.col("j")).join(v.select(F.col("id").alias("i"), F.col("v").alias("a")), "i").join(v.select(F.col("id").alias("j"), F.col("v").alias("b")), "j")
    e = e.withColumn("bin", F.floor(F.col("d") / width))
    return e.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("distance"), (F.avg(F.pow(F.col("a") - F.col("b"), 2)) / 2).alias("gamma"))


def _placed(points: DataFrame, id_col: str, x: str, y: str, v: str) -> tuple[DataFrame, DataFrame]:
    """Points with their deviation z, and n, m2 of all values, for statistics of ``band_weights`` without the pairs."""
    mean = points.agg(F.avg(v)).first()[0]
    z = F.col(v).cast("double") - F.lit(float(mean or 0.0))
    return bands.plane(points, id_col, x, y, [z.alias("z")]), points.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(z * z).alias("m2"))


def band_moran(points: DataFrame, id_col: str, x: str, y: str, v: str, threshold: float) -> DataFrame:
    """``moran`` of values under the weights 1 of ``band_weights``."""
    p, s = _placed(points, id_col, x, y, v)
    return _moran(beside(bands.near_products(p, threshold, 2).withColumn("s0", F.col("s0").cast("double")).withColumn("s1", 2 * F.col("s0")), s, []))


def band_geary(points: DataFrame, id_col: str, x: str, y: str, v: str, threshold: float) -> DataFrame:
    """``geary`` of values under the weights 1 of ``band_weights``."""
    p, s = _placed(points, id_col, x, y, v)
    return beside(bands.near_products(p, threshold, 2), s, []).select(((F.col("n") - 1) * F.col("q") / (2 * F.col("s0") * F.col("m2"))).alias("c"))


def band_variogram(points: DataFrame, id_col: str, x: str, y: str, v: str, threshold: float, width: float) -> DataFrame:
    """``variogram`` of the pairs of ``band_weights``."""
    return bands.near_bins(bands.plane(points, id_col, x, y, [F.col(v).cast("double").alias("z")]), threshold, 2, width)


def graph_size(edges: DataFrame, directed: bool = False) -> DataFrame:
    """nodes, edges (undirected ones once) and density."""
    e = clean(edges, directed=directed)
    m = e.agg((F.count(F.lit(1)) / (1 if directed else 2)).alias("edges"))
    s = beside(vertices(e).agg(F.count(F.lit(1)).alias("nodes")), m, [])
    most = F.col("nodes") * (F.col("nodes") - 1) / (1 if directed else 2)
    return s.select("nodes", F.col("edges").cast("long").alias("edges"), F.when(most > 0, F.col("edges") / most).otherwise(0.0).alias("density"))


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """triangles, connected triples and three times their ratio, of an undirected graph.

    Each edge points to its end of higher degree, so that a hub, which has few
    edges of its own then, does not pair all its neighbours.
    """
    e = staged(clean(edges), "edges")
    degree = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    triples = degree.agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0.0)).cast("long").alias("triples"))
    both = e.join(degree.select(F.col("id").alias("src"), F.col("k").alias("ks")), "src").join(degree.select(F.col("id").alias("dst"), F.col("k").alias("kd")), "dst")
    up = staged(both.where(F.struct("ks", "src") < F.struct(F.col("kd").alias("ks"), F.col("dst").alias("src"))).select("src", "dst"), "oriented")
    wedge = up.select("src", F.col("dst").alias("a")).join(up.select("src", F.col("dst").alias("b")), "src").where("a != b")
    closed = wedge.join(up.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"]).agg(F.count(F.lit(1)).alias("triangles"))
    s = beside(closed, triples, [])
    return s.withColumn("coefficient", F.when(F.col("triples") > 0, 3 * F.col("triangles") / F.col("triples")).otherwise(0.0))


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (id, component): the least id that a vertex reaches, by hooking and pointer jumping in a few rounds."""
    e = staged(clean(edges), "edges")
    label = staged(vertices(e).withColumn("component", F.col("id")), "labels")
    old = [label]
    while True:
        near = e.join(label.select(F.col("id").alias("dst"), F.col("component").alias("c")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("c"))
        hooked = label.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("c", "component")).alias("new"))
        roots = hooked.groupBy(F.col("component").alias("root")).agg(F.min("new").alias("low"))  # a root takes the least of its members'
        moved = staged(hooked.join(roots, hooked["component"] == roots["root"]).select("id", "component", "low"), "hooked")
        jump = moved.select(F.col("id").alias("low"), F.col("low").alias("lower"))
        new = staged(moved.join(jump, "low", "left").select("id", "component", F.coalesce("lower", "low").alias("new")), "labels")
        unstage(moved, *old)
        old, label = [new], new.select("id", F.col("new").alias("component"))
        if new.where("component != new").isEmpty():
            return label


def label_propagation(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Rows (id, community): all vertices at once take the most frequent label of their neighbours and themselves, ties the least."""
    e = staged(clean(edges), "edges")
    v = vertices(e)
    e = staged(e.unionByName(v.select(F.col("id").alias("src"), F.col("id").alias("dst"))), "votes")
    label = staged(v.withColumn("community", F.col("id")), "labels")
    kept = [label]
    for _ in range(rounds):
        votes = e.join(label.select(F.col("id").alias("dst"), F.col("community").alias("c")), "dst").groupBy("src", "c").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(F.col("src").alias("id")).agg(F.min(F.struct((-F.col("n")).alias("n"), "c")).alias("b"))
        new = staged(label.join(best, "id").select("id", F.col("community").alias("old"), F.col("b.c").alias("community")), "labels")
        label = new.select("id", "community")
        unstage(*kept)
        kept = [new]
        if new.where("old != community").isEmpty():
            break
    return label


def diameter(edges: DataFrame) -> DataFrame:
    """The longest of the shortest paths, in hops, between vertices that reach each other."""
    e = clean(edges)
    return distances_from(edges, vertices(e)).agg(F.coalesce(F.max("hops"), F.lit(0)).alias("diameter"))


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Shares of shortest paths through each vertex of an undirected graph, summed over sources (default: all) and halved.

    Paths are counted forward by rounds of joins over all sources at once, and
    dependencies summed backward by rounds.
    """
    e = staged(clean(edges), "edges")
    start = vertices(e) if sources is None else sources.select("id")
    seen = staged(start.select(F.col("id").alias("source"), "id", F.lit(0).alias("hops"), F.lit(1.0).alias("paths")), "paths")
    edge, hop = seen, 0
    while True:
        hop += 1
        step = edge.join(e, edge["id"] == e["src"]).groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        edge = staged(step.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(hop).alias("hops"), "paths"), "frontier")
        if edge.isEmpty():
            break
        seen = staged(seen.unionByName(edge), "paths")
    done = staged(seen.where("hops < 0").select("source", "id", F.lit(0.0).alias("share")), "shares")
    below = None
    for h in range(hop - 1, 0, -1):
        at = seen.where(F.col("hops") == h).select("source", "id", "paths")
        if below is None:
            own = at.withColumn("share", F.lit(0.0))
        else:
            own = at.join(below, ["source", "id"], "left").select("source", "id", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("share"))
        own = staged(own, "level")
        done = staged(done.unionByName(own.select("source", "id", "share")), "shares")
        if h > 1:  # what each vertex one hop nearer to the source gets, per path of its own
            up = seen.where(F.col("hops") == h - 1).select("source", F.col("id").alias("near"))
            flow = own.select("source", F.col("id").alias("src"), ((1 + F.col("share")) / F.col("paths")).alias("f")).join(e, "src").select("source", F.col("dst").alias("near"), "f")
            below = flow.join(up, ["source", "near"]).groupBy("source", F.col("near").alias("id")).agg(F.sum("f").alias("part"))
    total = done.groupBy("id").agg(F.sum("share").alias("s"))
    return vertices(e).join(total, "id", "left").select("id", (F.coalesce("s", F.lit(0.0)) / 2).alias("betweenness"))


def fit_variogram(bins: DataFrame, model: str = "spherical", steps: int = 40) -> tuple[float, float, float]:
    """(nugget, sill, range) of a spherical, exponential or gaussian model, by weighted least squares over the bins of ``variogram``."""
    shape = {
        "spherical": lambda h, a: F.when(h < a, 1.5 * h / a - 0.5 * F.pow(h / a, 3)).otherwise(1.0),
        "exponential": lambda h, a: 1 - F.exp(-3 * h / a),
        "gaussian": lambda h, a: 1 - F.exp(-3 * F.pow(h / a, 2)),
    }[model]
    w, y, h = F.col("n").cast("double"), F.col("gamma"), F.col("distance")
    most = bins.agg(F.max("distance")).first()[0]
    ranges = [most * (k + 1) * 1.5 / steps for k in range(steps)]
    terms = []
    for k, a in enumerate(ranges):  # linear in nugget and partial sill for each range
        g = shape(h, F.lit(float(a)))
        terms += [F.sum(w * g).alias(f"g{k}"), F.sum(w * g * g).alias(f"gg{k}"), F.sum(w * g * y).alias(f"gy{k}")]
    s = bins.agg(F.sum(w).alias("w"), F.sum(w * y).alias("y"), F.sum(w * y * y).alias("yy"), *terms).first()
    best = None
    for k, a in enumerate(ranges):
        det = s["w"] * s[f"gg{k}"] - s[f"g{k}"] ** 2
        slope = (s["w"] * s[f"gy{k}"] - s[f"g{k}"] * s["y"]) / det if det > 1e-12 else 0.0
        slope = max(0.0, slope)
        nugget = (s["y"] - slope * s[f"g{k}"]) / s["w"]
        if nugget < 0:
            nugget, slope = 0.0, max(0.0, s[f"gy{k}"] / s[f"gg{k}"])
        loss = s["yy"] - 2 * nugget * s["y"] - 2 * slope * s[f"gy{k}"] + nugget**2 * s["w"] + 2 * nugget * slope * s[f"g{k}"] + slope**2 * s[f"gg{k}"]
        if best is None or loss < best[0]:
            best = (loss, nugget, nugget + slope, a)
    return best[1:]
