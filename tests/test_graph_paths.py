from statloom.operators import graph


def test_distances_along_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(66)], "src long, dst long").coalesce(1)
    d = graph.distances_from(edges, spark.createDataFrame([(0,)], "id long"), directed=True)
    assert {r["id"]: r["hops"] for r in d.collect()} == {i: i for i in range(67)}
    assert abs(graph.closeness(d).first()["closeness"] - 66 / sum(range(67))) < 1e-12
