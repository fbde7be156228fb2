from pyspark.sql import functions as F

from tramline.operators import idchains

LINKS = "space_a string, id_a long, space_b string, id_b long"


def test_chains_of_several_spaces(spark):
    links = [("a", 1, "b", 1), ("c", 1, "b", 1), ("c", 1, "t", 10), ("a", 2, "b", 2), ("b", 2, "t", 30), ("b", 2, "t", 20), ("a", 3, "t", 99), ("a", 3, "b", 1), ("a", 4, "b", 4), ("t", 50, "t", 50), (None, 1, "t", 1), ("a", 1, "b", 1), ("x", 1, "x", 1)]
    rows = {(r.space, r.id): (r.target_id, r.steps, r.n_targets) for r in idchains.chains(spark.createDataFrame(links, LINKS), "t").collect()}
    assert rows[("a", 1)] == (10, 3, 2)  # through b and c, and through b and the third a to 99, equally near
    assert rows[("b", 1)] == (10, 2, 2) and rows[("c", 1)] == (10, 1, 1) and rows[("a", 3)] == (99, 1, 1)
    assert rows[("b", 2)] == (20, 1, 2) and rows[("a", 2)] == (20, 2, 2)
    assert rows[("t", 10)] == (10, 0, 1) and ("a", 4) not in rows and ("t", 50) not in rows and ("x", 1) not in rows
    few = {(r.space, r.id) for r in idchains.chains(spark.createDataFrame(links, LINKS), "t", 1).collect()}
    assert ("b", 2) in few and ("a", 2) not in few
    assert idchains.chains(spark.createDataFrame([], LINKS), "t").count() == 0


def test_points(spark):
    rows = [(True, True, 0, True, False, None, None, 128), (False, True, 1, False, False, 2, 2, 125), (False, False, 2, None, True, 2, 3, 925), (None, None, None, None, None, 3, None, 5), (False, False, 9, False, False, None, 4, 0)]
    df = spark.createDataFrame(rows, "exact boolean, prefix boolean, gap int, tv boolean, manual boolean, season int, entry int, want int")
    got = df.select("want", idchains.points(*[F.col(c) for c in ("exact", "prefix", "gap", "tv", "manual", "season", "entry")]).alias("p")).collect()
    assert all(r.p == r.want for r in got)
