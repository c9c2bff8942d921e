import random

from pyspark.sql import functions as F

from tickforge.llm.topn import Desc, latest, top_n


def brute(rows, n):
    out, groups = set(), {}
    for g, score, second, ident in rows:
        groups.setdefault(g, []).append((score, second, ident))
    for g, xs in groups.items():
        xs.sort(key=lambda x: ((x[0] is None), -(x[0] or 0), x[1] is None, -(x[1] or 0), x[2]))
        out |= {(g, i + 1, x[2]) for i, x in enumerate(xs[:n])}
    return out


def test_ties_nulls_and_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.05 else "hot" if rng.random() < 0.5 else f"g{rng.randrange(200)}", rng.choice([0.1, 0.2, 0.3]), rng.choice([None, 1.0, 2.0]), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, score double, second double, ident long").repartition(7)
    order = [Desc(F.col("score")), Desc(F.col("second")), F.col("ident")]
    got = {tuple(r) for r in top_n(df, ["g"], order, ["ident"], 5).collect()}
    assert got == brute(rows, 5)
    # a group larger than a partition's worth of places, and places that span partitions
    got = {tuple(r) for r in top_n(df, ["g"], order, ["ident"], 2500).collect()}
    assert got == brute(rows, 2500)


def test_empty_extra_columns_and_repeats(spark):
    df = spark.createDataFrame([("a", 1.0, 1, "x"), ("a", 1.0, 1, "y")], "g string, score double, ident long, place string")
    got = top_n(df, ["g"], [Desc(F.col("score")), F.col("ident")], ["ident"], 5)
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1), ("a", 2, 1)]
    assert top_n(df.limit(0), ["g"], [F.col("ident")], ["ident"], 5).collect() == []


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 0.5), ("a", 3, None), (None, 1, 2.0)], "k string, v long, x double")
    assert {tuple(r) for r in latest(df, ["k"], "v", ["x"]).collect()} == {("a", 3, None), (None, 1, 2.0)}
