from pyspark.sql import functions as F

from tidegrid.functions.canonical import canonical_grid_id, canonical_oid
from tidegrid.operators import heavy_keys as K


def test_canonical(spark):
    rows = [('"A-1"', " 42 "), (" a-1", "0000000042"), ("", ""), (None, None), ('""', "  "), ("b", "12345678901")]
    df = spark.createDataFrame(rows, "oid string, g string").select(canonical_oid(F.col("oid")), canonical_grid_id(F.col("g")))
    assert [tuple(r) for r in df.collect()] == [("a-1", "0000000042"), ("a-1", "0000000042"), (None, None), (None, None), (None, None), ("b", "12345678901")]


def test_heavy(spark):
    rows = [("hot", i % 3) for i in range(60)] + [("edge", 0)] * 4 + [(f"k{i}", None) for i in range(16)] + [(None, None)] * 50
    df = spark.createDataFrame(rows, "oid string, n int")  # n clashes with a result
    found = K.heavy_keys(df, {"oid": F.col("oid"), "n": F.col("n").cast("string")})
    got = {(r.key_kind, r.key_value, r.n) for r in found.collect()}
    assert got == {("oid", "hot", 60), ("oid", "edge", 4), ("n", "0", 24), ("n", "1", 20), ("n", "2", 20)}
    assert K.heavy_keys(df.limit(0), {"oid": F.col("oid")}).count() == 0


def test_eager_join(spark):
    left = spark.createDataFrame([("a", "p", 1), ("a", "p", None), ("b", "q", 5), (None, "q", 7), ("c", "q", 9)], "k string, roll string, v int")
    right = spark.createDataFrame([("a", 10), ("a", 20), ("b", None), (None, 3)], "k string, v int")
    plain = left.alias("l").join(right.alias("r"), "k").groupBy("k").agg(F.count("*").alias("n_pairs"), F.sum("l.v").alias("sl"), F.sum("r.v").alias("sr"))
    sums = {"sl": ("left", "v"), "sr": ("right", "v")}
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(K.eager_join(left, right, "k", sums)) == key(plain)
    assert key(K.eager_join(left, right, "k", sums, ["roll"])) == key(left.alias("l").join(right.alias("r"), "k").groupBy("roll").agg(F.count("*"), F.sum("l.v"), F.sum("r.v")))
    assert K.eager_join(left.limit(0), right, "k", sums).count() == 0
