"""Ordinals by hashes and texts, over groups that no task may hold."""

from pyspark.sql import functions as F

from pagequarry.operators.ordinals import with_ordinal


def test_order_by_text_with_null_keys_and_ties(spark):
    rows = [(k, f"{(i * 7919) % 101:03d}x", i) for i, k in enumerate(["a", None, "b"] * 40)]
    df = spark.createDataFrame(rows, "k string, name string, id long")
    got = with_ordinal(df, ["k"], "name", "n", ranges=7)
    assert got.columns == ["k", "name", "id", "n"]
    want = {}
    for k in ("a", None, "b"):
        for n, (_, i) in enumerate(sorted((name, i) for kk, name, i in rows if kk == k), 1):
            want[i] = n
    assert {r["id"]: r["n"] for r in got.collect()} == want
    ties = with_ordinal(df.withColumn("name", F.lit("same")), ["k"], "name", "n", ranges=7).groupBy("k").agg(F.sort_array(F.collect_list("n")).alias("n"))
    assert all(r["n"] == list(range(1, 41)) for r in ties.collect())


def test_hot_key_of_a_million_rows_by_hash(spark):
    df = spark.range(1_000_000).select(F.lit("hot").alias("k"), F.xxhash64("id").alias("h"))
    placed = with_ordinal(df, ["k"], "h", "n", ranges=32)
    # the only windows are inside a range, and no range holds much of the key
    assert "PARTITION BY _ordinals_range, k" in placed._jdf.queryExecution().toString() or "windowspecdefinition(_ordinals_range" in placed._jdf.queryExecution().toString()
    ranges = df.repartitionByRange(32, "k", "h").groupBy(F.spark_partition_id()).count()
    assert ranges.agg(F.max("count")).first()[0] < 100_000
    check = placed.agg(F.count_distinct("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    assert tuple(check) == (1_000_000, 1, 1_000_000)
    late = placed.where("n > 999000").agg(F.min("h")).first()[0]
    assert placed.where(F.col("h") > late).count() == 999
