import os

import pytest
from pyspark.sql import functions as F

from threadloom.operators.lookups import array_lookup
from threadloom.operators.skew import heavy_keys, salted_join
from threadloom.plans.runner import recorded_runs, run_suite
from threadloom.plans.suite import SuiteQuery
from threadloom.streaming.loader import latest_revisions, stream_first_arrivals, stream_lines


def comments(spark, n=6000):
    """A third of the comments stand below one post."""
    key = F.when(F.col("id") % 3 == 0, F.lit("t3_hot")).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.concat(F.lit("t3_"), (F.col("id") % 1500).cast("string")))
    return spark.range(n).select(F.col("id").alias("comment"), key.alias("link"))


def posts(spark):
    return spark.range(0, 1500, 2).select(F.concat(F.lit("t3_"), "id").alias("name"), F.col("id").alias("post")).union(spark.sql("SELECT 't3_hot', -1L"))


def test_heavy_keys(spark):
    assert [r.key for r in heavy_keys(comments(spark), "link", 0.05).collect()] == ["t3_hot"]
    assert heavy_keys(comments(spark).limit(0), "link").count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_is_the_join(spark, how):
    left, right = comments(spark), posts(spark)
    want = left.join(right, left["link"] == right["name"], how)
    got = salted_join(left, right, "link", "name", how, share=0.05, salts=5)
    assert got.columns == want.columns
    order = ["comment"]
    assert got.orderBy(order).collect() == want.orderBy(order).collect()


def test_hot_key_is_spread(spark):
    keys = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k) for k in keys}
    for key, value in zip(keys, ("false", "-1", "16"), strict=True):
        spark.conf.set(key, value)
    try:
        left, right = comments(spark), posts(spark)

        def largest(df):
            return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]

        assert largest(left.join(right, left["link"] == right["name"])) > 2000
        assert largest(salted_join(left, right, "link", "name", share=0.05, salts=64)) < 900
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_arrays_take_one_shuffle_of_the_right_side(spark):
    found = array_lookup(posts(spark), comments(spark).withColumn("id", F.col("comment")), "name", "link", "comment", "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = array_lookup(posts(spark), comments(spark).withColumn("id", F.col("comment")), "name", "link", "comment", "id")
        text = plan._jdf.queryExecution().executedPlan().toString()
        # The comments, the wanted keys and the posts.
        assert text.count("Exchange hashpartitioning") == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rows = {r.name: (r.matches, len(r["values"]), r.part) for r in found.collect()}
    assert rows["t3_hot"] == (2000, 2000, 0) and len(rows) == 751


def test_first_arrivals_over_batches(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def arrive(name, lines, age):
        (folder / name).write_text("".join(x + "\n" for x in lines))
        os.utime(folder / name, (1_700_000_000 + age, 1_700_000_000 + age))

    def run():
        rows = stream_lines(spark, str(folder), files_per_batch=1).select(
            F.split("value", " ")[0].alias("user"), F.split("value", " ")[1].cast("bigint").alias("at"), F.split("value", " ")[2].alias("word")
        )
        stream_first_arrivals(rows, ["user"], ["at", "word"], out, str(tmp_path / "state")).awaitTermination()
        return {r.user: (r["at"], r.word) for r in latest_revisions(spark.read.parquet(out), ["user"]).collect()}

    arrive("one", ["ann 5 five", "ann 7 seven", "bob 3 three", "bob 3 also"], 0)
    assert run() == {"ann": (5, "five"), "bob": (3, "also")}
    # A file that comes late holds an earlier row of ann, a later one of bob and a new user.
    arrive("two", ["ann -2 two", "bob 10 ten", "cid 1 one"], 50)
    arrive("three", ["ann 0 zero", "cid 100 later"], 60)
    assert run() == {"ann": (-2, "two"), "bob": (3, "also"), "cid": (1, "one")}
    sent = spark.read.parquet(out)
    assert sorted((r.user, r.revision) for r in sent.collect()) == [("ann", 0), ("ann", 1), ("bob", 0), ("cid", 0)]


def test_run_ledger_is_resumed(spark, tmp_path):
    tables = {"small": {"t": spark.range(100)}, "large": {"t": spark.range(5000)}}
    calls, broken = [], {"on": True}

    def grouped(t):
        calls.append("grouped")
        return t["t"].groupBy((F.col("id") % 7).alias("g")).count().orderBy("g")

    def sometimes(t):
        calls.append("sometimes")
        if broken["on"]:
            raise KeyboardInterrupt
        return t["t"]

    suite = {n: SuiteQuery(n, "simple", ("t",), b) for n, b in (("grouped", grouped), ("sometimes", sometimes))}
    ledger = str(tmp_path / "ledger")
    with pytest.raises(KeyboardInterrupt):
        run_suite(spark, suite, tables, loops=2, seed=3, ledger=ledger)
    assert recorded_runs(spark, ledger).count() == 1
    broken["on"] = False
    runs = run_suite(spark, suite, tables, loops=2, seed=3, ledger=ledger).collect()
    assert len(runs) == 8 and calls.count("grouped") == 4
    assert all(r.memory > 0 for r in runs if r.query == "grouped")
    assert {r.output_length for r in runs if r.query == "grouped"} == {7}
