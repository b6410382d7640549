import contextlib
import re

import pytest
from pyspark.sql import functions as F

from callscape import scale
from callscape.operators import presence as B
from callscape.operators.aggregates import share_of_total
from callscape.operators.spatial import attach_region

from helpers import calls, plan, random_calls, rows, sites


@contextlib.contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_measuring(spark):
    df = spark.range(100).select(F.col("id"), F.lit("x" * 50).alias("text"))
    assert scale.fits_broadcast(df)
    assert not scale.fits_broadcast(df, max_rows=99)
    assert not scale.fits_broadcast(df, max_bytes=1000)
    assert scale.fits_broadcast(df.limit(0))


def test_large_dimension_is_joined_by_salted_shuffle(spark):
    df = calls(spark, random_calls(900))
    small = attach_region(df, sites(spark), "prefix")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        large = attach_region(df, sites(spark), "prefix", max_broadcast_rows=3)
        assert "_salt" in plan(large) and "BroadcastHashJoin" not in plan(large)
        assert rows(large) == rows(small)
    assert "BroadcastHashJoin" in plan(small) and "Exchange hash" not in plan(small)


def test_salt_spreads_one_cell_and_exact_copies(spark):
    one = spark.range(0, 4000, 1, 40).select(F.lit("u").alias("user_id"), F.lit("c").alias("cell_id"))
    dimension = spark.createDataFrame([("c", "r")], "cell_id string, region string")
    joined = scale.lookup_join(one, dimension, "cell_id", max_rows=0)
    assert joined.count() == 4000
    spread = one.select(
        F.pmod(F.xxhash64(*one.columns) + F.spark_partition_id(), F.lit(scale.JOIN_SALTS)).alias("s")
    ).groupBy("s").count().collect()
    assert len(spread) == scale.JOIN_SALTS and max(r["count"] for r in spread) <= 200


def test_left_lookup_keeps_unmatched_rows(spark):
    facts = spark.createDataFrame([("a", 1), ("b", 2)], "cell_id string, n int")
    dimension = spark.createDataFrame([("a", "r")], "cell_id string, region string")
    for bound in (10, 0):
        got = scale.lookup_join(facts, dimension, "cell_id", "left", max_rows=bound)
        assert rows(got) == [("a", 1, "r"), ("b", 2, None)]


def test_prefilter_keeps_matches_and_drops_most_others(spark):
    facts = spark.range(40000).select(F.col("id").cast("string").alias("cell_id"), "id")
    facts = facts.unionByName(spark.createDataFrame([(None, 1)], "cell_id string, id long"))
    dimension = facts.filter("id % 4 = 0").select("cell_id", F.lit("r").alias("region"))
    kept = scale.matching_facts(facts, dimension, ["cell_id"], 10000)
    assert kept.filter("id % 4 = 0").count() == 10000
    assert kept.filter("id % 4 != 0").count() < 30000 * 0.2
    assert scale.matching_facts(facts, dimension.limit(0), ["cell_id"], 0).count() == 0
    plain = scale.lookup_join(facts, dimension, "cell_id", max_rows=0)
    fewer = scale.lookup_join(facts, dimension, "cell_id", max_rows=0, prefilter=True)
    assert fewer.columns == plain.columns and rows(fewer) == rows(plain) and fewer.count() == 10000


@pytest.mark.parametrize("job", ["presence", "od"])
def test_user_with_a_third_of_all_rows_is_split(spark, job):
    """The label join splits a user who holds most of the rows left after de-duplication."""
    moments = spark.range(60000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("user_id"),
        F.lit("00001_x").alias("start_cell"),
        F.timestamp_add("SECOND", F.col("id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("date"),
    )
    labels = spark.range(2000).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("user_id"),
        F.lit("1").alias("region"), F.lit("resident").alias("user_class"),
    )
    run = {"presence": B.presence, "od": B.od_matrix}[job]
    with settings(
        spark,
        spark__sql__shuffle__partitions="16",
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="32k",
        spark__sql__adaptive__coalescePartitions__minPartitionSize="1k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="64k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    ):
        found = run(moments, sites(spark), labels)
        total = sum(r["n_users"] for r in found.collect())
        assert "skew=true" in plan(found)
    assert total == 60000


def test_shared_folder_comes_from_the_session(spark):
    assert scale.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scale.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_cut_lineage_reads_stored_rows(spark):
    stored = scale.cut_lineage(spark.range(5).withColumn("x", F.rand()))
    assert "FileScan parquet" in plan(stored) and "Range" not in plan(stored)
    assert rows(stored) == rows(stored)


def test_numbering_an_empty_frame(spark):
    assert scale.with_row_number(spark.range(0), ["id"], "n").count() == 0


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5)], "g string, n bigint")
    assert rows(share_of_total(df, "n", ["g"])) == [("a", 1, 0.25), ("a", 3, 0.75), ("b", 5, 1.0)]


def test_measuring_sends_one_row_per_task(spark):
    df = spark.range(1000).repartition(7)
    assert scale.measure(df)[0] == 1000
    measured = df.agg(F.count("*"), F.sum("id"))
    text = plan(measured)
    assert "partial_count" in text and "GlobalLimit" not in text
    import inspect

    assert ".limit(" not in inspect.getsource(scale.measure)


def test_registered_shuffled_lookup_moves_the_facts(spark):
    from checks.queries import QUERIES

    text = plan(QUERIES["region_prefix_shuffled"](spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
    assert "hashpartitioning" in text


@pytest.mark.parametrize("name", ["kmeans_sampled", "kmeans"])
def test_profiles_do_not_move_to_their_window(spark, name):
    from checks.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        found = QUERIES[name](spark, sf)
        assert "SortMergeJoin" not in plan(found)
        by_window = r"hashpartitioning\(window_year#\d+, window_week#\d+, \d+\)"
        assert not re.search(by_window, plan(found))
        whole = rows(found.select("window_week", "n_profiles"))
    expected = QUERIES["user_profile_vector"](spark, sf).groupBy("window_week").count()
    assert whole == rows(expected)


def test_salts_follow_the_shuffle_partitions(spark):
    assert scale.salts_for(spark, 10) == scale.JOIN_SALTS
    assert scale.salts_for(spark, 10**9) == scale.JOIN_SALTS
