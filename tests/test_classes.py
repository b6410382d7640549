import random

import pytest
from pyspark.sql import functions as F

from callscape.functions.vectors import euclidean
from callscape.operators import classify as C
from callscape.operators import cluster as K
from callscape.operators.aggregates import ordered_mode
from callscape.plans.sociometer import run_sociometer

from helpers import calls, plan, random_calls, rows, sites

PROFILES = "window_year int, window_week int, region string, user_id string, profile array<double>"
CENTERS = "window_year int, window_week int, centroid_id int, label string, center array<double>"


def profiles(spark, *vectors, week=1):
    data = [(2024, week, "r", f"u{i}", list(v)) for i, v in enumerate(vectors)]
    return spark.createDataFrame(data, PROFILES)


def test_archetypes(spark):
    got = K.archetypes(spark).orderBy("ordinal").collect()
    assert [r["label"] for r in got] == (
        ["resident"] * 3 + ["dynamic_resident"] * 3 + ["commuter"] * 3 + ["visitor"] * 3
        + ["resident"] * 2 + ["visitor"] * 2
    )
    assert all(len(r["center"]) == 24 for r in got)
    assert got[6]["center"] == [1.0, 1.0, 1.0, 0.0, 0.0, 0.0] * 4
    assert got[12]["center"] == [1.0] * 6 + [0.5] * 6 + [0.1] * 6 + [0.0] * 6


def test_distance_uses_the_prefix(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 3.0, 9.0])], "a array<double>, b array<double>")
    assert df.select(euclidean(F.col("a"), F.col("b"))).first()[0] == 4.0


def test_label_ties_go_to_the_first_archetype(spark):
    typical = spark.createDataFrame(
        [(0, "resident", [1.0, 0.0]), (1, "commuter", [0.0, 1.0])],
        "ordinal int, label string, center array<double>",
    )
    centroids = spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.4, 0.6]), (2, [0.9])], "id int, center array<double>")
    got = {r["id"]: r["label"] for r in K.label_centroids(centroids, typical).collect()}
    assert got == {0: "resident", 1: "commuter", 2: "resident"}


@pytest.mark.parametrize("max_centroids", [1000, 0])
def test_classification(spark, max_centroids):
    centers = spark.createDataFrame(
        [(2024, 1, 0, "resident", [1.0, 1.0]), (2024, 1, 1, "visitor", [0.0, 0.0]),
         (2024, 1, 2, "commuter", [1.0, 0.0]), (2024, 2, 0, "commuter", [0.0, 0.0])], CENTERS,
    )
    vectors = [(0.4, 0.0), (0.5, 0.0), (0.2, 0.2), (0.9, 0.8), (0.0, 0.0), (0.9, 0.0)]
    df = profiles(spark, *vectors).union(profiles(spark, (0.9, 0.9), week=2)).union(
        profiles(spark, (0.9, 0.9), week=3))
    got = rows(C.classify(df, centers, max_centroids).select("window_week", "user_id", "user_class"))
    # one weak slot passes by whatever is near; (0.5, 0) ties between centres 1 and 2
    assert got == sorted([(1, "u0", "passing by"), (1, "u1", "visitor"), (1, "u2", "visitor"),
                          (1, "u3", "resident"), (1, "u4", "visitor"), (1, "u5", "commuter"),
                          (2, "u0", "commuter")], key=repr)


def test_both_ways_of_classifying_agree(spark):
    import random

    rng = random.Random(3)
    vectors = [[rng.randrange(6) / 5 for _ in range(24)] for _ in range(300)]
    centers = [(2024, 1, i, f"label {i % 5}", [rng.randrange(6) / 5 for _ in range(24)]) for i in range(40)]
    df, centroids = profiles(spark, *vectors), spark.createDataFrame(centers, CENTERS)
    assert rows(C.classify(df, centroids)) == rows(C.classify(df, centroids, max_centroids=0))


def test_sociometer_and_annotation(spark):
    schema = "window_year int, window_week int, region string, user_id string, user_class string"
    data = [(2024, 5, "a", "u", "visitor"), (2024, 1, "a", "u", "resident"), (2023, 50, "a", "v", "commuter"),
            (2024, 1, "a", "v", "visitor"), (2024, 5, "a", "v", "visitor"), (2024, 1, "b", "v", "resident")]
    df = spark.createDataFrame(data, schema)
    assert rows(C.annotate_global(df)) == [("u", "a", "resident"), ("v", "a", "visitor"), ("v", "b", "resident")]
    shares = C.sociometer(df).collect()
    assert [tuple(r)[:4] for r in shares] == sorted(tuple(r)[:4] for r in shares)
    assert {tuple(r)[:4]: r["share"] for r in shares}[2024, 1, "a", "visitor"] == 0.5
    totals = C.sociometer(df).groupBy("window_year", "window_week", "region").agg(F.sum("share").alias("s"))
    assert all(abs(r["s"] - 1) < 1e-12 for r in totals.collect())


def test_annotation_takes_one_exchange(spark):
    from helpers import plan

    schema = "window_year int, window_week int, region string, user_id string, user_class string"
    df = spark.createDataFrame([(2024, 1, "a", "u", "x")], schema)
    assert plan(C.annotate_global(df)).count("Exchange hashpartitioning") == 1


def test_clusters_of_each_window(spark):
    groups = [[(0.0, 0.1)] * 30, [(1.0, 0.9)] * 20, [(0.5, 0.0)] * 10]
    df = profiles(spark, *[v for g in groups for v in g]).union(profiles(spark, (0.2, 0.2), (0.2, 0.2), week=5))
    got = K.fit_clusters(df, k=3, restarts=3).collect()
    by_week = {w: sorted(tuple(r["center"]) for r in got if r["window_week"] == w) for w in (1, 5)}
    assert by_week[1] == [(0.0, 0.1), (0.5, 0.0), (1.0, 0.9)]
    assert by_week[5] == [(0.2, 0.2)]


def test_merged_vectors_keep_their_weight(spark):
    df = profiles(spark, *([(0.0, 0.0)] * 99 + [(1.0, 1.0)] + [(9.0, 9.0)] * 50))
    centers = sorted(tuple(r["center"]) for r in K.fit_clusters(df, k=2, restarts=5).collect())
    assert centers == [pytest.approx((0.01, 0.01)), pytest.approx((9.0, 9.0))]


def test_best_restart_is_kept(spark):
    import random

    rng = random.Random(5)
    vectors = [[rng.random(), rng.random()] for _ in range(120)]
    df = profiles(spark, *vectors)

    def cost(centroids):
        centers = [r["center"] for r in centroids.collect()]
        return sum(min(sum((a - b) ** 2 for a, b in zip(v, c)) for c in centers) for v in vectors)

    best = cost(K.fit_clusters(df, k=6, restarts=4, seed=10))
    singles = [cost(K.fit_clusters(df, k=6, restarts=1, seed=10 + i)) for i in range(4)]
    assert best == pytest.approx(min(singles))


def test_sampled_training(spark):
    df = profiles(spark, *[(i % 7 / 7, i % 5 / 5) for i in range(200)])
    assert 1 <= K.fit_clusters(df, k=4, restarts=1, sample_fraction=0.4).count() <= 4


def test_whole_chain(spark):
    result = run_sociometer(
        calls(spark, random_calls(900)), sites(spark), "2014-12-22", "2015-01-29", key="prefix", k=5, restarts=2
    )
    assert result.classified.count() == result.profiles.count()
    allowed = {"resident", "dynamic_resident", "commuter", "visitor", "passing by"}
    assert {r["user_class"] for r in result.shares.collect()} <= allowed
    assert result.annotations.count() == result.profiles.select("user_id", "region").distinct().count()


def test_fewer_vectors_than_clusters(spark):
    df = profiles(spark, (0.1, 0.0), (0.1, 0.0), (0.3, 0.2))
    centers = [r["center"] for r in K.fit_clusters(df, k=10).orderBy("centroid_id").collect()]
    assert centers == [[0.1, 0.0], [0.3, 0.2]]


def test_many_centres_give_equal_labels_in_one_and_in_several_parts(spark):
    rng = random.Random(8)
    centers = [(2024, 1, i, f"c{i}", [rng.random() for _ in range(6)]) for i in range(20_000)]
    schema = "window_year int, window_week int, centroid_id int, label string, center array<double>"
    centroids = spark.createDataFrame(centers, schema)
    people = [(2024, 1, "r", f"u{i}", [rng.random() for _ in range(6)]) for i in range(300)]
    profiles = spark.createDataFrame(
        people, "window_year int, window_week int, region string, user_id string, profile array<double>")
    whole = rows(C.classify(profiles, centroids))
    assert whole == rows(C.classify(profiles, centroids, max_centroids=7000))
    for _, _, _, user, label in whole[:20]:
        v = next(p[4] for p in people if p[3] == user)
        best = min(centers, key=lambda c: (round(sum((a - b) ** 2 for a, b in zip(v, c[4])), 9), c[2]))
        assert label == best[3]


def test_mode_counts_inside_tasks(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id % 5 AS v", "id AS o").repartition(3)
    text = plan(ordered_mode(df, ["k"], "v", F.col("o")))
    assert "partial_count" in text


def test_archetype_files_are_read_in_order(spark, tmp_path):
    folder = tmp_path / "typical"
    folder.mkdir()
    (folder / "a.csv").write_text("1;first;0.1;0.2\n")
    (folder / "b.csv").write_text("".join(f"1;later{i};0.3;0.4\n" for i in range(500)))
    found = K.read_archetypes(spark, str(folder)).orderBy("ordinal").collect()
    assert [r["label"] for r in found] == ["first", *[f"later{i}" for i in range(500)]]


def test_jobs_do_not_grow_with_windows_and_restarts(spark):
    schema = "window_year int, window_week int, region string, user_id string, profile array<double>"
    make = lambda windows: spark.createDataFrame(
        [(2024, w, "r", str(i), [float(i * i % 13), float(i % 7)]) for w in range(windows) for i in range(60)], schema)
    jobs = []
    for windows, restarts in ((1, 1), (6, 4)):
        group = f"kmeans-{windows}"
        spark.sparkContext.setJobGroup(group, "")
        found = K.fit_clusters(make(windows), k=4, max_iter=3, restarts=restarts)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        spark.sparkContext.setJobGroup("", "")
        assert found.groupBy("window_week").count().filter("count = 4").count() == windows
    assert jobs[0] == jobs[1]


def test_short_windows_train_beside_long_ones(spark):
    schema = "window_year int, window_week int, region string, user_id string, profile array<double>"
    data = [(2024, 1, "r", str(i), [float(i % 2) * 9] * 12) for i in range(20)]
    data += [(2024, 9, "r", str(i), [float(i % 3)] * 6) for i in range(30)]
    got = K.fit_clusters(spark.createDataFrame(data, schema), k=3, restarts=3)
    assert sorted((r["window_week"], tuple(r["center"])) for r in got.collect()) == [
        (1, (0.0,) * 12), (1, (9.0,) * 12), (9, (0.0,) * 6), (9, (1.0,) * 6), (9, (2.0,) * 6)]
