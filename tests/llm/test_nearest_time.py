import random

from tidemark.llm.nearest_time import nearest

SCHEMA = "entity string, t bigint, id bigint"


def brute(left, right, tolerance):
    out = set()
    for e, t, i in left:
        near = sorted((abs(t - u), u, k) for f, u, k in right if f == e and e is not None and t is not None and u is not None)
        if near and near[0][0] <= tolerance:
            out.add((i, near[0][2], near[0][0]))
    return out


def test_equals_brute_force_over_many_partitions(spark):
    rnd = random.Random(3)
    name = lambda: rnd.choice(["hot"] * 6 + ["a", "b", "c", None])
    left = [(name(), rnd.choice([None, *range(0, 4000, 7)]), i) for i in range(700)]
    right = [(name(), rnd.choice([None, *range(0, 4000, 50)]), 10_000 + i) for i in range(150)]
    for partitions in (1, 3, 17, 60):
        got = {tuple(r) for r in nearest(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), 40, partitions).collect()}
        assert got == brute(left, right, 40)


def test_ties_go_to_the_earlier_then_the_smaller_id(spark):
    left, right = [("a", 10, 1)], [("a", 5, 9), ("a", 5, 8), ("a", 15, 1)]
    assert [tuple(r) for r in nearest(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), 5, 4).collect()] == [(1, 8, 5)]


def test_one_entity_with_far_apart_records(spark):
    left, right = [("a", 1000 * k, k) for k in range(200)], [("a", 0, 1), ("a", 199_000, 2)]
    got = {tuple(r) for r in nearest(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), 10**9, 40).collect()}
    assert got == brute(left, right, 10**9)


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([("a", 1, 1), ("a", 1, 1)], SCHEMA)
    assert nearest(none, one, 5, 3).count() == 0 and nearest(one, none, 5, 3).count() == 0
    assert nearest(one, one, 0, 3).count() == 2
