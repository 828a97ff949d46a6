import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from firmnet.operators import rank

ORDER = [("s", False), ("a", True), ("b", True)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "s double, a int, b int")


def rows_with_hot_score(n, seed=1):
    r = random.Random(seed)
    return [(0.5 if i % 3 == 0 else round(r.uniform(-1, 1), 3), r.randrange(50), i) for i in range(n)]


def best(rows, k):
    return sorted(rows, key=lambda t: (-t[0], t[1], t[2]))[:k]


def test_distributed_rank_equals_a_plain_sort(spark):
    rows = rows_with_hot_score(5000)
    got = rank.distributed_rank(frame(spark, rows).repartition(7), ORDER).orderBy("rank").collect()
    assert [tuple(r)[:3] for r in got] == best(rows, len(rows))
    assert [r["rank"] for r in got] == list(range(1, len(rows) + 1))


def test_rank_within_hot_groups(spark):
    rows = [(s, a if i % 3 else 7, b) for i, (s, a, b) in enumerate(rows_with_hot_score(3000))]
    got = rank.distributed_rank(frame(spark, rows), [("s", False), ("b", True)], "rank", ["a"]).collect()
    for group in {r[1] for r in rows}:
        want = sorted((r for r in rows if r[1] == group), key=lambda t: (-t[0], t[2]))
        assert [tuple(r)[:3] for r in sorted((r for r in got if r["a"] == group), key=lambda r: r["rank"])] == want


@pytest.mark.parametrize("k", [0, 1, 1666, 1667, 1700, 2500, 4999, 5000, 6000])
def test_top_rows(spark, k):
    rows = rows_with_hot_score(5000)
    got = rank.top_rows(frame(spark, rows), k, "s", ["a", "b"], bins=16).collect()
    assert sorted(tuple(r) for r in got) == sorted(best(rows, k))


def test_top_rows_ascending_and_all_equal(spark):
    rows = [(2.0, i % 5, i) for i in range(100)]
    assert {r["b"] for r in rank.top_rows(frame(spark, rows), 20, "s", ["a", "b"]).collect()} == set(range(0, 100, 5))
    rows = rows_with_hot_score(500)
    got = rank.top_rows(frame(spark, rows), 50, "s", ["a", "b"], descending=False).collect()
    assert sorted(tuple(r) for r in got) == sorted(rows, key=lambda t: (t[0], t[1], t[2]))[:0] + sorted(
        sorted(rows, key=lambda t: (t[0], t[1], t[2]))[:50])


def test_scores_outside_the_bounds_still_count(spark):
    rows = [(1.0000001, 1, 1), (1.0, 1, 2), (0.3, 1, 3), (-1.0, 1, 4)]
    got = rank.top_rows(frame(spark, rows), 1, "s", ["a", "b"], bounds=(-1.0, 1.0)).collect()
    assert [r["b"] for r in got] == [1]


def test_infinite_scores_are_refused(spark):
    with pytest.raises(ValueError):
        rank.top_rows(frame(spark, [(float("inf"), 1, 1), (0.1, 1, 2)]), 1, "s", ["a", "b"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(scores=st.lists(st.sampled_from([0.1, 0.2, 0.25, 0.9]), min_size=1, max_size=40), k=st.integers(0, 45))
def test_top_rows_property(spark, scores, k):
    rows = [(s, i % 4, i) for i, s in enumerate(scores)]
    got = rank.top_rows(frame(spark, rows), k, "s", ["a", "b"], bins=3).collect()
    assert sorted(tuple(r) for r in got) == sorted(best(rows, k))


def test_top_fraction_cuts_by_the_number_of_firms(spark):
    peers = spark.createDataFrame([(f, r, round(1 - (f * 7 + r) / 100, 2)) for f in range(8) for r in range(8) if f != r],
                                  "focal_firmid bigint, rival_firmid bigint, wtnic_score double")
    assert rank.fraction_count(13, 0.02) == 3  # 3.12 pairs
    kept = rank.top_fraction(peers, 13, 0.02).collect()
    assert {(r[0], r[1]) for r in kept} == {(0, 1), (0, 2), (0, 3)}


def test_sorted_peers(spark):
    df = spark.createDataFrame([(1, 2, 0.1), (2, 1, 0.9), (1, 3, 0.9)], "focal_firmid int, rival_firmid int, wtnic_score double")
    assert [tuple(r)[:2] for r in rank.sorted_peers(df).collect()] == [(1, 3), (2, 1), (1, 2)]


def test_hash_sample(spark):
    df = spark.range(1000).select((F.col("id") % 400).cast("string").alias("company"))
    once = {r[0] for r in rank.hash_sample(df, "company", 100, "a").collect()}
    again = {r[0] for r in rank.hash_sample(df.repartition(5), "company", 100, "a").collect()}
    other = {r[0] for r in rank.hash_sample(df, "company", 100, "b").collect()}
    assert len(once) == 100 and once == again and once != other
    assert rank.hash_sample(df, "company", 10_000).count() == 400


def test_assign_ids(spark):
    dim = spark.createDataFrame([("a", 5), ("b", 9)], "company string, firm_id bigint")
    new = spark.createDataFrame([("c", 3), ("c", 1), ("d", 2), ("a", 0)], "company string, master_id bigint")
    got = rank.assign_ids(dim, new, "company", "master_id").orderBy("firm_id").collect()
    assert [tuple(r) for r in got] == [("c", 1, 10), ("d", 2, 11)]


@pytest.mark.parametrize("bounds", [None, (-1.0, 1.0)])
@pytest.mark.parametrize("descending", [True, False])
def test_missing_scores_come_last(spark, bounds, descending):
    rows = [(None, 1, 1), (float("nan"), 0, 2), (0.82, 3, 3), (0.74, 4, 4), (-0.5, 5, 5)]
    for k in range(1, 5):
        got = {r["b"] for r in rank.top_rows(frame(spark, rows), k, "s", ["a", "b"], descending, bounds).collect()}
        order = [3, 4, 5, 2, 1] if descending else [5, 4, 3, 2, 1]
        assert got == set(order[:k])


@pytest.mark.parametrize("group", [(), ("g",)])
def test_running_sum_over_ranges_equals_a_plain_one(spark, group):
    rows = [(None if i % 5 == 4 else i % 3, i * 7 % 101, None if i % 9 == 0 else i % 13) for i in range(101)]
    df = spark.createDataFrame(rows, "g int, at int, v int").repartition(7)
    got = {(r["g"], r["at"]): r["before"] for r in rank.running_sum(df, [("at", False)], "v", "before", list(group)).collect()}
    want, sums = {}, {}
    for g, at, v in sorted(rows, key=lambda r: -r[1]):
        key = g if group else 0
        want[g, at] = sums.get(key, 0)
        sums[key] = want[g, at] + (v or 0)
    assert got == want
