"""Interval coverage against a direct computation, and its edge cases."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sozmill.operators.coverage import coverage, scored_periods


def direct(rows):
    out, by = [], {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    for k, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(k, "period", s, e) for s, e in merged]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out)


def run(spark, rows, shard=100):
    df = spark.createDataFrame([(k, s, e, "x", 1) for k, s, e in rows], "k string, s long, e long, kind string, shard int")
    return sorted(tuple(r) for r in coverage(df, ["k"], "s", "e", shard).collect())


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 700), st.integers(-5, 450)), max_size=25))
def test_matches_direct(spark, rows):
    rows = [(k, s, s + n) for k, s, n in rows]
    assert run(spark, rows) == direct(rows)


def test_hot_entity_and_long_intervals(spark):
    rng = random.Random(3)
    rows = [("hot", s := rng.randrange(100_000), s + rng.randrange(1, 40)) for _ in range(3000)] + [("hot", 20_050, 45_010), ("b", 0, 10_000_000_000)]
    assert run(spark, rows) == direct(rows)


def test_nulls_repeats_touching_and_empty(spark):
    rows = [(None, 1, 2), ("a", None, 2), ("a", 1, None), ("a", 5, 5), ("a", 9, 3), ("a", 0, 100), ("a", 100, 200), ("a", 0, 100), ("a", 0, 100), ("a", 250, 260)]
    assert run(spark, rows) == [("a", "gap", 200, 250), ("a", "period", 0, 200), ("a", "period", 250, 260)]
    assert run(spark, []) == []


def test_scores_reach_their_period(spark):
    """Scores of islands inside whole covered shards, of pieces on both sides of a boundary, and nulls."""
    rng = random.Random(5)
    rows = [("hot", s := rng.randrange(20_000), s + rng.randrange(1, 90), rng.choice([None, rng.random()])) for _ in range(400)] + [("hot", 3_010, 9_020, 0.2), ("b", 5, 7, None), ("c", 0, 5_000, None), ("c", 410, 420, 0.7)]
    df = spark.createDataFrame(rows, "k string, s long, e long, score double")
    want = []
    for k, _, a, b in (r for r in direct([r[:3] for r in rows]) if r[1] == "period"):
        want.append((k, a, b, max((r[3] for r in rows if r[0] == k and a <= r[1] < b and r[3] is not None), default=None)))
    got = [tuple(r) for r in scored_periods(df, ["k"], "s", "e", "score", 100).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
