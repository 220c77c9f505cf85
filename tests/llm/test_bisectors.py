"""Clusters against plain arithmetic on Python integers."""

import hashlib
import math

import numpy as np
import pytest

from gristmill.llm import bisectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def scaled(x):
    return math.floor(64 * x) if abs(x) < 2**53 else 64 * int(x)


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def plain_report(rows, k=16, dims=64, rounds=3):
    kept = [
        (i, [scaled(float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=order)[:k]]

    def nearest(v):
        return min((squared(v, c), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        placed = [(nearest(v)[1], v) for _, v in kept]
        for j in range(len(centroids)):
            own = [v for at, v in placed if at == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    whole, sums = sum(d for _, _, d in found), {}
    for _, c, d in found:
        sums[c] = sums.get(c, 0) + d
    long = lambda n: n if n < 1 << 63 else None
    return [
        (i, c, long(d), long(sums[c]), long(whole), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found
    ]


def compare(spark, rows):
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    found = [tuple(r) for r in bisectors.cluster_report(vectors).collect()]
    wanted = plain_report([(r.vec_id, r.embedding) for r in vectors.collect()])
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    return found


def test_ties_repeats_and_rows_left_out(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 64) / 64).tolist()) for i in range(120)]
    rows += rows[:5] + [(500 + i, rows[0][1]) for i in range(30)] + [(None, rows[7][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [1.0] * 63 + [float("nan")])]
    rows += [(905, [float("inf")] + [0.0] * 63), (906, [0.0] * 65)]
    assert len(compare(spark, rows)) == 156


@pytest.mark.parametrize("large", [2.0**19, 2.0**21, 2.0**27, 2.0**40, 3e38])
def test_large_components(spark, large):
    rng = np.random.default_rng(4)
    compare(spark, [(i, (rng.normal(size=64) * (large if i % 7 == 0 else 1)).clip(-3e38, 3e38).tolist()) for i in range(60)])


def test_few_or_no_vectors(spark):
    assert len(compare(spark, [(1, [0.5] * 64), (2, [0.25] * 64)])) == 2
    assert compare(spark, []) == []


def test_a_tournament_finds_the_first_of_the_nearest():
    rng = np.random.default_rng(5)
    centroids = rng.integers(-2, 3, (16, 6)).tolist()
    vectors = rng.integers(-2, 3, (4000, 6))
    winner, distance = bisectors.Tournament(centroids).nearest(vectors)
    for v, w, d in zip(vectors.tolist(), winner.tolist(), distance.tolist(), strict=True):
        assert (d, w) == min((squared(v, c), j) for j, c in enumerate(centroids))
