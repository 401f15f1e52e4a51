"""Hard negatives against brute force on awkward vectors."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from bindery.llm import negatives


def brute(rows, anchors, positives=5, least=5, percent=80, scale=256):
    """rows: (id, vector, label) in any order; the result as a sorted list."""
    good = [(k, v, y) for k, v, y in rows if k is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(k, [int(np.floor(scale * x)) for x in v], y) for k, v, y in good]
    out = []
    for a, va, ya in whole:
        if not anchors(a):
            continue
        told = [(-sum(p * q for p, q in zip(va, v)), k, y) for k, v, y in whole if k != a]
        for s, p, _ in sorted(t for t in told if t[2] == ya)[:positives]:
            fit = sorted((t[0], t[1]) for t in told if t[2] != ya and percent * -s <= 100 * -t[0] <= 100 * -s)
            out += [(a, p, n, k, -s, -t) for n, (t, k) in enumerate(fit[:least], 1)]
    return sorted(out)


def found(spark, rows, kind="array<double>", **more):
    frame = spark.createDataFrame([(k, v, y, "x", 1) for k, v, y in rows], f"vec_id long, embedding {kind}, label int, anchor string, block int")
    got = negatives.mine(frame, F.col("vec_id") % 10 == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(n, dim, seed, spread=0.5):
    rng = random.Random(seed)
    middle = [[rng.uniform(-spread, spread) for _ in range(dim)] for _ in range(4)]
    return [(k, [x + rng.uniform(-0.3, 0.3) for x in middle[rng.randrange(4)]], rng.randrange(3)) for k in range(n)]


@pytest.mark.parametrize("chunk", [negatives.CHUNK_ROWS, 37])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(negatives, "CHUNK_ROWS", chunk)
    rows = vectors(300, 8, 1)
    rows += [(k, rows[5][1], k % 3) for k in range(300, 420)]  # one vector many times
    rows += [(k, None, 1) for k in (430, 431)] + [(440, [None] * 8, 1), (441, [float("nan")] * 8, 1), (442, [float("inf")] * 8, 1), (450, rows[3][1], None), (None, rows[3][1], 1)]
    rows += [(460, [0.5], 1), (461, [], 1), (470, [0.0] * 8, 2)]
    assert found(spark, rows) == brute(rows, lambda k: k % 10 == 0)
    assert found(spark, rows, positives=2, negatives=3, percent=50, scale=16) == brute(rows, lambda k: k % 10 == 0, 2, 3, 50, 16)


def test_wide_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-1, 1) * 1e5 for _ in range(4)], k % 2) for k in range(60)]
    rows += [(k, [rng.uniform(-1, 1) * 3e6, 1.0, 0.0, 2.0], k % 2) for k in range(60, 90)]
    assert found(spark, rows) == brute(rows, lambda k: k % 10 == 0)


def test_empty_tables_single_labels_and_repeated_ids(spark):
    assert found(spark, []) == []
    one = [(k, [1.0, 2.0], 7) for k in range(12)]
    assert found(spark, one) == [] == brute(one, lambda k: k % 10 == 0)
    twice = vectors(40, 4, 9) + [(k, v, y) for k, v, y in vectors(40, 4, 9) if k < 15]
    # Both rows of an id are anchors, and neither meets the other.
    assert found(spark, twice) == brute(twice, lambda k: k % 10 == 0)


def test_planes_drop_rows_before_the_last_one():
    values = np.array([[k, 100 - k] for k in range(1000)], dtype=np.int64)
    planes = negatives.Planes(values)
    seen = []

    def drop(low, high, alive, anchors):
        kept = negatives.best_of_label(3, np.array([-np.inf]))(low, high, alive, anchors)
        seen.append(int(kept.sum()))
        return kept

    ((rows, score),) = planes.survivors(np.array([[3, 1]]), np.ones((1000, 1), bool), drop)
    assert set(rows) >= {997, 998, 999} and seen[-1] == len(rows) < seen[0] and seen == sorted(seen, reverse=True)
    assert list(score) == [3 * k + 100 - k for k in rows]
