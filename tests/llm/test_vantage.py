import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from trafficlens.llm import vantage


def brute(rows, k=16, rounds=3):
    """The contract, with Python integers and every distance computed."""
    good = [(i, [math.floor(Fraction(x) * 64) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centres = [list(v) for _, v in starts]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        owner = [nearest(v)[1] for _, v in good]
        for n in range(len(centres)):
            own = [v for (_, v), o in zip(good, owner) if o == n]
            if own:
                centres[n] = [sum(c) // len(own) for c in zip(*own)]
    last = [nearest(v) for _, v in good]
    limit = (1 << 63) - 1
    out = []
    for (i, _), (d, n) in zip(good, last):
        inertia = sum(x for x, o in last if o == n)
        whole = sum(x for x, _ in last)
        lost, any_lost = any(x > limit for x, o in last if o == n), any(x > limit for x, _ in last)
        out.append((i, n, d if d <= limit else None, None if lost or inertia > limit else inertia, None if any_lost or whole > limit else whole,
                    hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(3)
    return sorted((tuple(r) for r in vantage.digest(*vantage.clustered(table, **options)).collect()), key=repr)


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vantage, "STEP", 50)
    draw = np.random.default_rng(4)
    rows = [(k, (draw.normal(size=64) + 3 * (k % 5)).tolist()) for k in range(300)]
    # a coarse grid makes ties, and repeated vectors make equal centroids
    rows += [(k, (draw.integers(0, 2, size=64) / 64).tolist()) for k in range(300, 500)] + [(k, [1.0] * 64) for k in range(500, 540)] + [rows[0], rows[0], (None, [0.5] * 64)]
    rows += [(600, None), (601, []), (602, [1.0] * 63), (603, [1.0] * 65), (604, [None] + [1.0] * 63), (605, [float("nan")] + [1.0] * 63), (606, [float("-inf")] * 64)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("huge", [2.0**30, 1e300])
def test_large_components(spark, huge):
    draw = np.random.default_rng(5)
    rows = [(k, draw.normal(size=64).tolist()) for k in range(60)] + [(70 + k, [huge * (k + 1) / 7] * 32 + [-huge] * 32) for k in range(5)] + [(80, [1e17] * 64)]
    assert run(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
    rows = [(k, [float(k)] * 64) for k in range(3)]
    assert run(spark, rows) == brute(rows)
    rows = [(k, [1.0] * 64) for k in range(40)]
    out = run(spark, rows)
    assert out == brute(rows) and {r[1] for r in out} == {0}


def test_tree_prunes_and_finds_all_ties():
    draw = np.random.default_rng(6)
    centres = draw.integers(-3, 4, size=(400, 64)).tolist() + [[0] * 64, [0] * 64]
    tree = vantage.Tree(centres)
    vectors = draw.integers(-2, 3, size=(500, 64)).astype(float)
    squares = ((vectors[:, None, :] - np.array(centres, float)[None]) ** 2).sum(axis=2)
    number, best = tree.nearest(vectors)
    assert np.array_equal(number, squares.argmin(axis=1)) and np.array_equal(best, squares.min(axis=1))
    spread = (draw.integers(0, 8, size=(400, 1)) * 1000 + draw.integers(0, 9, size=(400, 64))).tolist()
    tree = vantage.Tree(spread)
    near = np.array(spread, float)[:100] + 1
    seen = []
    squares_of = vantage._squares
    try:
        vantage._squares = lambda v, c: seen.append(len(v) * len(c)) or squares_of(v, c)
        tree.nearest(near)
    finally:
        vantage._squares = squares_of
    assert sum(seen) < 0.5 * 100 * 400
