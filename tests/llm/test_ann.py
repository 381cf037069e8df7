import math

import numpy as np

from trafficlens.llm import ann
from pyspark.sql import functions as F


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string")


def brute(rows, k=20, every=20):
    good = {}
    for vec_id, v, *_ in rows:
        if vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            good[vec_id] = min(good.get(vec_id, v), v)
    out = {}
    for q in good:
        if q % every == 0:
            scored = sorted((-float(np.dot(good[q], good[x])), x) for x in good if x != q)
            out[q] = [(x, -s) for s, x in scored[:k]]
    return out


def test_small_tables_are_exact(spark):
    draw = np.random.default_rng(1)
    rows = [(k, draw.normal(size=8).astype(float).tolist(), 0, "x") for k in range(80)]
    rows += [(100, None, 0, ""), (120, [0.0] * 8, 0, ""), (140, [float("nan")] + [1.0] * 7, 0, ""), (160, [None] + [1.0] * 7, 0, ""), (180, [float("inf")] * 8, 0, ""),
             (None, [1.0] * 8, 0, ""), (200, rows[3][1], 0, ""), (201, rows[3][1], 0, ""), (202, rows[3][1], 0, ""), (200, rows[3][1], 0, "")]
    out = {}
    for r in ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, target=1.0).collect():
        out.setdefault(r.query_id, {})[r.rank] = r.vec_id, r.score
    expected = brute(rows)
    assert out.keys() == expected.keys()
    for q, best in expected.items():
        assert [out[q][k + 1][0] for k in range(len(best))] == [x for x, _ in best]
        assert np.allclose([out[q][k + 1][1] for k in range(len(best))], [s for _, s in best], rtol=1e-12)
    assert ann.nearest(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(table(spark, rows[:1]), F.col("vec_id") % 20 == 0).count() == 0


def test_blocks_and_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rows = [(k, [1.0, 0.0], 0, "") for k in range(100)] + [(k, [0.0, float(k)], 0, "") for k in range(100, 140)]
    out = {}
    for r in ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=5).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert [v for _, v in sorted(out[0])] == [1, 2, 3, 4, 5] and [v for _, v in sorted(out[100])] == [139, 138, 137, 136, 135]


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    truth = brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    found = {}
    for r in ann.nearest(vectors, F.col("vec_id") % 20 == 0, sample=1000).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(found[q] & {x for x, _ in best}) for q, best in truth.items())
    assert hits >= 0.9 * sum(map(len, truth.values()))


def test_walks_go_on_until_answers_are_whole(spark, monkeypatch):
    """Big clusters that few visits suffice for, beside far ones of fewer vectors than an answer: with the least visits all answers are whole."""
    monkeypatch.setattr(ann, "calibrated_visits", lambda *_: 1)
    draw = np.random.default_rng(3)
    rows = [(k, (draw.normal(size=6) * 0.01 + np.eye(6)[k % 2] * 5).tolist(), 0, "") for k in range(600)]
    rows += [(600 + k, (draw.normal(size=6) * 0.01 - np.eye(6)[2 + k // 4] * 9).tolist(), 0, "") for k in range(16)]
    found = {}
    for r in ann.nearest(table(spark, rows), F.col("vec_id") % 4 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert len(found) == 154
    for q, best in found.items():
        assert [n for n, _ in sorted(best)] == list(range(1, 21)) and q not in {x for _, x in best} and len({x for _, x in best}) == 20


def test_small_tables_with_production_target(spark):
    rows = [(k, [1.0, float(k)], 0, "") for k in range(21)]
    assert ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0).count() == 40
    assert ann.nearest(table(spark, rows[:6]), F.col("vec_id") % 20 == 0).count() == 5


def test_vectors_of_another_length_take_no_part(spark):
    rows = [(k, [1.0, float(k)], 0, "") for k in range(6)] + [(20, [1.0] * 3, 0, ""), (21, [1.0] * 3, 0, ""), (40, [5.0], 0, "")]
    found = ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in found) == [1, 2, 3, 4, 5] and {r.query_id for r in found} == {0}
