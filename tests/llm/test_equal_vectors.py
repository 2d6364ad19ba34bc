"""Nearest neighbours where many vectors are equal."""

import numpy as np

from millrace.llm import hnsw


def test_a_third_of_rows_equal(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(32000, 16))
    hot = rng.permutation(32000)[:10700]
    v[hot] = v[hot[0]]
    near = rng.permutation(np.setdiff1d(np.arange(32000), hot))[:4000]
    v[near] = v[hot[0]] + 0.7 * rng.normal(size=(4000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = hnsw.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), every=200).toPandas()
    hits = total = 0
    for q in range(0, 32000, 200):
        s = np.round(v @ v[q], 12)
        s[q] = -np.inf
        top = np.lexsort((np.arange(32000), -s))[:20]
        mine = got[got.query_id == q].sort_values("rank").vec_id.tolist()
        assert len(mine) == 20
        if q in hot:
            assert mine == top.tolist() == sorted(set(hot) - {q})[:20]
        hits += len(set(top) & set(mine))
        total += 20
    assert hits / total >= 0.95


def test_copies_of_one_id(spark):
    data = [(20, [1.0, -0.0])] * 30 + [(k, [1.0, 0.0]) for k in range(21, 60) for _ in range(1 + (k == 21))] + [(40, [0.0, 1.0])]
    got = hnsw.nearest(spark.createDataFrame([(0, [0.5, 0.0]), *data], "vec_id long, embedding array<double>")).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [20] * 20
    assert {r.vec_id for r in got if r.query_id == 20} >= {21, 22}
