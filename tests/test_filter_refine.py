"""Search by rotated leading dimensions: exact, with fewer multiply-adds on vectors without clusters."""

import numpy as np
import pytest

from scanhouse.functions.vectors import LEADING, block_top_k, fit_rotation, near_pairs
from scanhouse.operators.retrieval import similarity_search


def smooth(seed, n, dim=64, decay=0.85):
    """No clusters; dimensions are mixed, and few directions hold most of the variance."""
    rng = np.random.default_rng(1)
    mixing = np.linalg.qr(rng.normal(size=(dim, dim)))[0] * decay ** np.arange(dim)[:, None]
    return np.random.default_rng(seed).normal(size=(n, dim)) @ mixing


@pytest.mark.parametrize("k", [1, 5, 5000])
@pytest.mark.parametrize("decay", [0.85, 1.0])
def test_pairs_hold_the_nearest(k, decay):
    q, d = smooth(2, 40, decay=decay), smooth(3, 900, decay=decay)
    d[10:20] = d[0]  # ties
    rotation = np.linalg.qr(np.random.default_rng(9).normal(size=(64, 64)))[0]
    order = np.arange(len(d))
    plain, filtered = block_top_k(q, d, order, k), block_top_k(q, d, order, k, rotation=rotation)
    assert all((a == b).all() for a, b in zip(plain, filtered, strict=True))


def test_fewer_multiply_adds_without_clusters():
    x, q, d = smooth(4, 3000), smooth(5, 256), smooth(6, 2048)
    rotation = fit_rotation(x, 3)
    assert rotation is not None and np.allclose(rotation @ rotation.T, np.eye(64))
    i, j, work = near_pairs(q, d, 3, rotation)
    every = len(q) * len(d) * q.shape[1]
    assert work < 0.35 * every and every / LEADING <= work
    assert len(i) < 0.1 * len(q) * len(d)


def test_no_rotation_where_it_does_not_pay():
    assert fit_rotation(smooth(4, 3000, decay=1.0), 3) is None
    assert fit_rotation(np.zeros((3000, 8)), 3) is None and fit_rotation(np.zeros((0, 64)), 3) is None


def test_search_is_the_same_with_and_without(spark, monkeypatch):
    from scanhouse.operators import retrieval

    x = smooth(7, 600).round(3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id bigint, vector array<double>")
    queries = rows.limit(60).withColumnRenamed("doc_id", "query_id")
    fitted, fit = [], retrieval.fit_rotation
    monkeypatch.setattr(retrieval, "fit_rotation", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    with_it = sorted(map(tuple, similarity_search(queries, rows, k=4, block_rows=300).collect()))
    assert fitted and fitted[0] is not None
    monkeypatch.setattr(retrieval, "fit_rotation", lambda *a: None)
    assert sorted(map(tuple, similarity_search(queries, rows, k=4, block_rows=300).collect())) == with_it
