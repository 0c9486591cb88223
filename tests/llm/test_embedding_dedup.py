import numpy as np
import pytest

from scanhouse.llm import embedding_dedup
from scanhouse.llm.embedding_dedup import near_duplicate_vectors

from .test_common import brute_components

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(ids, x, threshold=0.9):
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    linked = (u @ u.T >= threshold) & ~np.eye(len(ids), dtype=bool)
    comp = brute_components(sorted(ids), [(ids[i], ids[j]) for i, j in zip(*np.nonzero(linked), strict=True)])
    return sorted((i, int(n), comp[i], comp[i] == i) for i, n in zip(ids, linked.sum(axis=1), strict=True))


@pytest.mark.parametrize("small_blocks", [False, True])
def test_equals_brute_force_with_full_slack(spark, monkeypatch, small_blocks):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 40)
    if small_blocks:
        monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 16)
        monkeypatch.setattr(embedding_dedup, "STRIP", 3)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 12))
    x = (centres[rng.integers(0, 60, 500)] + 0.25 * rng.normal(size=(500, 12))).astype(np.float32)
    x[100:130] = x[7]  # copies
    ids = rng.permutation(500).tolist()
    df = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), SCHEMA).repartition(6)
    rows = near_duplicate_vectors(df, slack=1.0).collect()
    assert sorted(tuple(r) for r in rows) == brute(ids, x.astype(np.float64))


def test_recall_with_the_querys_slack(spark, monkeypatch):
    """Pairs at cosines from just over the threshold on, among vectors without clusters."""
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 100)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(1500, 64))
    near = base + rng.uniform(0.1, 0.46, size=(1500, 1)) * rng.normal(size=base.shape)
    x = np.concatenate([base, near]).astype(np.float32)
    ids = list(range(len(x)))
    found = near_duplicate_vectors(spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), SCHEMA)).toPandas().set_index("vec_id")
    want = {r[0]: r[1] for r in brute(ids, x.astype(np.float64))}
    assert all(found["n_links"][i] <= n for i, n in want.items())
    assert found["n_links"].sum() >= 0.97 * sum(want.values()) > 2000


@pytest.mark.parametrize(("dim", "moved"), [(12, 1000), (12, 0), (64, 0)])
def test_the_query_loses_no_link(spark, monkeypatch, dim, moved):
    """Pairs at cosines just over the threshold, among vectors without clusters, in one cell and in many."""
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 10)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 300)
    monkeypatch.setattr(embedding_dedup, "MOVED", moved)
    fits = []
    kernel = embedding_dedup.cell_kernel
    monkeypatch.setattr(embedding_dedup, "cell_kernel", lambda c, *a: fits.append(c) or kernel(c, *a))
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.sqrt((v * v).sum(axis=1))[:, None]
    base, aside = (unit(rng.normal(size=(1500, dim))) for _ in "ab")
    aside = unit(aside - (aside * base).sum(axis=1)[:, None] * base)
    cosine = rng.uniform(0.9001, 0.905, size=(1500, 1))
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * aside]).astype(np.float32)
    ids = rng.permutation(len(x)).tolist()
    rows = near_duplicate_vectors(spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), SCHEMA)).collect()
    assert sorted(tuple(r) for r in rows) == brute(ids, x.astype(np.float64))
    assert (len(fits[0][dim]) > 50) == (moved == 0)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]),
        (7, [inf, 0.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-30, 0.0]), (11, [0.0, -0.0, 3e38]),
    ]
    got = near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cell", "2 AS digest")).collect()
    links = {1: 4, 2: 4, None: 4, 10: 4}
    assert len(got) == len(rows)
    for r in got:
        assert r.n_links == links.get(r.vec_id, 0)
        assert r.component_id == (1 if r.vec_id in links else r.vec_id)
        assert r.kept == (r.component_id == r.vec_id)
    assert near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("cells", [1, 16])
def test_pairs_exactly_at_the_threshold(spark, monkeypatch, cells):
    """Integer vectors whose cosine is 9/10 to the last digit, or one part in a million beside it."""
    if cells > 1:
        monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 2)
        monkeypatch.setattr(embedding_dedup, "MOVED", 0)
    pairs = [([1, 0, 0, 0], [9, 3, 3, 1]), ([0, 2, 0, 0], [3, 9, 1, 3]), ([0, 0, 0, -5], [1, 3, 3, -9]), ([10, 0, 0, 0], [18, 6, 6, 2])]
    rows = [(10 * i + k, [float(c) * 8**i for c in v]) for i, p in enumerate(pairs) for k, v in enumerate(p)]
    rows += [(100, [9.00001, -3.0, -3.0, -1.0]), (101, [8.99999, -3.0, 3.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    cosine = lambda a, b: dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5)
    want = {i: sum(cosine(a, b) >= 0.9 for j, b in rows if j != i) for i, a in rows}
    assert want[0] >= 3 and want[100] and not want[101]
    assert {r.vec_id: r.n_links for r in near_duplicate_vectors(df).collect()} == want


def test_vectors_of_many_cells_take_little_memory():
    """A batch of rows against many centroids, most of whose cells are in reach of each row."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(8)
    unit = lambda v: v / np.sqrt((v * v).sum(axis=1))[:, None]
    x, centroids = unit(rng.normal(size=(2000, 16))), unit(rng.normal(size=(2000, 16)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(np.ones(2000, np.int64))], names=["class_id", "vector", "n"])
    kernel = embedding_dedup.cell_kernel({16: centroids}, 0.9, 1.0)
    n, arrow = 0, pa.total_allocated_bytes()
    tracemalloc.start()
    for part in kernel(iter([batch])):
        n += part.num_rows
        arrow = max(arrow, pa.total_allocated_bytes())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 20 * len(x)
    assert peak + arrow < 60e6


@pytest.mark.parametrize("moved", [1000, 0])
def test_rounds_move_a_bounded_share_of_the_pairs(spark, monkeypatch, moved):
    """Whatever the blocks of a cell, a shuffle gets about as many rows as there are vectors."""
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 20)
    monkeypatch.setattr(embedding_dedup, "ROUND_ROWS", 100, raising=False)
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 200)
    monkeypatch.setattr(embedding_dedup, "MOVED", moved)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 8))
    x = np.concatenate([base, base + 0.15 * rng.normal(size=base.shape)]).astype(np.float32)
    ids = rng.permutation(len(x)).tolist()
    written, kernel = [], embedding_dedup.tile_kernel

    def counted(threshold):
        written.append(1)
        return kernel(threshold)

    monkeypatch.setattr(embedding_dedup, "tile_kernel", counted)
    rows = near_duplicate_vectors(spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), SCHEMA)).collect()
    assert sorted(tuple(r) for r in rows) == brute(ids, x.astype(np.float64))
    assert len(written) > 5
