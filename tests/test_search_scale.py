"""Searches among vectors without clusters, where a query visits nearly all cells."""

import numpy as np
import pytest

from scanhouse.operators import retrieval
from scanhouse.operators import stored_index as si
from scanhouse.operators.retrieval import similarity_search

ROWS = "doc_id bigint, api string, vector array<float>"


def frames(spark, n=900, asked=300, dim=16):
    x = np.random.default_rng(3).normal(size=(n, dim)).astype(np.float32)
    x[20:30] = x[7]  # ties go to the smaller id
    rows = spark.createDataFrame([(i, f"/api{i % 3}", v.tolist()) for i, v in enumerate(x)], ROWS).repartition(4)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:asked])], "query_id bigint, vector array<float>").repartition(3)
    dist = ((x[:asked, None].astype(float) - x[None].astype(float)) ** 2).sum(axis=2)
    want = [(i, r + 1, int(j), f"/api{j % 3}") for i in range(asked) for r, j in enumerate(np.lexsort((np.arange(n), dist[i]))[:3])]
    return queries, rows, want


def found(df):
    return sorted((r.query_id, r.rank, r.doc_id, r.api) for r in df.collect())


@pytest.mark.parametrize("query_bytes", [16 << 20, 16 * 8 * 70])
def test_rows_are_not_moved_to_every_query(spark, monkeypatch, query_bytes):
    queries, rows, want = frames(spark)
    rounds, visits = [], retrieval._visits
    monkeypatch.setattr(retrieval, "_visits", lambda *a: rounds.append(a[-1]) or visits(*a))
    monkeypatch.setattr(retrieval, "QUERY_BYTES", query_bytes, raising=False)
    assert found(similarity_search(queries, rows, k=3, doc_cols=["api"], block_rows=40)) == want
    assert rounds == [False]  # the second round, of all further cells, makes no visits


def test_clustered_rows_are_moved_to_the_queries_that_visit_them(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(20, 16))[np.arange(900) % 20] * 9 + np.random.default_rng(5).normal(size=(900, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id bigint, vector array<double>")
    rounds, visits = [], retrieval._visits
    monkeypatch.setattr(retrieval, "_visits", lambda *a: rounds.append(a[-1]) or visits(*a))
    hits = similarity_search(rows.withColumnRenamed("doc_id", "query_id"), rows, k=2, block_rows=40).collect()
    dist = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert {(r.query_id, r.doc_id) for r in hits} == {(i, int(j)) for i in range(900) for j in np.lexsort((np.arange(900), dist[i]))[:2]}
    assert rounds == [False, True]


def test_a_stored_search_keeps_no_chunk_on_the_driver(spark, tmp_dir, monkeypatch):
    queries, rows, want = frames(spark)
    si.build_stored_index(rows, tmp_dir, cell_rows=40)
    monkeypatch.setattr(si, "QUERY_BYTES", 16 * 8 * 70)
    hits = si.search_stored(queries, tmp_dir, k=3, doc_cols=["api"])
    assert found(hits) == want
    # what a chunk asks for has been broadcast, used and dropped: the result reads stored hits
    assert "MapInArrow" not in hits._jdf.queryExecution().executedPlan().toString()


def test_all_cells_that_are_cut_are_read_at_once(spark, tmp_dir, monkeypatch):
    _, rows, _ = frames(spark)
    si.build_stored_index(rows.where("doc_id % 4 = 0"), tmp_dir, cell_rows=20)
    reads, read = [], si.read_cells
    monkeypatch.setattr(si, "read_cells", lambda *a: reads.append(len(a[3])) or read(*a))
    si.add_to_stored_index(rows.where("doc_id % 4 <> 0"), tmp_dir, cell_rows=20)
    assert len(reads) == 1 and reads[0] > 3
    cells = si.stored_cells(spark, tmp_dir)[16]
    assert cells.n.sum() == 900 and cells.n.max() < 200
