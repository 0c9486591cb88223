"""The stored index against the plain search, and search among vectors of several lengths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanhouse.operators import stored_index as si
from scanhouse.operators.retrieval import route, similarity_search
from scanhouse.sources import commits

ROWS = "doc_id bigint, api string, vector array<float>"
ASKED = "query_id bigint, vector array<float>"


def frame(spark, x, first=0, ddl=ROWS):
    rows = [(first + i, f"/api{i % 3}", v.tolist()) if ddl == ROWS else (first + i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, ddl)


def vectors(seed, n, dim=8, centres=12, spread=0.3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] * 4 + spread * rng.normal(size=(n, dim))).astype(np.float32)


def listed(df):
    return sorted(map(tuple, df.collect()))


def both(queries, rows, root, k, cols=("api",)):
    plain = similarity_search(queries, rows, k=k, doc_cols=list(cols))
    return listed(si.search_stored(queries, root, k=k, doc_cols=list(cols))), listed(plain)


@pytest.mark.parametrize("k", [1, 5])
@pytest.mark.parametrize("spread", [0.3, 10.0])
def test_equals_the_plain_search(spark, tmp_dir, k, spread):
    rows, queries = frame(spark, vectors(1, 900, spread=spread)), frame(spark, vectors(2, 60, spread=spread), ddl=ASKED)
    si.build_stored_index(rows, tmp_dir, cell_rows=40)
    assert len(si.stored_cells(spark, tmp_dir)[8].ids) > 10
    got, want = both(queries, rows, tmp_dir, k)
    assert got == want and len(got) == 60 * k


def test_chunks_of_queries(spark, tmp_dir, monkeypatch):
    rows, queries = frame(spark, vectors(1, 300)), frame(spark, vectors(2, 50), ddl=ASKED)
    si.build_stored_index(rows, tmp_dir, cell_rows=30)
    monkeypatch.setattr(si, "QUERY_BYTES", 8 * 8 * 12)
    got, want = both(queries, rows, tmp_dir, 3)
    assert got == want


def test_a_search_moves_no_row_and_reads_few_cells(spark, tmp_dir):
    x = vectors(1, 1200)
    si.build_stored_index(frame(spark, x), tmp_dir, cell_rows=50)
    cells = si.stored_cells(spark, tmp_dir)[8]
    visited = cells.visits(x[:1].astype(float), 1, None)
    assert visited.sum() == 1
    index = si.read_cells(spark, tmp_dir, 8, cells.ids[visited[0]].tolist(), commits.live(commits.entries(spark, tmp_dir)))
    found = si._compare(index, {int(cells.ids[c]): np.array([0]) for c in np.flatnonzero(visited[0])}, x[:1].astype(float), 8, 1, ["api"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull" in plan
    folders = {r[0].split("/cell=")[1].split("/")[0] for r in index.select(F.input_file_name()).distinct().collect()}
    assert folders == {str(c) for c in cells.ids[visited[0]]}


def test_appended_documents_are_found_and_cells_are_cut(spark, tmp_dir):
    first, more = vectors(1, 300), np.concatenate([vectors(1, 300)[:5], vectors(3, 500, centres=1)])
    si.build_stored_index(frame(spark, first), tmp_dir, cell_rows=60)
    before = si.stored_cells(spark, tmp_dir)[8]
    si.add_to_stored_index(frame(spark, more, first=10_000), tmp_dir, cell_rows=60)
    after = si.stored_cells(spark, tmp_dir)[8]
    assert set(before.ids) - set(after.ids) and after.n.sum() == 805 and after.n.max() <= 120
    rows = frame(spark, first).unionByName(frame(spark, more, first=10_000))
    got, want = both(frame(spark, np.concatenate([first[:20], more[:40]]), ddl=ASKED), rows, tmp_dir, 4)
    assert got == want


def test_equal_vectors_are_one_cell_and_odd_ones_are_left_out(spark, tmp_dir):
    x = [*vectors(1, 100).tolist(), *[[1.0] * 8] * 300]
    rows = spark.createDataFrame([(i, "/a", v) for i, v in enumerate(x)] + [(900, "/a", None), (901, "/a", []), (902, "/a", [float("nan")] * 8), (903, "/a", [None] * 8)], ROWS)
    si.build_stored_index(rows, tmp_dir, cell_rows=20)
    assert si.split_cells(spark, tmp_dir, 20) is None
    queries = spark.createDataFrame([(1, [1.0] * 8), (2, None), (3, [1.0]), (4, x[3])], ASKED)
    got, want = both(queries, rows, tmp_dir, 3)
    assert got == want and {r[0] for r in got} == {1, 4}


def test_a_load_that_dies_is_not_seen_and_a_build_replaces(spark, tmp_dir, monkeypatch):
    si.build_stored_index(frame(spark, vectors(1, 200)), tmp_dir, cell_rows=50)
    queries = frame(spark, vectors(2, 10), ddl=ASKED)
    before = listed(si.search_stored(queries, tmp_dir, k=2))
    with monkeypatch.context() as m:
        m.setattr(si, "commit", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            si.add_to_stored_index(frame(spark, vectors(2, 50), first=5000), tmp_dir)
    assert listed(si.search_stored(queries, tmp_dir, k=2)) == before
    rows = frame(spark, vectors(7, 120), first=7000)
    si.build_stored_index(rows, tmp_dir, cell_rows=50)
    got, want = both(queries, rows, tmp_dir, 2)
    assert got == want
    si.build_stored_index(rows.where("false"), tmp_dir)
    assert si.search_stored(queries, tmp_dir, doc_cols=["api"]).count() == 0


def test_two_adds_at_once(spark, tmp_dir, monkeypatch):
    si.build_stored_index(frame(spark, vectors(1, 100)), tmp_dir, cell_rows=50)
    write, done = si._write_cells, []

    def late(*a):
        write(*a)
        if not done:
            done.append(1)
            si.add_to_stored_index(frame(spark, vectors(5, 300), first=2000), tmp_dir, cell_rows=50)

    monkeypatch.setattr(si, "_write_cells", late)
    si.add_to_stored_index(frame(spark, vectors(6, 300), first=4000), tmp_dir, cell_rows=50)
    rows = frame(spark, vectors(1, 100)).unionByName(frame(spark, vectors(5, 300), first=2000)).unionByName(frame(spark, vectors(6, 300), first=4000))
    got, want = both(frame(spark, vectors(2, 30), ddl=ASKED), rows, tmp_dir, 3)
    assert got == want


# --- vectors of several lengths


def test_every_length_is_searched_among_its_own(spark, tmp_dir):
    two, three = vectors(1, 50, dim=2), vectors(2, 20, dim=3)
    rows = frame(spark, two).unionByName(frame(spark, three, first=1000))
    queries = frame(spark, two[:7], ddl=ASKED).unionByName(frame(spark, three[:7], first=500, ddl=ASKED)).unionByName(frame(spark, vectors(3, 2, dim=4), first=900, ddl=ASKED))
    hits = similarity_search(queries, rows, k=1)
    assert {(r.query_id, r.doc_id) for r in hits.collect()} == {(i, i) for i in range(7)} | {(500 + i, 1000 + i) for i in range(7)}
    every = {r.query_id: r.doc_id for r in similarity_search(queries, rows, keep_unmatched=True).collect()}
    assert len(every) == 16 and every[900] is None and every[901] is None
    routed = {r.query_id: (r.api, r.found) for r in route(queries, rows).collect()}
    assert routed[501] == ("/api1", True) and routed[900] == (None, False)
    si.build_stored_index(rows, tmp_dir, cell_rows=10)
    assert listed(si.search_stored(queries, tmp_dir, k=1)) == listed(hits)
    assert sorted(si.stored_cells(spark, tmp_dir)) == [2, 3]


def test_the_rarer_length_counts_whatever_the_majority(spark):
    rows = spark.createDataFrame([(1, "/a", [0.0, 1.0]), (2, "/a", [5.0, 1.0]), (3, "/a", [1.0, 2.0, 3.0])], ROWS)
    hit = similarity_search(spark.createDataFrame([(9, [1.0, 2.0, 3.0])], ASKED), rows).collect()
    assert [(r.query_id, r.doc_id, r.distance) for r in hit] == [(9, 3, 0.0)]
