"""Kernels work on stretches of bounded size, whatever an Arrow batch holds."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scanhouse.functions import vectors as v
from scanhouse.operators.retrieval import _visits
from scanhouse.plans import fixtures as fx


def lists(n=300, longest=40):
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 16, rng.integers(0, longest)).tolist() for _ in range(n)]
    return [None, *rows, []]


def test_stretches_cover_all_rows_and_stay_bounded(monkeypatch):
    monkeypatch.setattr(v, "WORK_CELLS", 100)
    rows = lists()
    column = pa.array([None, *rows], pa.list_(pa.int32())).slice(1)  # an offset into the buffers
    seen, at = [], 0
    for lo, hi, row, value in v.list_slices(column):
        assert lo == at and (len(value) <= 100 or hi == lo + 1)
        at = hi
        seen += [value[row == i].tolist() for i in range(hi - lo)]
    assert seen == [r or [] for r in rows]
    assert list(v.slices(30, 8)) == [(0, 3), (3, 6), (6, 8)] and list(v.slices(500, 2)) == [(0, 1), (1, 2)] and not list(v.slices(5, 0))


def test_dense_vectors_by_stretches(monkeypatch):
    column = pa.array(lists(), pa.list_(pa.int32()))
    whole = v.dense_normalized(column, 16)
    monkeypatch.setattr(v, "WORK_CELLS", 64)
    assert v.dense_normalized(column, 16).equals(whole) and len(whole) == len(column)
    for row, vector in zip(column.to_pylist(), whole.to_pylist(), strict=True):
        counts = np.bincount(row or [], minlength=16).astype(float)
        assert np.allclose(vector, counts / max(np.linalg.norm(counts), 1), atol=1e-6)


def test_visits_of_all_cells_come_in_small_batches(spark):
    dim, cells = 64, 256
    pivots = np.random.default_rng(2).normal(size=(cells, dim))
    queries = spark.range(0, 200, 1, 1).select(F.col("id").alias("q"), F.array_repeat(F.lit(0.5), dim).alias("qv"), F.lit(float("inf")).alias("kth"))
    visits = _visits(queries, pivots, np.full(cells, 100.0), np.ones(cells, np.int64), 1, True)

    assert visits.count() == 200 * (cells - 1)
    assert visits.groupBy("q").count().where(F.col("count") != cells - 1).isEmpty()


def test_findings_are_built_after_the_join(spark):
    """What is moved and sorted for a report are the lineitems' few columns."""
    from tests.conftest import SF_SMALL

    reports = fx.reports(spark, SF_SMALL)
    plan = reports._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("Join") :]
    assert "fp-" in plan and "fp-" not in moved
    found = reports.select("report_id", F.explode("results").alias("r")).select("report_id", "r.check_id", "r.extra.fingerprint", "r.extra.metadata.cwe")
    flat = fx.findings(spark, SF_SMALL)
    assert found.exceptAll(flat.select("report_id", "check_id", "fingerprint", "cwe")).isEmpty() and found.count() == flat.count()
