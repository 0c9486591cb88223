"""The registered queries against their SQL, and the pipeline stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scanhouse.llm.common import materialise, table
from scanhouse.llm.queries import ORACLE, QUERIES
from tests.compare import compare, duckdb_connect
from tests.conftest import SF_SMALL

from .test_ngram_join import brute


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    res = compare(QUERIES[name](spark, SF_SMALL), duckdb_connect(SF_SMALL), ORACLE[name])
    assert res["ok"], res


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_give_every_document(spark, name):
    rows = QUERIES[name](spark, SF_SMALL)
    table_name, key = ("pages", "page_id") if name.startswith("op12_") else ("documents", "doc_id")
    assert rows.select(key).distinct().count() == table(spark, SF_SMALL, table_name).count()


def test_pipeline_stages(spark):
    docs = table(spark, SF_SMALL, "documents")
    kept, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF_SMALL), name)
        kept[name] = docs
    for name in ("toxicity", "exact_dedup", "ngram_join"):
        assert kept[name].columns == columns
    scored = QUERIES["op4_toxicity"](spark, SF_SMALL)
    clean = {r[0] for r in scored.where("predicted = 0").select("doc_id").collect()}
    assert {r[0] for r in kept["toxicity"].select("doc_id").collect()} == clean
    squeezed = F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")
    assert kept["exact_dedup"].select(squeezed).distinct().count() == kept["exact_dedup"].count()
    before = kept["toxicity"].select(squeezed).distinct().count()
    assert kept["exact_dedup"].count() == before
    rows = [(r["doc_id"], r["text"]) for r in kept["exact_dedup"].select("doc_id", "text").collect()]
    stay = {d for d, _, low in brute(rows, 5, 4, 5) if d == low}
    assert {r[0] for r in kept["ngram_join"].select("doc_id").collect()} == stay
    packed = kept["best_fit_packing"]
    assert packed.select("doc_id").distinct().count() == kept["ngram_join"].count()


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF_SMALL).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
