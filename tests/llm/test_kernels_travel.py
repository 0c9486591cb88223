"""Every kernel runs in a process that has no package: what tasks get must hold all they need."""

import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark import cloudpickle

from scanhouse.llm import (
    common,
    conversation_repair,
    embedding_dedup,
    html_extraction,
    license_scan,
    ngram_join,
    packing,
    run_detection,
    sentencepiece_codec,
    token_counts,
    toxicity,
)
from scanhouse.llm.html_tree import DIM

MODEL = (np.zeros(DIM), np.zeros((3, 2, 2)))
DOCS = "pa.RecordBatch.from_pydict({'doc_id': [1, 2], 'text': ['one two three four five six seven', None]})"
KERNELS = {
    "sets": (ngram_join.set_rows(5), DOCS),
    "parts": (ngram_join.part_kernel(3, 9, 10, np.zeros(0, np.uint64)), DOCS),
    "grams": (ngram_join.gram_kernel(5), DOCS),
    "forest": (common._forest, "pa.RecordBatch.from_pydict({'u': [1, 2], 'v': [2, 3]})"),
    "pieces": (packing.piece_kernel(public_tokenizers.path("word_bpe_49k.json"), 1, 4096), DOCS),
    "tokens": (token_counts.count_kernel(public_tokenizers.path("byte_bpe_50k.json")), "pa.RecordBatch.from_pydict({'doc_id': [1], 'n': [3], 'text': ['one']})"),
    "vectors": (embedding_dedup.digest_kernel, "pa.RecordBatch.from_pydict({'vec_id': [1], 'embedding': [[1.0, 2.0]]})"),
    "runs": (run_detection.run_kernel(True), DOCS),
    "html": (html_extraction.extract_kernel(MODEL), "pa.RecordBatch.from_pydict({'page_id': [1], 'url': ['u'], 'html': ['<p>x']})"),
    "repair": (
        conversation_repair.repair_kernel,
        "pa.RecordBatch.from_pydict({'conv_id': [1], 'lost': [False], 'turn': [0], 'role': ['user'], 'text': ['Hi.']})",
    ),
}
LOADED_ONLY = {
    "tiles": ngram_join.tile_links(4, 5),
    "rep grams": ngram_join.rep_grams(5),
    "sweep": packing.sweep_kernel(0, ["length"], 4096),
    "cells": embedding_dedup.cell_kernel({2: np.eye(2)}, 0.9, 1.0),
    "vector tiles": embedding_dedup.tile_kernel(0.9),
    **{f"{m.__name__.split('.')[-1]}.{n}": getattr(m, n) for m in (license_scan, sentencepiece_codec, toxicity) for n in dir(m) if n.endswith("_kernel")},
}
RUN = """
import pickle, sys
import pyarrow as pa
assert not any('scanhouse' in m for m in sys.modules)
kernel = pickle.load(open(sys.argv[1], 'rb'))
if len(sys.argv) > 2:
    print(sum(b.num_rows for b in kernel(iter([eval(sys.argv[2])]))))
"""


def away(kernel, tmp_dir, *args):
    with open(f"{tmp_dir}/kernel", "wb") as f:
        cloudpickle.dump(kernel, f)
    return subprocess.run([sys.executable, "-c", RUN, f"{tmp_dir}/kernel", *args], cwd=tmp_dir, capture_output=True, text=True, timeout=120, env={"PATH": "", "PYTHONPATH": ""})


@pytest.mark.parametrize("name", KERNELS)
def test_kernel_runs_without_the_package(name, tmp_dir):
    kernel, batch = KERNELS[name]
    done = away(kernel, tmp_dir, batch)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 0


@pytest.mark.parametrize("name", LOADED_ONLY)
def test_kernel_loads_without_the_package(name, tmp_dir):
    done = away(LOADED_ONLY[name], tmp_dir)
    assert done.returncode == 0, done.stderr
