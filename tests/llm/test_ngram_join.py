import random
import re

import numpy as np
import pytest

from scanhouse.llm import ngram_join
from scanhouse.llm.ngram_join import block_links, drop_near_duplicates, n_parts, near_duplicates
from scanhouse.llm.shingles import shingle_sets

from .conftest import EDGE
from .test_common import brute_components


def grams(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, num, den):
    """(id, set size, component) of rows by place, since ids may repeat or be NULL."""
    sets = [grams(t, k) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])
    ]
    comp = brute_components(range(len(rows)), links)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[comp[i]] = min(doc_id, low.get(comp[i], doc_id))
    return sorted(((d, len(sets[i]), low.get(comp[i])) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, bases, copies, words):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=25)
    rows = []
    for _ in range(bases):
        base = rng.choices(vocab, k=rng.randint(1, words)) + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 1, copies])):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
@pytest.mark.parametrize("small_blocks", [False, True])
def test_equals_brute_force(spark, monkeypatch, k, num, den, small_blocks):
    if small_blocks:  # many blocks a component, and common shingles from few documents on
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
        monkeypatch.setattr(ngram_join, "HOT_LEAST", 4)
    rows = corpus(k, 60, 9, 120) + EDGE
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = near_duplicates(docs, k, (num, den)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, k, num, den)


def test_parts_of_linked_sets_agree():
    """Any two sets at the threshold share a part, for sizes from tiny to large."""
    rng = np.random.default_rng(1)
    for n in (4, 5, 9, 10, 40, 333, 2500):
        for num, den in ((9, 10), (4, 5)):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            d = (den - num) * len(a) // den  # a subset at the threshold
            b = np.delete(a, rng.choice(len(a), size=d, replace=False))
            sizes, keys = np.array([len(a), len(b)]), np.array([1, 2])
            for hot in (np.zeros(0, np.uint64), a[::2], a):
                p, k = ngram_join.part_rows(np.concatenate([a, b]), sizes, keys, hot, num, den, {})
                assert set(p[k == 1]) & set(p[k == 2]), (n, num, den, len(hot))
    assert n_parts(30, 9, 10) > 0


def test_block_links_finds_bridges():
    x = np.arange(100, dtype=np.int64)
    sets = [x[:90], x[5:95], x[10:100], np.arange(500, 520)]  # the middle one links its neighbours
    assert block_links(np.array([7, 8, 9, 3]), sets, 4, 5).tolist() == [7, 7, 7, 3]


def test_shingles_of_words_that_meet_at_row_ends():
    texts = [b"a b c", b"", b"d e f", b" x", b"y"]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    sets, sizes = shingle_sets(data, offsets, 3)
    assert sizes.tolist() == [1, 0, 1, 1, 1] and len(set(sets.tolist())) == 4


def test_drop_keeps_columns_and_one_of_each(spark, edge):
    kept = drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    rows = kept.collect()
    assert sum((r.text or "").startswith("the quick") for r in rows) == 1 + (2 in {r.doc_id for r in rows})
    assert {r.doc_id for r in rows} >= {1, 3, 4, 5, 6, 7, 8}


def test_no_rows(none):
    assert near_duplicates(none).count() == 0


def test_only_candidates_texts_are_moved(spark, monkeypatch):
    """Where too many rows are candidates, or go, for a broadcast, the texts of the others stay where they are."""
    from scanhouse.llm import ngram_join as nj

    words = [f"w{i}" for i in range(17_000)]
    rows = [(i, " ".join(words[60 * i : 60 * i + 60]) + f" x{i} y{i}") for i in range(280)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 200, 10)] + [(None, rows[5][1]), (None, "alone with no id"), (2000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = sorted(map(str, nj.drop_near_duplicates(docs, words=3, threshold=(4, 5)).collect()))
    monkeypatch.setattr(nj, "BROADCAST_ROWS", 0, raising=False)
    moved, join = [], nj.null_safe
    monkeypatch.setattr(nj, "null_safe", lambda left, *a: moved.append(left.count()) or join(left, *a))
    assert sorted(map(str, nj.drop_near_duplicates(docs, words=3, threshold=(4, 5)).collect())) == want
    assert len(want) < len(rows) and 0 < moved[0] < len(rows) / 2
