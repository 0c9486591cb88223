"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from scanhouse.llm import run_detection
from scanhouse.llm.common import table
from scanhouse.llm.queries import QUERIES
from tests.conftest import SF_SMALL

from .conftest import EDGE


def brute_runs(words):
    """(start, length, period) of every run, by trying every period and stretch."""
    n, out = len(words), set()
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if length >= max(6, 4 * p) and not any((s, m) == (i, length) for s, m, _ in out):
                out.add((i, length, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text, plant):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + m for s, m, p in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, " ".join(kept))]
    return (doc_id, len(runs), *best, milli, *sha)


def random_words(rng):
    """Words of a small alphabet, with nested repetitions planted."""
    words = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 30))]
    for _ in range(rng.randint(0, 4)):
        if not words:
            break
        a = rng.randrange(len(words))
        part = words[a : a + rng.randint(1, 9)] * rng.randint(2, 7)
        words[a:a] = part[: len(part) - rng.randint(0, 3)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        texts = [random_words(rng) for _ in range(25)]
        names = sorted({w for t in texts for w in t})
        ids = np.array([names.index(w) for t in texts for w in t], dtype=np.int64)
        runs = run_detection.find_runs(ids, np.array([len(t) for t in texts]), max(len(names), 1))
        for r, t in enumerate(texts):
            mine = sorted((tuple(x[1:]) for x in runs[runs[:, 0] == r].tolist()), key=lambda x: (x[0], x[2]))
            assert mine == brute_runs(t), t


def test_extensions_equal_comparison():
    rng = random.Random(6)
    for _ in range(40):
        words = random_words(rng) + random_words(rng)
        n = len(words)
        if n < 2:
            continue
        seq = np.array([100, *[ord(w) - 97 for w in words], 101])
        bars = np.array([True] + [False] * n + [True])
        g = run_detection.Grammar(seq, bars, 102)
        b = g.backwards()
        i, j = (x.ravel() + 1 for x in np.triu_indices(n, 1))
        forth, back = g.lce(i, j), b.lce(n + 1 - i, n + 1 - j)
        for x, y, f, k in zip(i, j, forth, back, strict=True):
            want = next(m for m in range(n + 2) if seq[x + m] != seq[y + m])
            assert f == want
            want = next(m for m in range(n + 2) if seq[x - m] != seq[y - m])
            assert k == want


def test_grid_blocks_do_not_change_runs(monkeypatch):
    ids = np.array([0, 1] * 300 + [2] * 500 + [0, 1, 2] * 100)
    whole = run_detection.find_runs(ids, np.array([len(ids)]), 3)
    monkeypatch.setattr(run_detection, "GRID_BLOCK", 64)
    assert (run_detection.find_runs(ids, np.array([len(ids)]), 3) == whole).all()
    assert [tuple(r) for r in whole] == [(0, 0, 600, 2), (0, 600, 501 - 1, 1), (0, 1100 - 1, 301, 3)]


@pytest.mark.parametrize("plant", [False, True])
def test_edge_rows(edge, none, plant):
    rows = [tuple(r) for r in run_detection.periodic_runs(edge, plant).collect()]
    small = [(d, t) for d, t in EDGE if len(t or "") < 1000]
    want = [brute(d, t, plant) for d, t in small]
    assert [r for r in rows if r[0] != 7] == want or sorted(map(str, [r for r in rows if r[0] != 7])) == sorted(map(str, want))
    if not plant:
        long = next(r for r in rows if r[0] == 7)
        assert long[1:6] == (1, 0, 30000, 1, 30_000_000)
        assert long[7] == hashlib.sha256(b"word end").hexdigest()
    assert run_detection.periodic_runs(none).count() == 0


def test_the_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]
    want = sorted(brute(d, t, True) for d, t in docs)
    got = sorted(tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF_SMALL).collect())
    assert got == want
    assert sum(r[1] > 0 for r in got) > 5
