"""The number of sequences against naive best fit, longest first."""

import random

import pytest

from scanhouse.llm.packing import pack


def naive(lengths, capacity):
    """Sequences that are opened if each document, longest first, goes to the fullest one that holds it."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps[gaps.index(min(fits))] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def packed(spark, lengths, capacity, **options):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id bigint, length bigint")
    out = pack(rows, capacity, **options).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(lengths)))
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("kind", ["mixed", "short", "long", "equal", "halves"])
def test_as_few_sequences_as_naive_best_fit(spark, kind):
    rng = random.Random(kind)
    lengths = {
        "mixed": [rng.randint(1, 128) for _ in range(400)],
        "short": [rng.randint(1, 20) for _ in range(400)],
        "long": [rng.randint(60, 128) for _ in range(300)],
        "equal": [43] * 200,
        "halves": [rng.choice([63, 64, 65]) for _ in range(200)],
    }[kind]
    assert packed(spark, lengths, 128) <= naive(lengths, 128)


def test_shares_lose_at_most_their_open_sequences(spark):
    rng = random.Random(11)
    lengths = [rng.randint(1, 128) for _ in range(500)]
    several = packed(spark, lengths, 128, share_rows=100)
    assert naive(lengths, 128) <= several <= naive(lengths, 128) + 7 * (len(lengths) // 100 + 1)
