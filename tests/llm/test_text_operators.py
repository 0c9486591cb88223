"""Token counts, SentencePiece, packing pieces, license scan and toxicity against plainer versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scanhouse.llm import license_scan, packing, sentencepiece_codec, token_counts, toxicity
from scanhouse.llm.common import table

from .conftest import EDGE

BITS = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "\x1c", "\x85", "\xa0", "é", "日本", "1", "23", "!", "...", "Ä", "▁", "é", "　"]
BITS += ["<|endoftext|>", "</s>", "<0x41>", "𝒳", "İ", "Σ", "H̱", "\x0b", " ", "Ⅷ", "²", "﻿", "�", "I'd", "Stop.)"]


def random_texts(n, seed, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, most))) for _ in range(n)]


TEXTS = [*random_texts(3000, 1), *[t or "" for _, t in EDGE]]


def by_row(rows):
    return sorted((tuple(r) for r in rows), key=str)


# --- token counts


def test_counts_equal_the_library(monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 1000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    counts, library = token_counts.WordCounts(path), Tokenizer.from_file(path)
    assert [counts.count(t) for t in TEXTS] == [len(e.ids) for e in library.encode_batch(TEXTS, add_special_tokens=False)]


def test_counts_of_a_table(edge, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = token_counts.token_counts(edge, path, limit=5).collect()
    library = Tokenizer.from_file(path)
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 5) for d, t in EDGE]
    assert by_row(rows) == by_row(want)
    assert token_counts.token_counts(none, path).count() == 0


def test_merging_pops_the_lowest_rank_leftmost():
    ranks = {("a", "a"): 1, ("aa", "b"): 0, ("b", "c"): 2}
    assert token_counts.merge_count(list("aaabc"), ranks) == 3  # aa, ab stays apart: aa a bc
    assert token_counts.merge_count(list("aab"), ranks) == 1
    assert token_counts.merge_count([], ranks) == 0


# --- SentencePiece


def test_codec_equals_the_library_and_keeps_spans():
    path = public_tokenizers.path("piece_bpe_32k.model")
    codec, library = sentencepiece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in TEXTS:
        ids, starts, stops = codec.encode(text)
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want
        assert codec.decode(ids) == library.decode(want)
        raw, at = text.encode(), 0
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):  # spans cover the text in order
            assert a <= b and (a == b or a == at)
            raw[a:b].decode()
            at = max(at, b)
        assert at == len(raw)


def test_compiled_map_equals_the_library():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    fields = dict(sentencepiece_codec._fields(library.serialized_model_proto()))
    blob = dict(sentencepiece_codec._fields(fields[3]))[2]
    ours = sentencepiece_codec.Normalizer(blob, extra_spaces=True, dummy_prefix=True)
    for text in [*random_texts(1500, 2), "ｱﾞ ㍿ ﬁ Å ① ", "  a  b  "]:
        norm, origin = ours.normalise(text.encode())
        assert norm.decode().replace("▁", " ") == library.normalize(text).replace("▁", " ")
        assert len(origin) == len(norm) + 1 and (np.diff(origin) >= 0).all()


def test_merges_of_unused_and_user_pieces():
    codec = sentencepiece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    codec.clear()
    the = codec.vocabulary["the"]
    codec.unused = {the}
    assert "the" not in codec._merge("the") and "".join(codec._merge("the")) == "the"


def test_bad_bytes_decode_one_by_one():
    codec = sentencepiece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = [codec.byte_ids[b] for b in b"\xe6\x97"] + [codec.vocabulary["▁the"], codec.byte_ids[0xFF], 0]
    assert codec.decode(np.array(ids)) == library.decode(ids)


def test_digests_of_a_table(edge, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for d, t in EDGE:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        digests = [np.array(ids, dtype="<u4").tobytes(), library.decode(ids).encode()]
        want.append((d, len(ids), *[hashlib.sha256(x).hexdigest() for x in digests]))
    assert by_row(sentencepiece_codec.encoding_digests(edge, path).collect()) == by_row(want)
    full = sentencepiece_codec.encode_decode(edge, path).collect()
    assert sorted(len(r.ids) for r in full) == sorted(w[1] for w in want)
    assert sentencepiece_codec.encoding_digests(none, path).count() == 0


# --- packing


def test_pieces_equal_the_library(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 300)
    path = public_tokenizers.path("word_bpe_49k.json")
    words, library = packing.WordIds(path), Tokenizer.from_file(path)
    for text in [*TEXTS, " ".join(random_texts(300, 4))]:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        want = [(k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
        assert list(packing.pieces_of(text.encode(), words, 1, 64)) == want, text


def test_words_of_letters_and_marks_between_others():
    path = public_tokenizers.path("word_bpe_49k.json")
    words, library = packing.WordIds(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    signs = [*"aZbQ\u00c9\u00e9\u00df\u00ff\u00d7\u00f7\u00aa\u00b5\u00c3\u00a9\u0130\u4e2d\u0301.,!&-'7<|>~", *" \t\n\x0b\x0c\r\x1c\x85\xa0\u2028" * 2, "'s", "<|endoftext|>", "The", "thing"]
    for n in [0, 1, *rng.integers(2, 60, 1500)]:
        text = "".join(rng.choice(signs, n))
        assert words.of(text.encode()) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)


def test_a_word_is_kept_once_whatever_its_case_and_marks():
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    list(packing.pieces_of("thing Thing. THING, (thing)! \u00c9t\u00e9 \u00e9t\u00e9.".encode(), words, 1, 64))
    assert set(words) == {b"thing", "\u00e9t\u00e9".encode("latin-1"), b".", b",", b"(", b")!"}


@pytest.mark.parametrize("share_rows", [10**6, 300])
def test_packing_is_gapless_and_tight(spark, share_rows):
    rng = np.random.default_rng(3)
    lengths = np.minimum(256, rng.lognormal(3.5, 1.2, 2000).astype(int) + 1)
    rows = [(None if i % 50 == 0 else i, int(n)) for i, n in enumerate(lengths)] + [(1, 7)] * 3
    items = spark.createDataFrame(rows, "rank bigint, length bigint")
    got = packing.pack(items, capacity=256, share_rows=share_rows).toPandas()
    assert got[["length"]].value_counts().to_dict() == items.toPandas()[["length"]].value_counts().to_dict()
    assert got["rank"].isna().sum() == sum(r[0] is None for r in rows)
    got = got.sort_values(["sequence_id", "offset"])
    before = got.groupby("sequence_id")["length"].cumsum() - got["length"]
    assert (before == got["offset"]).all() and ((got["offset"] + got["length"]) <= 256).all()
    least = -(-int(got["length"].sum()) // 256)
    shares = -(-len(rows) // share_rows)
    assert got["sequence_id"].nunique() <= least * 1.02 + 2 * shares


def test_best_fit_takes_the_successor():
    seq, off, s, g = packing.best_fit(np.array([6, 5, 2]), np.array([10, 11, 12]), np.array([5, 7, 9]), 16, 100)
    assert seq.tolist() == [11, 10, 12] and off.tolist() == [9, 11, 7]
    assert dict(zip(s.tolist(), g.tolist(), strict=True)) == {11: 1, 12: 7}


def test_packing_edge_cases(edge, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(packing.token_pieces(edge, path)).collect()
    assert sum(r.doc_id is None for r in got) == 2
    assert max(r.piece for r in got if r.doc_id == 7) == (30001 + 1 - 1) // 4096
    assert {(r.length, r.start) for r in got if r.doc_id == 4} == {(1, 0)}
    assert packing.pack(packing.token_pieces(none, path)).count() == 0


# --- license scan


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_patience_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 25))] for _ in "ab")
        pairs = license_scan.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= longest_common(a, b)
        assert len(license_scan.patience(a, a)) == len(a)
    rising = [3, 1, 4, 1, 5, 9, 2, 6]
    got = [rising[i] for i in license_scan.longest_increasing(rising)]
    assert len(got) == 4 and got == sorted(set(got))


def test_licenses_are_found_anywhere(spark, none):
    rng = random.Random(4)
    names, rows, want = list(license_scan.TEMPLATES), [], {}
    for i in range(120):
        filler = lambda: " ".join("".join(rng.choices("aeioubdgklmnrst", k=rng.randint(2, 9))) for _ in range(rng.randint(0, 400)))
        chosen = rng.sample(names, rng.randint(0, 2))
        parts = [filler()]
        for name in chosen:
            words = license_scan.TEMPLATES[name].split()
            for _ in range(len(words) // 12):
                words[rng.randrange(len(words))] = "zzz"
            parts += [" ".join(words), filler()]
        rows.append((i, " ".join(parts)))
        want[i] = chosen
    found = license_scan.license_scan(spark.createDataFrame([*rows, *EDGE[3:6]], "doc_id bigint, text string")).collect()
    assert len(found) == len(rows) + 3
    for r in found[: len(rows)]:
        got = {m.license for m in r.licenses}
        assert got >= set(want[r.doc_id]), r.doc_id
        assert {g.split()[0] for g in got} <= {w.split()[0] for w in want[r.doc_id]}
        assert all(m.coverage >= 0.8 and 0 <= m.start < m.stop for m in r.licenses)
    assert license_scan.license_scan(none).count() == 0


# --- toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(6)
    terms = [("idiot", False, 1, 1.0), ("worthless", False, 2, 1.0), ("lowei", True, 1, 1.0), ("ab", True, 0, 1.0)]
    automaton = toxicity.Automaton(toxicity.Lexicon(terms))
    words = ["idiot", "idot", "idiott", "worthles", "vorthlesz", "loweichen", "lwei", "lowxei", "ab", "abc", "a", ""]
    words += ["".join(rng.choices("idotlwea", k=rng.randint(1, 8))) for _ in range(3000)]
    for w in words:
        best = []
        for t, (text, stem, edits, _) in enumerate(terms):
            d = min(distance(text, w[:n]) for n in range(len(w) + 1)) if stem else distance(text, w)
            if d <= edits:
                best.append((d, t))
        assert automaton.match(w) == min(best, default=None), w


def test_quotation_counts_less():
    matches = toxicity.Matches(toxicity.Lexicon([("idiot", False, 1, 6.0)]))
    assert toxicity.features("you idiot!", matches) == [6.0, 0.0, 0.0]
    assert toxicity.features("you idi0t", matches) == [0.0, 6.0, 0.0]
    assert toxicity.features('he wrote "you idiot" then', matches) == [0.0, 0.0, 6.0]
    assert toxicity.features("« idiot », a word", matches) == [0.0, 0.0, 6.0]
    assert toxicity.features("", matches) == [0.0, 0.0, 0.0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = toxicity.toxicity(docs, toxicity.learn_from(docs, labels))
    rows = scored.where("held_out").join(labels.where("toxic is not null"), "doc_id").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hit >= 0.85 * sum(r.toxic == 1 for r in rows)
    assert sum(r.predicted == 1 and r.toxic == 0 for r in rows) <= 0.01 * len(rows)


def test_toxicity_edge_cases(spark, edge, none):
    lexicon = toxicity.Lexicon([("fox", False, 0, 6.0)])
    rows = toxicity.toxicity(edge, lexicon).collect()
    assert by_row((r.doc_id, r.predicted) for r in rows) == by_row((d, int("fox" in (t or ""))) for d, t in EDGE)
    assert all(0 <= r.score <= 1 for r in rows)
    kept = toxicity.drop_toxic(edge, lexicon)
    assert kept.columns == edge.columns and kept.count() == len(EDGE) - 2
    assert toxicity.toxicity(none, lexicon).count() == 0
    no_labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.learn_from(edge, no_labels).terms == []
