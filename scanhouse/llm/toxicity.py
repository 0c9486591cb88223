"""Operator 4: toxicity from a learned lexicon, matched by Levenshtein automata over its trie.

Learning takes labelled documents only: words and word stems that stand almost only in toxic
documents, after many different words (so that copies of one document teach nothing), become the
lexicon. Their trie, intersected with the automaton of at most one or two edits, runs over every
word, misspelled ones included; the product is built state by state as words need it. A window of
words around each match tells quotation and report from abuse. A logistic model over the matches
gives the score.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanhouse.llm.common import materialise, table
from scanhouse.llm.worker import kept

#: Labelled rows that the lexicon and the model are learned from, at most (about); scoring covers all rows.
TRAIN_ROWS = 20_000
STEM_CHARS = range(4, 9)
#: Share of toxic documents (weighted as if classes were equal) among those with a term.
PURITY = 0.95
#: Most that one match and all matches of a kind count.
MATCH_MOST, KIND_MOST = 6.0, 30.0
#: A term may be misspelled if clean documents have at most so many such forms: 2, or this share of them.
MISSPELLED_CLEAN = 0.0005
WINDOW = 6
MEMO_WORDS = 200_000
THRESHOLD = 0.7

# Quotation marks, and words of report in four languages.
OPENING, CLOSING = "\"“”„«»‹›‘", "\"“”«»‹›’"
REPORTING = frozenset(
    "said says quote quoted quotes called wrote reported according alleged told "
    "sagte schrieb nannte zitiert laut dit disait écrit selon cité dijo escribió llamó según citó".split()
)

WORD = re.compile(r"\w+")


# --- trie and automaton ---------------------------------------------------------------


@dataclass
class Lexicon:
    """``terms``: (text, is a stem, edits allowed, log of its odds); ``known``: clean words that
    are no misspelling; ``weights``: of a constant, exact, misspelled and quoted matches."""

    terms: list[tuple[str, bool, int, float]]
    known: frozenset[str] = frozenset()
    weights: tuple[float, ...] = (-4.0, 1.0, 0.8, 0.2)


@dataclass
class Automaton:
    """Levenshtein automaton of a lexicon's trie, as a deterministic one grown on demand.

    A state is the set of (trie node, edits) reached; a stem's end is kept for good, as it
    matches whatever follows. ``states[0]`` is dead.
    """

    lexicon: Lexicon
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))
    slack: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self):
        for t, (text, _, edits, _) in enumerate(self.lexicon.terms):
            node = 0
            self.slack[0] = max(self.slack[0], edits)
            for ch in text:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.slack.append(0)
                node = self.children[node][ch]
                self.slack[node] = max(self.slack[node], edits)
            self.ends[node].append(t)
        self.ids: dict[frozenset, int] = {frozenset(): 0}
        self.states: list[frozenset] = [frozenset()]
        self.moves: list[dict[str, int]] = [{}]
        self.finals: list[tuple[int, int] | None] = [None]
        self.start = self._state(self._close({(0, 0)}))

    def _close(self, pairs: set) -> frozenset:
        """Add what skipping a term's letters reaches; stems that end here stay matched."""
        todo, out = list(pairs), set(pairs)
        while todo:
            node, e = todo.pop()
            if node < 0:
                continue
            for t in self.ends.get(node, ()):
                if self.lexicon.terms[t][1] and e <= self.lexicon.terms[t][2]:
                    out.add((-1 - t, e))
            for child in self.children[node].values():
                if e + 1 <= self.slack[child] and (child, e + 1) not in out:
                    out.add((child, e + 1))
                    todo.append((child, e + 1))
        return frozenset(out)

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.ids:
            self.ids[pairs] = len(self.states)
            self.states.append(pairs)
            self.moves.append({})
            found = [(e, -1 - node) for node, e in pairs if node < 0]
            found += [(e, t) for node, e in pairs for t in self.ends.get(node, ()) if e <= self.lexicon.terms[t][2]]
            self.finals.append(min(found, default=None))
        return self.ids[pairs]

    def _move(self, state: int, ch: str) -> int:
        out = set()
        for node, e in self.states[state]:
            if node < 0:
                out.add((node, e))
                continue
            if e + 1 <= self.slack[node]:
                out.add((node, e + 1))
            for c, child in self.children[node].items():
                cost = e + (c != ch)
                if cost <= self.slack[child]:
                    out.add((child, cost))
        self.moves[state][ch] = to = self._state(self._close(out))
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """``(edits, term)`` of the best term within its allowed edits of the word, or None."""
        state, moves = self.start, self.moves
        for ch in word:
            nxt = moves[state].get(ch)
            state = self._move(state, ch) if nxt is None else nxt
            if not state:
                return None
        return self.finals[state]


NO_MATCH: list = []  # one for all chunks without a match


class Matches(dict):
    """Matches of white-space-delimited chunks: a list of (edits, term), mostly empty."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.automaton, self.known = Automaton(lexicon), lexicon.known

    def __missing__(self, chunk: str) -> list:
        words = WORD.findall(chunk)
        whole = chunk.strip(".,;:!?\"'()[]")
        if len(words) > 1:  # as with a letter replaced by a mark
            words.append(whole)
        found = []
        for w in words:
            m = self.automaton.match(w)
            if m and not (m[0] and w in self.known):
                found.append(m)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[chunk] = found or NO_MATCH
        return found


def quoted(chunks: list[str], i: int) -> bool:
    """Whether chunk i stands in quotation marks or follows a word of report, within the window."""
    before = chunks[max(0, i - WINDOW) : i]
    after = chunks[i + 1 : i + 1 + WINDOW]
    if any(c.strip(".,;:!?") in REPORTING for c in before[-3:]):
        return True
    opens = chunks[i][:1] in OPENING
    for c in before:
        if c[:1] in OPENING:
            opens = True
        if c.rstrip(".,;:!?")[-1:] in CLOSING and len(c) > 1:
            opens = False
    opens = opens or chunks[i][:1] in OPENING
    return opens and any(c.rstrip(".,;:!?")[-1:] in CLOSING for c in [chunks[i], *after])


def features(text: str, matches: Matches) -> list[float]:
    """Log odds summed over exact, misspelled and quoted matches."""
    sums = [0.0, 0.0, 0.0]
    chunks = text.lower().split()
    terms = matches.automaton.lexicon.terms
    for i, found in [(i, f) for i, c in enumerate(chunks) if (f := matches[c])]:
        edits, term = min(found)
        sums[2 if quoted(chunks, i) else edits > 0] += terms[term][3]
    return [min(x, KIND_MOST) for x in sums]


# --- learning -------------------------------------------------------------------------


def word_features(words: set[str]) -> Iterator[str]:
    """Every whole word (as ``word$``) and every stem of it."""
    for w in words:
        yield w + "$"
        for n in STEM_CHARS:
            if len(w) > n:
                yield w[:n]


def toxic_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the toxic rows: each feature's documents, and a bit map of the words before it."""
    docs: dict[str, int] = defaultdict(int)
    before: dict[str, int] = defaultdict(int)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            ws = WORD.findall((text or "").lower())
            last = {w: p for p, w in zip(["", *ws], ws, strict=False)}
            for f in set(word_features(set(last))):
                docs[f] += 1
            for w, p in last.items():
                bit = 1 << (sum(p.encode()) * 2654435761 >> 7 & 63)
                for f in word_features({w}):
                    before[f] |= bit
    bits = pa.array(np.array([before[f] for f in docs], dtype=np.uint64).view(np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64()), bits], names=["f", "n", "bits"])


def clean_kernel(wanted: frozenset[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[str, int] = defaultdict(int)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for f in {f for f in word_features(set(WORD.findall((text or "").lower()))) if f in wanted}:
                    docs[f] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64())], names=["f", "n"])

    return rows


def misspelled_kernel(lexicon: Lexicon):
    """Of the clean rows: each misspelled form, its term and its documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, docs, memo = Automaton(lexicon), defaultdict(int), {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in set(WORD.findall((text or "").lower())):
                    if w not in memo:
                        memo[w] = automaton.match(w)
                    if memo[w] and memo[w][0]:
                        docs[w, memo[w][1]] += 1
        keys = list(docs)
        cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(docs.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["w", "t", "n"])

    return rows


def feature_kernel(lexicon: Lexicon):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = Matches(lexicon)
        for batch in batches:
            x = [features(t or "", matches) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    return rows


def choose_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> list[tuple[str, bool, int, float]]:
    """Pure features; of nested ones the longest that keeps nine tenths of the support."""
    odds = {f: (k + 0.5) / n_toxic / ((clean.get(f, 0) + 0.5) / n_clean) for f, k in toxic.items()}
    pure = {f: toxic[f] for f, o in odds.items() if o / (1 + o) >= PURITY}
    nested = defaultdict(int)
    for f, k in pure.items():
        for n in range(min(STEM_CHARS), len(f)):
            if f[:n] in pure:
                nested[f[:n]] = max(nested[f[:n]], k)
    rest = {f for f, k in pure.items() if nested[f] < 0.9 * k}
    out = []
    for f in sorted(rest):
        if not any(f[:n] in rest for n in range(min(STEM_CHARS), len(f))):
            word = f.removesuffix("$")
            edits = 0 if len(word) < 4 else 1 if len(word) < 9 else 2
            out.append((word, word == f, edits, min(MATCH_MOST, math.log(odds[f]))))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...]) -> tuple[float, ...]:
    """Damped Newton steps for a logistic model, held near ``prior`` by a small penalty."""
    w0 = np.array(prior)
    if not len(y) or y.min() == y.max():
        return prior
    a, w = np.column_stack([np.ones(len(x)), x]), w0.copy()

    def loss(w):
        z = a @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.05 * ((w - w0) ** 2).sum()

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (p - y) + 0.1 * (w - w0))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return tuple(w.tolist())


def learn(texts: DataFrame, train_rows: int = TRAIN_ROWS) -> Lexicon:
    """Lexicon and weights from ``texts(doc_id, text, toxic)``, on about ``train_rows`` rows of it.

    The sample is taken by a hash of the id, so it is the same each time. What comes to the
    driver is bounded by it: features over the support, misspelled forms, a row of features
    each. Without rows of both classes the lexicon is empty.
    """
    n = texts.count()
    if n > train_rows:
        part = int(train_rows / n * (1 << 32))
        texts = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < part)
    texts = materialise(texts.select("text", F.col("toxic").cast("int").alias("toxic")), "training")
    n_by = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n_by.get(1, 0), n_by.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon([])
    toxic, clean = texts.where("toxic = 1").select("text"), texts.where("toxic = 0").select("text")
    counts = toxic.mapInArrow(toxic_kernel, "f string, n bigint, bits bigint").groupBy("f")
    counts = materialise(counts.agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("bits")).alias("spread")), "features")
    # support at which a feature of chance would still be pure less than once in a hundred samples
    base = n_toxic / (n_toxic + n_clean)
    least = max(4, math.ceil(math.log(100 * max(counts.count(), 1)) / -math.log(base)), math.ceil(0.004 * n_toxic))
    kept_rows = counts.where((F.col("n") >= least) & (F.col("spread") >= min(least, 16))).collect()
    support = {r["f"]: r["n"] for r in kept_rows}
    seen = clean.mapInArrow(clean_kernel(frozenset(support)), "f string, n bigint").groupBy("f").agg(F.sum("n").alias("n"))
    terms = choose_terms(support, {r["f"]: r["n"] for r in seen.collect()}, n_toxic, n_clean)
    forms = clean.mapInArrow(misspelled_kernel(Lexicon(terms)), "w string, t bigint, n bigint")
    forms = forms.groupBy("w", "t").agg(F.sum("n").alias("n")).collect()
    known = frozenset(r["w"] for r in forms)
    wrong = defaultdict(int)
    for r in forms:
        wrong[r["t"]] += 1
    terms = [(w, s, 0 if wrong[t] > max(2, MISSPELLED_CLEAN * n_clean) else e, o) for t, (w, s, e, o) in enumerate(terms)]
    lexicon = Lexicon(terms, known)
    rows = texts.select("text", "toxic").mapInArrow(feature_kernel(lexicon), "toxic int, x array<double>").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], dtype=float)
    lexicon.weights = fit_logistic(x, y, lexicon.weights)
    return lexicon


# --- scoring --------------------------------------------------------------------------


def score_kernel(lexicon: Lexicon):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = kept(("matches", tuple(lexicon.terms), len(lexicon.known)), lambda: Matches(lexicon))
        bias, *w = lexicon.weights
        for batch in batches:
            score = []
            for text in batch.column(1):
                z = bias + sum(a * b for a, b in zip(w, features(text.as_py() or "", matches), strict=True))
                score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])

    return rows


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_from(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learn from the labelled rows of ``docs`` that are not held out."""
    train = labels.where("toxic is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    return learn(docs.select("doc_id", "text").join(train, "doc_id"))


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, held_out, score, predicted.

    A NULL text scores as an empty one, the score of a text without matches. Repeated rows and
    NULL ids are scored like others; other columns are not read.
    """
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(score_kernel(lexicon), f"doc_id {id_type}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, with all their columns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = kept(("matches", tuple(lexicon.terms), len(lexicon.known)), lambda: Matches(lexicon))
        bias, *w = lexicon.weights
        cut = math.log(THRESHOLD / (1 - THRESHOLD))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            keep = [bias + sum(a * b for a, b in zip(w, features(t.as_py() or "", matches), strict=True)) < cut for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, learn_from(docs, table(spark, sf_dir, "labels")))
