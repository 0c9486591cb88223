"""Operator 12: main text of web pages by a tree-structured graphical model of the DOM.

Each element and text of a page is a node with a binary variable: article or not. A node's own
potential is a weighted sum of its features (element and class names, size, link density); each
parent-child pair has a potential by the kind of child. The graph is a tree, so sum-product messages, once
upward and once downward, give every node's exact marginal; a text stays if its own is at least
1/2. Weights are trained by the gradient of the pages' log-likelihood, for which the same
messages give the expected counts.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scanhouse.llm.common import table
from scanhouse.llm.html_pages import labelled_page
from scanhouse.llm.html_tree import DIM, Page

#: Labelled pages of the default model, and how it learns from them.
PAGES, SEED = 1600, 20
BATCH, EPOCHS, RATE, PENALTY = 60, 10, 0.15, 0.0003
#: Characters of html whose nodes are worked on at once.
PIECE_CHARS = 1 << 20


class Forest:
    """Nodes of several pages, by depth: messages of a level are computed together."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parent) for p in pages]
        self.starts = np.cumsum([0, *sizes])
        shift = np.repeat(self.starts[:-1], sizes)
        parent = np.array([u for p in pages for u in p.parent], dtype=np.int64)
        self.kind = np.array([k for p in pages for k in p.kind], dtype=np.int64)
        self.parent = np.where(parent >= 0, parent + shift, -1)
        depth = np.array([d for p in pages for d in p.depth], dtype=np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, (int(depth.max()) if len(depth) else 0) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]  # without the roots
        # known beforehand: the page as a whole is no article
        self.known = np.array([t in ("html", "head", "body") for p in pages for t in p.tags], dtype=bool)
        counts = np.array([len(f) for p in pages for f in p.features], dtype=np.int64)
        self.node = np.repeat(np.arange(len(counts)), counts)
        self.features = np.array([x for p in pages for f in p.features for x in f], dtype=np.int64)

    def messages(self, weights: np.ndarray, pair: np.ndarray):
        """Log-odds of every node's marginal, and the joint marginals of each node and its parent
        (n x 2 x 2, parent first; of no meaning for roots)."""
        n = len(self.parent)
        local = np.zeros((n, 2))
        local[:, 1] = np.bincount(self.node, weights=weights[self.features], minlength=n)
        local[self.known, 1] = -1000.0
        potential = pair[self.kind]  # n x 2 x 2
        up = np.zeros((n, 2))
        for level in reversed(self.levels):
            up[level] = np.logaddexp(potential[level, :, 0] + local[level, 0, None], potential[level, :, 1] + local[level, 1, None])
            np.add.at(local, self.parent[level], up[level])  # what a node and all below it say
        belief = local.copy()
        joint = np.zeros((n, 2, 2))
        for level in self.levels:
            above = belief[self.parent[level]] - up[level]
            both = above[:, :, None] + potential[level]
            belief[level] += np.logaddexp(both[:, 0], both[:, 1])
            both += local[level][:, None, :]
            both -= both.max(axis=(1, 2), keepdims=True)
            both = np.exp(both)
            joint[level] = both / both.sum(axis=(1, 2), keepdims=True)
        return belief[:, 1] - belief[:, 0], joint


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labelled(Forest):
    """A forest whose labels are known, and the log-likelihood's gradient on it."""

    def __init__(self, pages: list[Page]):
        super().__init__(pages)
        self.label = np.array([x for p in pages for x in p.labels()], dtype=np.int64)
        self.child = self.parent >= 0
        self.seen = np.zeros((3, 2, 2))
        above = self.label[self.parent[self.child]]
        np.add.at(self.seen, (self.kind[self.child], above, self.label[self.child]), 1)

    def gradient(self, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odds, joint = self.messages(weights, pair)
        wrong = self.label - sigmoid(odds)
        expected = np.zeros((3, 2, 2))
        np.add.at(expected, self.kind[self.child], joint[self.child])
        return np.bincount(self.features, weights=wrong[self.node], minlength=DIM), self.seen - expected


def learn(pages: Iterable[str], epochs: int = EPOCHS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """``(weights, pair potentials)`` of pages whose ``data-main`` attributes mark the article."""
    memo: dict = {}
    read = [Page(p, memo) for p in pages]
    parts = [Labelled(read[i : i + BATCH]) for i in range(0, len(read), BATCH)]
    values = [np.zeros(DIM), np.zeros((3, 2, 2))]
    first, second = ([np.zeros_like(v) for v in values] for _ in range(2))
    step, steps = 0, epochs * len(parts)
    for part in parts * epochs:  # Adam, its steps growing smaller
        step += 1
        rate = RATE * (1 - (step - 1) / steps)
        for value, slope, m, v in zip(values, part.gradient(*values), first, second, strict=True):
            slope = slope / BATCH - penalty * value
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return values[0], values[1]


@cache
def default_model() -> tuple[np.ndarray, np.ndarray]:
    """The model of ``PAGES`` invented pages; the same in every run."""
    rng = random.Random(SEED)
    return learn([labelled_page(rng) for _ in range(PAGES)])


def main_texts(sources: list[str], model: tuple[np.ndarray, np.ndarray], memo: dict | None = None) -> list[str]:
    pages = [Page(s, memo) for s in sources]
    forest = Forest(pages)
    odds, _ = forest.messages(*model)
    return [p.join(odds[a:b] >= 0) for p, a, b in zip(pages, forest.starts[:-1], forest.starts[1:], strict=True)]


def extract_kernel(model: tuple[np.ndarray, np.ndarray]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            held, size, lo = [], 0, 0
            for i in range(batch.num_rows):
                source = batch.column(2)[i].as_py() or ""
                held.append(source)
                size += len(source)
                if size >= PIECE_CHARS or i == batch.num_rows - 1:
                    texts = main_texts(held, model, memo)
                    cols = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                    part = batch.slice(lo, len(held))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["page_id", "url", "text", "n_chars"])
                    held, size, lo = [], 0, i + 1

    return rows


def extract_main_text(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """One row per row of ``pages(page_id, url, html, ...)``: page_id, url, text, n_chars.

    ``text`` is the article without menus, headers, footers, sidebars, notices, adverts, forms,
    scripts and reader comments: character references decoded, white space in a block one space, blocks
    joined by a line feed; empty if there is none. ``n_chars`` counts its code points. A NULL or empty
    html gives an empty text; html that breaks off, unclosed and stray tags are read as far as they
    go; repeated rows and NULL ids are treated like others; other columns are not read.

    ``model``: what ``learn`` gives; by default that of the invented pages in ``html_pages``. It is
    about 512 KB, whatever the number of pages. No shuffle; a page is one task's.
    """
    model = default_model() if model is None else model
    types = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(extract_kernel(model), ", ".join([*types, "text string, n_chars bigint"]))


#: The article element of pages that have one, as these tables' pages do.
ORACLE = r"""
WITH a AS (
  SELECT page_id, url, string_split_regex(
    coalesce(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|\z)', 1), ''), '</?(?:p|h1)>') AS parts FROM pages),
d AS (
  SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')) AS parts
  FROM a),
t AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x:
    trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM d)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
