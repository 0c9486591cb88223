"""Operator 2: token counts by byte-pair merging with a heap over a linked list.

A count needs no identifiers: it is a word's initial symbols minus the merges. Merging pops the
lowest-ranked adjacent pair (the leftmost of equals), joins it in the list and pushes the two
pairs that it makes. Words recur, so a worker remembers the counts of those it has met.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanhouse.llm.common import table
from scanhouse.llm.worker import kept

LIMIT = 512
MEMO_WORDS = 1_000_000
#: Characters of text that are cut up at once.
CHUNK = 1 << 20
#: Between two characters that aren't white space, a space always begins a new word.
CUT = re.compile(r"(?<=\S)(?= \S)")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it can be printed in Latin-1, or else
    the next unused one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def merge_count(symbols: list, ranks: dict) -> int:
    """Symbols that are left when no adjacent pair has a rank."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    symbols = list(symbols)
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # one of the two has merged meanwhile
        symbols[i], symbols[j] = a + b, None
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return left


class WordCounts(dict):
    """Token counts of stretches of text that begin and end where words do."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        merges = model["model"]["merges"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(merges)}
        self.added = [t["content"] for t in model["added_tokens"]]
        self.symbols = byte_symbols()
        # white space as Unicode has it; Python's own class holds four more characters
        self.words = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def __missing__(self, stretch: str) -> int:
        words = self.words.findall(stretch)
        if len(words) == 1:
            n = merge_count([self.symbols[b] for b in stretch.encode()], self.ranks)
        else:
            n = sum(map(self.__getitem__, words))
        if len(self) >= MEMO_WORDS:
            self.clear()
        if len(stretch) < 256:
            self[stretch] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text; each added token's string counts as one and parts the rest."""
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(self._plain(p) for p in parts)

    def _plain(self, text: str) -> int:
        lo, n = 0, 0
        while lo < len(text):
            cut = CUT.search(text, lo + CHUNK) if lo + CHUNK < len(text) else None
            hi = cut.start() if cut else len(text)
            n += sum(map(self.__getitem__, CUT.split(text[lo:hi])))
            lo = hi
        return n


def count_kernel(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = kept(("word counts", path), lambda: WordCounts(path))
        for batch in batches:
            n = [counts.count(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return rows


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_bytes, n_tokens, over_limit.

    ``path``: a byte-level BPE file of the tokenizers library. A NULL text is an empty one, of no
    bytes and no tokens. Repeated rows and NULL ids are counted like others; other columns
    are not read.
    """
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(count_kernel(path), f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
