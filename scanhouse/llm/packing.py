"""Operator 3: bulk-synchronous best-fit packing of token sequences.

Supersteps go down the lengths, halving each time. In each, the documents of that length range
and the gaps of the open sequences are range-sorted and dealt by rank to shares of bounded size,
so that every share sees the same mix; a share sweeps its documents from the longest down, each
to the successor of its length among the gaps (the smallest gap that holds it). Equal documents
and equal gaps are matched by rank. What finds no gap opens a sequence. The changed gaps are
written to the shared folder, and the next superstep sorts and deals them anew.

Shares are the only loss against one global sweep: at most the open sequences of a share's end.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanhouse.llm.common import materialise, table
from scanhouse.llm.shingles import text_buffers
from scanhouse.llm.token_counts import byte_symbols
from scanhouse.llm.worker import forget, kept

CAPACITY = 4096
#: Rows (documents and gaps) that one share holds in memory.
SHARE_ROWS = 200_000
#: Supersteps: lengths over capacity/2, /4, ... and the rest.
HALVINGS = 6
#: Bytes of words and their ids that a worker remembers, in two generations of half as many; a word
#: is counted with WORD_BYTES for its place in the table and the heads of two bytes objects.
MEMO_BYTES, WORD_BYTES = 48 << 20, 180
CHUNK = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"
#: Letters that have one code point each, also in small (Latin-1), and marks that are words of their own to
#: this tokenizer (no apostrophe, which it takes with some letters, and no sign of its special tokens).
LETTERS, MARKS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:;=?@\[-`{}~"
ODD = re.compile(f"[^{LETTERS}{MARKS} ]")
#: Runs of small letters and of marks in Latin-1.
PART = re.compile(rb"[a-z\xdf-\xf6\xf8-\xff]+|[" + MARKS.encode() + rb"]+")
SPACES = bytes.maketrans(_SPACE, b" " * len(_SPACE))
SMALL = bytes(range(256)).decode("latin-1").translate({c: c + 32 for c in (*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF))}).encode("latin-1")

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class WordIds(dict):
    """Token ids (little-endian 32-bit) of words without ASCII white space, which this tokenizer
    drops and never merges across. Marks beside letters are words of their own to it, and it
    lower-cases, so of words of Latin letters and marks only the runs of small letters and of marks
    are kept (in Latin-1, which no UTF-8 of another word is), each one word of its model. Other
    words are taken whole; all are if an added token has such letters and marks alone."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size, self.older = 0, {}
        self.plain = sys.byteorder == "little" and not any(
            re.fullmatch(f"[{LETTERS}{MARKS}]+", t.content) for t in self.tokenizer.get_added_tokens_decoder().values()
        )
        symbols = byte_symbols()
        self.symbols = {c: "".join(symbols[b] for b in chr(c).encode()) for c in range(256)}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.pop(word, None) or self._ids(word)
        self.size += WORD_BYTES + len(word) + len(ids)
        if self.size > MEMO_BYTES // 2:  # what wasn't asked for since the last time goes
            self.older = dict(self)
            self.clear()
            self.size = WORD_BYTES + len(word) + len(ids)
        self[word] = ids
        return ids

    def _ids(self, word: bytes) -> bytes:
        if self.plain and PART.fullmatch(word):
            return array("I", [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.symbols))]).tobytes()
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def of(self, text: bytes) -> bytes:
        """The ids of a text that begins and ends where words do."""
        if not self.plain:
            return b"".join([self[w] for w in text.split()])
        text, lo, out = text.translate(SPACES).decode(), 0, []
        while odd := ODD.search(text, lo):
            at = max(lo, text.rfind(" ", lo, odd.start()) + 1)
            hi = text.find(" ", odd.start())
            hi = len(text) if hi < 0 else hi
            out += [self._parts(text[lo:at]), self[text[at:hi].encode()]]
            lo = hi
        return b"".join([*out, self._parts(text[lo:])])

    def _parts(self, text: str) -> bytes:
        return b"".join([self[p] for p in PART.findall(text.encode("latin-1").translate(SMALL))])


def chunks(text: bytes) -> Iterator[bytes]:
    """The text in parts of about CHUNK bytes that end before white space."""
    lo = 0
    while lo < len(text):
        hi = lo + CHUNK
        while hi < len(text) and text[hi] not in _SPACE:
            hi += 1
        yield text[lo:hi]
        lo = hi


def pieces_of(text: bytes, words: WordIds, end_id: int, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """``(piece, start, length, crc32)`` of a text's ids and the end id, cut at the capacity."""
    size, held, start, piece = 4 * capacity, b"", 0, 0
    for part in chunks(text):
        held += words.of(part)
        while len(held) > size:
            yield piece, start, capacity, zlib.crc32(held[:size])
            held, start, piece = held[size:], start + capacity, piece + 1
    held += end_id.to_bytes(4, "little")
    while held:
        yield piece, start, len(held[:size]) // 4, zlib.crc32(held[:size])
        held, start, piece = held[size:], start + capacity, piece + 1


def piece_kernel(path: str, end_id: int, capacity: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(("word ids", path), lambda: WordIds(path))
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            raw = data.data
            at, out = [], []
            for i in range(batch.num_rows):
                for p in pieces_of(bytes(raw[offsets[i] : offsets[i + 1]]), words, end_id, capacity):
                    at.append(i)
                    out.append(p)
            piece, start, length, crc = (np.array(x, dtype=np.int64) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
            cols = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows


def token_pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids of ``docs(doc_id, text, ...)``; a NULL text is empty."""
    return docs.select("doc_id", "text").mapInArrow(piece_kernel(path, end_id, capacity), PIECES)


# --- supersteps -----------------------------------------------------------------------


def best_fit(lengths: np.ndarray, seqs: np.ndarray, gaps: np.ndarray, capacity: int, first_new: int):
    """Sweep lengths (longest first) over the gaps: ``(sequence and offset of each, seqs, gaps)``.

    Gaps are stacks by size and a bit set of the sizes in use, so a successor is its lowest set
    bit at or above the length.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for s, g in zip(seqs[::-1].tolist(), gaps[::-1].tolist(), strict=True):
        stacks[g].append(s)
        used |= 1 << g
    seq_out, off_out, new = [], [], first_new
    for n in lengths.tolist():
        above = used >> n
        if above:
            g = n + (above & -above).bit_length() - 1
            s = stacks[g].pop()
            if not stacks[g]:
                used &= ~(1 << g)
        else:
            g, s, new = capacity, new, new + 1
        seq_out.append(s)
        off_out.append(capacity - g)
        stacks[g - n].append(s)
        used |= 1 << (g - n)
    left = [(s, g) for g in range(1, capacity + 1) for s in stacks[g]]
    s, g = (np.array(x, dtype=np.int64) for x in zip(*left, strict=True)) if left else (np.zeros(0, np.int64),) * 2
    return np.array(seq_out, dtype=np.int64), np.array(off_out, dtype=np.int64), s, g


def sweep_kernel(step: int, columns: list[str], capacity: int):
    def sweep(key, docs: pa.Table, gaps: pa.Table) -> pa.Table:
        forget()  # the words of the pieces
        docs = docs.sort_by([("length", "descending"), ("rank", "ascending")])
        gaps = gaps.sort_by([("gap", "ascending"), ("sequence_id", "ascending")])
        first = (step << 56) + (key[0].as_py() << 32)
        sides = [t.column(c).to_numpy() for t, c in ((docs, "length"), (gaps, "sequence_id"), (gaps, "gap"))]
        seq, off, s, g = best_fit(*sides, capacity, first)
        placed = docs.select(columns)
        for name, values in (("sequence_id", seq), ("offset", off), ("gap", np.zeros(len(seq), np.int64))):
            placed = placed.append_column(name, pa.array(values))
        open_ = {c: pa.nulls(len(s), placed.schema.field(c).type) for c in columns}
        open_ |= {"sequence_id": pa.array(s), "offset": pa.array(np.full(len(s), -1)), "gap": pa.array(g)}
        return pa.concat_tables([placed, pa.table(open_, schema=placed.schema)])

    return sweep


def dealt(df: DataFrame, order: list, shares: int) -> DataFrame:
    """``df`` range-sorted by ``order``, with ``rank`` (sorted position in its part, then the part)
    and the share that each row is dealt to by it."""
    df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df = df.withColumn("_at", F.monotonically_increasing_id())
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    return df.withColumn("rank", F.col("_at")).withColumn("share", F.pmod(part + at, F.lit(shares)).cast("int")).drop("_at")


def pack(items: DataFrame, capacity: int = CAPACITY, share_rows: int = SHARE_ROWS) -> DataFrame:
    """Place every row of ``items(length, ...)`` (1 <= length <= capacity): adds sequence_id, offset.

    Rows in a sequence lie end to end from offset 0. All rows are placed, repeated ones too, each
    once; ties are broken by the other columns, NULLs first. No rows give no sequences. Columns
    that are called sequence_id or offset are replaced.
    """
    names = [c for c in items.columns if c not in ("sequence_id", "offset")]
    columns = ["length", *[f"c{i}" for i, c in enumerate(names) if c != "length"]]  # clash with none used here
    given = ["length", *[c for c in names if c != "length"]]
    items = items.select(*[F.col(f"`{c}`").alias(new) for c, new in zip(given, columns, strict=True)])
    step_of = F.least(F.lit(HALVINGS), F.floor(F.log2(F.lit(float(capacity)) / F.col("length")))).cast("int")
    items = materialise(items.withColumn("step", step_of), "items")
    counts = {r[0]: r[1] for r in items.groupBy("step").count().collect()}  # HALVINGS + 1 rows
    types = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in columns)
    gaps = items.sparkSession.createDataFrame([], "sequence_id bigint, gap bigint")
    placed, n_gaps = items.where("false").selectExpr(*columns, "0L AS sequence_id", "0L AS offset"), 0
    for step in sorted(counts):
        shares = -(-(counts[step] + n_gaps) // share_rows)
        docs = dealt(items.where(F.col("step") == step).drop("step"), [F.desc("length"), *columns[1:]], shares)
        open_ = dealt(gaps, [F.asc("gap"), F.asc("sequence_id")], shares).drop("rank")
        swept = docs.groupBy("share").cogroup(open_.groupBy("share")).applyInArrow(
            sweep_kernel(step, columns, capacity), f"{types}, sequence_id bigint, offset bigint, gap bigint"
        )
        swept = materialise(swept, f"packed-{step}")
        placed = placed.unionByName(swept.where("offset >= 0").drop("gap"))
        gaps = swept.where("offset < 0").select("sequence_id", "gap")
        n_gaps = gaps.count()
    back = dict(zip(given, columns, strict=True))
    return placed.select(*[F.col(back[c]).alias(c) for c in names], "sequence_id", "offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces)
