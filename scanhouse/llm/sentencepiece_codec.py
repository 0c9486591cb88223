"""Operator 6: SentencePiece encoding and decoding that keeps the way back to the original bytes.

The model file is read as it is. Normalisation takes the longest prefix that the model's compiled
character map knows (a double-array trie over UTF-8) and records, for every normalised byte, the
original byte that it comes from. Pieces are merged best score first, leftmost first; each piece's
normalised bytes then give its span of original bytes. Decoding looks pieces up by id.

Where no piece of the model holds the space mark after another character, merges never cross
the beginning of a run of space marks; such stretches are encoded one by one and remembered.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scanhouse.llm.common import table
from scanhouse.llm.worker import kept

MARK = "▁"
MARK_BYTES = MARK.encode()
MEMO_STRETCHES = 1_000_000

# Fixed values of the model format: kinds of pieces, field numbers of its messages.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES_FIELD, TRAINER_FIELD, NORMALIZER_FIELD = 1, 2, 3
UNK_SURFACE_FIELD, TREAT_AS_SUFFIX_FIELD = 44, 24
CHARSMAP_FIELD, DUMMY_PREFIX_FIELD, EXTRA_SPACES_FIELD, ESCAPE_FIELD = 2, 3, 4, 5


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(field number, value)`` of a protocol-buffer message."""

    def number(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[i]
            out |= (b & 0x7F) << shift
            i, shift = i + 1, shift + 7
            if b < 0x80:
                return out, i

    i = 0
    while i < len(data):
        tag, i = number(i)
        if tag & 7 == 0:
            value, i = number(i)
        else:
            n = {1: 8, 5: 4}.get(tag & 7)
            if n is None:
                n, i = number(i)
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class CharacterMap:
    """The compiled map: a double-array trie whose values point at replacement strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest known prefix at ``at`` and what replaces it; (0, b"") if none."""
        if not self.units:
            return 0, b""
        units, best, value = self.units, 0, 0
        node = self._offset(units[0])
        for i in range(at, len(text)):
            b = text[i]
            node ^= b
            unit = units[node]
            if unit & 0x800000FF != b:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best, value = i + 1 - at, units[node] & 0x7FFFFFFF
        if not best:
            return 0, b""
        return best, self.replacements[value : self.replacements.index(b"\0", value)]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


def _utf8_length(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Normalizer:
    def __init__(self, blob: bytes = b"", dummy_prefix: bool = True, extra_spaces: bool = True, escape: bool = True):
        self.map = CharacterMap(blob)
        self.dummy_prefix, self.extra_spaces, self.escape = dummy_prefix, extra_spaces, escape
        self.space = MARK_BYTES if escape else b" "

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and the end, the original byte it comes from.

        ``extra_spaces`` drops leading, trailing and repeated spaces.
        """
        if not text:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.extra_spaces:
            return self._plain(text)
        out, origin, at = bytearray(), [], 0

        def step(i: int) -> tuple[int, bytes]:
            n, new = self.map.longest(text, i)
            return (n, new) if n else ((m := _utf8_length(text[i])), text[i : i + m])

        while self.extra_spaces and at < len(text):
            n, new = step(at)
            if new != b" ":
                break
            at += n
        if at == len(text):
            return b"", np.full(1, at)
        if self.dummy_prefix:
            out += self.space
            origin += [at] * len(self.space)
        after_space = self.extra_spaces
        while at < len(text):
            n, new = step(at)
            if after_space:
                new = new.lstrip(b" ")
            if new:
                written = new.replace(b" ", self.space)
                out += written
                origin += [at] * len(written)
                after_space = self.extra_spaces and new.endswith(b" ")
            at += n
        if self.extra_spaces:
            while out.endswith(self.space):
                del out[-len(self.space) :]
                at = origin[len(out)]
                del origin[len(out) :]
        return bytes(out), np.array([*origin, at], dtype=np.int64)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """No map, no space dropped: only the prefix and the escapes, without a loop."""
        out = (self.space if self.dummy_prefix else b"") + text.replace(b" ", self.space)
        raw = np.frombuffer(text, dtype=np.uint8)
        width = np.where(raw == 0x20, len(self.space), 1)
        # bytes within a character stand for the character's first byte
        first = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(raw)), 0))
        head = np.zeros(len(out) - int(width.sum()), np.int64)
        return out, np.concatenate([head, np.repeat(first, width), [len(raw)]])


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("scanhouse-each-byte", _each_byte)


class Codec(dict):
    """Encoder and decoder of one model; as a dict, the ids of the stretches that it remembers."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, norm = {}, {}
        for number, value in fields:
            if number == PIECES_FIELD:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == TRAINER_FIELD:
                trainer = dict(_fields(value))
            elif number == NORMALIZER_FIELD:
                norm = dict(_fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(TREAT_AS_SUFFIX_FIELD, 0):
            raise ValueError("only BPE models with the space mark in front are read")
        self.normalizer = Normalizer(
            norm.get(CHARSMAP_FIELD, b""), bool(norm.get(DUMMY_PREFIX_FIELD, 1)), bool(norm.get(EXTRA_SPACES_FIELD, 1)), bool(norm.get(ESCAPE_FIELD, 1))
        )
        of_kind = lambda *kinds: {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in kinds}
        self.vocabulary = of_kind(NORMAL, USER, UNUSED)
        self.unused = set(of_kind(UNUSED).values())
        self.unknown = next(iter(of_kind(UNKNOWN).values()))
        controls = of_kind(CONTROL)
        self.begin, self.end = controls.get("<s>"), controls.get("</s>")
        self.byte_ids = {int(p[3:5], 16): i for p, i in of_kind(BYTE).items()}
        symbols = sorted(of_kind(USER), key=len, reverse=True)
        self.user = re.compile("|".join(map(re.escape, symbols))) if symbols else None
        mark_inside = any(MARK in p.lstrip(MARK) for p in self.vocabulary)
        self.stretches = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if not mark_inside and not self.user else r"[\s\S]+")
        self.dummy_dropped = self.normalizer.dummy_prefix or self.normalizer.extra_spaces
        self.widths = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.kinds, strict=True)])
        unk = trainer.get(UNK_SURFACE_FIELD, " ⁇ ".encode())
        self.surfaces = [
            b"" if k == CONTROL else unk if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode()
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]

    # encoding

    def _symbols(self, text: str) -> tuple[list[str], list[bool]]:
        if not self.user:
            return list(text), [False] * len(text)
        out, whole, at = [], [], 0
        for m in self.user.finditer(text):
            out += [*text[at : m.start()], m[0]]
            whole += [False] * (m.start() - at) + [True]
            at = m.end()
        return [*out, *text[at:]], whole + [False] * (len(text) - at)

    def _merge(self, text: str) -> list[str]:
        """Pieces of a stretch: best score first, leftmost of equals; unused pieces part again."""
        sym, whole = self._symbols(text)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap, made = [], {}
        vocabulary, scores = self.vocabulary, self.scores

        def add(i: int, j: int) -> None:
            if whole[i] or whole[j]:
                return
            piece = sym[i] + sym[j]
            k = vocabulary.get(piece)
            if k is not None:
                heapq.heappush(heap, (-scores[k], i, len(piece), j))
                if k in self.unused:
                    made[piece] = (sym[i], sym[j])

        for i in range(n - 1):
            add(i, i + 1)
        while heap:
            _, i, size, j = heapq.heappop(heap)
            if sym[i] is None or sym[j] is None or after[i] != j or len(sym[i]) + len(sym[j]) != size:
                continue
            sym[i], sym[j] = sym[i] + sym[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                add(i, k)
            if before[i] >= 0:
                add(before[i], i)
        out, todo = [], [s for s in reversed(sym) if s is not None]
        while todo:
            s = todo.pop()
            if s in made and vocabulary[s] in self.unused:
                todo += reversed(made[s])
            else:
                out.append(s)
        return out

    def __missing__(self, stretch: str) -> bytes:
        ids = []
        for piece in self._merge(stretch):
            k = self.vocabulary.get(piece)
            if k is not None:
                ids.append(k)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in piece.encode()]
            else:
                ids.append(self.unknown)
        out = np.array(ids, dtype="<u4").tobytes()
        if len(self) >= MEMO_STRETCHES:
            self.clear()
        if len(stretch) < 256:
            self[stretch] = out
        return out

    def _unknown_widths(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and normalised widths for a model without byte pieces, where neighbouring unknown
        pieces are one."""
        pieces = [p for s in stretches for p in self._merge(s)]
        ids = np.array([self.vocabulary.get(p, self.unknown) for p in pieces], dtype="<u4")
        widths = np.array([len(p.encode()) for p in pieces], dtype=np.int64)
        first = np.concatenate([[True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)])[: len(ids)]
        return ids[first], np.add.reduceat(widths, np.flatnonzero(first)) if len(ids) else widths

    def encode(self, text: str, begin: bool = True, end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and each one's span of the original UTF-8 bytes (empty for begin and end ids; of
        a character given byte by byte, the last byte has its span)."""
        raw = text.encode()
        norm, origin = self.normalizer.normalise(raw)
        stretches = self.stretches.findall(norm.decode())
        if self.byte_ids:
            ids = np.frombuffer(b"".join(map(self.__getitem__, stretches)), dtype="<u4")
            widths = self.widths[ids]
        else:
            ids, widths = self._unknown_widths(stretches)
        ends = np.cumsum(widths)
        starts, stops = origin[ends - widths], origin[ends]
        if begin:
            ids, starts, stops = (np.concatenate([[x], a]) for x, a in ((self.begin, ids), (0, starts), (0, stops)))
        if end:
            ids, starts, stops = (np.concatenate([a, [x]]) for x, a in ((self.end, ids), (len(raw), starts), (len(raw), stops)))
        return ids.astype("<u4"), starts, stops

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks are spaces, the first one goes, each bad byte is U+FFFD."""
        ids = ids.tolist()
        parts = list(map(self.surfaces.__getitem__, ids))
        if self.dummy_dropped:
            for n, k in enumerate(ids):
                if self.kinds[k] == CONTROL:
                    continue
                if self.kinds[k] in (NORMAL, USER, UNUSED) and parts[n][:1] == b" " and self.pieces[k][0] == MARK:
                    parts[n] = parts[n][1:]
                break
        return b"".join(parts).decode("utf-8", "scanhouse-each-byte")


ENCODED = "ids array<int>, starts array<bigint>, stops array<bigint>, decoded string"


def codec_kernel(path: str, digests: bool):
    """Of (doc_id, text): ids, spans and the decoded text, or their number and digests."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs.register_error("scanhouse-each-byte", _each_byte)
        codec = kept(("sentencepiece", path), lambda: Codec(path))
        for batch in batches:
            out = []
            for text in batch.column(1):
                ids, starts, stops = codec.encode(text.as_py() or "")
                decoded = codec.decode(ids)
                if digests:
                    out.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                else:
                    out.append((ids.astype(np.int32), starts, stops, decoded))
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "starts", "stops", "decoded"]
            kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
            cols = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *names])

    return rows


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, ids with begin and end ids, starts
    and stops (each id's span of the text's UTF-8 bytes) and the text decoded from the ids.

    A NULL text is an empty one, of the begin and end ids only. Repeated rows and NULL ids
    are encoded like others; other columns are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(codec_kernel(path, False), f"doc_id {id_type}, {ENCODED}")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """``encode_decode`` with its arrays and texts as their number and digests, made in the task."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(codec_kernel(path, True), schema)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
