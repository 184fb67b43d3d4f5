"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file is brought to the library's form: every byte has a printable character, and every split
of a token into two lower-ranked tokens is a merge at the token's rank. So the library merges just
what a rank table merges. Pieces of the splitting pattern are encoded once for each task and kept in
a bounded table. Decoding reverses the byte table; a character may be split between tokens, so bytes
are joined before they become text.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import batches_of, others, ship

ship(__name__)

#: Pieces kept for a task, and the longest piece that is kept.
KEPT_PIECES, KEPT_CHARS = 200_000, 64


def byte_characters() -> list[str]:
    """Character of each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in printable}
    for b in range(256):
        out.setdefault(b, chr(0x100 + b - sum(p < b for p in printable)))
    return [out[b] for b in range(256)]


class Pieces(dict):
    """Ids of each piece, encoded by the library on first use."""

    def __init__(self, model):
        super().__init__()
        self.tokens_of = model.tokenize
        self.characters = dict(enumerate(byte_characters()))

    def __missing__(self, piece: str) -> bytes:
        spelled = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.characters)
        ids = np.array([t.id for t in self.tokens_of(spelled)], "<u4").tobytes()
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one rank file; made once for each task, the encoder when first asked for."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = pattern
        self.token_bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token_bytes[rank] = token
        self.token_sizes = np.array([len(t) for t in self.token_bytes], np.int64)

    @cached_property
    def pieces_of(self):
        import regex

        return regex.compile(self.pattern).findall

    @cached_property
    def kept(self) -> Pieces:
        from tokenizers import models

        of, ranks = byte_characters(), self.ranks
        chars = {token: "".join(map(of.__getitem__, token)) for token in ranks}
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(token)):
                a, b = token[:i], token[i:]
                if ranks.get(a, rank) < rank and ranks.get(b, rank) < rank:
                    merges.append((chars[a], chars[b]))
        return Pieces(models.BPE(vocab={chars[t]: r for t, r in ranks.items()}, merges=merges))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.kept.__getitem__, self.pieces_of(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> tuple[list[int], list[int]]:
        """Start and end of each token in code points; a split character belongs to all its tokens."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        ends = np.cumsum(self.token_sizes[np.frombuffer(ids, "<u4")])
        begun = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters begun before a byte
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        first = begun[np.minimum(starts + 1, len(raw))] - 1 if len(ends) else starts
        return first.tolist(), begun[ends].tolist()


def codec(path: str, pattern: str) -> Codec:
    """The codec of this process: tasks that share a Python worker share it."""
    loaded = sys.__dict__.setdefault("_corpusloom_codecs", {})
    if (path, pattern) not in loaded:
        loaded[path, pattern] = Codec(path, pattern)
    return loaded[path, pattern]


def bpe_encode(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", offsets: bool = False
) -> DataFrame:
    """``docs`` with ``ids``, the token ids as little-endian unsigned 32-bit integers in one binary.

    With ``offsets`` also ``starts`` and ``ends``, the code points that each token covers. Each match
    of ``pattern`` is encoded apart and whole; there are no special tokens, their strings are text.
    A null or empty text has no ids. Repeated rows are encoded one by one, an empty table gives none;
    other columns stay, but for those of the names of the new ones. Nothing is shuffled. ``path`` is
    a file that all executors have.
    """
    new = [("ids", "binary"), ("starts", "array<bigint>"), ("ends", "array<bigint>")][: 3 if offsets else 1]
    keep = others(docs, *dict(new))
    place = (rows := docs.select(*keep, text_of_column(docs, text_col))).columns.index("_bpe_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for whole in batches:
            for batch in batches_of(whole, 500):
                texts = [t or "" for t in batch.column(place).to_pylist()]
                ids = [own.encode(t) for t in texts]
                made = [pa.array(ids, pa.binary())]
                if offsets:
                    spans = [own.offsets(t, i) for t, i in zip(texts, ids)]
                    made += [pa.array([s[k] for s in spans], pa.list_(pa.int64())) for k in (0, 1)]
                kept = [c for i, c in enumerate(batch.columns) if i != place]
                yield pa.RecordBatch.from_arrays(kept + made, keep + [n for n, _ in new])

    schema = docs.select(*keep).schema
    for name, kind in new:
        schema = schema.add(name, kind_of(kind))
    return rows.mapInArrow(run, schema)


def bpe_decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the bytes of the ids in ``ids_col``; null ids decode to none.

    Text is ``decode('utf-8')`` of it: bytes are joined first, so that characters that were split
    between tokens are whole again.
    """
    keep = others(rows, "decoded")
    place = keep.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for whole in batches:
            for batch in batches_of(whole, 500):
                out = [own.decode(i or b"") for i in batch.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*keep, "decoded"])

    return rows.select(*keep).mapInArrow(run, rows.select(*keep).schema.add("decoded", kind_of("binary")))


def text_of_column(docs: DataFrame, text_col: str):
    return docs[text_col].alias("_bpe_text")


def kind_of(ddl: str):
    from pyspark.sql.types import ArrayType, BinaryType, LongType

    return BinaryType() if ddl == "binary" else ArrayType(LongType())
