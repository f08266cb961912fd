"""Encoding of a corpus with a public byte-level BPE vocabulary.

Texts are split into pieces by the vocabulary's pattern, and each piece is merged by its own priority queue: all neighbouring
pairs that the vocabulary knows wait in a heap by merge rank, symbols form a doubly linked list, and heap entries whose symbols
have changed since are skipped. A piece of ``n`` bytes costs O(n log n), whatever its length. Pieces recur, so each Python
worker keeps the ids of pieces up to ``KEEP_LETTERS`` letters; the memory for them is bounded and they do not change results.

The vocabulary file is read on the driver (its path is a parameter) and broadcast: at most ``MAX_VOCABULARY_BYTES``.

Defined cases: null and empty texts give an empty list; blanks are encoded like any other text; strings of special tokens are
ordinary text; lone surrogates, which UTF-8 cannot hold, count as the replacement character; each row of the input gives
one row; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("BASINWEAVE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
MAX_VOCABULARY_BYTES = 64 << 20
#: Ids in one output batch, but for those of its last text.
MOST_IDS = 1_000_000
KEEP_LETTERS, KEEP_PIECES = 32, 400_000

#: How the public vocabulary cuts a text into pieces (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks by byte string, of a file with a base64 string and a rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    symbols: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    before = list(range(-1, n - 1))
    after = [*range(1, n), -1]
    get = ranks.get
    heap = [(r, i, 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        left = symbols[i]
        if left is None:
            continue
        j = after[i]
        if j < 0 or len(left) + len(symbols[j]) != size:
            continue  # a stale entry: one of its symbols has grown since
        merged = left + symbols[j]
        symbols[i], symbols[j] = merged, None
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := get(merged + symbols[k])) is not None:
                heapq.heappush(heap, (r, i, size + len(symbols[k])))
        h = before[i]
        if h >= 0 and (r := get(symbols[h] + merged)) is not None:
            heapq.heappush(heap, (r, h, len(symbols[h]) + size))
    return tuple(ranks[s] for s in symbols if s is not None)


class Encoder(dict):
    """Ids of pieces; unknown pieces are merged when they are asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.find = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = merge_piece(piece.encode("utf-8", "replace"), self.ranks)
        if len(piece) <= KEEP_LETTERS:
            if len(self) >= KEEP_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> array:
        """Ids of one text."""
        if not text:
            return array("i")
        return array("i", chain.from_iterable(map(self.__getitem__, self.find(text))))

    def decode(self, ids) -> str:
        """Text of ids: the vocabulary's strings, one after the other."""
        strings = getattr(self, "strings", None)
        if strings is None:
            strings = self.strings = {i: s for s, i in self.ranks.items()}
        return b"".join(strings[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids) of every document. Narrow: documents stay in their partition."""
    path = vocabulary or VOCABULARY
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    key = hash((path, os.path.getmtime(path)))
    id_type = documents.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(key)
        if encoder is None:
            encoder = _ENCODERS[key] = Encoder(read_ranks(shared.value))
        encode = encoder.encode
        def packed(batch: pa.RecordBatch, first: int, sizes: list[int], ids: array) -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(ids, dtype=np.int32) if ids else np.empty(0, np.int32)))
            return pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sizes)), lists], names=[id_col, "ids"])

        for batch in batches:
            first, sizes, ids = 0, [], array("i")
            for at, text in enumerate(batch.column(1)):
                got = encode(text.as_py())
                sizes.append(len(got))
                ids.extend(got)
                if len(sizes) == 256 or len(ids) >= MOST_IDS:  # bounded output batches, however long the texts are
                    yield packed(batch, first, sizes, ids)
                    first, sizes, ids = at + 1, [], array("i")
            if sizes:
                yield packed(batch, first, sizes, ids)

    return documents.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")
