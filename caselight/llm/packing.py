"""Best-fit packing of tokenised documents into sequences of a fixed length.

Method: bounded-space online best-fit. A fixed number of bins is open at a time. A bitset
with one bit per amount of free space finds the fullest bin that still takes a piece (the
lowest set bit at or above its length); when too many bins are open, the fullest closes.
Pieces arrive in the order of a hash and pass a buffer of a fixed size, which hands on its
longest first; so a packer holds OPEN_BINS bins and REORDERED pieces, whatever its input.

Defined cases: a null or empty text is a document of one token (the end mark); repeated
rows are packed each for itself; a null doc_id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import BPE_RANKS, doc_texts, file_partitions

SEQUENCE_TOKENS = 2048
#: Bins that a packer has open, at most.
OPEN_BINS = 1024
#: Pieces that are put in order together, longest first, before they are placed.
REORDERED = 4096
END_ID = 0
#: The vocabulary's one special token; its string in a text is read as that token.
SPECIAL = {"<|endoftext|>": 50256}
#: So many reading tasks' pieces are packed together, which leaves few half-filled bins.
TASKS_A_PACKER = 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoding(ranks_path: str) -> tiktoken.Encoding:
    """The byte-level BPE vocabulary; its ids are those of the same vocabulary's json form."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(text: str, ranks_path: str = BPE_RANKS) -> np.ndarray:
    """A document's ids, the end mark included."""
    try:
        ids = encoding(ranks_path).encode_to_numpy(text, allowed_special="all")
    except ValueError:  # white space so long that the library's pattern gives up
        ids = np.array(_own_ids(text, ranks_path), "<u4")
    return np.append(ids, END_ID).astype("<u4")


def _own_ids(text: str, ranks_path: str) -> list[int]:
    """The same ids by the encoder of op5, whose pattern takes texts of any length."""
    ((mark, number),) = SPECIAL.items()
    first, *rest = [bpe.load(ranks_path).encode(part) for part in text.split(mark)]
    return first + [i for ids in rest for i in (number, *ids)]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, behind a first that may be shorter."""
    head = n % size
    bounds = ([0] if head else []) + list(range(head, n, size))
    return list(zip(bounds, [b - a for a, b in zip(bounds, [*bounds[1:], n], strict=True)], strict=True))


class OpenBins:
    """The open bins of one packer, in a bitset keyed by free space."""

    def __init__(self, size: int = SEQUENCE_TOKENS, limit: int = OPEN_BINS) -> None:
        self.size, self.limit, self.bits, self.open, self.made = size, limit, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin for a piece of this length, and the piece's place in it."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(free)
        else:
            free, chosen = self.size, self.made
            self.made += 1
        left = free - length
        if left:
            self.bins[left].append(chosen)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return chosen, self.size - free


def pieces(docs: DataFrame, size: int = SEQUENCE_TOKENS, ranks_path: str = BPE_RANKS) -> DataFrame:
    """Each document's pieces, with a checksum of their ids."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                ids = token_ids(text, ranks_path)
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return doc_texts(docs).mapInPandas(split, PIECES)


def _longest_first(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The rows in buffers of one size, each with its longest pieces first; equals keep their order."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        while sum(map(len, held)) >= size:
            rows = pd.concat(held, ignore_index=True)
            yield rows[:size].sort_values("length", ascending=False, kind="stable")
            held = [rows[size:]]
    if held:
        yield pd.concat(held, ignore_index=True).sort_values("length", ascending=False, kind="stable")


def pack(found: DataFrame, packers: int, size: int = SEQUENCE_TOKENS, limit: int = OPEN_BINS, reordered: int = REORDERED) -> DataFrame:
    """Adds sequence_id and offset to pieces. Each packer fills sequences of its own.

    The pieces are dealt round, whatever their document or source, and come to a packer in the
    order of a hash, so one that runs again makes the same sequences.
    """

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = OpenBins(size, limit)
        first = TaskContext.get().partitionId() << 40
        for batch in _longest_first(batches, reordered):
            places = [bins.place(n) for n in batch["length"].tolist()]
            batch["sequence_id"] = [first + b for b, _ in places]
            batch["offset"] = [at for _, at in places]
            yield batch.astype({"doc_id": "Int64"})

    dealt = found.repartition(packers).sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "ids_crc32", "length")
    return dealt.mapInPandas(fill, PACKED)


def pack_documents(docs: DataFrame, size: int = SEQUENCE_TOKENS, limit: int = OPEN_BINS, ranks_path: str = BPE_RANKS) -> DataFrame:
    """Tokenises and packs every document; one row per piece (columns PACKED)."""
    packers = -(-file_partitions(docs) // TASKS_A_PACKER)
    return pack(pieces(docs, size, ranks_path), packers, size, limit)
