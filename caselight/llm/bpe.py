"""Byte-level BPE encoding and decoding by a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary resolves a whole pre-token that is
itself in the vocabulary. Second tier: other pre-tokens are merged by a heap of adjacent
pairs over a linked list of bytes. Pre-tokens met before in a worker come from a bounded
memo in front of the two tiers.

Defined cases: a null text is empty and has no ids; repeated rows, null doc_ids and texts
of any length are encoded like any other; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import BPE_RANKS, doc_texts

#: Pre-tokens kept in a worker's memo; it is emptied when full.
MEMO_ENTRIES = 700_000
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PerfectHash:
    """Minimal perfect hash: n keys in n slots, one displacement per bucket of keys."""

    ODD, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def _at(self, h: int, move: int) -> int:
        return ((((h ^ move) * self.ODD) & self.MASK) >> 24) % self.n

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // 3)
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, i))
        self.moves = [0] * self.buckets
        self.slots: list[int] = [-1] * n
        free = 0
        for bucket, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:  # the last buckets go straight to what is left
                while self.slots[free] >= 0:
                    free += 1
                self.moves[bucket], self.slots[free] = -1 - free, members[0][1]
                continue
            move = 0
            while True:
                at = [self._at(h, move) for h, _ in members]
                if len(set(at)) == len(at) and all(self.slots[a] < 0 for a in at):
                    break
                move += 1
            self.moves[bucket] = move
            for a, (_, i) in zip(at, members, strict=True):
                self.slots[a] = i

    def slot(self, key: bytes) -> int:
        """The one place where this key can be; the caller compares the key kept there."""
        h = xxhash.xxh64_intdigest(key)
        move = self.moves[h % self.buckets]
        return self.slots[-1 - move if move < 0 else self._at(h, move)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE ids of a piece: the lowest-ranked adjacent pair joins first, the leftmost of equals."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it has been joined
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not end[i] or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Memo(dict):
    """Ids of pre-tokens as little-endian bytes, worked out when first asked for."""

    def __init__(self, bpe: ByteBPE) -> None:
        self.bpe = bpe

    def __missing__(self, token: str) -> bytes:
        ids = np.array(self.bpe.encode_piece(token.encode()), "<u4").tobytes()
        if len(token) < 200:
            self[token] = ids
        return ids


class ByteBPE:
    """Encoder and decoder for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks = ranks
        self.tokens = list(ranks)
        self.ids = list(ranks.values())
        self.by_id = {i: token for token, i in ranks.items()}
        self.hash = PerfectHash(self.tokens)
        self.split = regex.compile(pattern).findall
        self.memo = Memo(self)

    def encode_piece(self, piece: bytes) -> list[int]:
        at = self.hash.slot(piece)
        return [self.ids[at]] if self.tokens[at] == piece else merge(piece, self.ranks)

    def encode_bytes(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids))


@lru_cache(maxsize=2)
def load(ranks_path: str) -> ByteBPE:
    with open(ranks_path, "rb") as lines:
        return ByteBPE({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


def encode_documents(docs: DataFrame, ranks_path: str = BPE_RANKS) -> DataFrame:
    """doc_id and ids (array<int>) of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(ranks_path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": [bpe.encode(x) for x in batch["text"]]})

    return doc_texts(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str = BPE_RANKS) -> DataFrame:
    """doc_id and text of every row of ids (null: empty); bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(ranks_path)
        for batch in batches:
            texts = ["" if x is None else bpe.decode([int(i) for i in x]).decode("utf-8", "replace") for x in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": texts})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, ranks_path: str = BPE_RANKS) -> DataFrame:
    """Encodes and decodes every text; counts and digests of both sides (columns ENCODED)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(ranks_path)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                packed = bpe.encode_bytes(text)
                back = bpe.decode(np.frombuffer(packed, "<u4").tolist())
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").values)
            yield out

    return doc_texts(docs).mapInPandas(run, ENCODED)
