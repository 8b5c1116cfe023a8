"""Document fingerprints from prefix polynomial hashes.

PrefixHash keeps, for one text, modular prefix sums of its code points times powers of two
bases. Any two spans are compared in constant time, and the longest common extension of two
positions is found by binary search. A document's fingerprint is made from such span hashes:
the hash of the whole text, and the least hash among all windows of 12 code points in each of
128 bins, shortened to eight bits. The likeness of two fingerprints is the share of bins that
agree among those which either has filled; it estimates the share of windows in common. How
far a text and its edited form agree from their starts and from their ends are two extensions.

Defined cases: a null text is empty; two empty texts are alike (1.0), an empty and another are
not (0.0); rows with the same doc_id follow each other by a hash of their texts; null doc_ids
come after all others, in the same order; with one document, the next is itself; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, file_partitions

PRIME = (1 << 31) - 1
BASES = (1_000_003, 998_244_353)
WINDOW, BINS = 12, 128
NO_ID = -(1 << 63)
#: Ranges of ids for each task, as they are dealt by hash; the driver gets a row for each range, and so many at most.
RANGES_A_TASK, MOST_RANGES = 6, 60_000

EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "common_prefix long, common_suffix long"
)


def _mod(x: np.ndarray) -> np.ndarray:
    """Residues of numbers below 2^62."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


class _Powers:
    """Powers of a base and of its inverse, as far as the longest text so far needs."""

    def __init__(self, base: int) -> None:
        self.base = (base, pow(base, -1, PRIME))
        self.up, self.down = (np.ones(1, np.uint64) for _ in range(2))

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up, self.down = (self._grown(x, b, size) for x, b in zip((self.up, self.down), self.base, strict=True))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _grown(x: np.ndarray, base: int, size: int) -> np.ndarray:
        while len(x) < size:
            x = np.concatenate((x, _mod(x * np.uint64(pow(base, len(x), PRIME)))))
        return x


_POWERS = [_Powers(b) for b in BASES]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class PrefixHash:
    """Prefix hashes of one sequence of code points."""

    def __init__(self, points: np.ndarray) -> None:
        self.n = len(points)
        shifted = points.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for powers in _POWERS:
            terms = _mod(shifted * powers.to(self.n + 1)[0][: self.n])
            self.sums.append(_mod(np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))))

    def spans(self, starts: np.ndarray, length: int) -> np.ndarray:
        """62-bit hashes of the spans of this length at these places."""
        parts = []
        for powers, sums in zip(_POWERS, self.sums, strict=True):
            down = powers.to(self.n + 1)[1]
            parts.append(_mod(_mod(sums[starts + length] + np.uint64(PRIME) - sums[starts]) * down[starts]))
        return (parts[0] << np.uint64(31)) | parts[1]

    def windows(self, length: int) -> np.ndarray:
        """The hashes of all spans of this length."""
        parts, m = [], self.n - length + 1
        for powers, sums in zip(_POWERS, self.sums, strict=True):
            down = powers.to(self.n + 1)[1]
            parts.append(_mod(_mod(sums[length:] + np.uint64(PRIME) - sums[:m]) * down[:m]))
        return (parts[0] << np.uint64(31)) | parts[1]

    def span(self, start: int, length: int) -> int:
        """The hash of one span."""
        first, second = (
            (int(sums[start + length]) - int(sums[start])) % PRIME * int(powers.to(self.n + 1)[1][start]) % PRIME
            for powers, sums in zip(_POWERS, self.sums, strict=True)
        )
        return first << 31 | second

    def equal(self, start: int, other: PrefixHash, other_start: int, length: int) -> bool:
        return self.span(start, length) == other.span(other_start, length)

    def common_extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """How many code points from both places on are the same."""
        return _most(min(self.n - start, other.n - other_start), lambda k: self.equal(start, other, other_start, k))

    def common_suffix(self, other: PrefixHash) -> int:
        """How many code points at the ends of both texts are the same."""
        return _most(min(self.n, other.n), lambda k: self.equal(self.n - k, other, other.n - k, k))


def _most(high: int, holds: Callable[[int], bool]) -> int:
    """The largest number up to `high` for which something holds that holds for all smaller ones, by halves."""
    low = 0
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if holds(mid) else (low, mid - 1)
    return low


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def fingerprint(text: str) -> str:
    return fingerprint_of(PrefixHash(code_points(text)))


def fingerprint_of(hashed: PrefixHash) -> str:
    """Hex digits: 16 of the whole text's hash, then two for each bin (00: empty)."""
    whole = (hashed.span(0, hashed.n) * 31 + hashed.n) & ((1 << 64) - 1)
    bins = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    if hashed.n:
        mixed = _mixed(hashed.windows(min(WINDOW, hashed.n)))
        np.minimum.at(bins, (mixed & np.uint64(BINS - 1)).astype(np.int64), mixed >> np.uint64(7))
    filled = bins != np.iinfo(np.uint64).max
    short = np.where(filled, 1 + _mixed(bins) % np.uint64(255), 0).astype(np.uint8)
    return f"{whole:016x}{short.tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Share of agreeing bins among those that either fingerprint has filled."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(z[16:]), np.uint8) for z in (a, b))
    either = (x > 0) | (y > 0)
    return float((x[either] == y[either]).sum() / either.sum()) if either.any() else 0.0


def edited(text: str, following: str) -> str:
    """The last third replaced by as many of the first code points of the text that follows."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fingerprint": [fingerprint(x) for x in batch["text"]]})

    return doc_texts(docs).mapInPandas(run, "doc_id long, fingerprint string")


def with_following(docs: DataFrame, per_pair, schema: str) -> DataFrame:
    """Applies per_pair(doc_id, text, next text, carry) to each document and the next by descending id.

    The keys alone (id, hash of the text) are dealt into ranges first; a range's last key is all
    the driver gets. Then each text moves once, to its range, and the document that heads a range
    goes to the range above as well, where it ends the sequence.
    """
    tasks = file_partitions(docs)
    keyed = doc_texts(docs).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    order = (F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "mark")
    ranges = keyed.select(*order).repartitionByRange(min(tasks * RANGES_A_TASK, MOST_RANGES), "named", "id", "mark")
    found = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("named", "id", "mark")).alias("top")).collect()
    tops = sorted(tuple(r["top"]) for r in found)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = list(zip(batch["named"].tolist(), batch["id"].tolist(), batch["mark"].tolist(), strict=True))
            block = np.array([bisect_left(tops, k) for k in keys], np.int64)
            yield batch.assign(block=block, last=False)[names]
            heads = [i for i, k in enumerate(keys) if tops[block[i]] == k]
            if heads:
                yield batch.iloc[heads].assign(block=(block[heads] + 1) % len(tops), last=True)[names]

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, carry, rows = None, None, []
        for batch in batches:
            for block, last, named, doc_id, text in zip(*(batch[x].tolist() for x in ("block", "last", "named", "id", "text")), strict=True):
                if held is not None and held[0] == block:
                    row, carry = per_pair(held[1], held[2], text, carry)
                    rows.append((held[1], *row))
                else:
                    carry = None
                held = None if last else (block, doc_id if named else None, text)
            if rows:
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
                yield out.astype({"doc_id": "Int64"})
                rows = []

    names = ["block", "last", "named", "id", "mark", "text"]
    dealt = keyed.select(*order, "text").mapInPandas(deal, "block int, last boolean, named boolean, id long, mark long, text string").repartition(tasks, "block")
    down = ("block", "last", F.desc("named"), F.desc("id"), F.desc("mark"), "text")
    return dealt.sortWithinPartitions(*down).mapInPandas(pairs, schema)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form (columns EDITED)."""

    def compare(doc_id: int | None, text: str, following: str, carry: tuple | None) -> tuple[tuple, tuple]:
        hashed, own = carry or _with_fingerprint(text)
        after = _with_fingerprint(following)
        changed = edited(text, following)
        other, other_print = _with_fingerprint(changed)
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        near = (likeness(own, other_print), likeness(own, after[1]))
        return (len(text), digest, own, other_print, *near, hashed.common_extension(0, other, 0), hashed.common_suffix(other)), after

    return with_following(docs, compare, EDITED)


def _with_fingerprint(text: str) -> tuple[PrefixHash, str]:
    hashed = PrefixHash(code_points(text))
    return hashed, fingerprint_of(hashed)
