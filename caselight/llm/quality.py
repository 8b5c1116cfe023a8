"""Quality rules: base counts of a text, and repetition judged by a suffix array over its words.

The suffix array of each document's word sequence is built by prefix doubling, many documents
at a time (a word of one document never equals one of another). Longest common prefixes of
neighbouring suffixes give every maximal repeated run of words; the union of the runs' spans
gives the covered fraction, the longest of them the longest repeat. A text is kept if both
stay within their limits and the base rules hold.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows and
null doc_ids are judged like any other row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts

#: Base rules.
LEAST_WORDS, WINDOW_WORDS, REPEAT_PERCENT = 50, 3, 50
#: A run of so many words that appears again in its text is a repeat.
RUN_WORDS = 10
#: Largest part of the words that repeats may cover, and largest length of one repeat in words.
COVERED_LIMIT, LONGEST_LIMIT = 0.3, 200
#: Words for which suffix arrays are built together.
BATCH_WORDS = 400_000
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\r\x0b\x0c"

RULES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_fraction double, longest_repeat long"
)


class WordSuffixes:
    """Suffix array of many word sequences that share no word."""

    def __init__(self, words: np.ndarray, owner: np.ndarray) -> None:
        """words: ids of words; owner: the number of each word's document, ascending."""
        n = self.n = len(words)
        self.levels: list[np.ndarray] = []  # k: the rank of each suffix by its first 2^k words
        key = owner.astype(np.int64) * (int(words.max()) + 1 if n else 1) + words
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        self.order = order
        if n:
            sorted_key = key[order]
            new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
            rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.levels.append(rank)
        step = 1
        self.end = np.searchsorted(owner, owner, side="right") - 1  # the last position of each word's document
        while True:
            shared = self._shared(rank)
            at = np.flatnonzero(shared[rank])
            if not len(at):
                break
            beyond = at + step > self.end[at]
            follow = np.where(beyond, -1, rank[np.minimum(at + step, n - 1)])
            pick = np.lexsort((follow, rank[at]))
            at, follow = at[pick], follow[pick]
            base = rank[at]
            new = np.concatenate(([True], (base[1:] != base[:-1]) | (follow[1:] != follow[:-1]) | (follow[1:] < 0)))
            group = np.concatenate(([True], base[1:] != base[:-1]))
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(group, np.arange(len(at)), 0))
            start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            self.order[base + place] = at
            rank = rank.copy()
            rank[at] = base + place[start]
            self.levels.append(rank)
            step *= 2

    def _shared(self, rank: np.ndarray) -> np.ndarray:
        return np.bincount(rank, minlength=self.n) > 1

    def common_prefixes(self) -> np.ndarray:
        """Words that each suffix of the array shares with the one before it."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            inside = (a + out <= self.end[a]) & (b + out <= self.end[b]) if len(a) else np.zeros(0, bool)
            x, y = np.minimum(a + out, self.n - 1), np.minimum(b + out, self.n - 1)
            out += (inside & (rank[x] == rank[y])).astype(np.int64) << k
        return np.concatenate(([0], out)) if self.n else out

    def longest_repeats(self) -> np.ndarray:
        """For each position, the most words from there that also stand elsewhere in its document."""
        if not self.n:
            return np.zeros(0, np.int64)
        lcp = np.append(self.common_prefixes(), 0)
        out = np.empty(self.n, np.int64)
        out[self.order] = np.maximum(lcp[:-1], lcp[1:])
        return out


def _covered(lengths: np.ndarray) -> np.ndarray:
    """Positions inside some span [i, i + lengths[i])."""
    reach = np.maximum.accumulate(np.arange(len(lengths)) + lengths) if len(lengths) else lengths
    return np.arange(len(lengths)) < reach


def judge(texts: list[str]) -> pd.DataFrame:
    """The columns RULES without doc_id, for some texts."""
    rows, words, sizes = [], [], []
    for text in texts:
        own = text.encode("utf-8", "surrogatepass").split()
        lines = [x for x in text.split("\n") if x.strip(WHITE)]
        rows.append((len(own), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))))
        words += own
        sizes.append(len(own))
    out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines"], dtype="int64")
    owner = np.repeat(np.arange(len(texts)), sizes)
    codes = pd.factorize(np.array(words, dtype=object))[0] if words else np.zeros(0, np.int64)
    repeats = WordSuffixes(codes, owner).longest_repeats()
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    in_window = _covered(np.where(repeats >= WINDOW_WORDS, WINDOW_WORDS, 0))
    in_run = _covered(np.where(repeats >= RUN_WORDS, repeats, 0))
    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[bounds])
    out["n_repeat_words"] = total(in_window)
    out["longest_repeat"] = [int(repeats[a:b].max()) if b > a else 0 for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    out["covered_fraction"] = total(in_run) / np.maximum(out["n_words"], 1)
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["covered_fraction"] <= COVERED_LIMIT) & (out["longest_repeat"] <= LONGEST_LIMIT)
    return out


def judge_documents(docs: DataFrame) -> DataFrame:
    """One row of RULES per document, over its whole text."""
    names = [x.split()[0] for x in RULES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = (batch["text"].str.len().cumsum() // (6 * BATCH_WORDS)).to_numpy()
            for k in np.unique(part):
                some = batch[part == k]
                out = judge(some["text"].tolist())
                out.insert(0, "doc_id", some["doc_id"].astype("Int64").values)
                yield out[names]

    return doc_texts(docs).mapInPandas(run, RULES)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, all columns kept, each row judged once in place."""
    text = F.coalesce("text", F.lit(""))
    kept = F.pandas_udf(_kept, "boolean")
    return docs.where(kept(text))


def _kept(texts: pd.Series) -> pd.Series:
    parts = (texts.str.len().cumsum() // (6 * BATCH_WORDS)).to_numpy()
    found = [judge(texts[parts == k].tolist())["kept"] for k in np.unique(parts)]
    return pd.concat(found, ignore_index=True) if found else pd.Series([], dtype=bool)
