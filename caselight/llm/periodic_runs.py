"""Periodic runs of words: Crochemore's partition refinement, squares at the distance of a class's length, merged into runs.

Positions whose next l words are equal form the classes of level l. Level l + 1 comes from level l
by the classes that were split off: the position before each of their members leaves its own class
for a new one. Of the parts of a split class all but the largest count as split off (the smaller
halves), so a position is moved O(log n) times however many levels there are. Members of a class
are linked in the order of positions; two neighbours at distance l in a class of level l are a
square whose root is no power, and squares of one period at consecutive positions are one run.

Texts of a batch are refined together: no word of one equals a word of another, and a sign behind
each text ends it. All steps of a level are array operations over what moves in it.

Defined cases: a null or empty text has no runs; repeated rows and null doc_ids are searched like
any other row; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, doc_texts

#: A run has so many words at least, and twice its period.
LEAST_LENGTH = 12
#: Words that are refined together, and letters that a word is taken to have where texts are dealt to batches.
BATCH_WORDS, LETTERS = 2_000_000, 6
NONE = -1


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where some key differs from the one before it."""
    differs = np.zeros(len(keys[0]), bool)
    differs[:1] = True
    for key in keys:
        differs[1:] |= key[1:] != key[:-1]
    return differs


class Partition:
    """Classes of positions by their next `level` words, refined level by level.

    symbols: a number for each position. Those of different texts differ, and each text ends with
    one that occurs once. limit: the last level that is of use.
    """

    def __init__(self, symbols: np.ndarray, limit: int) -> None:
        n, self.level, self.limit = len(symbols), 1, limit
        self.order = np.argsort(symbols, kind="stable")  # members of a class side by side
        self.place, self.of = np.empty(n, np.int64), np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        first = np.flatnonzero(_heads(symbols[self.order]))
        self.classes = len(first)
        self.start, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.start[: self.classes], self.size[: self.classes] = first, np.diff(np.append(first, n))
        self.of[self.order] = np.repeat(np.arange(self.classes), self.size[: self.classes])
        self.next, self.before = np.empty(n, np.int64), np.empty(n, np.int64)
        self.due: dict[int, list[np.ndarray]] = defaultdict(list)
        self.flag = np.zeros(n, bool)
        self._link(self.order)
        self.split_off = np.arange(n)

    def _link(self, members: np.ndarray) -> None:
        """Links members, which come by class and position."""
        self.next[members], self.before[members] = NONE, NONE
        together = self.of[members[1:]] == self.of[members[:-1]]
        a, b = members[:-1][together], members[1:][together]
        self.next[a], self.before[b] = b, a
        self._expect(a, b - a)

    def _unlink(self, members: np.ndarray) -> None:
        """Takes members, which come by class and position, out of their links, which close behind them."""
        chained = self.next[members[:-1]] == members[1:]
        a = self.before[members[np.concatenate(([True], ~chained))]]
        b = self.next[members[np.concatenate((~chained, [True]))]]
        self.next[a[a != NONE]] = b[a != NONE]
        self.before[b[b != NONE]] = a[b != NONE]
        both = (a != NONE) & (b != NONE)
        self._expect(a[both], b[both] - a[both])

    def _expect(self, at: np.ndarray, gap: np.ndarray) -> None:
        """Notes positions for the level that equals the distance to their neighbour; distances only grow."""
        useful = (gap >= self.level) & (gap <= self.limit)
        at, gap = at[useful], gap[useful]
        if len(at):
            pick = np.argsort(gap, kind="stable")
            at, gap = at[pick], gap[pick]
            cuts = np.flatnonzero(_heads(gap))
            for g, some in zip(gap[cuts].tolist(), np.split(at, cuts[1:]), strict=True):
                self.due[g].append(some)

    def squares(self) -> np.ndarray:
        """Positions, in order, where words of this level's number stand twice in a row."""
        noted = self.due.pop(self.level, None)
        if noted is None:
            return np.zeros(0, np.int64)
        at = np.unique(np.concatenate(noted))
        return at[self.next[at] - at == self.level]

    def refine(self) -> bool:
        """Goes on to the next level; False if no class is left that could be split."""
        moved = self.split_off[self.split_off > 0] - 1
        moved = np.sort(moved[self.size[self.of[moved]] > 1])
        self.level += 1
        if not len(moved):
            return False
        moved = moved[np.argsort(self.of[moved], kind="stable")]
        self._unlink(moved)
        old, cause = self.of[moved], self.of[moved + 1]
        pick = np.argsort(old * len(self.of) + cause, kind="stable")
        moved, old, cause = moved[pick], old[pick], cause[pick]
        # the parts that leave each class, by the class of what follows
        new_class = _heads(old)
        parts = np.flatnonzero(new_class | _heads(cause))
        sizes = np.diff(np.append(parts, len(moved)))
        begins = np.flatnonzero(new_class)
        olds, taken = old[begins], np.diff(np.append(begins, len(moved)))
        owner = np.cumsum(new_class)[parts] - 1
        rest = self.size[olds] - taken
        low = self.start[olds] + rest
        self._to_the_end(moved, np.repeat(low - begins, taken) + np.arange(len(moved)), np.repeat(low, taken))
        # a class that leaves as a whole keeps its name for its first part
        keeps = new_class[parts] & (rest[owner] == 0)
        names = olds[owner]
        fresh = len(names) - int(keeps.sum())
        names[~keeps] = self.classes + np.arange(fresh)
        self.classes += fresh
        self.size[olds] = rest
        self.start[names], self.size[names] = low[owner] + parts - begins[owner], sizes
        self.of[moved] = np.repeat(names, sizes)
        self._link(moved)
        # all but the largest part of each class are split off
        largest = np.maximum.reduceat(sizes, np.flatnonzero(new_class[parts]))
        stays = np.flatnonzero((sizes == largest[owner]) & (rest[owner] < largest[owner]))
        off = np.ones(len(parts), bool)
        off[stays[_heads(owner[stays])]] = False
        self.split_off = moved[np.repeat(off, sizes)]
        left = olds[(rest > 0) & (rest < largest)]
        if len(left):
            n = self.size[left]
            places = np.repeat(self.start[left] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self.split_off = np.concatenate((self.split_off, self.order[places]))
        return True

    def _to_the_end(self, moved: np.ndarray, zone: np.ndarray, low: np.ndarray) -> None:
        """Puts moved members into the zones at the ends of their classes, and those found there into the gaps.

        Classes are ranges of places, so gaps and members both fall into them in order.
        """
        places = self.place[moved]
        gaps = np.sort(places[places < low])
        self.flag[moved] = True
        there = np.sort(zone)
        there = self.order[there[~self.flag[self.order[there]]]]
        self.flag[moved] = False
        self.order[gaps], self.place[there] = there, gaps
        self.order[zone], self.place[moved] = moved, zone


def runs_of(symbols: np.ndarray, limit: int, least: int = LEAST_LENGTH) -> np.ndarray:
    """Rows start, length, period of all maximal runs, by start and period; symbols as for Partition."""
    partition, found = Partition(symbols, limit), []
    while partition.level <= limit:
        q, at = partition.level, partition.squares()
        if len(at):
            first = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
            length = at[np.append(first[1:], len(at)) - 1] + 2 * q - at[first]
            long = length >= least
            found.append(np.stack((at[first], length, np.full(len(first), q)), axis=1)[long])
        if not partition.refine():
            break
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


RUNS = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"


def search(texts: list[str], least: int = LEAST_LENGTH) -> pd.DataFrame:
    """The columns RUNS without doc_id, for some texts."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    used = np.flatnonzero(sizes >= least)  # shorter ones hold no run
    runs: dict[int, np.ndarray] = {}
    if len(used):
        codes = pd.factorize(np.array([x for k in used for x in words[k]], dtype=object))[0].astype(np.int64)
        ends = np.cumsum(sizes[used])
        owner = np.repeat(np.arange(len(used)), sizes[used])
        symbols = np.insert(owner * (codes.max() + 1) + codes, ends, -1 - np.arange(len(used)))
        begins = ends - sizes[used] + np.arange(len(used))
        rows = runs_of(symbols, int(sizes[used].max()) // 2, least)
        of = np.searchsorted(begins, rows[:, 0], side="right") - 1
        rows[:, 0] -= begins[of]
        cuts = np.flatnonzero(_heads(of)) if len(of) else []
        runs = dict(zip(used[of[cuts]].tolist(), np.split(rows, cuts[1:]), strict=True)) if len(of) else {}
    none, out = np.zeros((0, 3), np.int64), []
    for k, own in enumerate(words):
        found = runs.get(k, none)
        if len(found):
            depth = np.zeros(len(own) + 1, np.int64)
            np.add.at(depth, found[:, 0] + found[:, 2], 1)
            np.add.at(depth, found[:, 0] + found[:, 1], -1)
            own = [own[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
        out.append((sizes[k], *found.T, b" ".join(own).decode("utf-8", "surrogatepass")))
    return pd.DataFrame(out, columns=["n_words", "starts", "lengths", "periods", "collapsed"])


def find_runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every whole text.

    runs: structs of start (number of a word), length and period (in words), by start and period.
    collapsed: the words, joined by single spaces, without those that some run contains after its first period.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = (batch["text"].str.len().cumsum() // (LETTERS * BATCH_WORDS)).to_numpy()
            for k in np.unique(part):
                some = batch[part == k]
                out = search(some["text"].tolist(), least)
                out.insert(0, "doc_id", some["doc_id"].astype("Int64").values)
                yield out

    found = doc_texts(docs).mapInPandas(run, RUNS)
    runs = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"), F.col("periods").alias("period"))
    return found.select("doc_id", "n_words", runs.cast("array<struct<start: bigint, length: bigint, period: bigint>>").alias("runs"), "collapsed")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in about one text of ten the words repeat from some word on, with a period drawn by doc_id."""
    texts = doc_texts(docs)
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(drawn % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    rows = texts.select("doc_id", "text", F.floor(drawn / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    left = F.col("n") - F.col("a")
    rows = rows.withColumn("p", (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int"))
    root = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(root, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def _best(runs: Column) -> Column:
    """The greatest length; of those the smallest start, then period."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))


def run_digests(docs: DataFrame) -> DataFrame:
    """Of every text with its planted runs: the number of runs, the greatest one, and digests of all runs and of the collapsed text."""
    found = find_runs(with_planted_runs(docs)).withColumn("best", _best(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
