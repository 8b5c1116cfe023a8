"""SimHash near-duplicates: fingerprints, and a binary trie self-join under a Hamming budget.

Fingerprints within the budget of 3 bits agree in at least one of four 16-bit blocks, so
each distinct fingerprint goes into four tries, one for each block turned to the top. The
tries' subtrees under a 16-bit top are joined with themselves in tasks of their own: pairs of
nodes go down together, differing bits add up, and a pair over the budget goes no further.
A subtree with too many fingerprints for one task is dealt again by blocks of its remaining
bits (still exact, by the same argument), as often as needed. From each subtree comes a
spanning forest of its links, not all pairs.

Defined cases: a null or empty text has fingerprint zero and links like any other; repeated
rows share a component; a null doc_id is never the smallest, and a group of null ids alone stays whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, free_name, keep_lineage_short
from .components import component_roots

SHINGLE_WORDS = 3
BUDGET = 3
SEED = 42
#: Distinct fingerprints that one task joins at most before its subtree is dealt again.
SUBTREE_LIMIT = 20_000
#: Node pairs that are expanded at once.
FRONTIER = 1 << 18


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The majority of the XXH64 bits of all word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: 1 - shingle_words or None].tolist(), ends[shingle_words - 1 :].tolist(), strict=True)
    hashed = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 4096):
        bits = np.unpackbits(hashed[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashed), bitorder="little").view("<u8")[0])


def text_digest(text: Column) -> Column:
    """What stands for a whole text where rows meet; a null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, digest of the text and fp, the fingerprint as a signed long, of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(x, shingle_words) for x in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "digest": batch["digest"], "fp": found})

    return doc_texts(docs).withColumn("digest", text_digest(F.col("text"))).mapInPandas(run, "doc_id long, digest binary, fp long")


def _labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links a-b."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(jumped := labels[labels], labels):
            labels = jumped
    return labels


def trie_self_join(values: np.ndarray, trees: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Labels of the components under the budget; a node is a range of sorted values.

    values: distinct unsigned 64-bit numbers, sorted within each of the trees, which follow
    each other. Pairs of nodes descend bit by bit from each tree's root joined with itself.
    """
    n = len(values)
    labels = np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], trees[1:] != trees[:-1]))) if n else np.array([], np.int64)
    last = np.append(first[1:], n) if n else first
    stack = [(63, first, last, first, last, np.zeros(len(first), np.int8))]
    while stack:
        bit, lo, hi, lo2, hi2, errors = stack.pop()
        if len(lo) > FRONTIER:
            half = len(lo) // 2
            stack.append((bit, lo[:half], hi[:half], lo2[:half], hi2[:half], errors[:half]))
            lo, hi, lo2, hi2, errors = lo[half:], hi[half:], lo2[half:], hi2[half:], errors[half:]
        single = (hi - lo == 1) & (hi2 - lo2 == 1)
        a, b = lo[single], lo2[single]
        near = (a != b) & (np.bitwise_count(values[a] ^ values[b]) <= budget)
        labels = _labels(n, a[near], b[near], labels)
        lo, hi, lo2, hi2, errors = (x[~single] for x in (lo, hi, lo2, hi2, errors))
        if not len(lo) or bit < 0:
            continue
        mid, mid2 = _split(values, lo, hi, bit), _split(values, lo2, hi2, bit)
        same = lo == lo2
        parts = [
            (lo, mid, lo2, mid2, errors, np.ones(len(lo), bool)),
            (mid, hi, mid2, hi2, errors, np.ones(len(lo), bool)),
            (lo, mid, mid2, hi2, errors + 1, errors < budget),
            (mid, hi, lo2, mid2, errors + 1, (errors < budget) & ~same),
        ]
        joined = [np.concatenate([p[k][p[5] & (p[0] < p[1]) & (p[2] < p[3])] for p in parts]) for k in range(5)]
        if len(joined[0]):
            stack.append((bit - 1, *joined))
    return labels


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where in each range [lo, hi) of sorted values this bit turns from 0 to 1."""
    low, high, one = lo.copy(), hi.copy(), np.uint64(1 << bit)
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        is_one = (values[np.minimum(mid, len(values) - 1)] & one) != 0
        high = np.where(open_ & is_one, mid, high)
        low = np.where(open_ & ~is_one, mid + 1, low)
    return low


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each subtree's spanning forest; rows come sorted by subtree."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        tree = rows["tree"].to_numpy()
        turned, fp = rows["turned"].to_numpy().view(np.uint64), rows["fp"].to_numpy()
        number = np.concatenate(([0], np.cumsum(tree[1:] != tree[:-1])))
        order = np.lexsort((turned, number))
        labels = trie_self_join(turned[order], number[order])
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return pd.DataFrame({"u": fp[order][moved], "v": fp[order][labels[moved]]})

    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        whole = (rows["tree"] != rows["tree"].iloc[-1]).to_numpy() if len(rows) else np.array([], bool)
        rest = rows[~whole].reset_index(drop=True)
        if whole.any():
            yield links(rows[whole].reset_index(drop=True))
    if rest is not None and len(rest):
        yield links(rest)


def _dealt(rows: DataFrame, used: int) -> DataFrame:
    """Each row four times, with another block of its remaining 64 - used bits at the top.

    Among the remaining bits, at most three differ, so one of their four blocks is equal.
    """
    left = 64 - used
    width = left // 4
    out = []
    for k in range(4):
        size = width if k < 3 else left - 3 * width
        at = left - (k + 1) * width if k < 3 else 0
        block = F.expr(f"shiftrightunsigned(turned, {at + used}) & {(1 << size) - 1}L") if size else F.lit(0)
        rest = F.expr(f"shiftleft(shiftrightunsigned(turned, {at + used + size}), {at + size + used})" if at + used + size < 64 else "0L")
        low = F.expr(f"shiftleft(turned & {(1 << (at + used)) - 1 if at + used else 0}L, {size})")
        # the block leaves; the bits below it move up, those above stay
        out.append(rows.select("fp", rest.bitwiseOR(low).alias("turned"), F.xxhash64("tree", F.lit(k), block).alias("tree")))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def spanning_links(distinct_fps: DataFrame, limit: int = SUBTREE_LIMIT) -> DataFrame:
    """(u, v) links that connect exactly the fingerprints connected within the budget."""
    rows = distinct_fps.select("fp", F.col("fp").alias("turned"), F.lit(0).cast("long").alias("tree"))
    rows, used, found = _dealt(rows, 0), 16, None
    while True:
        large = rows.groupBy("tree").count().where(F.col("count") > limit).select("tree")
        again = used < 60 and not large.isEmpty()
        small = rows.join(large, "tree", "left_anti") if again else rows
        links = small.select("tree", "turned", "fp").repartition("tree").sortWithinPartitions("tree").mapInPandas(_forest, "u long, v long")
        found = links if found is None else found.union(links)
        if not again:
            return found
        rows = keep_lineage_short(_dealt(rows.join(large, "tree", "left_semi"), used))
        used += (64 - used) // 4


def near_duplicate_classes(found: DataFrame) -> DataFrame:
    """root, one for each component, and first_id, the least doc_id with it, of every fp among fingerprints."""
    firsts = keep_lineage_short(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = component_roots(spanning_links(firsts)).withColumnRenamed("u", "fp")
    return firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id linked with it, over any number of links)."""
    found = keep_lineage_short(fingerprints(docs, shingle_words).select("doc_id", "fp"))
    classed = near_duplicate_classes(found)
    least = classed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = classed.join(least, "root").select("fp", "component_id")
    return found.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def first_of_each_group(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each near-duplicate group: that of smallest doc_id (null last), then of smallest digest.

    Rows are told apart by id and text, as an id may be null or taken twice; of rows that are equal in both, one stays.
    """
    found = keep_lineage_short(fingerprints(docs, shingle_words))
    rows = found.groupBy("fp", "doc_id", "digest").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest", "n")).alias("first")
    # a fingerprint's own first row comes before the join, so copies do not meet in their component
    firsts = rows.groupBy("fp").agg(first).join(near_duplicate_classes(found).select("fp", "root"), "fp")
    own, text = free_name(docs, "_kept"), free_name(docs, "_digest")
    kept = firsts.groupBy("root").agg(F.min("first").alias("first"))
    kept = keep_lineage_short(kept.select(F.col("first.doc_id").alias(own), F.col("first.digest").alias(text), "first.n"))
    marked = docs.withColumn(text, text_digest(F.col("text"))).withColumn(own, F.col("doc_id").cast("long"))
    same = lambda k: marked[own].eqNullSafe(k[own]) & (marked[text] == k[text])
    single, repeated = kept.where("n = 1"), kept.where("n > 1")
    out = marked.join(single, same(single), "left_semi")
    if not repeated.isEmpty():
        out = out.union(marked.join(repeated, same(repeated), "left_semi").dropDuplicates([own, text]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
