"""Past records and a few queries: records meet queries where they are read, in Arrow batches, and only the near ones are aligned."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import text as T

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Scores have six decimals, so what is within one of them can still be equal.
NEAR = 1e-6


def sort_key(value: object) -> tuple:
    """Orders values, and structs of them, as Spark does: nulls first."""
    if isinstance(value, dict):
        return (1, *map(sort_key, value.values()))
    return (0,) if value is None else (1, value)


class Asked:
    """Queries (query, q_form, q_terms) with the postings of their terms."""

    def __init__(self, queries: pa.Table) -> None:
        self.texts = queries["query"].combine_chunks()
        terms = queries["q_terms"].to_pylist()
        flat = sorted((t, q) for q, ts in enumerate(terms) for t in ts)
        self.terms = pa.array(dict.fromkeys(t for t, _ in flat), pa.string())
        self.queries = np.array([q for _, q in flat], np.int64)
        self.uses = np.array([*Counter(t for t, _ in flat).values()], np.int64)
        self.starts = np.cumsum(self.uses) - self.uses
        self.sizes = np.array([len(ts) for ts in terms], np.int64)
        self.lengths = np.array([len(f) for f in queries["q_form"].to_pylist()], np.int64)

    def shared(self, rows: np.ndarray, places: np.ndarray, n_rows: int) -> np.ndarray:
        """Terms that each query shares with each of n_rows records; a record's terms are given once each, by place."""
        uses = self.uses[places]
        each = np.arange(uses.sum()) - np.repeat(np.cumsum(uses) - uses - self.starts[places], uses)
        cells = self.queries[each] * n_rows + np.repeat(rows, uses)
        return np.bincount(cells, minlength=len(self.sizes) * n_rows).reshape(-1, n_rows)


def terms_of(words: pa.Array) -> pa.Array:
    """What history_terms makes of single words; null for those that say nothing."""
    letters = pc.utf8_length(words)
    cut = pc.and_(pc.greater_equal(letters, 6), pc.not_equal(letters, pc.binary_length(words)))
    says = pc.and_(pc.greater_equal(letters, 2), pc.invert(pc.is_in(words, pa.array(T.HISTORY_STOP_WORDS, words.type))))
    return pc.if_else(says, pc.if_else(cut, pc.utf8_slice_codeunits(words, 0, 6), words), pa.scalar(None, words.type))


class Records:
    """Texts by history_plain: sizes of their sets of terms, lengths of their forms, and each asked term of each, by row and place."""

    def __init__(self, plain: pa.Array, asked: Asked) -> None:
        words = pc.split_pattern_regex(plain, T.HISTORY_GAPS)
        rows, coded = pc.list_parent_indices(words).to_numpy().astype(np.int64), words.flatten().dictionary_encode()
        codes, letters = coded.indices.to_numpy(), pc.utf8_length(coded.dictionary).to_numpy()[coded.indices.to_numpy()]
        n_words = np.bincount(rows[letters > 0], minlength=len(plain))
        self.lengths = np.bincount(rows, letters, len(plain)).astype(np.int64) + np.maximum(n_words - 1, 0)
        terms = terms_of(coded.dictionary).dictionary_encode()
        n, term = max(1, len(terms.dictionary)), terms.indices.fill_null(-1).to_numpy()[codes]
        pairs = np.sort(rows[term >= 0] * n + term[term >= 0])
        rows, term = np.divmod(pairs[np.flatnonzero(np.diff(pairs, prepend=-1))], n)  # each once
        self.sizes = np.bincount(rows, minlength=len(plain))
        places = pc.index_in(terms.dictionary, asked.terms.cast(terms.dictionary.type)).fill_null(-1).to_numpy()
        place = places[term] if len(places) else term
        self.rows, self.places = rows[place >= 0], place[place >= 0]


class Met:
    """Queries and the distinct texts of a batch, so many pairs at once: what each pair scores without alignment."""

    def __init__(self, asked: Asked, plain: pa.Array, pairs: int) -> None:
        self.asked, self.records, self.step = asked, Records(plain, asked), max(1, pairs // max(1, len(asked.sizes)))

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        asked, records = self.asked, self.records
        for at in range(0, len(records.sizes), self.step):
            n_query, n_source = asked.sizes[:, None], records.sizes[None, at : at + self.step]
            low, high = np.searchsorted(records.rows, [at, at + self.step])
            shared = asked.shared(records.rows[low:high] - at, records.places[low:high], n_source.size)
            yield at, 0.5 * (shared / np.maximum(np.minimum(n_query, n_source), 1)) + 0.25 * (shared / np.maximum(n_query + n_source - shared, 1))


def likely_pairs(queries: pa.Table, best: int, pairs: int) -> Batches:
    """For mapInArrow over records (plain): pairs (query, plain, least) among which are the `best` greatest least of each query.

    least is what a pair scores without alignment. `pairs` pairs are counted at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(queries)
        top = np.zeros((len(asked.sizes), best))
        for batch in batches:
            plain = batch.column("plain")
            for at, least in Met(asked, plain, pairs):
                better = np.flatnonzero(least.max(axis=1) > top[:, 0])
                top[better] = np.sort(np.hstack([top[better], least[better]]), axis=1)[:, -best:]
                q, row = np.nonzero((least[better] > 0) & (least[better] >= top[better, :1]))
                if len(q):
                    yield pa.RecordBatch.from_arrays([asked.texts.take(pa.array(better[q])), plain.take(pa.array(row + at)), pa.array(least[better[q], row])], ["query", "plain", "least"])

    return run


def near_pairs(queries: pa.Table, reached: np.ndarray, best: int, pairs: int) -> Batches:
    """For mapInArrow over records (item_id, order, text, plain): pairs that can score what is reached for their query.

    They get least, most, with a bound of the alignment (2 * min / (a + b) of the lengths), and
    reached. Of equal texts in a batch the first `best` by order stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(queries)
        for batch in batches:
            coded = batch.column("plain").dictionary_encode()
            codes, met = coded.indices.to_numpy(), Met(asked, coded.dictionary, pairs)
            for at, least in met:
                q, row = np.nonzero((least > 0) & (least >= reached[:, None] - 0.25 - NEAR))
                a, b = asked.lengths[q], met.records.lengths[row + at]
                most = least[q, row] + 0.25 * (2 * np.minimum(a, b) / np.maximum(a + b, 1))
                near = most >= reached[q] - NEAR
                if near.any():
                    bounds = {"least": least[q, row][near], "most": most[near], "reached": reached[q][near]}
                    yield placed(batch, codes, asked.texts, q[near], row[near] + at, bounds, best)

    return run


def placed(batch: pa.RecordBatch, codes: np.ndarray, texts: pa.Array, q: np.ndarray, code: np.ndarray, bounds: dict[str, np.ndarray], best: int) -> pa.RecordBatch:
    """Pairs of a query and a distinct text as pairs of the query and the first rows of that text."""
    firsts = {c: np.flatnonzero(codes == c) for c in np.unique(code).tolist()}
    for c, same in firsts.items():
        if len(same) > best:
            keys = [sort_key(o) for o in batch.column("order").take(pa.array(same)).to_pylist()]
            firsts[c] = same[sorted(range(len(same)), key=keys.__getitem__)[:best]]
    pair = np.repeat(np.arange(len(code)), [len(firsts[c]) for c in code.tolist()])
    taken = batch.take(pa.array(np.concatenate([firsts[c] for c in code.tolist()])))
    kept = {c: taken.column(c) for c in ("item_id", "order", "text")}
    return pa.RecordBatch.from_pydict({"query": texts.take(pa.array(q[pair])), **kept, **{c: pa.array(v[pair]) for c, v in bounds.items()}})


def longest_common(masks: dict[str, int], n: int, text: str) -> int:
    """Length of the longest common subsequence of a text and one of n letters, given by the places of each letter."""
    whole = free = (1 << n) - 1
    for letter in text:
        met = free & masks.get(letter, 0)
        free = ((free + met) | (free - met)) & whole
    return n - free.bit_count()


def aligned(best: int) -> Batches:
    """For mapInArrow over pairs (query, q_form, s_form, least, most, reached, ...), by query and falling most: those that can be among the best, with sequence.

    A pair is aligned only if its bound comes up to what is reached and to the `best` scores met
    so far. Matching blocks are a common subsequence, so the longest one is a second bound, much
    cheaper than they are. Each partition stands alone, so a query's pairs can lie in many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = before = None
        for batch in batches:
            columns = [batch.column(c) for c in ("query", "least", "most", "reached")]
            rows, found = [], []
            for i, (text, least, most, reached) in enumerate(zip(*[c.to_pylist() for c in columns], strict=True)):
                if text != query:
                    query, before, top, a = text, None, [], batch.column("q_form")[i].as_py()
                    masks: dict[str, int] = {}
                    for k, letter in enumerate(a):
                        masks[letter] = masks.get(letter, 0) | 1 << k
                reached = max(reached, top[0]) if len(top) == best else reached
                if most < reached - NEAR:
                    continue
                b = batch.column("s_form")[i].as_py()
                if b != before:
                    before, sequence = b, None
                    bound = 2 * longest_common(masks, len(a), b) / max(1, len(a) + len(b))
                if least + 0.25 * bound < reached - NEAR:
                    continue
                sequence = SequenceMatcher(None, a, b).ratio() if sequence is None else sequence
                score = least + 0.25 * sequence
                if score >= reached - NEAR:
                    heappushpop(top, score) if len(top) == best else heappush(top, score)
                    rows.append(i)
                    found.append(sequence)
            if rows:
                names = ["query", "item_id", "order", "text"]
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*[taken.column(c) for c in names], pa.array(found, pa.float64())], [*names, "sequence"])

    return run
