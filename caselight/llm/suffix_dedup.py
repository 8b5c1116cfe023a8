"""Removal of every byte inside a 100-byte string that also starts earlier in the corpus.

1. Each 100-byte window has an anchor: its 32-byte gram of least hash, the leftmost of equals.
   Windows with one anchor form a snippet of at most 168 bytes, and equal windows lie at the
   same place around equal anchors, so only snippets with equal anchors have to meet.
2. Equal snippets (by two 64-bit hashes) meet by shuffle, after a first round within each
   batch of documents; all but the earliest are copies as a whole.
3. Different snippets with equal anchors are the rest. Their bytes are fetched, and each task
   builds the Burrows-Wheeler transform and the common prefixes of a bounded set of them
   column by column: every round inserts one symbol of each snippet. Intervals of common
   prefixes of 100 bytes and more hold the windows that repeat.

The rounds run over snippets, as whole documents would need one pass over the corpus for each
byte of the longest text; and over arrays in memory rather than external files, as a set of
snippets is bounded. An anchor with very many different snippets (the edge of a very common
passage) is dealt by windows instead: a sample of documents only names such anchors, and those
that it misses are dealt by windows after step 2.

Defined cases: a null text is empty; texts under 100 bytes stay whole; rows that repeat a
doc_id and a text are one document, those that repeat a doc_id alone are told apart and ordered
by 31 bits of a hash of the text; a null doc_id comes before all others; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, keep_lineage_short

WINDOW, GRAM = 100, 32
#: Bytes of text that are worked on at once; snippets of one Burrows-Wheeler transform.
CHUNK_BYTES, SET_SNIPPETS = 2_000_000, 4_000
#: Different snippets of an anchor beyond which it is dealt by windows.
WIDE = 4_000
#: Share of the documents that the search for such anchors looks at, and its bounds.
LOOK_SHARE, LOOK_ANCHORS, LOOK_LEAST = 0.02, 20_000, 12
NO_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15

#: known: the row is a part already known to be a copy, and its anchor holds where it stops.
SNIPPETS = "anchor long, content long, doc_id long, mark int, place long, known boolean"
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 32-byte gram."""
    h, step, power = data.astype(np.uint64) + np.uint64(1), 1, _BASE
    while step < GRAM:
        h = h[:-step] + h[step:] * np.uint64(power) if len(h) > step else h[:0]
        step, power = step * 2, power * power % (1 << 64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window: the place of its anchor; and the hashes of all grams."""
    hashes = gram_hashes(data)
    best, at, step, left = hashes, np.arange(len(hashes), dtype=np.int32), 1, WINDOW - GRAM + 1
    while step * 2 <= left:
        first = best[:-step] <= best[step:]
        best, at = np.where(first, best[:-step], best[step:]), np.where(first, at[:-step], at[step:])
        step *= 2
    rest = left - step
    if rest:
        first = best[:-rest] <= best[rest:]
        at = np.where(first, at[:-rest], at[rest:])
    return at, hashes


def snippets(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(document, start, windows, place of the anchor, anchor hash, content hash) of all snippets."""
    lengths = np.array([len(x) for x in texts], np.int64)
    data = b"".join(texts)
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * 6
    if len(data) < WINDOW:
        return tuple(found)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    place, hashes = anchors(np.frombuffer(data, np.uint8))
    whole = np.flatnonzero(owner[: len(place)] == owner[WINDOW - 1 :])
    if not len(whole):
        return tuple(found)
    at = place[whole]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)))
    first = np.flatnonzero(new)
    start, count = whole[first], np.diff(np.append(first, len(whole)))
    doc = owner[start]
    offset = at[first] - start
    digest = xxhash.xxh3_64_intdigest
    content = np.array([digest(data[a:b], k) for a, b, k in zip(start.tolist(), (start + count + WINDOW - 1).tolist(), offset.tolist(), strict=True)], np.uint64)
    begin = ends - lengths
    return doc, start - begin[doc], count, offset, hashes[at[first]].view(np.int64), content.view(np.int64)


def chunks(ids: np.ndarray, texts: list[str]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Documents in pieces of about CHUNK_BYTES, a document in one piece. ids: one row each; pieces have a column each."""
    own: list[bytes] = []
    first = size = 0
    for k, text in enumerate(texts):
        own.append(text.encode("utf-8", "surrogatepass"))
        size += len(own[-1])
        if size > CHUNK_BYTES or k == len(texts) - 1:
            yield ids[first : k + 1].T, own
            own, first, size = [], k + 1, 0


def _pack(start: np.ndarray, count: np.ndarray, gram: np.ndarray | int = 0) -> np.ndarray:
    """One number that sorts by start. gram: where in the snippet its anchor stands."""
    return (start << 15) | (gram << 8) | count


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> 15, place & 255


def _windows(data: bytes, start: int, count: int) -> list[int]:
    return [xxhash.xxh3_64_intdigest(data[a : a + WINDOW]) for a in range(start, start + count)]


def _earliest_first(anchor: np.ndarray, content: np.ndarray, ids: np.ndarray, mark: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key and then by document and place; whether each row heads its key."""
    order = np.lexsort((place, mark, ids, content, anchor))
    a, c = anchor[order], content[order]
    return order, np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]))) if len(order) else np.zeros(0, bool)


def _snippet_rows(wide: frozenset[int]):
    """Rows SNIPPETS of batches of documents."""
    wide_ids = np.array(sorted(wide), np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for (ids, marks), texts in chunks(batch[["doc_id", "mark"]].to_numpy(np.int64), batch["text"].tolist()):
                doc, start, count, gram, anchor, content = snippets(texts)
                common = np.isin(anchor, wide_ids) if len(wide_ids) else np.zeros(len(anchor), bool)
                if common.any():
                    some = [x[common] for x in (doc, start, count)]
                    hashed = [_windows(texts[d], s, c) for d, s, c in zip(*(x.tolist() for x in some), strict=True)]
                    many = np.array([h for w in hashed for h in w], np.uint64).view(np.int64)
                    doc2 = np.repeat(some[0], some[2])
                    start2 = np.concatenate([np.arange(s, s + c) for s, c in zip(some[1].tolist(), some[2].tolist(), strict=True)])
                    doc, start = np.concatenate((doc[~common], doc2)), np.concatenate((start[~common], start2))
                    count, gram = np.concatenate((count[~common], np.ones(len(many), np.int64))), np.concatenate((gram[~common], np.zeros(len(many), np.int64)))
                    anchor, content = np.concatenate((anchor[~common], many)), np.concatenate((content[~common], ~many))
                parts.append((ids[doc], marks[doc], _pack(start, count, gram), anchor, content))
            if not parts:
                continue
            ids, mark, place, anchor, content = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, head = _earliest_first(anchor, content, ids, mark, place)
            # repeated rows are one document: both are heads or neither is
            first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            ids, mark, place, anchor, content = ids[order], mark[order], place[order], anchor[order], content[order]
            again = ~head & (ids == ids[first]) & (mark == mark[first]) & (place == place[first])
            keep = ~again
            copy = (~head)[keep]
            out = pd.DataFrame({"anchor": anchor[keep], "content": content[keep], "doc_id": ids[keep], "mark": mark[keep], "place": place[keep], "known": False})
            yield out[~copy]
            yield _merged(out[copy])[list(out.columns)]

    return run


def _merged(copies: pd.DataFrame) -> pd.DataFrame:
    """Copies (doc_id, mark, place) that touch or overlap in a document as one known row each."""
    start, count = _unpack(copies["place"].to_numpy(np.int64))
    stop = start + count + WINDOW - 1
    ids, mark = copies["doc_id"].to_numpy(np.int64), copies["mark"].to_numpy(np.int64)
    order = np.lexsort((start, mark, ids))
    ids, mark, start, stop = ids[order], mark[order], start[order], stop[order]
    new = np.ones(len(ids), bool)
    other = (ids[1:] != ids[:-1]) | (mark[1:] != mark[:-1])
    number = np.concatenate(([0], np.cumsum(other))) << 40 if len(ids) else np.zeros(0, np.int64)
    reach = np.maximum.accumulate(stop + number) - number if len(ids) else stop
    new[1:] = other | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids))[: len(first)] - 1
    place = _pack(start[first], np.zeros(len(first), np.int64))
    return pd.DataFrame({"anchor": reach[last], "content": 0, "doc_id": ids[first], "mark": mark[first], "place": place, "known": True})


#: What is known of a part of a document. kind: "copy" (remove start to stop), "open" (compare
#: the snippet's bytes with others of its key) or "wide" (compare its windows one by one).
PARTS = "kind string, key long, doc_id long, mark int, start long, stop long, gram long"


def _parts(kind: str, key, ids, mark, place=None, start=None, stop=None) -> pd.DataFrame:
    gram = 0
    if place is not None:
        start, count = _unpack(place)
        stop, gram = start + count + WINDOW - 1, (place >> 8) & 127
    return pd.DataFrame({"kind": kind, "key": key, "doc_id": ids, "mark": mark, "start": start, "stop": stop, "gram": gram})


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """PARTS from rows SNIPPETS sorted by anchor, content, doc_id, mark, place.

    Streams: all it holds is the heads of at most WIDE different snippets of one anchor.
    """
    columns = ("anchor", "doc_id", "mark", "place")
    held = pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})
    last = wide = None  # last: (anchor, content, doc_id, mark, place) of the latest head; wide: an anchor

    def settled(heads: pd.DataFrame) -> Iterator[pd.DataFrame]:
        size = heads.groupby("anchor")["place"].transform("size").to_numpy()
        many = (size > WIDE) | (heads["anchor"].to_numpy() == wide) if wide is not None else size > WIDE
        for kind, pick in (("wide", many), ("open", ~many & (size > 1))):
            some = heads[pick]
            if len(some):
                yield _parts(kind, *(some[c].to_numpy() for c in columns))

    for batch in batches:
        known = batch["known"].to_numpy()
        if known.any():
            some = batch[known]
            start, _ = _unpack(some["place"].to_numpy(np.int64))
            yield _parts("copy", 0, some["doc_id"].to_numpy(), some["mark"].to_numpy(), None, start, some["anchor"].to_numpy())
            batch = batch[~known]
        if not len(batch):
            continue
        anchor, content, ids, mark, place = (batch[x].to_numpy(np.int64) for x in ("anchor", "content", "doc_id", "mark", "place"))
        head = np.ones(len(batch), bool)
        head[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
        head[0] = last is None or (anchor[0], content[0]) != last[:2]
        first = np.maximum.accumulate(np.where(head, np.arange(len(head)), -1))
        own = [np.where(first >= 0, x[first], 0 if last is None else last[k]) for k, x in ((2, ids), (3, mark), (4, place))]
        copy = ~head & ((ids != own[0]) | (mark != own[1]) | (place != own[2]))
        if copy.any():
            yield _parts("copy", 0, ids[copy], mark[copy], place[copy])
        last = (anchor[-1], content[-1], *(x[-1] for x in own))
        held = pd.concat([held, pd.DataFrame(dict(zip(columns, (anchor[head], ids[head], mark[head], place[head]), strict=True)))], ignore_index=True)
        going_on = (held["anchor"] == anchor[-1]).to_numpy()
        yield from settled(held[~going_on])
        held = held[going_on]
        if len(held) > WIDE or wide == anchor[-1]:
            wide = anchor[-1]
            yield from settled(held)
            held = held.iloc[:0]
    yield from settled(held)


class ColumnBWT:
    """Burrows-Wheeler transform and common prefixes of many short strings, column by column.

    Round j puts the suffix of length j of every string that has one into the sorted list of
    all shorter suffixes. Its place follows from the transform alone: the suffixes before the
    string's last one that are preceded by the same symbol keep their order in front of it.
    """

    def __init__(self, strings: list[bytes], least: int = 0) -> None:
        """least: suffixes shorter than this need no names."""
        m = len(strings)
        sizes = self.sizes = np.array([len(x) for x in strings], np.int64)
        data = np.frombuffer(b"".join(strings), np.uint8)
        ends = np.cumsum(sizes)
        # symbols are the ranks of the bytes that occur, from 1; 0 ends a string
        codes = np.zeros(256, np.uint16)
        codes[np.unique(data)] = np.arange(1, len(np.unique(data)) + 1)
        data = codes.astype(np.uint8 if codes.max() < 256 else np.uint16)[data]
        active = np.flatnonzero(sizes > 0)
        self.symbol, self.lcp = np.zeros(m, data.dtype), np.zeros(m, np.uint8)
        self.symbol[active] = data[ends[active] - 1]
        self.name = np.arange(m) * 256  # string * 256 + length; -1 where it does not matter
        spot, step, n_ended = np.arange(m), 0, m - len(active)
        while len(active):
            step += 1
            order = np.argsort(self.symbol, kind="stable")
            # where the places of the active strings stand in that order: by symbol, then place
            at = spot[active]
            here = self.symbol[at]
            mine = np.lexsort((at, here))
            is_active = np.zeros(len(order), bool)
            is_active[at] = True
            where = np.empty(len(active), np.int64)
            where[mine] = np.flatnonzero(is_active[order])
            to = where - n_ended + m
            low = self._between(order, where - 1, where, here)
            high = self._between(order, where, where + 1, here)
            more = sizes[active] > step
            fresh = np.zeros(len(active), data.dtype)
            fresh[more] = data[ends[active[more]] - step - 1]
            total = len(order) + len(active)
            old = np.ones(total, bool)
            old[to] = False
            self.symbol = self._merged(old, to, self.symbol, fresh)
            self.lcp = self._merged(old, to, self.lcp, low)
            if step == least:
                self.name = np.full(total, -1)
                self.name[to] = active * 256 + step
            elif step > least:
                self.name = self._merged(old, to, self.name, active * 256 + step)
            behind = to + 1
            touch = (behind < total) & np.append(old, True)[np.minimum(behind, total)]
            self.lcp[behind[touch]] = high[touch]
            spot[active] = to
            n_ended += int((~more).sum())
            active = active[more]
        if step < least:
            self.name = np.full(len(self.symbol), -1)

    @staticmethod
    def _merged(old: np.ndarray, to: np.ndarray, kept: np.ndarray, added: np.ndarray) -> np.ndarray:
        out = np.empty(len(old), kept.dtype)
        out[old] = kept
        out[to] = added
        return out

    def _between(self, order: np.ndarray, a: np.ndarray, b: np.ndarray, here: np.ndarray) -> np.ndarray:
        """1 + the least common prefix between two neighbouring places of one symbol; else 0."""
        n = len(order)
        inside = (a >= 0) & (b < n)
        x, y = order[np.clip(a, 0, n - 1)], order[np.clip(b, 0, n - 1)]
        inside &= (self.symbol[x] == here) & (self.symbol[y] == here)
        out = np.zeros(len(a), np.uint8)
        found = np.flatnonzero(inside)
        if len(found):
            start, stop = x[found] + 1, y[found] + 1
            pick = np.argsort(start, kind="stable")
            pairs = np.column_stack((start[pick], stop[pick])).ravel()
            padded = np.append(self.lcp, np.uint8(0))
            out[found[pick]] = np.minimum.reduceat(padded, pairs)[::2] + np.uint8(1)
        return out

    def repeats(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, string, offset) of all substrings of this width that occur more than once."""
        joined = self.lcp >= width
        joined[:1] = False
        inside = joined | np.append(joined[1:], False)
        group, name = np.cumsum(~joined)[inside], self.name[inside]
        return group, name >> 8, self.sizes[name >> 8] - (name & 255)


def may_repeat(rows: pd.DataFrame) -> np.ndarray:
    """Which snippets can share a window with another one.

    A window reaches 34 bytes or more beyond its anchor on one side, so two that are equal have
    equal bytes from there to the anchor's other end. Snippets without such bytes in common leave.
    """
    side = (WINDOW - GRAM) // 2
    digest = xxhash.xxh3_64_intdigest
    keys = []
    for data, gram in zip(rows["bytes"], rows["gram"].tolist(), strict=True):
        keys.append((digest(data[gram - side : gram + GRAM], 1) if gram >= side else 0, digest(data[gram : gram + GRAM + side], 2) if len(data) >= gram + GRAM + side else 0))
    out = np.zeros(len(rows), bool)
    for column in np.array(keys, np.uint64).reshape(-1, 2).T:
        _, number, count = np.unique(column, return_inverse=True, return_counts=True)
        out |= (count[number] > 1) & (column != 0)
    return out


def repeated_windows(rows: pd.DataFrame) -> pd.DataFrame:
    """PARTS of kind copy from snippets (doc_id, mark, start, bytes) whose windows repeat earlier ones."""
    rows = rows[may_repeat(rows)].reset_index(drop=True)
    group, string, offset = ColumnBWT(rows["bytes"].tolist(), WINDOW).repeats(WINDOW)
    ids, mark = rows["doc_id"].to_numpy(np.int64)[string], rows["mark"].to_numpy(np.int64)[string]
    start = rows["start"].to_numpy(np.int64)[string] + offset
    order = np.lexsort((start, mark, ids, group))
    new = np.concatenate(([True], group[order][1:] != group[order][:-1]))[: len(order)]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    # repeated rows are one document, whose first window is no copy in either
    pick = order[(ids[order] != ids[head]) | (mark[order] != mark[head]) | (start[order] != start[head])]
    merged = _merged(pd.DataFrame({"doc_id": ids[pick], "mark": mark[pick], "place": _pack(start[pick], np.ones(len(pick), np.int64))}))
    start, _ = _unpack(merged["place"].to_numpy(np.int64))
    stop = merged["anchor"].to_numpy() if len(merged) else np.zeros(0, np.int64)
    return _parts("copy", 0, merged["doc_id"].to_numpy(), merged["mark"].to_numpy(), None, start, stop)


FETCHED = PARTS + ", bytes binary"


def _fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the parts that are to be compared; copies among wide windows of a batch."""
    for batch in batches:
        rows, windows = [], []
        for doc_id, mark, text, parts in zip(batch["doc_id"].tolist(), batch["mark"].tolist(), batch["text"], batch["parts"], strict=True):
            if parts is None:
                continue
            data = text.encode("utf-8", "surrogatepass")
            for p in parts:
                start, stop = p["start"], p["stop"]
                if p["kind"] == "open":
                    rows.append(("open", p["key"], doc_id, mark, start, stop, p["gram"], data[start:stop]))
                else:
                    windows += [(data[a : a + WINDOW], doc_id, mark, a) for a in range(start, stop - WINDOW + 1)]
        windows.sort()
        head = None
        for content, doc_id, mark, a in windows:
            if head is None or head[0] != content:
                head = (content, doc_id, mark, a)
            again = head != (content, doc_id, mark, a)
            key = xxhash.xxh3_64_intdigest(content) - (1 << 63)
            rows.append(("copy" if again else "open", a if again else key, doc_id, mark, a, a + WINDOW, 0, b"" if again else content))
        if rows:
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FETCHED.split(", ")])


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Copies from snippets sorted by key; whole keys go into each transform."""
    names = [x.split()[0] for x in PARTS.split(", ")]
    rest = None
    for batch in batches:
        known = (batch["kind"] == "copy").to_numpy()
        if known.any():
            yield batch[known][names]
        rows = batch[~known] if rest is None else pd.concat([rest, batch[~known]], ignore_index=True)
        if len(rows) < SET_SNIPPETS:
            rest = rows
            continue
        whole = (rows["key"] != rows["key"].iloc[-1]).to_numpy()
        rest = rows[~whole]
        if whole.any():
            yield repeated_windows(rows[whole].reset_index(drop=True))
    if rest is not None and len(rest):
        yield repeated_windows(rest.reset_index(drop=True))


def wide_anchors(docs: DataFrame) -> frozenset[int]:
    """Anchors that many documents of a sample have in different snippets; at most LOOK_ANCHORS."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, texts in chunks(batch["doc_id"].to_numpy(np.int64), batch["text"].tolist()):
                *_, anchor, content = snippets(texts)
                yield pd.DataFrame({"anchor": anchor, "content": content})

    some = docs.where(F.abs(F.xxhash64("doc_id")) % 1000 < int(1000 * LOOK_SHARE))
    seen = some.mapInPandas(look, "anchor long, content long").distinct().groupBy("anchor").count()
    found = seen.where(F.col("count") >= LOOK_LEAST).orderBy(F.desc("count"), "anchor").limit(LOOK_ANCHORS).collect()
    return frozenset(r["anchor"] for r in found)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, start, stop) of bytes to remove; spans may overlap. docs: doc_id, mark and text, no nulls."""
    rows = docs.mapInPandas(_snippet_rows(wide_anchors(docs)), SNIPPETS)
    order = ("anchor", "content", "doc_id", "mark", "place")
    deal = F.when(F.col("known"), F.xxhash64("doc_id", "mark", "place")).otherwise(F.col("anchor"))
    met = keep_lineage_short(rows.repartition(deal).sortWithinPartitions(*order).mapInPandas(_meet, PARTS))
    unsettled = met.where("kind <> 'copy'").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("kind", "key", "start", "stop", "gram")).alias("parts"))
    fetched = docs.join(unsettled, ["doc_id", "mark"], "left").mapInPandas(_fetch, FETCHED)
    compared = fetched.repartition("key").sortWithinPartitions("key").mapInPandas(_compare, PARTS)
    return met.where("kind = 'copy'").union(compared).select("doc_id", "mark", "start", "stop")


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint, maximal spans in order."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame) -> DataFrame:
    mark = F.xxhash64("text").bitwiseAND((1 << 31) - 1).cast("int")
    texts = doc_texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("mark", mark)
    spans = repeated_spans(texts).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return texts.join(spans, ["doc_id", "mark"], "left")


def _own_spans(spans) -> list[tuple[int, int]]:
    return [] if spans is None else union_of([(s["start"], s["stop"]) for s in spans])


def _cut_out(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, removed spans (byte offsets) and the bytes that remain, as text where they are UTF-8."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch["doc_id"].tolist(), batch["text"], batch["spans"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                own = _own_spans(spans)
                rows.append((None if doc_id == NO_ID else doc_id, [{"start": a, "stop": b} for a, b in own], _cut_out(data, own).decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["doc_id", "spans", "text"]).astype({"doc_id": "Int64"})

    return _with_spans(docs).mapInPandas(run, "doc_id long, spans array<struct<start long, stop long>>, text string")


def removal_digests(docs: DataFrame) -> DataFrame:
    """What is removed from each text, and a digest of what remains (columns REMOVED)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch["doc_id"].tolist(), batch["text"], batch["spans"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                own = _own_spans(spans)
                removed = sum(b - a for a, b in own)
                rows.append((None if doc_id == NO_ID else doc_id, len(data), removed, len(own), hashlib.sha256(_cut_out(data, own)).hexdigest()))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in REMOVED.split(", ")]).astype({"doc_id": "Int64"})

    return _with_spans(docs).mapInPandas(run, REMOVED)
