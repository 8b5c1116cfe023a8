"""Properties of the in-task structures over generated input."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from caselight.llm import bpe, fingerprints, packing, quality, simhash, suffix_dedup
from caselight.llm.common import BPE_RANKS

few = settings(max_examples=150, deadline=None)
strings = st.lists(st.text("ab", max_size=9).map(str.encode), max_size=6)


@few
@given(strings)
def test_columns_sort_all_suffixes(texts):
    found = suffix_dedup.ColumnBWT(texts)
    suffixes = [(texts[n >> 8][len(texts[n >> 8]) - (n & 255) :], n >> 8) for n in found.name.tolist()]
    assert suffixes == sorted(suffixes, key=lambda s: (tuple(x + 1 for x in s[0]) + (0,), s[1]))
    for (a, _), (b, _), lcp in zip(suffixes, suffixes[1:], found.lcp[1:].tolist(), strict=False):
        assert lcp == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@few
@given(strings, st.integers(1, 4))
def test_columns_find_all_repeats(texts, width):
    group, string, offset = suffix_dedup.ColumnBWT(texts, width).repeats(width)
    found = {}
    for g, s, o in zip(group.tolist(), string.tolist(), offset.tolist(), strict=True):
        found.setdefault(g, set()).add((s, o))
    expected = {}
    for s, text in enumerate(texts):
        for o in range(len(text) - width + 1):
            expected.setdefault(text[o : o + width], set()).add((s, o))
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in expected.values() if len(v) > 1)


@few
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=4))
def test_longest_repeats(docs):
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    words = np.array([w for d in docs for w in d], np.int64)
    expected = []
    for d in docs:
        for i in range(len(d)):
            longest = [next((k for k in range(len(d)) if i + k >= len(d) or j + k >= len(d) or d[i + k] != d[j + k]), len(d)) for j in range(len(d)) if j != i]
            expected.append(max(longest, default=0))
    assert quality.WordSuffixes(words, owner).longest_repeats().tolist() == expected


@few
@given(st.lists(st.integers(0, 2**64 - 1), max_size=4), st.lists(st.sets(st.integers(0, 63), max_size=4), min_size=1, max_size=8))
def test_trie_links_what_is_near(base, flips):
    values = np.unique(np.array([b ^ sum(1 << k for k in f) for b in base for f in flips], np.uint64))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= simhash.BUDGET if len(values) else np.zeros((0, 0), bool)
    a, b = np.nonzero(np.triu(near, 1))
    assert simhash.trie_self_join(values, np.zeros(len(values), np.int64)).tolist() == simhash._labels(len(values), a, b).tolist()


@few
@given(st.text())
def test_bpe_round_trip_and_reference(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = bpe.load(BPE_RANKS).encode(text)
    assert ids == packing.encoding(BPE_RANKS).encode_ordinary(text)
    assert bpe.load(BPE_RANKS).decode(ids) == text.encode()


@few
@given(st.text("abc", max_size=30), st.text("abc", max_size=30), st.integers(0, 30), st.integers(0, 30))
def test_common_extensions(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    x, y = (fingerprints.PrefixHash(fingerprints.code_points(s)) for s in (a, b))
    expected = next((k for k in range(31) if i + k >= len(a) or j + k >= len(b) or a[i + k] != b[j + k]), 0)
    assert x.common_extension(i, y, j) == expected


@few
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 8))
def test_bins_never_overflow(lengths, limit):
    bins, fill = packing.OpenBins(50, limit), {}
    for n in lengths:
        b, at = bins.place(n)
        assert at == fill.get(b, 0)
        fill[b] = at + n
        assert fill[b] <= 50 and bins.open <= limit
