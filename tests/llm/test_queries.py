"""Queries of the subpackage on the smallest tables, against SQL or brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from caselight.llm import packing, registry, token_counts, toxicity
from caselight.llm.common import BPE_JSON, BPE_RANKS, table

from ..both_engines import comparable, connect


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}


def rows(spark, sf_dir, name):
    return registry.QUERIES[name](spark, sf_dir).collect()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    got = comparable(registry.QUERIES[name](spark, sf_dir).toPandas())
    assert got == comparable(connect(sf_dir).sql(registry.ORACLE_SQL[name]).df())


def hf_ids(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(BPE_JSON).encode_batch(list(texts), add_special_tokens=False)]


def test_packing(spark, sf_dir, texts):
    found = rows(spark, sf_dir, "op1_best_fit_packing")
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, ids in zip(texts, hf_ids(texts.values()), strict=True):
        ids = np.array([*ids, 0], "<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert all(r["length"] == 2048 for r in pieces[1:]) and 0 < pieces[0]["length"] <= 2048
        at = 0
        for r in pieces:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(r["length"] for r in found)
    assert len(by_sequence) <= -(-total // 2048) * 1.03 + 1


def test_simhash(spark, sf_dir, texts):
    found = {r["doc_id"]: r for r in rows(spark, sf_dir, "op3_simhash_near_dedup")}

    def print_of(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        if not words:
            return 0
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))

    prints = {d: print_of(t) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in found.items()} == {d: (f"{prints[d]:016x}", root(d)) for d in texts}


def test_bpe(spark, sf_dir, texts):
    found = {r["doc_id"]: r for r in rows(spark, sf_dir, "op5_byte_bpe")}
    encode = packing.encoding(BPE_RANKS).encode_ordinary
    for d, text in texts.items():
        ids = encode(text)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (found[d]["n_tokens"], found[d]["ids_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert found[d]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_quality(spark, sf_dir, texts):
    for r in rows(spark, sf_dir, "op6_quality_rules"):
        text = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])


def removed(texts):
    seen, out = set(), {}
    for d in sorted(texts):
        data = texts[d].encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, sf_dir, texts):
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(spark, sf_dir, "op8_suffix_array_dedup")}
    assert found == removed(texts)


def plain_fingerprint(text):
    """The fingerprint by its definition: every window's polynomial on its own."""
    prime, mask = 2**31 - 1, 2**64 - 1

    def span(points):
        first, second = (sum((c + 1) * pow(base, i, prime) for i, c in enumerate(points)) % prime for base in (1_000_003, 998_244_353))
        return first << 31 | second

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        return x ^ x >> 27

    points = [ord(c) for c in text]
    bins = [None] * 128
    width = min(12, len(points))
    for i in range(len(points) - width + 1 if points else 0):
        m = mixed(span(points[i : i + width]))
        bins[m & 127] = min(m >> 7, bins[m & 127] if bins[m & 127] is not None else m >> 7)
    return f"{span(points) * 31 + len(points) & mask:016x}" + "".join("00" if x is None else f"{1 + mixed(x) % 255:02x}" for x in bins)


def test_fingerprints(spark, sf_dir, texts):
    found = {r["doc_id"]: r for r in rows(spark, sf_dir, "op9_document_fingerprints")}
    ids = sorted(texts, reverse=True)
    prints = {}
    for k, (d, after) in enumerate(zip(ids, ids[1:] + ids[:1], strict=True)):
        own, following, r = texts[d], texts[after], found[d]
        n = len(own) // 3
        edited = own[: len(own) - n] + following[:n]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        prefix = next((i for i, (x, y) in enumerate(zip(own, edited, strict=False)) if x != y), min(len(own), len(edited)))
        suffix = next((i for i, (x, y) in enumerate(zip(own[::-1], edited[::-1], strict=False)) if x != y), min(len(own), len(edited)))
        assert (r["common_prefix"], r["common_suffix"]) == (prefix, suffix)
        if len(own) < 3000 and k % 3 == 0:
            assert r["fingerprint"] == plain_fingerprint(own) and r["edited_fingerprint"] == plain_fingerprint(edited)
        prints[d] = r["fingerprint"]
        for other, near in ((r["edited_fingerprint"], r["near_edited"]), (found[after]["fingerprint"], r["near_next"])):
            pairs = [(a, b) for a, b in zip(re.findall("..", r["fingerprint"][16:]), re.findall("..", other[16:]), strict=True) if (a, b) != ("00", "00")]
            expected = 1.0 if other == r["fingerprint"] else sum(a == b for a, b in pairs) / len(pairs) if pairs else 0.0
            assert near == pytest.approx(expected)
    assert sum(r["near_edited"] > r["near_next"] for r in found.values()) > 0.95 * len(found)


def test_token_counts(spark, sf_dir, texts):
    found = registry.QUERIES["op7_token_counts"](spark, sf_dir).toPandas()
    encode = packing.encoding(BPE_RANKS).encode_ordinary
    own = found["tokenizer"] == "bpe-50k"
    assert comparable(found[~own]) == comparable(connect(sf_dir).sql(token_counts.PATTERN_SQL).df())
    expected = Counter()
    for r in table(spark, sf_dir, "documents").collect():
        expected[r["source"], r["lang"], "docs"] += 1
        expected[r["source"], r["lang"], "tokens"] += len(encode(r["text"] or ""))
    got = Counter()
    for r in found[own].itertuples():
        got[r.source, r.lang, "docs"], got[r.source, r.lang, "tokens"] = r.n_docs, r.n_tokens
    assert got == expected


def test_toxicity_scores_by_brute_force(spark, sf_dir, texts):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        return row[-1]

    def errors(word):
        hits = []
        for x in toxicity.readings(word):
            if x in model.ordinary:
                continue
            for term, stem in model.terms:
                allowed = toxicity.allowed_errors(term, stem)
                if stem and x.startswith(term):
                    hits.append(0)
                elif not stem and abs(len(x) - len(term)) <= allowed and (d := distance(x, term)) <= allowed:
                    hits.append(d)
        return min(hits, default=-1)

    def citation(words, i):
        """By characters: the marks before and after the word's letters, each with its own partner."""
        start = max(0, i - toxicity.CONTEXT_WORDS)
        near = words[start : i + toxicity.CONTEXT_WORDS + 1]
        line, at = " ".join(near), len(" ".join(near[: i - start])) + (i > start)
        inside = False
        for kind in ('"“”„', "«»", "‘’"):
            marks = [k for k, x in enumerate(line) if x in kind and (k == 0 or k + 1 == len(line) or not (line[k - 1].isalnum() and line[k + 1].isalnum()))]
            word_of = {k: line[: k].count(" ") for k in marks}
            opens = {k: any(x.isalnum() for x in line[k:].split(" ")[0]) and not any(x.isalnum() for x in line[:k].split(" ")[-1]) for k in marks}
            pairs = [(a, b) for a, b in zip(marks, marks[1:], strict=False) if opens[a] and not opens[b]]
            inside |= any(word_of[a] <= line[:at].count(" ") <= word_of[b] for a, b in pairs)
        spoken = any(w.strip(toxicity.EDGE) in toxicity.REPORTING for w in near[: i - start] + near[i - start + 1 :])
        return 0.6 * inside + 0.3 * spoken

    known = {}
    for d, text in list(texts.items())[:60]:
        words = text.lower().split()
        z = uttered = cited = 0.0
        for i, w in enumerate(words):
            if w not in known:
                known[w] = errors(w)
            if known[w] >= 0:
                share = citation(words, i)
                cited, uttered = cited + share, uttered + 1 - share
        z = model.weights[0] + model.weights[1] * np.log1p(uttered) + model.weights[2] * np.log1p(cited)
        assert found[d]["score"] == pytest.approx(1 / (1 + np.exp(-z)))


def test_line_dedup_deletes_something(spark, sf_dir):
    assert sum(r["n_deleted"] for r in rows(spark, sf_dir, "op10_line_dedup")) > 0


def test_toxicity(spark, sf_dir):
    found = rows(spark, "/root/testdata/sf0.1", "op4_toxicity")
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    judged = [(labels[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in judged) > 0.97 * len(judged)
    assert sum(a == b == 1 for a, b in judged) > 0.85 * sum(a for a, _ in judged)


def test_pii_is_gone_and_stays_apart(spark, sf_dir):
    from caselight.llm import pii

    docs = table(spark, sf_dir, "documents")
    after = pii.replace_pii(docs, "a key of tests").cache()
    old, new = (pii.entities(x).select("kind", "canonical").distinct() for x in (docs, after))
    assert old.count() == new.count() and old.intersect(new).count() == 0
    assert after.agg(F.sum("n_entities")).first()[0] == pii.entities(docs).count()


def test_pipeline_keeps_columns_and_rules(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        n.append(docs.count())
        if name != "best_fit_packing":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert n[0] > n[1] == n[2] > n[3] == n[4] <= n[5]
    assert corpus_pipeline.run(spark, sf_dir).count() == n[5]
