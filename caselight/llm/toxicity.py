"""Toxicity scores from a learned lexicon, matched by Levenshtein automata.

Fit, on a bounded sample of labelled rows (SAMPLE_ROWS): terms and open-ended stems that mark
toxic texts, near copies counted once; then a logistic regression over match counts. Score:
the lexicon's trie and the Levenshtein automata of its terms run together as one automaton
over each word, its states built when first met. Each match is weighed by its context window:
quotation marks and words of reporting around it mean that abuse is cited rather than uttered.

Defined cases: a null or empty text gets the score of a text without matches; repeated rows
get equal scores; a null doc_id is not held out; labels that are null are not learned from;
without labels of both kinds every score is the smoothed share
of toxic ones, 0.25 without any; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, keep_lineage_short

#: Labelled rows that a model is fitted on, at most.
SAMPLE_ROWS = 20_000
STEM_LETTERS = (4, 5, 6, 7)
#: A term has to be so many times likelier in a toxic text than in another.
LIKELIER = 15.0
COPY_SIGNS = 3
CONTEXT_WORDS = 6
MEMO_ENTRIES = 500_000
#: States of an automaton that are kept; beyond, they are made anew.
STATES = 200_000
#: What a cited match weighs as long as the sample does not say otherwise; an uttered one is learned from zero.
CITED_WEIGHT = 1.0
#: Letters that digits and signs stand for, marks and words of quotation.
LOOKALIKES = str.maketrans("01345@$", "oieasas")
QUOTE_KINDS = {sign: kind for kind in ("\"“”„", "«»", "‘’") for sign in kind}
ALONE = {"„": True, "«": True, "‘": True, "»": False, "”": False, "’": False}
REPORTING = frozenset(
    "said says wrote writes quote quotes quoted called calls reported reports word words term "
    "sagte sagt schrieb schreibt nannte nennt zitierte zitiert zitat wort "
    "dit disait écrit écrivait appelé appelle cité cite citation mot "
    "dijo dice escribió escribe llamó llama citó cita palabra".split()
)
LETTERS = re.compile(r"[^\W\d_]+")
EDGE = "\"'“”„«»‘’.,;:!?()[]{}<>-–—…*#&%|"


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: a fifth, by the checksum of the id's digits."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def allowed_errors(term: str, stem: bool) -> int:
    return 0 if len(term) < 5 or stem else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """The lexicon's trie met with Levenshtein automata; states are made as words reach them."""

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[bool, bool]] = [(False, False)]  # of a whole term; of a stem
        self.budget: list[int] = [0]  # most errors that any term below allows
        for term, stem in terms:
            node, budget = 0, allowed_errors(term, stem)
            self.budget[0] = max(self.budget[0], budget)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append((False, False))
                    self.budget.append(0)
                node = self.children[node][letter]
                self.budget[node] = max(self.budget[node], budget)
            whole, open_ended = self.ends[node]
            self.ends[node] = (whole or not stem, open_ended or stem)
        self.own_budget: dict[int, int] = {}
        self.term_of: dict[int, str] = {}
        for term, stem in terms:
            node = 0
            for letter in term:
                node = self.children[node][letter]
            self.own_budget[node] = max(self.own_budget.get(node, 0), allowed_errors(term, stem))
            self.term_of[node] = term
        self._begin()

    def _begin(self) -> None:
        self.states: list[dict[int, int]] = []
        self.numbers: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, found: dict[int, int]) -> int:
        """Number of the state with these (node, errors), left-out letters allowed for; -1: dead."""
        queue = list(found.items())
        while queue:
            node, errors = queue.pop()
            for child in self.children[node].values():
                if errors + 1 <= self.budget[child] and found.get(child, 9) > errors + 1:
                    found[child] = errors + 1
                    queue.append((child, errors + 1))
        if not found:
            return -1
        key = frozenset(found.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(found)
            self.steps.append({})
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        found: dict[int, int] = {}

        def add(node: int, errors: int) -> None:
            if errors <= self.budget[node] and found.get(node, 9) > errors:
                found[node] = errors

        for node, errors in self.states[state].items():
            if self.ends[node][1] and errors == 0:
                found[node] = 0  # a stem takes any ending
            add(node, errors + 1)
            for other, child in self.children[node].items():
                add(child, errors + (other != letter))
        self.steps[state][letter] = to = self._state(found)
        return to

    def errors(self, word: str) -> int:
        """Fewest errors between the word and a term; -1 if there is no match."""
        return self.nearest(word)[0]

    def nearest(self, word: str) -> tuple[int, str]:
        """Those errors, and the term; -1 and nothing if there is no match."""
        if len(self.states) > STATES:
            self._begin()
        state = self.start
        for letter in word:
            to = self.steps[state].get(letter)
            state = self._step(state, letter) if to is None else to
            if state < 0:
                return -1, ""
        best, term = -1, ""
        for node, errors in self.states[state].items():
            whole, stem = self.ends[node]
            if (whole and errors <= self.own_budget[node] or stem and errors == 0) and (best < 0 or (errors, self.term_of[node]) < (best, term)):
                best, term = errors, self.term_of[node]
        return best, term


def readings(word: str) -> tuple[str, ...]:
    """What a word may stand for: itself, its runs of letters, and with letters for digits and signs."""
    bare = word.strip(EDGE)
    return (bare,) if bare.isalpha() else (bare, *LETTERS.findall(bare), bare.translate(LOOKALIKES))


class Matcher:
    """Counts of a text's matches: uttered and cited ones, exact and misspelled."""

    FEATURES = ("uttered", "misspelled", "cited")

    def __init__(self, terms: list[tuple[str, bool]], ordinary: frozenset[str] = frozenset()) -> None:
        """ordinary: words that look like a term but are none."""
        self.automaton = LexiconAutomaton(terms)
        self.ordinary = ordinary
        self.memo: dict[str, int] = {}

    def _errors(self, word: str) -> int:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > MEMO_ENTRIES:
                self.memo.clear()
            read = (-1 if x in self.ordinary else self.automaton.errors(x) for x in readings(word))
            found = min((x for x in read if x >= 0), default=-1)
            self.memo[word] = found
        return found

    def counts(self, text: str) -> tuple[float, float, float]:
        words = text.lower().split()
        hits = {w: e for w in set(words) if (e := self._errors(w)) >= 0}
        if not hits:
            return 0.0, 0.0, 0.0
        uttered = misspelled = cited = 0.0
        for i, word in enumerate(words):
            if (errors := hits.get(word)) is not None:
                share = self._citation(words, i)
                cited += share
                uttered += (1 - share) * (errors == 0)
                misspelled += (1 - share) * (errors > 0)
        return uttered, misspelled, cited

    @staticmethod
    def _citation(words: list[str], i: int) -> float:
        """How far the words around word i read like a quotation: 0 to 0.9."""
        start = max(0, i - CONTEXT_WORDS)
        window = words[start : i + 1 + CONTEXT_WORDS]
        reported = any(w.strip(EDGE) in REPORTING for k, w in enumerate(window, start) if k != i)
        return 0.6 * quoted(window, i - start) + 0.3 * reported


def quotation_marks(word: str) -> list[tuple[str, bool | None]]:
    """The kind of each quotation mark of a word and whether it opens, by the side that its letters are on.

    A mark by itself opens or closes by its form; one form for both is None. An apostrophe between letters is none.
    """
    out = []
    for k, sign in enumerate(word):
        kind = QUOTE_KINDS.get(sign)
        if kind is None:
            continue
        before, after = any(map(str.isalnum, word[:k])), any(map(str.isalnum, word[k + 1 :]))
        if before and after:
            left, right = word[k - 1].isalnum(), word[k + 1].isalnum()
            if left != right:
                out.append((kind, right))
        elif before or after:
            out.append((kind, after))
        else:
            out.append((kind, ALONE.get(sign)))
    return out


def quoted(words: list[str], i: int) -> bool:
    """Whether word i stands between an opening mark and the mark that closes it, both among these words."""
    open_at: dict[str, list[int]] = {}
    for k, word in enumerate(words):
        for kind, opens in quotation_marks(word):
            unclosed = open_at.setdefault(kind, [])
            if opens or (opens is None and not unclosed):
                unclosed.append(k)
            elif unclosed and unclosed.pop() <= i <= k:
                return True
    return False


def inputs(counts: np.ndarray) -> np.ndarray:
    """What a score depends on: uttered terms, misspelled or not, and cited ones."""
    return np.log1p(np.column_stack((counts[:, 0] + counts[:, 1], counts[:, 2])))


@dataclass(frozen=True)
class Model:
    terms: tuple[tuple[str, bool], ...]
    ordinary: frozenset[str]
    weights: tuple[float, ...]

    def score(self, counts: np.ndarray) -> np.ndarray:
        z = inputs(counts) @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """text and toxic of at most `limit` labelled rows that are not held out."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(limit)
    )
    return doc_texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def learn_terms(sample: DataFrame) -> list[tuple[str, bool]]:
    """(term, whether it is a stem that takes any ending) of the words that mark toxic texts."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<!\p{L})(\p{L}{3,40})(?!\p{L})"), F.lit(1)))
    texts = sample.select("toxic", words.alias("words")).where(F.size("words") > 0)
    # near copies share a rare word of least hash under one of some hashes, and then count once
    rare = F.filter("words", lambda w: F.length(w) >= 7)
    for k in range(COPY_SIGNS):
        sign = F.coalesce(F.array_min(F.transform(rare, lambda w, k=k: F.xxhash64(w, F.lit(k)))), F.xxhash64("words"))
        texts = texts.withColumn("sign", sign).dropDuplicates(["toxic", "sign"])
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return []
    stems = [F.transform("words", lambda w, n=n: F.when(F.length(w) > n, F.substring(w, 1, n))) for n in STEM_LETTERS]
    whole = F.transform("words", lambda w: F.concat(w, F.lit("$")))
    terms = texts.select("toxic", F.explode(F.array_compact(F.array_distinct(F.concat(whole, *stems)))).alias("term"))
    least = max(3, bad // 80)
    counted = terms.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where(F.col("t") >= least)
    likelier = (F.col("t") + 0.5) / bad / ((F.col("c") + 0.5) / good)
    found = counted.where((likelier >= LIKELIER) & (F.col("c") * 10 <= F.col("t"))).collect()  # words of the bounded sample
    marks = shortest_marks({r["term"]: r["t"] for r in found})
    return marks + forms(texts, [term for term, stem in marks if stem])


def forms(texts: DataFrame, stems: list[str]) -> list[tuple[str, bool]]:
    """The words of toxic texts under the stems, as terms of their own that allow errors."""
    if not stems:
        return []
    word = F.explode("words").alias("word")
    under = [F.substring("word", 1, n).isin(some) for n in STEM_LETTERS if (some := [x for x in stems if len(x) == n])]
    found = texts.where("toxic = 1").select(word).distinct().where(functools.reduce(Column.__or__, under)).collect()
    return [(r["word"], False) for r in sorted(found)]  # words of the bounded sample


def shortest_marks(counts: dict[str, int]) -> list[tuple[str, bool]]:
    """The fewest terms: the longest stem that keeps the count, or the one word under it.

    counts: texts with each stem, or with each whole word (marked by a $ at its end).
    """
    out: list[tuple[str, bool]] = []
    for term in sorted(counts, key=lambda x: (len(x), x)):
        if any(term.startswith(x) if stem else term == x + "$" for x, stem in out):
            continue
        if term.endswith("$"):
            out.append((term[:-1], False))
            continue
        while longer := [x for x in counts if len(x) > len(term) and x.startswith(term) and x[-1] != "$" and counts[x] >= 0.95 * counts[term]]:
            term = min(longer, key=lambda x: (len(x), -counts[x], x))
        words = [x for x in counts if x[-1] == "$" and x.startswith(term)]
        if len(words) == 1 and counts[words[0]] >= 0.9 * counts[term]:
            out.append((words[0][:-1], False))
        else:
            out.append((term, True))
    return list(dict.fromkeys(out))


def ordinary_words(sample: DataFrame, terms: list[tuple[str, bool]]) -> frozenset[str]:
    """Words of other texts that resemble a term and do not mark toxic texts themselves."""

    def resembling(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = LexiconAutomaton(terms)
        for batch in batches:
            found = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                read = {x for w in set(text.lower().split()) for x in readings(w)}
                found += [(x, toxic) for x in read if automaton.errors(x) > 0]
            yield pd.DataFrame(found, columns=["word", "toxic"])

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    counted = sample.where("toxic is not null").mapInPandas(resembling, "word string, toxic long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    likelier = (F.col("t") + 0.5) / max(bad, 1) / ((F.col("c") + 0.5) / max(good, 1))
    return frozenset(r["word"] for r in counted.where((F.col("c") > 0) & (likelier < LIKELIER)).collect())  # words of the bounded sample


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Model:
    """Learns terms and weights from the bounded sample."""
    sample = keep_lineage_short(labelled_sample(docs, labels, limit))
    terms = learn_terms(sample)
    ordinary = ordinary_words(sample, terms) if terms else frozenset()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(terms, ordinary)
        for batch in batches:
            out = pd.DataFrame([matcher.counts(x) for x in batch["text"]], columns=list(Matcher.FEATURES), dtype=float)
            yield out.assign(toxic=batch["toxic"].to_numpy())

    rows = sample.mapInPandas(count, "uttered double, misspelled double, cited double, toxic int").toPandas()
    counts = rows[list(Matcher.FEATURES)].to_numpy(float).reshape(-1, 3)
    return Model(tuple(terms), ordinary, tuple(map(float, logistic(inputs(counts), rows["toxic"].to_numpy(float)))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 60) -> np.ndarray:
    """Weights of the constant, uttered and cited matches, by Newton's method from a prior.

    Of one kind of label alone, or none, the constant follows from its smoothed share, (toxic + 0.5) / (labels + 2). Both kinds of label weigh the same. A citation, which a sample may hardly have, keeps the prior's weight then.
    """
    x = np.column_stack((np.ones(len(x)), x))
    prior = np.array([0.0, 0.0, CITED_WEIGHT])
    w = prior.copy()
    if not len(y) or y.min() == y.max():
        return np.array([np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5)), 0.0, 0.0])
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    penalty = ridge * np.diag([0.0] + [1.0] * (len(w) - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + penalty @ (w - prior)
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the match counts of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(list(model.terms), model.ordinary)
        for batch in batches:
            counts = np.array([matcher.counts(x) for x in batch["text"]], float).reshape(-1, 3)
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.score(counts)})
            yield out.assign(**{name: counts[:, k] for k, name in enumerate(Matcher.FEATURES)})

    scored = doc_texts(docs).mapInPandas(run, "doc_id long, score double, uttered double, misspelled double, cited double")
    decided = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", decided, *Matcher.FEATURES)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, fit(docs, labels))
