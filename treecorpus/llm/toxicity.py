"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from treecorpus.llm.common import held_out_column, logistic, small_batches, training_rows, utf8
from treecorpus.llm.quality import Constant

#: Training texts per class, terms of the lexicon, and clean words that are never a misspelling.
PER_CLASS, TERMS, CLEAN = 3000, 4000, 100_000
#: A term is in this share of the toxic training texts, and so many times as frequent there as in clean ones.
SHARE, TIMES = 0.004, 20
#: Most texts of a term that are looked at for what chance alone would give.
CHANCE = 100
#: Shortest term that may be misspelled, lengths of stems, words on either side of a hit that are its context.
FUZZY_FROM, STEMS, AROUND = 5, (4, 5, 6), 8
#: Words that report speech, and words that address somebody.
REPORTING = {"said", "says", "say", "called", "calls", "word", "words", "term", "quote", "quoted", "reported", "wrote", "phrase"}
ADDRESSING = {"you", "your", "u", "ur", "tu", "te", "du", "dich", "vous", "toi", "usted"}
QUOTES = re.compile("[\"“”„«»]")
WORD = re.compile(r"\w+")
TERM, LONG, STEM = "", "~", "*"
#: Words whose answer a worker remembers before it starts anew.
REMEMBERED = 400_000


class Lexicon:
    """Terms in a trie: a node is a dict of children, and of what ends there.

    ``TERM`` holds the weight of a term, ``LONG`` the same if the term may be misspelled, ``STEM`` that
    of a stem; none of these is a letter of a word.
    """

    def __init__(self, terms: Iterable[tuple[str, float]], clean: Iterable[str] = ()):
        self.trie: dict = {}
        self.clean = set(clean)
        self.heads, self.tails = set(), set()
        for term, weight in terms:
            node = self.trie
            for c in term.rstrip(STEM):
                node = node.setdefault(c, {})
            if term.endswith(STEM):
                node[STEM] = weight
                continue
            node[TERM] = weight
            if len(term) >= FUZZY_FROM:
                node[LONG] = weight
                # One edit touches one half at most (two swapped letters may touch both).
                half = len(term) // 2
                self.heads |= {term[:half], term[:half - 1] + term[half]}
                self.tails |= {term[half:], term[half - 1] + term[half + 1:]}
        self.sizes = sorted({len(x) for x in self.heads | self.tails})
        self.known: dict[str, tuple[float, int] | None] = {}

    def find(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the best term for a word, or None."""
        try:
            return self.known[word]
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = self.exact(word)
            if found is None and len(word) >= FUZZY_FROM - 1 and word not in self.clean and any(
                    word[:n] in self.heads or word[-n:] in self.tails for n in self.sizes):
                found = self.misspelled(word)
            self.known[word] = found
            return found

    def exact(self, word: str) -> tuple[float, int] | None:
        node, stem = self.trie, None
        for c in word:
            node = node.get(c)
            if node is None:
                return stem and (stem, 0)
            if STEM in node:
                stem = max(stem or 0, node[STEM])
        weight = node.get(TERM, stem)
        return weight and (weight, 0)

    def misspelled(self, word: str) -> tuple[float, int] | None:
        """The heaviest term one edit (insert, delete, replace, swap) away.

        The word's Levenshtein automaton and the trie are walked together. Without an edit so far
        there is one trie node per place in the word; each edit leads to a state after which word
        and trie must go on alike.
        """
        n, best = len(word), 0.0

        def alike(node: dict, place: int) -> None:
            nonlocal best
            for c in word[place:]:
                node = node.get(c)
                if node is None:
                    return
            best = max(best, node.get(LONG, 0.0))

        node = self.trie
        for place in range(n + 1):
            if place < n:
                alike(node, place + 1)  # a letter too many
            after = word[place + 1:place + 2]
            for c, child in node.items():
                if c == TERM or c == LONG or c == STEM:
                    continue
                if place < n and (not after or after in child):
                    alike(child, place + 1)  # another letter
                if place == n or word[place] in child:
                    alike(child, place)  # a letter too few
                if c == after and word[place] in child:
                    alike(child[word[place]], place + 2)  # two letters swapped
            node = node.get(word[place]) if place < n else None
            if node is None:
                break
        return (best, 1) if best else None


FEATURES = 7


def evidence(text: str, lexicon: Lexicon) -> np.ndarray:
    """What a text holds: hits by weight, per word, at their densest, misspelled, quoted, addressed."""
    text = text.lower()
    words = WORD.findall(text)
    listed = {w: f for w in set(words) if (f := lexicon.find(w))}
    if not listed:
        return np.zeros(FEATURES)
    hits = [(i, *listed[w]) for i, w in enumerate(words) if w in listed]
    places = np.array([h[0] for h in hits])
    weights = np.array([h[1] * (0.7 if h[2] else 1) for h in hits])
    spots = [m.start() for m in WORD.finditer(text)]
    marks = np.array([m.start() for m in QUOTES.finditer(text)], dtype=np.int64)
    quoted = np.zeros(len(hits), bool)
    aimed = np.zeros(len(hits), bool)
    for k, i in enumerate(places):
        near = words[max(0, i - AROUND):i + AROUND + 1]
        inside = np.searchsorted(marks, spots[i]) % 2 == 1
        quoted[k] = inside or any(w in REPORTING for w in words[max(0, i - 4):i])
        aimed[k] = any(w in ADDRESSING for w in near)
    own = weights * np.where(quoted, 0.4, 1.0) * np.where(aimed, 1.2, 1.0)
    sums = np.r_[0, np.cumsum(own)]
    density = (sums[np.searchsorted(places, places + AROUND, side="right")] - sums[np.searchsorted(places, places - AROUND)]).max()
    n = max(len(words), 1)
    return np.array([np.log1p(own.sum()), np.log1p(100 * own.sum() / n), np.log1p(density), len(hits) / n * 10,
                     sum(h[2] for h in hits) / len(hits), quoted.mean(), aimed.mean()])


class Judge:
    """A lexicon and the weights of its evidence."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        found = np.array([evidence(x.decode(), self.lexicon) for x in texts]).reshape(-1, FEATURES)
        return logistic(found @ self.weights + self.bias)


def terms_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + STEM for w in words for n in STEMS if len(w) > n}


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms that tell toxic training texts from clean ones; equal texts count once.

    Words are counted in Spark; at most ``TERMS`` terms and ``CLEAN`` clean words come to the driver.
    """

    def run(batches):
        for batch in batches:
            for text, label in zip(utf8(batch.column("text")), batch.column("label").to_pylist()):
                found = sorted(terms_of(text.decode()))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())], ["term", "label"])

    texts = sample.dropDuplicates(["text", "label"]).select("text", "label")
    totals = dict(texts.groupBy("label").count().collect())
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    counted = texts.mapInArrow(run, "term string, label int").groupBy("term").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    # A term of d texts is toxic in all of them by chance with probability prior ** d: of the terms
    # with no clean text, take those that so many others make unlikely to be a coincidence.
    prior = toxic / max(toxic + clean, 1)
    number = counted.groupBy((F.col("toxic") + F.col("clean")).alias("d")).count().filter(f"d <= {CHANCE}").collect()
    fewest = 1 + max([r["d"] for r in number if r["count"] * prior ** r["d"] > 1], default=1)
    ratio = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    strong = counted.filter((F.col("toxic") >= max(fewest, SHARE * toxic)) & (
        (ratio >= TIMES) | (F.col("clean") == 0)))
    top = strong.withColumn("weight", F.log(ratio)).orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "term").limit(TERMS)
    terms = [(r.term, float(r.weight)) for r in top.select("term", "weight").collect()]
    known = counted.filter((F.col("clean") > 0) & ~F.col("term").endswith(STEM)).orderBy(F.desc("clean"), "term").limit(CLEAN)
    return Lexicon(terms, [r.term for r in known.select("term").collect()])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Judge | Constant:
    """A judge fitted on at most ``per_class`` labelled texts of each class; held-out ids take no part."""
    small_batches(docs.sparkSession)
    sample = training_rows(docs, labels, label, per_class)
    totals = dict(sample.groupBy("label").count().collect())
    if not (totals.get(0) and totals.get(1)):
        return Constant(1.0 if totals.get(1) else 0.0 if totals.get(0) else 0.5)
    lexicon = learn_lexicon(sample)

    def run(batches):
        for batch in batches:
            found = [evidence(x.decode(), lexicon).tolist() for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.float64()))], ["label", "found"])

    rows = sorted((r.label, *r.found) for r in sample.mapInArrow(run, "label int, found array<double>").collect())
    table = np.array(rows, dtype=np.float64)
    y, x = table[:, 0], table[:, 1:]
    known = dict(labels.filter(F.col(label).isin(0, 1) & ~held_out_column(F.col("doc_id"))).groupBy(label).count().collect())
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(FEATURES + 1)
    penalty = np.r_[np.full(FEATURES, 1e-2), 1e-6] * len(y) / 100
    for _ in range(50):  # Newton steps of a logistic regression
        p = logistic(x1 @ w)
        hessian = (x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(penalty)
        w -= np.linalg.solve(hessian, x1.T @ (p - y) + penalty * w)
    shift = np.log(known.get(1, 1) / known.get(0, 1)) - np.log(y.sum() / (len(y) - y.sum()))
    return Judge(lexicon, w[:-1], float(w[-1] + shift))
