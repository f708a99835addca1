"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only the bag has a label. A sentence has the probability
sigmoid(bias + sum of the weights of its features); a document is toxic unless none of its sentences
is (noisy-or), with a small leak for labels that no sentence explains:

    P(toxic) = 1 - (1 - leak) * product of (1 - p) over the sentences

Features are lower-cased words and their runs of four and five letters, borders included, so
inflected forms of a known word count too. How often a feature is in a word of a toxic or of a clean document
is counted over all labelled documents, each word of a document once; the features most associated with
toxic ones (log-likelihood ratio) are the vocabulary. A text is searched for all of them in one pass (Aho-Corasick).
Weights, which are never negative (no word makes a sentence harmless), bias and leak follow the gradient of the documents' likelihood, over all labelled documents: tasks add up
gradients of their documents, one number per weight reaches the driver per step. The documents come as a table
of known features per sentence, so texts are not read again.

A document's score is P(toxic). The sentences with a probability of at least ``LEAST`` are
located by start and end in code points.

Defined cases: null and empty texts are one sentence without known features, and get the score of
that. Labels are joined by doc_id: null labels teach nothing, of several labels of a doc_id the highest counts, a
row without doc_id has no label. Repeated rows each count, and get equal scores. Without training
rows every score is that of a fresh model, close to 0. Words of any length are taken whole; extra columns
pass through inside ``_row`` whatever their names; labels, languages, sources and ids of the rows that are scored
are not looked at. Ties between features at the end of the vocabulary go to the smaller feature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, saved
from .near_dups import small

VOCABULARY = 16_384
#: Log-likelihood ratio a feature needs; chance reaches it about once in 10^4 features, which the ridge keeps small.
LEAST_RATIO = 15.0
#: How many times as often a feature must occur in words of toxic documents; common letters pass any count by chance of topic.
LEAST_LIFT = 4.0
STEPS = 40
RATE = 0.3
RIDGE = 1.0
LEAST = 0.5
HELD_WORDS = 500_000
ENDS = ".!?\n"
SHORT, LONG = 4, 5
_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: what a letter becomes in lower case (a space for anything else), and whether it ends a sentence."""
    if not _tables:
        small = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                small[c] = ord(low) if len(low) == 1 else c
        ends = np.zeros(0x110000, bool)
        ends[[ord(c) for c in ENDS]] = True
        _tables.extend([small, ends])
    return _tables[0], _tables[1]


def plain(text: str | None) -> tuple[str, np.ndarray, np.ndarray]:
    """The text with letters in lower case and spaces for the rest, one space around it; where it is a
    letter, and where sentences end. Positions are those of the text plus one."""
    small, ends = _letters()
    points = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    found = small[points]
    return found.tobytes().decode("utf-32-le", "surrogatepass"), found != 32, np.flatnonzero(ends[points])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Text and ``toxic`` of the documents with a label."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_l")).agg(F.max("toxic").cast("int").alias("toxic"))
    return docs.join(small(known), F.col("doc_id") == F.col("_l")).select(F.col("text").cast("string").alias("text"), "toxic")


def word_counts(training: DataFrame) -> DataFrame:
    """``word`` and the documents of either label that hold it, over all of them; each task sends sums."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[dict[str, int], dict[str, int]] = ({}, {})

        def frames() -> Iterator[pd.DataFrame]:
            for toxic, counts in enumerate(held):
                if counts:
                    yield pd.DataFrame({"word": pd.Series(list(counts), dtype=object), "n": list(counts.values()), "toxic": bool(toxic)})
                    counts.clear()

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                counts = held[1 if toxic else 0]
                for word in set(plain(text)[0].split()):
                    counts[word] = counts.get(word, 0) + 1
                if len(held[0]) + len(held[1]) > HELD_WORDS:
                    yield from frames()
        yield from frames()

    found = training.mapInPandas(rows, "word string, n long, toxic boolean")
    sums = [F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)).alias(name) for t, name in ((False, "clean"), (True, "toxic"))]
    return found.groupBy("word").agg(*sums)


def word_features(word: Column) -> Column:
    """The word within spaces and its runs of letters, each once."""
    whole = F.concat(F.lit(" "), word, F.lit(" "))
    size = F.length(whole)

    def runs(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(size - (k - 1), F.lit(1)))
        return F.filter(F.transform(starts, lambda i: F.substring(whole, i, F.lit(k))), lambda run: F.length(run) == k)

    return F.array_union(F.array_union(runs(SHORT), runs(LONG)), F.array(whole))


def vocabulary(training: DataFrame, size: int = VOCABULARY) -> list[str]:
    """The ``size`` features most associated with toxic documents."""
    words = saved(word_counts(training), "toxicity-words")
    total = words.agg(F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    clean, toxic = total
    if not clean or not toxic:
        return []
    counts = words.select(F.explode(word_features(F.col("word"))).alias("feature"), "clean", "toxic").groupBy("feature").agg(
        F.sum("clean").cast("double").alias("clean"), F.sum("toxic").cast("double").alias("toxic"))
    a, b = F.col("toxic"), F.col("clean")
    share = (a + b) / float(clean + toxic)

    def cell(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    def side(seen: Column, pairs: int) -> Column:
        return cell(seen, pairs * share) + cell(F.lit(float(pairs)) - seen, pairs * (1 - share))

    kept = counts.withColumn("ratio", 2 * (side(a, toxic) + side(b, clean))).where((F.col("ratio") >= LEAST_RATIO) & (a * float(clean) >= LEAST_LIFT * b * float(toxic)))
    return [r["feature"] for r in kept.orderBy(F.desc("ratio"), "feature").limit(size).select("feature").collect()]


@dataclass
class Model:
    """Weights of the features, bias and leak (both as log odds)."""

    index: dict[str, int]
    weights: np.ndarray
    bias: float = -6.0
    leak: float = -6.0
    _automaton: ahocorasick.Automaton | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def known(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known features in a plain text, and the position of a letter of each."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for feature, k in self.index.items():
                self._automaton.add_word(feature, (k, len(feature) - 2))
            self._automaton.make_automaton()
        if not self.index:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # A feature's second character is never a border.
        found = [(k, end - back) for end, (k, back) in self._automaton.iter(text)]
        both = np.array(found, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def bag(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sentences with words but without known features, then the others: which they are, their features and how many; and the letters.

        A text without words is one sentence.
        """
        line, letter, ends = plain(text)
        ids, at = self.known(line)
        sentence = np.searchsorted(ends, at)
        order = np.argsort(sentence, kind="stable")
        which, sizes = np.unique(sentence, return_counts=True)
        before = np.concatenate([[0], np.cumsum(letter)])
        cuts = before[np.concatenate([[0], ends, [len(letter)]])]
        return max(int((np.diff(cuts) > 0).sum()), 1) - len(which), which, ids[order], sizes, letter

    def judge(self, text: str | None, least: float = LEAST) -> tuple[float, list[dict]]:
        """The document's score, and the sentences that are toxic by themselves."""
        rest, which, ids, sizes, letter = self.bag(text)
        p = _sigmoid(self.bias + np.bincount(np.repeat(np.arange(len(sizes)), sizes), self.weights[ids], len(sizes)))
        logs = np.log1p(-np.minimum(p, 1 - 1e-12)).sum() + rest * np.log1p(-_sigmoid(self.bias)) + np.log1p(-_sigmoid(self.leak))
        located = []
        if (p >= least).any():
            ends = plain(text)[2]
            cuts = np.concatenate([[0], ends, [len(letter)]])
            for k, score in zip(which[p >= least], p[p >= least]):
                inside = cuts[k] + np.flatnonzero(letter[cuts[k] : cuts[k + 1]])
                located.append({"start": int(inside[0]) - 1, "end": int(inside[-1]), "score": float(score)})
        return float(min(max(-np.expm1(logs), 0.0), 1.0)), located


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def bags(training: DataFrame, index: dict[str, int]) -> DataFrame:
    """Per document its label, the sentences without known features, and the known features of the others.

    Documents without any known feature differ only in label and sentences, and are counted in ``n``.
    """
    sent = training.sparkSession.sparkContext.broadcast(Model(index, np.zeros(len(index))))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            plain_ones, ids, sizes = [], [], []
            for text in batch["text"]:
                rest, _, known, counts, _ = model.bag(text)
                plain_ones.append(rest)
                ids.append(known.astype(np.int32))
                sizes.append(counts.astype(np.int32))
            yield pd.DataFrame({"toxic": batch["toxic"], "plain": plain_ones, "ids": pd.Series(ids, dtype=object), "sizes": pd.Series(sizes, dtype=object)})

    found = saved(training.mapInPandas(rows, "toxic int, plain long, ids array<int>, sizes array<int>"), "toxicity-documents")
    empty = F.array().cast("array<int>")
    without = found.where(F.size("ids") == 0).groupBy("toxic", "plain").agg(F.count(F.lit(1)).alias("n")).select("toxic", "plain", empty.alias("ids"), empty.alias("sizes"), "n")
    return found.where(F.size("ids") > 0).withColumn("n", F.lit(1).cast("bigint")).unionByName(without)


def loss_and_gradient(batch: pd.DataFrame, weights: np.ndarray, bias: float, leak: float) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of the documents and its gradient by weights, bias and leak."""
    n, width = len(batch), len(weights)
    ids = np.concatenate([np.zeros(0, np.int64), *batch["ids"]]).astype(np.int64)
    sizes = np.concatenate([np.zeros(0, np.int64), *batch["sizes"]]).astype(np.int64)
    doc = np.repeat(np.arange(n), [len(s) for s in batch["sizes"]])
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    p = _sigmoid(bias + np.bincount(sentence, weights[ids], len(sizes)))
    p0, q0 = _sigmoid(bias), _sigmoid(leak)
    plain = batch["plain"].to_numpy(np.float64)
    none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n) + plain * np.log1p(-p0) + np.log1p(-q0)
    toxic, times = batch["toxic"].to_numpy() > 0, batch["n"].to_numpy(np.float64)
    some = np.maximum(-np.expm1(none), 1e-12)
    loss = (times * np.where(toxic, -np.log(some), -none)).sum()
    pull = times * np.where(toxic, -np.exp(none) / some, 1.0)
    by_sentence = pull[doc] * p
    out = np.zeros(width + 2)
    out[:width] = np.bincount(ids, by_sentence[sentence], width)
    out[width] = by_sentence.sum() + (pull * plain).sum() * p0
    out[width + 1] = pull.sum() * q0
    return float(loss), out


def fit(training: DataFrame, size: int = VOCABULARY, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> Model:
    """A model from all training rows (``text``, ``toxic``)."""
    index = {f: k for k, f in enumerate(vocabulary(training, size))}
    model = Model(index, np.zeros(len(index)))
    if not index:
        return model
    table = saved(bags(training, index), "toxicity-bags")
    at = np.concatenate([model.weights, [model.bias, model.leak]])
    width = len(index)
    mean, square = np.zeros(len(at)), np.zeros(len(at))
    for step in range(1, steps + 1):
        weights, bias, leak = at[:width].copy(), float(at[width]), float(at[width + 1])

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(width + 3)
            for batch in batches:
                loss, gradient = loss_and_gradient(batch, weights, bias, leak)
                total[: width + 2] += gradient
                total[width + 2] += loss
            k = np.flatnonzero(total)
            yield pd.DataFrame({"k": k, "g": total[k]})

        found = table.mapInPandas(rows, "k int, g double").groupBy("k").agg(F.sum("g").alias("g")).collect()
        gradient = np.zeros(len(at))
        for row in found:
            if row["k"] < len(at):
                gradient[row["k"]] = row["g"]
        gradient[:width] += ridge * weights
        # Adam: moving means of the gradient and of its square.
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient * gradient
        pace = rate * (1 - step / (steps + 1)) ** 0.5
        at = at - pace * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        at[:width] = np.maximum(at[:width], 0.0)
    return Model(index, at[:width], float(at[width]), float(at[width + 1]))


def scored(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """``_row``, ``score`` and ``offending`` (start, end and score of sentences) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, offending array<struct<start:int,end:int,score:double>>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.judge(t, least) for t in texts], columns=["score", "offending"])

    rows = packed(docs, F.col("text").cast("string").alias("_text")).select("_row", judge("_text").alias("_found"))
    return rows.select("_row", "_found.score", "_found.offending")
