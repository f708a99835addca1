"""Language identification with language-bitmask n-gram filters.

Training counts the letter trigrams of every training text per language, over all of them. A
trigram belongs to the languages in which its share is at least ``LEAST_SHARE`` and at least
``RELATIVE`` of its largest share in any language, so a language has at most 1 / LEAST_SHARE
trigrams, whatever the corpus. The members go into bit-sliced Bloom filters: one table of slots,
each slot a mask with one bit per language. The AND of the masks at a trigram's slots names
all languages that contain it, in one lookup for all languages.

A text's trigrams are looked up and counted per language. A filter that is filled to a share f
answers wrongly with probability f ** HASHES; the counts are corrected for that, the highest
one decides and its share of all trigrams is the score (ties: the first name).

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is every text
when nothing was learned. Training rows with null text or language teach nothing. Ids, sources
and languages of the rows that are judged are not looked at. Repeated rows get equal answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed
from .hashing import splitmix

LEAST_SHARE = 1e-5
RELATIVE = 0.2
SLOT_BITS = 20
HASHES = 3
HELD_ENTRIES = 1_000_000
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(text: str | None) -> np.ndarray:
    """All letter trigrams of the lower-cased text, packed exactly into 63 bits.

    Whatever is no letter counts as a gap; a gap may begin or end a trigram, not stand in it.
    """
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _is_letter()[points]
    points = np.where(letter, points, 0)
    return ((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[letter[1:-1]]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == 0, F.lit(False))


def trigram_counts(training: DataFrame) -> DataFrame:
    """``lang``, ``gram`` and ``n`` over all training texts; each task sends sums."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(at, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)

        def frames():
            for lang, parts in held.items():
                grams, n = merged(parts)
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                found = [trigrams(t) for t in texts]
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((grams, n))
                if len(parts) > 8:
                    held[lang] = [merged(parts)]
            if sum(len(g) for parts in held.values() for g, _ in parts) > HELD_ENTRIES:
                yield from frames()
                held.clear()
        yield from frames()

    known = training.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return known.mapInPandas(rows, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """Bit-sliced Bloom filters of all languages: ``masks[slot, word]``."""

    def __init__(self, members: pd.DataFrame, slot_bits: int = SLOT_BITS):
        self.names = sorted(members["lang"].unique())
        self.slot_bits = slot_bits
        self.masks = np.zeros((1 << slot_bits, max(1, -(-len(self.names) // 64))), np.uint64)
        for k, name in enumerate(self.names):
            for slots in self.slots(members.loc[members["lang"] == name, "gram"].to_numpy(np.int64)):
                self.masks[slots, k // 64] |= np.uint64(1 << (k % 64))
        fill = np.array([((self.masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(self.names))])
        self.wrong = fill ** HASHES

    def slots(self, grams: np.ndarray) -> list[np.ndarray]:
        mixed = splitmix(grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        low = np.uint64((1 << self.slot_bits) - 1)
        return [((mixed >> np.uint64(k * 64 // HASHES)) & low).astype(np.int64) for k in range(HASHES)]

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """Per language, how many of the trigrams it contains, corrected for wrong answers."""
        found = np.bitwise_and.reduce([self.masks[s] for s in self.slots(grams)])
        hits = np.array([int(((found[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).sum()) for k in range(len(self.names))])
        return np.clip((hits - len(grams) * self.wrong) / np.maximum(1 - self.wrong, 1e-12), 0, len(grams))

    def judge(self, text: str | None) -> tuple[str, float]:
        grams = trigrams(text)  # none without a letter
        if not self.names or not len(grams):
            return UNKNOWN, 0.0
        counts = self.counts(grams)
        best = int(np.argmax(counts))
        return self.names[best], float(counts[best] / len(grams))


def learn(training: DataFrame, least_share: float = LEAST_SHARE, relative: float = RELATIVE) -> Filters:
    """Filters from all training texts. At most 1 / least_share trigrams a language are gathered."""
    counts = trigram_counts(training)
    totals = counts.groupBy(F.col("lang").alias("_l")).agg(F.sum("n").alias("_all"))
    shares = counts.join(totals, F.col("lang") == F.col("_l")).select("lang", "gram", (F.col("n") / F.col("_all")).alias("share")).where(F.col("share") >= least_share)
    largest = shares.groupBy(F.col("gram").alias("_g")).agg(F.max("share").alias("_most"))
    members = shares.join(largest, F.col("gram") == F.col("_g")).where(F.col("share") >= relative * F.col("_most"))
    return Filters(members.select("lang", "gram").toPandas())


def identified(docs: DataFrame, filters: Filters) -> DataFrame:
    """``_row``, ``lang_pred`` and ``score`` of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.judge(t) for t in texts], columns=["lang_pred", "score"])

    rows = packed(docs, F.col("text").cast("string").alias("_text")).select("_row", judge("_text").alias("_found"))
    return rows.select("_row", "_found.lang_pred", "_found.score")
