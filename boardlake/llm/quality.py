"""Quality rules as a short-circuit cascade.

Each rule is a predicate that rejects a text. On a bounded sample the operator measures how long each
rule's measures take and which rows it rejects,
and then orders the rules greedily: always the rule next that rejects most of the rows still
left per second. The ordered rules become one CASE expression over a text and its words, which are split
once, so an expensive rule is only evaluated for texts that every earlier rule let pass. The order changes the work, never
the verdict.

Nulls and empty texts have no words and are rejected by ``few_words``. Rows are judged one by
one: repeated rows get equal verdicts, an empty table gives an empty table, and further
columns, whatever their names, pass through.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, count_rows, let, packed, text_of, words

SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2000
WINDOW = 5


def repeated_words(found: Column) -> Column:
    """Words covered by five-word windows that occur twice or more in the text."""
    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            def twice(x: Column, i: Column) -> Column:
                return F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))

        def total(p: Column) -> Column:
            gained = F.transform(p, lambda x, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(p, i - 1))))
            return F.aggregate(gained, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return let(let(ordered, starts), total)

    def windows(w: Column) -> Column:
        return F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]),
        )

    none = F.lit(0).cast("bigint")
    return let(
        let(found, windows),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)),
    )


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(SPACE)) != "")


#: Measures of a text and its words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("bigint"),
    "word_chars": lambda t, w: F.length(F.array_join(w, "")).cast("bigint"),
    "n_symbols": lambda t, w: (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
    "n_text_lines": lambda t, w: F.size(_lines(t)).cast("bigint"),
    "n_dup_lines": lambda t, w: let(_lines(t), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")),
    "n_repeat_words": lambda t, w: repeated_words(w),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` builds the predicate from the measures named in ``needs``."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[dict[str, Column]], Column]


FEW_WORDS = Rule("few_words", ("n_words",), lambda m: m["n_words"] < 10)
REPEATED_WORDS = Rule("repeated_words", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"])
SYMBOL_HEAVY = Rule("symbol_heavy", ("n_words", "n_symbols"), lambda m: m["n_symbols"] > m["n_words"])
WORD_LENGTH = Rule("word_length", ("n_words", "word_chars"), lambda m: (m["word_chars"] > 20 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"]))
DUPLICATE_LINES = Rule("duplicate_lines", ("n_text_lines", "n_dup_lines"), lambda m: 2 * m["n_dup_lines"] > m["n_text_lines"])
BASE = (FEW_WORDS, REPEATED_WORDS)
FURTHER = (SYMBOL_HEAVY, WORD_LENGTH, DUPLICATE_LINES)
RULES = (*BASE, *FURTHER)


def with_measures(docs: DataFrame, names: list[str] | None = None, text: str = "text") -> DataFrame:
    """``_row`` and the measures of every whole text."""
    names = names or list(MEASURES)
    rows = packed(docs, text_of(text).alias("_text")).select("_row", "_text", words(F.col("_text")).alias("_words"))
    return rows.select("_row", *[MEASURES[n](F.col("_text"), F.col("_words")).alias(n) for n in names])


def measure_seconds(rows: DataFrame, names: list[str], runs: int = 2) -> dict[str, float]:
    """How long each measure takes over ``rows`` (held in memory), beyond what a pass takes anyway."""

    def seconds(value: Column) -> float:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            rows.agg(F.sum(value)).collect()
            taken.append(time.perf_counter() - start)
        return min(taken)

    text, held = F.col("_text"), F.col("_words")
    rows.agg(F.sum(F.size(held))).collect()  # fills the memory
    empty = seconds(F.size(held))
    return {n: max(seconds(MEASURES[n](text, held)) - empty, 1e-3) for n in names}


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> list[Rule]:
    """The rules, those first that reject most of the rows still left per second.

    The sample takes about ``sample_rows`` rows by a hash of id and text, so that copies with
    ids of their own are not taken or left together. What reaches the driver
    is one row per set of failed rules, so no more than the sample has rows.
    """
    every = max(1, count_rows(docs) // sample_rows)
    key = [F.col(c) for c in ("doc_id", text) if c in docs.columns]
    sample = docs.where(F.pmod(F.xxhash64(*key), F.lit(every)) == 0).select(text_of(text).alias("_text"))
    rows = sample.select("_text", words(F.col("_text")).alias("_words")).persist()
    try:
        needs = sorted({n for r in rules for n in r.needs})
        seconds = measure_seconds(rows, needs)
        measures = {n: F.col(n) for n in needs}
        measured = rows.select(F.length("_text").alias("_chars"), *[MEASURES[n](F.col("_text"), F.col("_words")).alias(n) for n in needs])
        failed = measured.select(F.array(*[r.rejects(measures) for r in rules]).alias("fails"), "_chars").groupBy("fails").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("_chars").alias("chars")).collect()
    finally:
        rows.unpersist()
    every_char = sum(r["chars"] for r in failed) or 1
    left, order, rest = [(list(r["fails"]), r["rows"], r["chars"]) for r in failed], [], list(range(len(rules)))

    def rate(k: int) -> float:
        cost = sum(seconds[n] for n in rules[k].needs) * sum(chars for _, _, chars in left) / every_char
        return sum(n for fails, n, _ in left if fails[k]) / (cost + 1e-9)

    while rest:
        best = max(rest, key=lambda k: (rate(k), -k))
        order.append(rules[best])
        rest.remove(best)
        left = [x for x in left if not x[0][best]]
    return order


def cascade(measures: dict[str, Column], ordered: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    out = None
    for rule in ordered:
        fails, name = F.coalesce(rule.rejects(measures), F.lit(False)), F.lit(rule.name)
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``_row`` and ``rejected_by``: the verdict of the cascade, measures evaluated as it goes."""
    return judged_by(docs, plan_cascade(docs, rules, text=text), text)


def judged_by(docs: DataFrame, ordered: list[Rule], text: str = "text") -> DataFrame:
    """``_row`` and ``rejected_by`` under rules in a given order; the words are split once, where the cascade is."""
    value = F.col("_text")
    verdict = let(words(value), lambda w: cascade({n: f(value, w) for n, f in MEASURES.items()}, ordered))
    return packed(docs, text_of(text).alias("_text")).select("_row", verdict.alias("rejected_by"))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns."""
    return judge(docs, rules, text).where(F.col("rejected_by").isNull()).select("_row.*")
