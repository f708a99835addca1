"""Toxicity, the Merkle manifest and importance resampling: brute force, edge cases, held-out accuracy."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boardlake.llm import language, manifest, resampling, toxicity
from boardlake.llm.common import prepare
from boardlake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, _row string, weight string"
data = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test data not mounted")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    prepare(spark)
    long_text = "\n".join(f"w{i % 700}x{i}" for i in range(30_000))
    rows = [
        (1, None, None, None, 5), (2, "", "en", "a", 0), (None, "no id\nhere at all", "de", "a", None), (4, long_text, "en", "b", 7), (5, long_text, "en", "b", 7),
        (6, " \n\t\n", None, "b", 1), (7, "one two three", "fr", None, 2), (7, "one two three", "fr", None, 2), (7, "two\none", "fr", None, 2),
        (7, "a\nb", "fr", "b", 2), (None, "no id\nhere at all", "de", "a", None), (None, "x\ny", "de", "a", 3), (-3, "é\n▁", "de", "a", 3), (1 << 40, "far\n", "de", "a", 3),
    ]
    return spark.createDataFrame([(*r, "k", "r", "w") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 11
def test_gradient_is_that_of_the_noisy_or():
    rng = np.random.default_rng(4)
    batch = pd.DataFrame({"toxic": [1, 0, 1, 0], "plain": [2, 0, 1, 40], "ids": [[0, 1, 1], [2], [], [0, 2, 1]], "sizes": [[2, 1], [1], [], [1, 2]], "n": [1, 1, 3, 2]})
    at = rng.normal(size=5)

    def brute(x):
        total = 0.0
        for toxic, plain, ids, sizes, n in batch.itertuples(index=False):
            p = [1 / (1 + math.exp(-x[3]))] * plain
            k = 0
            for s in sizes:
                p.append(1 / (1 + math.exp(-(x[3] + sum(x[j] for j in ids[k : k + s])))))
                k += s
            clean = math.prod([1 - v for v in p]) * (1 - 1 / (1 + math.exp(-x[4])))
            total -= n * math.log(1 - clean if toxic else clean)
        return total

    loss, gradient = toxicity.loss_and_gradient(batch, at[:3], at[3], at[4])
    assert loss == pytest.approx(brute(at))
    for k in range(5):
        step = np.zeros(5)
        step[k] = 1e-6
        assert gradient[k] == pytest.approx((brute(at + step) - brute(at - step)) / 2e-6, abs=1e-5)


def test_offending_sentences_are_located_from_document_labels(spark):
    rng = random.Random(8)
    plain = [f"word{k}" for k in range(60)]

    def sentence(*more):
        return " ".join([*rng.choices(plain, k=6), *more]).capitalize() + "."

    docs, labels, spots = [], [], {}
    for i in range(600):
        parts = [sentence() for _ in range(rng.randrange(1, 9))]
        toxic = i % 4 == 0
        if toxic:
            bad = sentence(rng.choice(["grobian", "grobiane", "Lump"]))
            at = rng.randrange(len(parts) + 1)
            parts.insert(at, bad)
            spots[i] = sum(len(p) + 1 for p in parts[:at])
        docs.append((i, " ".join(parts)))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame([*docs, (600, "Such grobianen here. Nothing else."), (601, None), (602, "")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(frame, known))
    got = {r["_row"]["doc_id"]: r for r in toxicity.scored(frame, model).collect()}
    assert all((got[i]["score"] >= 0.5) == bool(toxic) for i, toxic in labels)
    assert all([x["start"] for x in got[i]["offending"]] == [at] for i, at in spots.items())
    assert got[600]["score"] > 0.5 and got[600]["offending"][0]["end"] == 19  # an ending never seen
    assert got[601]["score"] == got[602]["score"] < 0.1


def test_scores_are_the_noisy_or_of_the_sentences():
    model = toxicity.Model({" bad ": 0, " worse ": 1}, np.array([3.0, 4.0]), bias=-2.0, leak=-3.0)

    def sigmoid(z):
        return 1 / (1 + math.exp(-z))

    score, located = model.judge("Bad day! worse, Bad\nfine", 0.8)
    assert score == pytest.approx(1 - (1 - sigmoid(-3)) * (1 - sigmoid(1)) * (1 - sigmoid(5)) * (1 - sigmoid(-2)))
    assert [(x["start"], x["end"]) for x in located] == [(9, 19)]
    assert model.judge(None)[0] == model.judge("12 ...")[0] == pytest.approx(1 - (1 - sigmoid(-3)) * (1 - sigmoid(-2)))


def test_toxicity_takes_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (7, 0), (7, 1), (2, 0), (4, None)], "doc_id long, toxic int")
    for docs, n in ((odd, 14), (none, 0)):
        model = toxicity.fit(toxicity.training_rows(docs, labels), steps=2)
        rows = toxicity.scored(docs, model).collect()
        assert len(rows) == n and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.training_rows(odd, labels).where("text = 'one two three'").select("toxic").collect() == [(1,)] * 2
    assert toxicity.fit(toxicity.training_rows(odd, labels.limit(0))).index == {}


@data
def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = QUERIES["op11_toxicity"](spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").toPandas()
    rank, n1 = got["score"].rank(), int(got["toxic"].sum())
    area = (rank[got["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(got) - n1))
    assert area > 0.95
    assert got.loc[got["toxic"] == 1, "predicted"].mean() > 0.75 and got.loc[got["toxic"] == 0, "predicted"].mean() < 0.01


# 12
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def brute_manifest(rows):
    """Rows of (doc_id, leaf, subroot, root, proof, folded, verified)."""

    def written(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha(*[written(r[c]) for c in ("doc_id", "source", "lang", "n_chars")], written(text))

    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    forest = {s: tree_levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = tree_levels([forest[s][-1][0] for s in names])

    def path(levels, k):
        for level in levels[:-1]:
            a = k // 3 * 3
            yield "".join(level[a:k]), "".join(level[k + 1 : a + 3])
            k //= 3

    out = []
    for j, s in enumerate(names):
        for k, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            node = own
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                node = leaf(r, r["text"].replace("\n", ""))
            steps = [*path(forest[s], k), *path(top, j)]
            for left, right in steps:
                node = sha(left, node, right)
            out.append((r["doc_id"], own, forest[s][-1][0], top[-1][0], sha(*[a + b for a, b in steps]), node, node == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_manifest_equals_brute_force(spark, levels):
    prepare(spark)
    rng = random.Random(levels)
    ids = rng.sample(range(-70_000, 70_000), 300) + [2**62, -(2**62), 32767, 32768, 0]
    rows = [(i, rng.choice(["x\ny", "plain", None, "é"]), None, rng.choice(["hot"] * 3 + [f"s{k}" for k in range(12)] + [None, ""]), 3) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = Counter(tuple(r) for r in manifest.manifest(docs, tamper=True, levels=levels).collect())
    assert got == brute_manifest(docs.collect())


def test_manifest_takes_odd_rows(odd, none):
    got = Counter(tuple(r) for r in manifest.manifest(odd, tamper=True).collect())
    assert got == brute_manifest(odd.collect())
    assert all(r["verified"] for r in manifest.manifest(odd).collect())
    assert manifest.manifest(none).count() == 0


def test_places_are_ranks(spark):
    prepare(spark)
    rng = random.Random(2)
    ids = rng.sample(range(200_000), 5000)
    rows = spark.createDataFrame([(i, "s", "1:s", "x", None) for i in ids], "doc_id long, source string, group string, leaf string, other string")
    got = {r["doc_id"]: r["place"] for r in manifest.places(rows).collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}


# 13
def brute_resampling(docs, target, buckets=10_000, longest=1, percent=10, least=20):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = {c: c + 32 for c in range(65, 91)}

    def counts(text):
        w = word.findall((text or "").translate(lower))
        runs = [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
        return len(w), Counter(zlib.crc32(r.encode()) % buckets for r in runs)

    ours = [(i, *counts(t)) for i, t in docs]
    s, t = sum((c for _, _, c in ours), Counter()), sum((counts(x)[1] for x in target), Counter())
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    out, may = [], []
    for i, n, c in ours:
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, sum(c.values()), weight, score, None])
        if n >= least:
            may.append(out[-1])
    may.sort(key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for k, x in enumerate(may[: percent * len(may) // 100]):
        x[4] = k + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_brute_force(spark, longest):
    prepare(spark)
    rng = random.Random(longest)
    words = [f"w{k}" for k in range(50)] + ["É", "ÄB", "1st", "\x00", "-", "İ"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(400)] + [(None, "x " * 30), (7, "Y" * 5000), (8, None), (9, "")]
    target = [" ".join(rng.choices(words[:10], k=40)) for _ in range(20)] + [None]
    frame = spark.createDataFrame([(*d, "k", 1, 2) for d in docs], "doc_id long, text string, rank string, _place int, score int")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(frame, goal, percent=25, buckets=97, longest=longest)
    want = brute_resampling(docs, target, 97, longest, 25)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_resampling_takes_odd_rows(odd, none):
    for docs, n in ((odd, 14), (none, 0)):
        for target in (odd, none):
            rows = resampling.resampled(docs, target).collect()
            assert len(rows) == n
            assert Counter(tuple(r) for r in rows) == brute_resampling([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])


def test_spans_overlap_and_end_at_word_borders():
    line = b"ab abc ab"
    found = [m.group() for m in resampling.run_pattern(2).finditer(line, overlapped=True)]
    assert found == [b"ab abc", b"abc ab"]
