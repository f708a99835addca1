"""Large keys take the chunked path; results must equal the plain window's."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boardlake.functions.digests import tree_digest
from boardlake.operators.ordered import chunks_needed, ordered, with_chunks
from boardlake.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 600
    key = np.where(rng.random(n) < 0.4, 7, rng.integers(0, 20, n))
    pdf = pd.DataFrame({
        "k": [None if x == 19 else int(x) for x in key], "id": rng.permutation(n), "v": rng.integers(0, 50, n),
        "s": [None if x % 9 == 0 else f"s{x % 5}" for x in rng.integers(0, 99, n)],
    })
    return spark.createDataFrame(pdf.astype({"k": "Int64"}), "k bigint, id bigint, v bigint, s string").cache()


def options(rows):
    return dict(
        number="n", previous={"pv": "v", "ps": "s"}, running={"run": F.col("v"), "even": F.when(F.col("v") % 2 == 0, F.col("v"))},
        total={"all": F.col("v")},
    )


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("hot_rows", [10, 50, 200])
def test_chunked_equals_plain(rows, keys, hot_rows):
    assert chunks_needed(rows, keys, hot_rows) > 1
    plain = ordered(rows, keys, ["id"], **options(rows)).toPandas().sort_values("id", ignore_index=True)
    split = ordered(rows, keys, ["id"], hot_rows=hot_rows, **options(rows)).toPandas().sort_values("id", ignore_index=True)
    pd.testing.assert_frame_equal(plain, split[plain.columns], check_dtype=False)


def test_chunked_with_ties_in_position(rows):
    plain = ordered(rows, ["k"], ["v", "id"], number="n", running={"r": F.col("id")}).toPandas()
    split = ordered(rows, ["k"], ["v", "id"], number="n", running={"r": F.col("id")}, hot_rows=20).toPandas()
    a, b = plain.sort_values("id", ignore_index=True), split.sort_values("id", ignore_index=True)
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)


def test_chunks_are_cut_by_rank(spark):
    """One far value and many hot keys; no chunk is far above its share."""
    far = spark.range(20_000).select(F.lit(1).alias("k"), F.when(F.col("id") == 0, 10**15).otherwise(F.col("id")).alias("id"))
    sizes = with_chunks(far, ["k"], ["id"], 20).groupBy("_chunk").count().toPandas()["count"]
    assert sizes.max() <= 2000 and len(sizes) == 20
    keys = spark.range(60_000).select((F.col("id") % 20_000).alias("k"), "id")
    assert with_chunks(keys, ["k"], ["id"], 16).groupBy("_chunk").count().toPandas()["count"].max() <= 7500
    many = keys.where("k < 2000")
    plain = ordered(many, ["k"], ["id"], number="n").toPandas().sort_values("id", ignore_index=True)
    split = ordered(many, ["k"], ["id"], number="n", hot_rows=2).toPandas().sort_values("id", ignore_index=True)
    pd.testing.assert_frame_equal(plain, split[plain.columns], check_dtype=False)


def test_equal_positions(spark):
    same = spark.range(500).select(F.lit(1).alias("k"), F.lit(5).alias("v"), "id")
    split = ordered(same, ["k"], ["v", "id"], number="n", hot_rows=50).toPandas()
    assert (split["n"] == split["id"] + 1).all()


def test_digest_past_its_levels(spark):
    rows = spark.range(20).select((F.col("id") % 2).alias("k"), "id")
    got = tree_digest(rows, ["k"], ["id"], F.col("id").cast("string"), fanout=2).collect()
    assert sorted((r["k"], r["item_count"]) for r in got) == [(0, 10), (1, 10)]


def test_no_large_key_gives_one_window(rows):
    plan = ordered(rows, ["k"], ["id"], number="n")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Window ") == 1


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("interpolate", [True, False])
def test_quantiles_of_large_groups(rows, keys, interpolate):
    probs = {"a": 0.1, "b": 0.5, "c": 0.95}
    plain = exact_quantiles(rows, keys, "v", probs, interpolate=interpolate).toPandas()
    split = exact_quantiles(rows, keys, "v", probs, interpolate=interpolate, hot_rows=40).toPandas()
    if keys:
        plain, split = (d.sort_values("k", ignore_index=True) for d in (plain, split))
    pd.testing.assert_frame_equal(plain, split, check_dtype=False)
    whole = np.asarray(rows.toPandas()["v"])
    if not keys and interpolate:
        assert np.allclose(split[["a", "b", "c"]].to_numpy()[0], np.quantile(whole, [0.1, 0.5, 0.95]))
