"""User-defined operators over the given tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import extensions as op
from .catalog import query


def _score_limit(df, limit, mode):
    over = F.col("score") >= limit
    return df.withColumn("verdict", F.when(over if mode == "fail-high" else ~over, "FAIL").otherwise("PASS"))


def registry() -> op.Registry:
    r = op.Registry()
    r.register(op.Operator(
        "score-limit", _score_limit, ("id", "score"), ("verdict",),
        {"limit": op.Parameter(float, 0.5, 0.0, 1.0), "mode": op.Parameter(str, "fail-high", options=("fail-high", "fail-low"))},
    ))
    return r


@query("n01_registered_operator", "SELECT id, CASE WHEN score >= 0.25 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM v_inspection")
def registered_operator(t):
    return registry().run("score-limit", t.v_inspection, limit=0.25).select("id", "verdict")


@F.pandas_udf(T.DoubleType())
def _squash(values: pd.Series) -> pd.Series:
    return values / (1.0 + values.abs())


@query("n01_scalar_extension", "SELECT id, round(score / (1 + abs(score)), 6) AS squashed FROM v_inspection")
def scalar_extension(t):
    return t.v_inspection.select("id", F.round(_squash("score"), 6).alias("squashed"))


@query("n02_verified_side_input", "SELECT i.id, r.slug FROM v_inspection i JOIN v_recipe r ON r.id = i.recipe_id WHERE r.is_active")
def verified_side_input(t):
    recipes = t.v_recipe.where("is_active")
    stored = op.store_artifact(recipes, "recipes", "id")
    checked = op.load_artifact(t.spark, stored[0], "id", *stored[1:])
    return t.v_inspection.select("id", "recipe_id").join(
        checked.select(F.col("id").alias("recipe_id"), "slug"), "recipe_id"
    ).select("id", "slug")


def _contrast(image: pd.DataFrame) -> pd.DataFrame:
    cells = np.concatenate(image["row"].to_numpy())
    return pd.DataFrame({
        "image_id": [int(image["image_id"].iloc[0])], "median": [float(np.median(cells))],
        "contrast": [float(cells.max() - cells.min())],
    })


@query("n04_per_image_function", """
SELECT image_id, round(quantile_cont(v, 0.5), 6) AS median, round(max(v) - min(v), 6) AS contrast FROM v_pixel GROUP BY image_id
""")
def per_image_function(t):
    out = op.per_image(t.v_scanline, _contrast, "image_id bigint, median double, contrast double")
    return out.select("image_id", F.round("median", 6).alias("median"), F.round("contrast", 6).alias("contrast"))
