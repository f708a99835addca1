"""Neighbour, classifier and distribution queries over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images as im
from ..operators import vectors as op
from .catalog import query

DIFF = "list_zip(q.f, s.f)"
E = "(SELECT vec_id, label, list_transform(embedding, lambda v: cast(v AS double)) AS f FROM embeddings)"
L2 = "sqrt(list_sum(list_transform(list_zip(q.f, s.f), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
L1 = "list_sum(list_transform(list_zip(q.f, s.f), lambda p: abs(p[1] - p[2])))"
COS = ("1 - list_sum(list_transform(list_zip(q.f, s.f), lambda p: p[1] * p[2])) / "
       "(sqrt(list_sum(list_transform(q.f, lambda v: v * v))) * sqrt(list_sum(list_transform(s.f, lambda v: v * v))))")


def ranked_sql(distance: str, k: int, extra: str = "") -> str:
    """Leave-one-out neighbours of every vector."""
    return f"""
SELECT qid, sid, label, d, n FROM (
 SELECT qid, sid, label, d, row_number() OVER (PARTITION BY qid ORDER BY d, {extra} sid) AS n FROM (
  SELECT q.vec_id AS qid, s.vec_id AS sid, cast(s.label AS varchar) AS label, {distance} AS d
  FROM {E} q JOIN {E} s ON s.vec_id <> q.vec_id)) WHERE n <= {k}
"""


def neighbours(t, k, metric="euclidean", **options):
    e = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("f"))
    return op.nearest(e, e, "vec_id", "vec_id", "f", k, metric=metric, exclude_self=True, **options)


def doubles(t):
    return t.embeddings.select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("f"))


@query("c12_nearest_neighbours", f"SELECT qid AS vec_id, cast(n AS int) AS rank, sid AS neighbour_id, round(d, 6) AS distance FROM ({ranked_sql(L2, 5)})")
def nearest_neighbours(t):
    return neighbours(t, 5).select("vec_id", "rank", "neighbour_id", F.round("distance", 6).alias("distance"))


@query("c12_nearest_neighbours_manhattan", f"SELECT qid AS vec_id, cast(n AS int) AS rank, sid AS neighbour_id, round(d, 6) AS distance FROM ({ranked_sql(L1, 3)})")
def nearest_neighbours_manhattan(t):
    return neighbours(t, 3, "manhattan").select("vec_id", "rank", "neighbour_id", F.round("distance", 6).alias("distance"))


@query("c12_nearest_neighbours_partitioned", f"SELECT qid AS vec_id, cast(n AS int) AS rank, sid AS neighbour_id, round(d, 6) AS distance FROM ({ranked_sql(L2, 5)})")
def nearest_neighbours_partitioned(t):
    """The path taken when the sample side is too large to broadcast."""
    found = neighbours(t, 5, small_side_bytes=0, pivots=8, block_rows=400)
    return found.select("vec_id", "rank", "neighbour_id", F.round("distance", 6).alias("distance"))


@query("c13_ratio_matches", f"""
SELECT a.qid AS vec_id, a.sid AS neighbour_id, round(a.d, 6) AS distance, round(b.d, 6) AS second_distance
FROM ({ranked_sql(L2, 2)}) a JOIN ({ranked_sql(L2, 2)}) b ON b.qid = a.qid AND a.n = 1 AND b.n = 2 WHERE a.d < 0.95 * b.d
""")
def ratio_matches(t):
    m = op.ratio_matches(neighbours(t, 2), "vec_id", 0.95)
    return m.select("vec_id", "neighbour_id", F.round("distance", 6).alias("distance"), F.round("second_distance", 6).alias("second_distance"))


@query("i01_region_mean_colour", """
SELECT r.image_id, r.roi_id, p.ch, round(avg(p.v) / 255.0::double, 6) AS mean FROM v_roi r JOIN v_colour p ON p.image_id = r.image_id
 AND p.x >= r.x AND p.x < r.x + r.width AND p.y >= r.y AND p.y < r.y + r.height GROUP BY r.image_id, r.roi_id, p.ch
""")
def region_mean_colour(t):
    cells = im.regions(t.v_colour_scanline, t.v_roi)
    total = F.aggregate("row", F.lit(0.0), lambda a, v: a + v)
    return cells.groupBy("image_id", "roi_id", "ch").agg(
        F.round(F.sum(total) / F.sum(F.size("row")) / 255.0, 6).alias("mean")
    )


@query("i02_sample_checks", """
SELECT count(*) AS sample_count, count(DISTINCT label) AS label_count, 0::bigint AS blank_labels,
  count(*) FILTER (WHERE list_max(embedding) > 0.4) AS out_of_range, count(DISTINCT len(embedding)) AS width_count,
  count(*) >= 2 AND count(DISTINCT label) >= 2 AND count(*) FILTER (WHERE list_max(embedding) > 0.4) = 0 AS is_usable FROM embeddings
""")
def sample_checks(t):
    return op.sample_checks(t.embeddings, "label", "embedding", -1.0, float("0.4"))


VOTE_SQL = f"""
WITH k AS ({ranked_sql(L2, 5)}),
 v AS (SELECT qid, label, sum(1 / greatest(d, 1e-9)) AS w, min(d) AS d FROM k GROUP BY qid, label),
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY w DESC, d, label) AS n, sum(w) OVER (PARTITION BY qid) AS t FROM v)
SELECT qid AS vec_id, label AS predicted, round(w / t, 6) AS confidence FROM r WHERE n = 1
"""


@query("i03_weighted_neighbour_vote", VOTE_SQL)
def weighted_neighbour_vote(t):
    v = op.object_vote(neighbours(t, 5), "vec_id", weighted=True)
    return v.select("vec_id", "predicted", F.round("confidence", 6).alias("confidence"))


@query("i03_neighbour_list", f"""
WITH k AS ({ranked_sql(L2, 5)}), p AS ({VOTE_SQL.strip()})
SELECT p.vec_id, p.predicted, p.confidence, string_agg(k.label, ',' ORDER BY k.d, k.sid) AS labels, round(max(k.d), 6) AS farthest
FROM p JOIN k ON k.qid = p.vec_id GROUP BY ALL
""")
def neighbour_list(t):
    v = op.neighbour_classification(neighbours(t, 5), "vec_id", weighted=True)
    return v.select(
        "vec_id", "predicted", F.round("confidence", 6).alias("confidence"), F.array_join("neighbours.label", ",").alias("labels"),
        F.round(F.array_max("neighbours.distance"), 6).alias("farthest"),
    )


@query("i04_tabular_neighbour_vote", f"""
WITH k AS ({ranked_sql(L2, 7, 'label,')}), v AS (SELECT qid, label, count(*) AS c FROM k GROUP BY qid, label)
SELECT qid AS vec_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, label) AS n FROM v) WHERE n = 1
""")
def tabular_neighbour_vote(t):
    return op.tabular_vote(neighbours(t, 7, order="label"), "vec_id")


LONG = f"(SELECT vec_id, cast(label AS varchar) AS label, unnest(f) AS v, generate_subscripts(f, 1) AS dim FROM {E})"


@query("i05_gaussian_naive_bayes", f"""
WITH x AS (SELECT * FROM {LONG}), g AS (SELECT max(s) AS s FROM (SELECT var_pop(v) AS s FROM x GROUP BY dim)),
 m AS (SELECT label, dim, avg(v) AS mu, var_pop(v) + 1e-9 * (SELECT s FROM g) AS var FROM x GROUP BY label, dim),
 p AS (SELECT cast(label AS varchar) AS label, ln(count(*) / (SELECT count(*) FROM embeddings)) AS prior FROM embeddings GROUP BY label),
 l AS (SELECT x.vec_id, m.label, any_value(p.prior) - 0.5 * sum(ln(2 * pi() * var) + (v - mu) * (v - mu) / var) AS score
       FROM x JOIN m ON m.dim = x.dim JOIN p ON p.label = m.label GROUP BY x.vec_id, m.label),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label DESC) AS n, max(score) OVER (PARTITION BY vec_id) AS top FROM l)
SELECT vec_id, max(label) FILTER (WHERE n = 1) AS predicted, round(1 / sum(exp(score - top)), 6) AS confidence FROM r GROUP BY vec_id
""")
def gaussian_naive_bayes(t):
    e = t.embeddings
    return op.gaussian_naive_bayes(e, e, "vec_id", "embedding").select(
        "vec_id", "predicted", F.round("confidence", 6).alias("confidence")
    )


@query("i06_logistic_regression")
def logistic_regression(t):
    e = t.embeddings
    return op.logistic_classifier(e, e, "vec_id", "embedding", "label")


def centroid_sql(centre: str, term: str, outer: str) -> str:
    return f"""
WITH x AS (SELECT * FROM {LONG}), m AS (SELECT label, dim, {centre} AS c FROM x GROUP BY label, dim),
 d AS (SELECT x.vec_id, m.label, {outer}(sum({term})) AS d FROM x JOIN m ON m.dim = x.dim GROUP BY x.vec_id, m.label)
SELECT vec_id, label AS predicted, round(d, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS n FROM d) WHERE n = 1
"""


@query("i07_nearest_centroid", centroid_sql("avg(v)", "(v - c) * (v - c)", "sqrt"))
def nearest_centroid(t):
    e = t.embeddings
    return op.nearest_centroid(e, e, "vec_id", "embedding").select("vec_id", "predicted", F.round("distance", 6).alias("distance"))


@query("i07_nearest_median", centroid_sql("quantile_cont(v, 0.5)", "abs(v - c)", ""))
def nearest_median(t):
    e = t.embeddings
    return op.nearest_centroid(e, e, "vec_id", "embedding", metric="manhattan").select(
        "vec_id", "predicted", F.round("distance", 6).alias("distance")
    )


@query("i08_linear_svm")
def linear_svm(t):
    e = t.embeddings
    return op.linear_svm(e, e, "vec_id", "embedding", "label")


@query("i09_class_mapping", """
SELECT cast(min(label) AS bigint) AS first_id, cast(max(label) AS bigint) AS last_id, count(DISTINCT label) AS class_count,
  min(label) = 0 AND max(label) = count(DISTINCT label) - 1 AND count(DISTINCT label) >= 2 AS is_valid FROM embeddings
""")
def class_mapping(t):
    return op.class_mapping_contract(t.embeddings, "label")


@query("i10_failed_items", """
SELECT doc_id, CASE WHEN n_chars < 200 THEN 'too-short' WHEN quality IS NULL THEN 'no-label' WHEN toxic = 1 THEN 'toxic' END AS reason
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE n_chars < 200 OR quality IS NULL OR toxic = 1
""")
def failed_items(t):
    items = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    _, failed = op.split_failed_items(items, {
        "too-short": F.col("n_chars") < 200, "no-label": F.col("quality").isNull(), "toxic": F.col("toxic") == 1,
    })
    return failed.select("doc_id", "reason")


@query("i11_kmeans_segmentation")
def kmeans_segmentation(t):
    cells = t.v_pixel.select("image_id", "y", "x", F.array("v").alias("f"))
    return op.kmeans_clusters(cells, ["image_id", "y", "x"], "f", 3, [2])


@query("i12_neighbour_segmentation", """
WITH s AS (SELECT vec_id AS sid, CASE WHEN label >= 5 THEN 'part' ELSE 'board' END AS label,
    list_sum(list_transform(embedding[1:8], lambda v: (cast(v AS double) + 1) / 2)) / 8 AS f FROM embeddings),
 r AS (SELECT p.image_id, p.y, p.x, s.label, row_number() OVER (PARTITION BY p.image_id, p.y, p.x ORDER BY abs(p.v - s.f), s.sid) AS n
       FROM v_pixel p JOIN (SELECT * FROM s ORDER BY f, sid) s ON true),
 v AS (SELECT image_id, y, x, count(*) FILTER (WHERE label = 'part' AND n <= 5) AS c FROM r GROUP BY image_id, y, x)
SELECT image_id, y, x, cast(CASE WHEN c / 5.0 >= 0.8 THEN 255 ELSE 0 END AS int) AS mask FROM v
""")
def neighbour_segmentation(t):
    samples = t.embeddings.select(
        F.col("vec_id").alias("sid"), F.when(F.col("label") >= 5, "part").otherwise("board").alias("label"),
        F.array(F.aggregate(F.slice("embedding", 1, 8), F.lit(0.0), lambda a, v: a + (v.cast("double") + 1) / 2) / 8).alias("f"),
    )
    cells = t.v_pixel.select((F.col("image_id") * 64 + F.col("y") * 8 + F.col("x")).alias("pid"), F.array("v").alias("f"))
    found = op.neighbour_segmentation(cells, samples, "pid", "sid", "f", 5, ["part"], 0.8)
    return found.select(
        F.floor(F.col("pid") / 64).alias("image_id"), F.floor(F.pmod("pid", F.lit(64)) / 8).cast("int").alias("y"),
        F.pmod("pid", F.lit(8)).cast("int").alias("x"), "mask",
    )


@query("i13_pca_anomaly")
def pca_anomaly(t):
    e = t.embeddings
    return op.pca_anomaly(e, e, "vec_id", "embedding", 8)


@query("i14_position_gaussians", f"""
WITH b AS (SELECT vec_id, label, cast((dim - 1) // 2 AS int) AS position, max(v) FILTER (WHERE dim % 2 = 1) AS a, max(v) FILTER (WHERE dim % 2 = 0) AS c
           FROM {LONG} GROUP BY vec_id, label, (dim - 1) // 2),
 m AS (SELECT label, position, avg(a) AS ma, avg(c) AS mc, var_pop(a) + 0.01::double AS saa, var_pop(c) + 0.01::double AS scc, covar_pop(a, c) AS sac FROM b GROUP BY label, position)
SELECT vec_id, position, round(sqrt(greatest(((a - ma) * (a - ma) * scc - 2 * (a - ma) * (c - mc) * sac + (c - mc) * (c - mc) * saa) / (saa * scc - sac * sac), 0)), 6) AS distance
FROM b JOIN m USING (label, position)
""")
def position_gaussians(t):
    return op.position_scores(t.embeddings, "vec_id", "label", "embedding", 2).select(
        "vec_id", "position", F.round("distance", 6).alias("distance")
    )


def bank_steps(n: int) -> str:
    ctes = [f"e AS {E}", "c0 AS (SELECT vec_id, f FROM e ORDER BY vec_id LIMIT 1)"]
    dist = "sqrt(list_sum(list_transform(list_zip(e.f, c.f), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
    for i in range(1, n):
        centres = " UNION ALL ".join(f"SELECT f FROM c{j}" for j in range(i))
        ctes.append(f"d{i} AS MATERIALIZED (SELECT e.vec_id, any_value(e.f) AS f, min({dist}) AS far FROM e CROSS JOIN ({centres}) c GROUP BY e.vec_id)")
        ctes.append(f"c{i} AS MATERIALIZED (SELECT vec_id, f, far FROM d{i} ORDER BY far DESC, vec_id LIMIT 1)")
    out = ["SELECT 0::int AS step, vec_id AS id, 0.0::double AS distance FROM c0"]
    out += [f"SELECT {i}::int, vec_id, round(far, 6) FROM c{i}" for i in range(1, n)]
    return "WITH " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(out)


@query("i15_memory_bank_coreset", bank_steps(6))
def memory_bank_coreset(t):
    chosen = op.coreset(t.embeddings, "vec_id", "embedding", 6)
    return chosen.select("step", "id", F.round(F.coalesce("distance", F.lit(0.0)), 6).alias("distance"))


@query("i15_memory_bank_distance", f"SELECT qid AS vec_id, round(d, 6) AS distance FROM ({ranked_sql(L2, 1)})")
def memory_bank_distance(t):
    return neighbours(t, 1).select("vec_id", F.round("distance", 6).alias("distance"))


@query("i16_cosine_anomaly", f"SELECT qid AS vec_id, round(d, 6) AS score FROM ({ranked_sql(COS, 1)})")
def cosine_anomaly(t):
    return neighbours(t, 1, "cosine").select("vec_id", F.round("distance", 6).alias("score"))


@query("i17_mean_neighbour_distance", f"""
SELECT qid AS vec_id, round(avg(d), 6) AS mean_distance, round(min(d), 6) AS least_distance FROM ({ranked_sql(L2, 5)}) GROUP BY qid
""")
def mean_neighbour_distance(t):
    return neighbours(t, 5).groupBy("vec_id").agg(
        F.round(F.avg("distance"), 6).alias("mean_distance"), F.round(F.min("distance"), 6).alias("least_distance")
    )
