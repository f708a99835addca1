"""Score, decision and measure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions.digests import sha256
from ..operators import scores as op
from .catalog import query


@query("d09_accuracy", "SELECT round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM v_prediction")
def accuracy(t):
    return op.accuracy(t.v_prediction).select(F.round("accuracy", 6).alias("accuracy"))


@query("d10_confusion_matrix", """
WITH c AS (SELECT label AS c FROM v_prediction UNION SELECT predicted FROM v_prediction)
SELECT a.c AS label, b.c AS predicted, (SELECT count(*) FROM v_prediction p WHERE p.label = a.c AND p.predicted = b.c) AS n
FROM c a CROSS JOIN c b
""")
def confusion_matrix(t):
    return op.confusion_matrix(t.v_prediction)


@query("d11_class_report", """
WITH c AS (SELECT label AS c FROM v_prediction UNION SELECT predicted FROM v_prediction),
 s AS (SELECT c, (SELECT count(*) FROM v_prediction WHERE label = c AND predicted = c) AS tp,
   (SELECT count(*) FROM v_prediction WHERE label = c) AS support, (SELECT count(*) FROM v_prediction WHERE predicted = c) AS claimed FROM c)
SELECT c AS class_name, round(CASE WHEN claimed = 0 THEN 0.0 ELSE tp / claimed END, 6) AS precision,
 round(CASE WHEN support = 0 THEN 0.0 ELSE tp / support END, 6) AS recall,
 round(CASE WHEN support + claimed = 0 THEN 0.0 ELSE 2 * tp / (support + claimed) END, 6) AS f1, support FROM s
""")
def class_report(t):
    r = op.class_report(t.v_prediction)
    return r.select("class_name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("d12_score_fusion", """
SELECT image_id, round(max(score), 6) AS maximum, round(avg(score), 6) AS mean, bool_and(score >= 0 AND score <= 1) AS is_bounded
FROM v_score GROUP BY image_id
""")
def score_fusion(t):
    f = op.fuse(t.v_score, "image_id", "score")
    return f.select("image_id", F.round("maximum", 6).alias("maximum"), F.round("mean", 6).alias("mean"), "is_bounded")


@query("d13_fused_decision", """
SELECT image_id, CASE WHEN max(score) >= 0.65 THEN 'FAIL' ELSE 'PASS' END AS decision FROM v_score GROUP BY image_id
""")
def fused_decision(t):
    return op.fused_decision(t.v_score, "image_id", "score", 0.65)


@query("d14_group_logic", """
SELECT l_orderkey, bool_and(l_returnflag = 'R') AS all_of, bool_or(l_returnflag = 'R') AS any_of,
  count(*) FILTER (WHERE l_returnflag = 'R') % 2 = 1 AS odd_of FROM lineitem GROUP BY l_orderkey
""")
def group_logic(t):
    return op.group_logic(t.lineitem, "l_orderkey", F.col("l_returnflag") == "R")


@query("d15_merge_policy", """
SELECT user_id, count(DISTINCT event_type) FILTER (WHERE event_type IN ('purchase', 'signup') AND value > 40) > 0 AS any_arrived,
  count(DISTINCT event_type) FILTER (WHERE event_type IN ('purchase', 'signup') AND value > 40) = 2 AS all_arrived FROM events GROUP BY user_id
""")
def merge_policy(t):
    arrivals = t.events.withColumn("event_type", F.when(F.col("value") > 40, F.col("event_type")))
    return op.merge_ready(arrivals, "user_id", "event_type", ["purchase", "signup"])


@query("d20_image_summary", """
SELECT image_id, count(DISTINCT y) AS height, cast(count(DISTINCT x) AS int) AS width, count(DISTINCT ch) AS channels,
  round(min(v), 6) AS lowest, round(max(v), 6) AS highest FROM v_pixel GROUP BY image_id
""")
def image_summary(t):
    s = op.image_summary(t.v_scanline)
    return s.select("image_id", "height", "width", "channels", F.round("lowest", 6).alias("lowest"), F.round("highest", 6).alias("highest"))


@query("d21_heightmap_summary", """
SELECT image_id, count(*) FILTER (WHERE v >= 0.45) AS valid_count, count(*) FILTER (WHERE v < 0.45) AS missing_count,
  round(min(v) FILTER (WHERE v >= 0.45), 6) AS lowest, round(max(v) FILTER (WHERE v >= 0.45), 6) AS highest FROM v_pixel GROUP BY image_id
""")
def heightmap_summary(t):
    grid = t.v_scanline.withColumn("row", F.transform("row", lambda v: F.when(v >= 0.45, v)))
    s = op.heightmap_summary(grid)
    return s.select("image_id", "valid_count", "missing_count", F.round("lowest", 6).alias("lowest"), F.round("highest", 6).alias("highest"))


@query("d22_luminance_checks", """
SELECT image_id, round(var_pop(v) + 1e-9, 6) AS variance, var_pop(v) < 250 AS is_blurred, round(least(abs(avg(v) - 127.5) / 127.5, 1.0), 6) AS reference_score
FROM v_byte GROUP BY image_id
""")
def luminance_checks(t):
    s = op.luminance_checks(t.v_byte_scanline, 250)
    return s.select("image_id", F.round(F.col("variance") + 1e-9, 6).alias("variance"), "is_blurred", F.round("reference_score", 6).alias("reference_score"))


def labelled_scores(t):
    truth = t.embeddings.select(F.col("vec_id").alias("image_id"), "label")
    return t.v_score.join(truth, "image_id").withColumn("score", F.round("score", 6))


SCORES_SQL = "SELECT s.image_id, s.detector, round(s.score, 6) AS score, e.label FROM v_score s JOIN embeddings e ON e.vec_id = s.image_id"


@query("d23_image_auroc", f"""
WITH s AS ({SCORES_SQL}), r AS (SELECT *, rank() OVER (PARTITION BY detector ORDER BY score) +
   (count(*) OVER (PARTITION BY detector, score) - 1) / 2.0 AS r FROM s)
SELECT detector, round((cast(sum(r) FILTER (WHERE label >= 5) AS double) - count(*) FILTER (WHERE label >= 5) * (count(*) FILTER (WHERE label >= 5) + 1) / 2)
  / (count(*) FILTER (WHERE label >= 5) * count(*) FILTER (WHERE label < 5)), 6) AS auroc FROM r GROUP BY detector
""")
def image_auroc(t):
    return op.auroc(labelled_scores(t), "detector", "score", F.col("label") >= 5).select(
        "detector", F.round("auroc", 6).alias("auroc")
    )


@query("e06_visit_limit", """
SELECT event_id, user_id, n AS visit, CASE WHEN n < 10 THEN 'under-limit' ELSE 'limit-reached' END AS branch FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
""")
def visit_limit(t):
    return op.visit_limit(t.events.select("event_id", "user_id"), "user_id", ["event_id"], 10)


@query("e12_top_k_mean", """
SELECT image_id, round(avg(v), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) AS n FROM v_pixel)
WHERE n <= 5 GROUP BY image_id
""")
def top_k_mean(t):
    return op.top_k_mean(t.v_pixel, "image_id", "v", [F.asc("y"), F.asc("x")], 5).select(
        "image_id", F.round("score", 6).alias("score")
    )


@query("e13_empirical_rank", f"""
WITH s AS ({SCORES_SQL})
SELECT image_id, detector, score, round(count(*) FILTER (WHERE label < 5) OVER (PARTITION BY detector ORDER BY score RANGE UNBOUNDED PRECEDING)
  / count(*) FILTER (WHERE label < 5) OVER (PARTITION BY detector), 6) AS normalized FROM s
""")
def empirical_rank(t):
    return op.empirical_rank(labelled_scores(t), "detector", "score", F.col("label") < 5).select(
        "image_id", "detector", "score", F.round("normalized", 6).alias("normalized")
    )


@query("g08_switch_case", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'now' WHEN o_orderpriority = '2-HIGH' THEN 'soon'
   WHEN o_orderpriority = '5-LOW' THEN 'later' ELSE 'default' END AS branch FROM orders
""")
def switch_case(t):
    cases = [("1-URGENT", "now"), ("2-HIGH", "soon"), ("5-LOW", "later")]
    return t.orders.select("o_orderkey", sc.switch_case(F.col("o_orderpriority"), cases).alias("branch"))


@query("g09_logic_not", "SELECT l_orderkey, l_linenumber, NOT (l_returnflag = 'R') AS result FROM lineitem")
def logic_not(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", (~(F.col("l_returnflag") == "R")).alias("result"))


@query("g10_pose_age", """
SELECT event_id, round(age, 6) AS age_seconds, age < 0 OR age > 45 AS is_stale FROM (
 SELECT event_id, (epoch_us(ts) - epoch_us(date_trunc('minute', ts + INTERVAL 10 SECOND))) / 1000000.0::double AS age FROM events)
""")
def pose_age(t):
    age = sc.age_seconds(F.col("ts"), F.date_trunc("minute", F.col("ts").cast("timestamp") + F.expr("INTERVAL 10 SECONDS")))
    return t.events.select("event_id", F.round(age, 6).alias("age_seconds"), sc.is_stale(age, 45).alias("is_stale"))


@query("g11_precheck_code", """
SELECT event_id, CASE WHEN user_id % 20 = 0 THEN 'corrupt' WHEN event_type = 'error' THEN 'checksum-invalid' WHEN value < 1 THEN 'blurred'
  WHEN user_id % 7 = 0 THEN 'unregistered' WHEN value > 150 THEN 'motion-not-in-position' WHEN user_id < 70 OR user_id > 130 THEN 'stale-pose' ELSE 'ok' END AS code
FROM events
""")
def precheck_code(t):
    sha = F.sha2("event_type", 256)
    code = sc.precheck_code(
        F.col("user_id") % 20, sha, F.when(F.col("event_type") == "error", "?").otherwise(sha), F.col("value") < 1,
        F.col("user_id") % 7 != 0, F.col("value") <= 150, F.col("user_id").cast("double") - 70, 60.0,
    )
    return t.events.select("event_id", F.coalesce(code, F.lit("ok")).alias("code"))


BYTES = " + ".join(f"cast(concat('0x', substr(s, {2 * i + 1}, 2)) AS int)" for i in range(32))


@query("g12_reference_verdict", f"""
SELECT doc_id, round(v1, 6) AS score_v1, CASE WHEN v1 <= 0.5 THEN 'PASS' ELSE 'FAIL' END AS decision_v1,
 round(least(greatest(n_chars / 4000.0::double - 0.1, 0), 1), 6) AS score_v2,
 CASE WHEN least(greatest(n_chars / 4000.0::double - 0.1, 0), 1) <= 0.5 THEN 'PASS' ELSE 'FAIL' END AS decision_v2
FROM (SELECT doc_id, n_chars, 1.0::double - ({BYTES}) / (32 * 255.0::double) AS v1 FROM (SELECT doc_id, n_chars, sha256(text) AS s FROM documents))
""")
def reference_verdict(t):
    v1 = sc.digest_score(sha256("text"))
    v2 = sc.bounded_score(F.col("n_chars") / F.lit(4000.0) - 0.1)
    scored = t.documents.select("doc_id", v1.alias("v1"), v2.alias("v2"))
    return scored.select(
        "doc_id", F.round("v1", 6).alias("score_v1"), sc.pass_at_most(F.col("v1"), 0.5).alias("decision_v1"),
        F.round("v2", 6).alias("score_v2"), sc.pass_at_most(F.col("v2"), 0.5).alias("decision_v2"),
    )


@query("g13_fallback_decision", """
SELECT image_id, detector, coalesce(CASE WHEN image_id < 50 THEN 'PASS' END, CASE WHEN coalesce(score, 0) >= 0.6 THEN 'FAIL' ELSE 'PASS' END) AS decision FROM v_score
""")
def fallback_decision(t):
    given = F.when(F.col("image_id") < 50, "PASS")
    return t.v_score.select("image_id", "detector", sc.fail_at_least(F.col("score"), 0.6, given).alias("decision"))


@query("g15_position_match", """
SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) <= 10 AND abs(l_tax * 100 - 4) <= 10 AND abs(l_discount * 100 - 30) <= 25.5 AS is_match FROM lineitem
""")
def position_match(t):
    first = sc.within([F.col("l_quantity"), F.col("l_tax") * 100], [F.lit(25.0), F.lit(4.0)], 10.0)
    second = sc.within([F.col("l_discount") * 100], [F.lit(30.0)], 25.5)
    return t.lineitem.select("l_orderkey", "l_linenumber", (first & second).alias("is_match"))


@query("g21_robust_z", f"""
WITH s AS ({SCORES_SQL}), m AS (SELECT detector, quantile_cont(score, 0.5) AS md FROM s WHERE label < 5 GROUP BY detector),
 d AS (SELECT s.detector, quantile_cont(abs(score - md), 0.5) AS mad FROM s JOIN m ON m.detector = s.detector WHERE label < 5 GROUP BY s.detector)
SELECT image_id, s.detector, round((score - md) / (1.4826::double * mad + 0.000001), 5) AS z FROM s JOIN m ON m.detector = s.detector JOIN d ON d.detector = s.detector
""")
def robust_z(t):
    return op.robust_normalised(labelled_scores(t), "detector", "score", F.col("label") < 5).select(
        "image_id", "detector", F.round("z", 5).alias("z")
    )


@query("g22_min_max_score", """
SELECT image_id, detector, round(greatest(0, least(1, (score - 0.45) / (0.7 - 0.45)::double)), 6) AS normalized FROM v_score
""")
def min_max_score(t):
    return t.v_score.select("image_id", "detector", F.round(sc.min_max(F.col("score"), 0.45, 0.7), 6).alias("normalized"))


@query("g23_three_way_policy", """
SELECT image_id, detector, CASE WHEN image_id % 17 = 0 OR score >= 0.7 THEN 'NG' WHEN score >= 0.6 THEN 'REVIEW' ELSE 'OK' END AS verdict FROM v_score
""")
def three_way_policy(t):
    return t.v_score.select(
        "image_id", "detector", sc.three_way(F.col("score"), 0.6, 0.7, F.col("image_id") % 17 == 0).alias("verdict")
    )
