"""Listing, detail, metrics, quality rules and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inspections as op
from ..operators.ordered import ordered, top_rows
from ..sources.exports import EXPORT_COLUMNS, quoted_line
from ..sources.tables import conform
from .catalog import query

LISTING = """
SELECT i.id, i.board_serial, i.lot, r.name AS recipe_name, r.slug AS recipe_slug, i.result, i.defect_count,
       i.score, i.cycle_time_ms, i.review_decision, i.inspected_at, u.full_name AS operator_name
FROM v_inspection i JOIN v_recipe r ON r.id = i.recipe_id JOIN v_user u ON u.id = i.operator_id
"""
LISTING_COLUMNS = [
    "id", "board_serial", "lot", "recipe_name", "recipe_slug", "result", "defect_count", "score",
    "cycle_time_ms", "review_decision", "inspected_at", "operator_name",
]
NEWEST = [F.desc, F.desc]


def listing(t):
    return op.with_names(t.v_inspection, t.v_recipe, t.v_user).select(*LISTING_COLUMNS)


def newest():
    return [F.desc("inspected_at"), F.desc("id")]


KPI_SQL = """
SELECT {by} count(*) AS total_inspections,
       count(*) FILTER (WHERE result = 'PASS') AS pass_count,
       count(*) FILTER (WHERE result = 'FAIL') AS fail_count,
       count(*) FILTER (WHERE result = 'REVIEW') AS review_count,
       cast(round(count(*) FILTER (WHERE result = 'PASS') * 100.0 / greatest(count(*), 1), 1) AS double) AS first_pass_yield,
       cast(coalesce(sum(defect_count), 0) AS bigint) AS total_defects,
       count(*) FILTER (WHERE result = 'REVIEW' AND review_decision IS NULL) AS pending_review
FROM v_inspection {group}
"""


@query("d01_kpi_totals", KPI_SQL.format(by="", group=""))
def kpi_totals(t):
    return op.kpis(t.v_inspection)


@query("d01_kpi_by_lot", KPI_SQL.format(by="lot,", group="GROUP BY lot"))
def kpi_by_lot(t):
    return op.kpis(t.v_inspection, ["lot"])


@query("d01_kpi_by_recipe", KPI_SQL.format(by="recipe_id,", group="GROUP BY recipe_id"))
def kpi_by_recipe(t):
    return op.kpis(t.v_inspection, ["recipe_id"])


@query("a01_inspection_scan", """
SELECT id, board_serial, lot, cast(recipe_id AS bigint) AS recipe_id, result, defect_count,
       cast(cast(score AS float) AS double) AS score, inspected_at FROM v_inspection
""")
def inspection_scan(t):
    typed = conform(
        t.v_inspection.withColumn("recipe_name", F.lit("")), "inspection_results"
    )
    return typed.select(
        "id", "board_serial", "lot", "recipe_id", "result", "defect_count",
        F.col("score").cast("double").alias("score"), F.col("inspected_at").cast("timestamp_ntz").alias("inspected_at"),
    )


@query("a06_record_export_lines", """
SELECT id, '"' || id || '","' || board_serial || '","' || r_name || '","' || result || '","' || defect_count
       || '","' || coalesce(cast(score AS varchar), '') || '","' || day || '"' AS line
FROM (SELECT i.id, board_serial, r.name AS r_name, result, defect_count, score,
             strftime(inspected_at, '%Y-%m-%d') AS day
      FROM v_inspection i JOIN v_recipe r ON r.id = i.recipe_id)
""")
def record_export_lines(t):
    rows = listing(t).withColumn("inspected_at", F.date_format("inspected_at", "yyyy-MM-dd"))
    return rows.select("id", quoted_line(EXPORT_COLUMNS).alias("line"))


@query("b01_equality_filters", f"""
SELECT * FROM ({LISTING}) WHERE result = 'FAIL' AND recipe_slug = 'nation_11' AND lot = 'MFG-1996-5'
""")
def equality_filters(t):
    return op.filter_inspections(listing(t), result="FAIL", recipe_slug="nation_11", lot="MFG-1996-5", search="")


@query("b02_search_three_columns", f"""
SELECT * FROM ({LISTING}) WHERE board_serial ILIKE '%on_1%' OR lot ILIKE '%on_1%' OR recipe_name ILIKE '%on_1%'
""")
def search_three_columns(t):
    return op.filter_inspections(listing(t), search="on_1")


@query("b03_search_runs_newest", """
SELECT o_orderkey, o_orderstatus, o_orderpriority, c_name, c_mktsegment, o_orderdate
FROM orders JOIN customer ON c_custkey = o_custkey
WHERE cast(o_orderkey AS varchar) ILIKE '%urg%' OR o_orderstatus ILIKE '%urg%' OR o_orderpriority ILIKE '%urg%'
   OR c_name ILIKE '%urg%' OR c_mktsegment ILIKE '%urg%'
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200
""")
def search_runs_newest(t):
    runs = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).withColumn(
        "_key", F.col("o_orderkey").cast("string")
    )
    hit = op.matches_any(["_key", "o_orderstatus", "o_orderpriority", "c_name", "c_mktsegment"], "urg")
    return (
        runs.where(hit).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200)
        .select("o_orderkey", "o_orderstatus", "o_orderpriority", "c_name", "c_mktsegment", "o_orderdate")
    )


@query("b04_pending_review", "SELECT id, result, lot FROM v_inspection WHERE review_decision IS NULL AND result = 'REVIEW'")
def pending_review(t):
    return t.v_inspection.where(F.col("review_decision").isNull() & (F.col("result") == "REVIEW")).select(
        "id", "result", "lot"
    )


@query("b05_active_recipes", "SELECT id, slug, name FROM v_recipe WHERE is_active ORDER BY name")
def active_recipes(t):
    return t.v_recipe.where("is_active").orderBy("name").select("id", "slug", "name")


# Run states.
ACTIVE_STATUSES = ["queued", "precheck", "moving", "capturing", "executing"]
TERMINAL_STATUSES = ["completed", "cancelled", "faulted"]


@query("b06_status_sets", """
SELECT id, status, status IN ('queued','precheck','moving','capturing','executing') AS is_active,
       status IN ('completed','cancelled','faulted') AS is_terminal FROM v_run
""")
def status_sets(t):
    return t.v_run.select(
        "id", "status", F.col("status").isin(ACTIVE_STATUSES).alias("is_active"),
        F.col("status").isin(TERMINAL_STATUSES).alias("is_terminal"),
    )


@query("b08_check_rule_violations", """
SELECT id, 'inspection-result' AS rule FROM v_inspection WHERE result NOT IN ('PASS','FAIL')
UNION ALL SELECT id, 'inspection-review' FROM v_inspection WHERE NOT (review_decision IN ('PASS','FAIL'))
UNION ALL SELECT id, 'defect-severity' FROM v_defect WHERE severity NOT IN ('medium','high','critical')
UNION ALL SELECT id, 'defect-confidence' FROM v_defect WHERE NOT (confidence >= 0 AND confidence <= 0.9)
""")
def check_rule_violations(t):
    a = op.rule_violations(t.v_inspection, "id", {
        "inspection-result": F.col("result").isin("PASS", "FAIL"),
        "inspection-review": F.col("review_decision").isin("PASS", "FAIL"),
    })
    b = op.rule_violations(t.v_defect, "id", {
        "defect-severity": F.col("severity").isin("medium", "high", "critical"),
        "defect-confidence": F.col("confidence").between(0, 0.9),
    })
    return a.unionByName(b)


@query("b09_box_inside_image", """
SELECT image_id, det_id, x >= 0 AND y >= 0 AND width >= 1 AND height >= 1 AND x + width <= 80 AND y + height <= 64 AS is_inside
FROM v_detection
""")
def box_inside_image(t):
    inside = (
        (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("width") >= 1) & (F.col("height") >= 1)
        & (F.col("x") + F.col("width") <= 80) & (F.col("y") + F.col("height") <= 64)
    )
    return t.v_detection.select("image_id", "det_id", inside.alias("is_inside"))


@query("b10_payload_projection", """
SELECT id AS "resultId", board_serial AS "boardSerial", result, coalesce(review_decision, result) AS "effectiveResult",
       cycle_time_ms AS "cycleTimeMs" FROM v_inspection
""")
def payload_projection(t):
    return t.v_inspection.select(
        F.col("id").alias("resultId"), F.col("board_serial").alias("boardSerial"), "result",
        F.coalesce("review_decision", "result").alias("effectiveResult"), F.col("cycle_time_ms").alias("cycleTimeMs"),
    )


@query("b12_table_contract", """
SELECT 'row_score' AS column_name, 'missing-column' AS code, cast(1 AS bigint) AS n
UNION ALL SELECT 'id', 'wrong-type', cast(1 AS bigint)
UNION ALL SELECT 'predicted', 'unexpected-column', cast(1 AS bigint)
UNION ALL SELECT '*', 'row-limit', greatest(count(*) - 1000, 0) FROM v_prediction HAVING count(*) > 1000
""")
def table_contract(t):
    return op.contract_violations(t.v_prediction, {"id": "int", "label": "string", "row_score": "double"}, 1000)


@query("c01_listing_join", LISTING)
def listing_join(t):
    return listing(t)


@query("c02_reviewer_left_join", """
SELECT i.id, i.review_decision, op.full_name AS operator_name, rv.full_name AS reviewer_name
FROM v_inspection i JOIN v_user op ON op.id = i.operator_id LEFT JOIN v_user rv ON rv.id = i.reviewed_by
""")
def reviewer_left_join(t):
    users = t.v_user
    operators = users.select(F.col("id").alias("operator_id"), F.col("full_name").alias("operator_name"))
    reviewers = users.select(F.col("id").alias("reviewed_by"), F.col("full_name").alias("reviewer_name"))
    return (
        t.v_inspection.select("id", "review_decision", "operator_id", "reviewed_by")
        .join(operators, "operator_id").join(reviewers, "reviewed_by", "left")
        .select("id", "review_decision", "operator_name", "reviewer_name")
    )


@query("c03_detail_with_evidence", """
SELECT i.id, i.board_serial, i.result, coalesce(d.page, 0) AS page, coalesce(d.n_defects, 0) AS n_defects, d.defects
FROM v_inspection i LEFT JOIN (
  SELECT result_id, page, count(*) AS n_defects,
         string_agg(cast(id AS varchar) || ':' || defect_type || ':' || severity, ';' ORDER BY seq) AS defects
  FROM (SELECT *, cast((seq - 1) // 1000 AS bigint) AS page FROM (
          SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY detected_at, id) AS seq FROM v_defect))
  GROUP BY result_id, page) d ON d.result_id = i.id
""")
def detail_with_evidence(t):
    item = F.concat_ws(":", F.col("id").cast("string"), "defect_type", "severity")
    pages = op.evidence_pages(
        t.v_inspection.select("id", "board_serial", "result"), t.v_defect, ["detected_at", "id"], item
    )
    return pages.select(
        "id", "board_serial", "result", F.coalesce("page", F.lit(0)).cast("bigint").alias("page"),
        F.coalesce(F.array_size("items"), F.lit(0)).cast("bigint").alias("n_defects"),
        F.array_join("items", ";").alias("defects"),
    )


@query("c04_literal_relation_join", """
SELECT r_regionkey, r_name, d.kind, d.severity FROM region CROSS JOIN
 (VALUES ('solder_bridge', 'high'), ('missing_component', 'critical')) AS d(kind, severity) WHERE r_name <> 'ASIA'
""")
def literal_relation_join(t):
    literal = F.array(
        F.struct(F.lit("solder_bridge").alias("kind"), F.lit("high").alias("severity")),
        F.struct(F.lit("missing_component").alias("kind"), F.lit("critical").alias("severity")),
    )
    return t.region.where("r_name <> 'ASIA'").select("r_regionkey", "r_name", F.inline(literal))


@query("c05_insert_if_absent", """
SELECT n_nationkey AS id, n_name AS name FROM nation
UNION ALL SELECT s_suppkey, s_name FROM supplier
WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation)
""")
def insert_if_absent(t):
    existing = t.nation.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    incoming = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return op.insert_absent(existing, incoming, ["id"])


@query("d02_page_counts", f"""
SELECT count(*) AS total, cast(greatest(ceil(count(*) / 25.0), 1) AS bigint) AS total_pages
FROM ({LISTING}) WHERE result = 'REVIEW'
""")
def page_counts(t):
    return op.page_counts(op.filter_inspections(listing(t), result="REVIEW"), 25)


@query("d19_pilot_acceptance", """
SELECT inspected_board_count, cycle_time_p95_ms, false_call_rate_percent, escape_rate_percent,
  CASE WHEN cycle_time_p95_ms <= 1700 AND false_call_rate_percent <= 60 AND escape_rate_percent <= 60
       THEN 'passed' ELSE 'failed' END AS status
FROM (SELECT count(*) AS inspected_board_count,
  round(quantile_cont(cast(cycle_time_ms AS double), 0.95), 6) AS cycle_time_p95_ms,
  round(count(*) FILTER (WHERE result = 'FAIL' AND review_decision = 'PASS') * cast(100 AS double)
    / greatest(count(*) FILTER (WHERE result = 'FAIL' AND review_decision IS NOT NULL), 1), 6) AS false_call_rate_percent,
  round(count(*) FILTER (WHERE result = 'PASS' AND review_decision = 'FAIL') * cast(100 AS double)
    / greatest(count(*) FILTER (WHERE result = 'PASS' AND review_decision IS NOT NULL), 1), 6) AS escape_rate_percent
  FROM v_inspection)
""")
def pilot_acceptance(t):
    return op.acceptance(t.v_inspection, max_p95_ms=1700, max_false_call=60, max_escape=60)


@query("f01_listing_page", f"SELECT * FROM ({LISTING}) ORDER BY inspected_at DESC, id DESC LIMIT 20 OFFSET 40")
def listing_page(t):
    return op.page(listing(t), newest(), page_number=3, page_size=20)


@query("f01_listing_keyset_page", f"""
SELECT * FROM ({LISTING}) WHERE inspected_at < TIMESTAMP '1997-06-01' OR (inspected_at = TIMESTAMP '1997-06-01' AND id < 5000)
ORDER BY inspected_at DESC, id DESC LIMIT 50
""")
def listing_keyset_page(t):
    last = F.lit("1997-06-01 00:00:00").cast("timestamp_ntz")
    return op.page_after(listing(t), "inspected_at", "id", last, 5000, 50)


@query("f02_clamped_event_page", "SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 100")
def clamped_event_page(t):
    return op.page(
        t.events.select("event_id", "ts", "user_id"), [F.desc("ts"), F.desc("event_id")], page_number=2, page_size=500
    )


@query("f03_newest_runs", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def newest_runs(t):
    return t.orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200)


@query("f04_export_order", """
SELECT document_id, revision, id, created_by,
       row_number() OVER (ORDER BY created_by ASC NULLS FIRST, document_id, revision, created_at, id) AS position
FROM v_settings_version
""")
def export_order(t):
    return ordered(
        t.v_settings_version, [], ["created_by", "document_id", "revision", "created_at", "id"], number="position",
    ).select("document_id", "revision", "id", "created_by", "position")


@query("f05_set_difference", "SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def set_difference(t):
    used = t.supplier.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return t.nation.select("n_nationkey").subtract(used)


@query("f06_tagged_union", """
SELECT o_orderkey, 'train' AS source FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, 'test' FROM orders WHERE o_orderstatus = 'P'
""")
def tagged_union(t):
    return op.tagged_union({
        "train": t.orders.where("o_orderstatus = 'F'").select("o_orderkey"),
        "test": t.orders.where("o_orderstatus = 'P'").select("o_orderkey"),
    })


@query("f07_first_occurrences", """
SELECT role, text, conv_id, turn FROM (
  SELECT *, row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) AS n FROM conversations) WHERE n = 1
""")
def first_occurrences(t):
    return op.first_occurrences(
        t.conversations.select("role", "text", "conv_id", "turn"), ["role", "text"], ["conv_id", "turn"]
    )


@query("f08_bounded_repeat", "SELECT n_nationkey, n_name, cast(unnest(range(1, 4)) AS int) AS iteration FROM nation")
def bounded_repeat(t):
    return op.repeat_rows(t.nation.select("n_nationkey", "n_name"), 3)


@query("f09_head_sample", """
SELECT c_mktsegment, c_custkey, cast(n AS int) AS n FROM (
  SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer)
WHERE n <= 20
""")
def head_sample(t):
    return top_rows(t.customer.select("c_mktsegment", "c_custkey"), ["c_mktsegment"], [F.asc("c_custkey")], 20, "n")
