"""The given tables and the views that give them inspection shapes.

The SQL is portable between Spark and DuckDB except for the pixel view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.images import to_bytes
from ..operators.ordered import ordered

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "v_recipe": """
SELECT n_nationkey AS id, lower(n_name) AS slug, n_name AS name, n_nationkey % 5 <> 0 AS is_active
FROM nation""",
    "v_user": "SELECT c_custkey AS id, c_name AS full_name FROM customer",
    "v_inspection": """
SELECT o_orderkey AS id,
       concat('PCB-', cast(o_orderkey AS string)) AS board_serial,
       concat('MFG-', cast(year(o_orderdate) AS string), '-', cast(month(o_orderdate) AS string)) AS lot,
       cast(o_orderkey % 25 AS int) AS recipe_id,
       o_custkey AS operator_id,
       CASE o_orderstatus WHEN 'O' THEN 'PASS' WHEN 'F' THEN 'FAIL' ELSE 'REVIEW' END AS result,
       cast(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_orderkey % 4 END AS int) AS defect_count,
       cast((o_orderkey * 7919) % 1000 AS double) / 1000 AS score,
       cast(1000 + (o_orderkey * 31) % 700 AS int) AS cycle_time_ms,
       CASE o_orderkey % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' END AS review_decision,
       CASE WHEN o_orderkey % 3 < 2 THEN 1 + o_orderkey % 100 END AS reviewed_by,
       o_orderdate AS inspected_at
FROM orders""",
    "v_line": """
SELECT lineitem.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_extendedprice) AS line_no
FROM lineitem""",
    "v_defect": """
SELECT l_orderkey * 100 + line_no AS id, l_orderkey AS result_id,
       CASE l_returnflag WHEN 'R' THEN 'missing_component' WHEN 'A' THEN 'solder_bridge' ELSE 'scratch' END AS defect_type,
       CASE l_linenumber % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
       l_quantity AS location_x, l_tax * 100 AS location_y, l_discount * 10 AS confidence,
       l_shipdate AS detected_at
FROM v_line""",
    "v_run": """
SELECT concat('inspection-', cast(o_orderkey AS string)) AS id, o_orderkey AS result_id,
       concat('station-', cast(o_custkey % 8 AS string)) AS station_id,
       CASE o_orderkey % 7 WHEN 0 THEN 'faulted' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'executing'
            WHEN 3 THEN 'queued' ELSE 'completed' END AS status,
       o_orderkey % 2 = 0 AS plc_enabled, o_orderkey % 3 = 0 AS mes_enabled,
       o_orderdate AS created_at
FROM orders""",
    "v_calibration": """
SELECT concat('cal-', cast(s_suppkey AS string)) AS id,
       concat('station-', cast(s_suppkey % 8 AS string)) AS station_id,
       cast(5 + s_suppkey % 20 AS int) AS image_count,
       cast(50 + s_suppkey % 50 AS double) AS coverage_percent,
       cast(s_suppkey % 30 AS double) / 20 AS reprojection_error_pixels,
       DATE '1996-01-01' + cast(s_suppkey % 1000 AS int) AS valid_until
FROM supplier""",
    "v_settings_version": """
SELECT l_orderkey AS document_id, l_linenumber AS revision,
       l_orderkey * 100 + line_no AS id, l_partkey AS created_by, l_shipdate AS created_at
FROM v_line""",
    "v_stored_version": """
SELECT l_orderkey * 100 + line_no AS id, l_orderkey AS document_id, l_linenumber AS revision, cast(1 + l_linenumber % 2 AS int) AS schema_version,
       concat(chr(123), '"mode": "', l_returnflag, '", "limits": ', chr(123), '"min": ', cast(l_linenumber AS string), ', "max": ', cast(cast(l_quantity AS int) AS string), chr(125), chr(125)) AS payload,
       l_partkey AS created_by, CASE WHEN l_linenumber % 3 = 0 THEN concat('lô "', cast(l_suppkey AS string), '"') END AS reason,
       CASE WHEN l_linenumber > 4 THEN l_orderkey * 100 + 1 END AS source_version_id, l_shipdate AS created_at, l_returnflag, l_quantity
FROM v_line""",
    "v_stored_document": """
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'station' ELSE 'user' END AS scope,
       concat('station-', cast(o_custkey % 8 AS string)) AS subject_id, concat('recipe-', cast(o_orderkey % 25 AS string)) AS document_key,
       CASE WHEN o_orderkey % 3 = 2 THEN o_custkey END AS owner_user_id, coalesce(last_revision, 0) AS current_revision,
       last_version AS current_version_id, first_version AS active_version_id, o_orderdate AS created_at, o_orderdate AS updated_at
FROM orders LEFT JOIN (
  SELECT document_id, max(revision) AS last_revision, max(id) AS last_version, min(id) AS first_version FROM v_stored_version GROUP BY document_id) v
  ON o_orderkey = document_id""",
    "v_stored_activation": """
SELECT l_orderkey * 100 + line_no AS id, l_orderkey AS document_id, l_orderkey * 100 + line_no AS requested_version_id,
       concat('activate-', cast(l_orderkey AS string), '-', cast(line_no AS string)) AS idempotency_key, concat('r', cast(l_partkey AS string)) AS request_checksum,
       CASE l_returnflag WHEN 'R' THEN 'failed' ELSE 'applied' END AS status, l_linenumber AS observed_target_revision,
       CASE l_returnflag WHEN 'R' THEN '[ "slow",  1 ]' ELSE '[]' END AS diagnostics, l_suppkey AS requested_by, cast(NULL AS string) AS reason,
       l_shipdate AS created_at, CASE WHEN l_returnflag <> 'R' THEN l_shipdate END AS completed_at
FROM v_line WHERE l_linenumber % 2 = 1""",
    "v_model_version": """
SELECT o_orderkey AS id, concat('model-', cast(o_custkey % 20 AS string)) AS model_name,
       row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS version,
       o_orderkey % 4 <> 0 AS evidence_passed, o_orderkey % 5 <> 0 AS run_completed
FROM orders""",
    "v_promotion": """
SELECT event_id AS id, user_id % 20 AS model_id,
       CASE WHEN event_type IN ('view', 'click') THEN 'candidate' ELSE 'champion' END AS alias,
       event_id % 7 + 1 AS next_version,
       lag(event_id % 7 + 1) OVER (PARTITION BY user_id % 20,
           CASE WHEN event_type IN ('view', 'click') THEN 'candidate' ELSE 'champion' END
           ORDER BY event_id) AS previous_version,
       ts AS created_at
FROM events""",
    "v_review": """
SELECT event_id AS id, user_id AS result_id,
       CASE WHEN value < 20 THEN 'PASS' ELSE 'FAIL' END AS decision, ts AS created_at
FROM events""",
    "v_prediction": """
SELECT l_orderkey * 100 + line_no AS id, l_returnflag AS label,
       CASE WHEN l_linenumber % 5 = 0 THEN 'N' ELSE l_returnflag END AS predicted
FROM v_line""",
    "v_detection": """
SELECT l_orderkey AS image_id, line_no AS det_id,
       cast(l_quantity AS int) AS x, cast(l_linenumber * 7 AS int) AS y,
       cast(l_partkey % 40 + 1 AS int) AS width, cast(l_suppkey % 40 + 1 AS int) AS height
FROM v_line""",
    "v_board": "SELECT o_orderkey AS board_id, o_orderkey % 4 AS board_type, o_orderstatus = 'O' AS good FROM orders",
    "v_component_golden": """
SELECT l_orderkey % 4 AS board_type, cast(line_no AS int) AS ref, l_returnflag AS kind, l_quantity AS x, l_tax * 600 AS y, cast(0 AS double) AS angle,
       l_extendedprice / 2000 AS size
FROM v_line JOIN (
  SELECT min(l_orderkey) AS first FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) c WHERE n = 7 GROUP BY l_orderkey % 4) t
  ON l_orderkey = t.first""",
    "v_component_obs": """
SELECT l_orderkey AS board_id, l_orderkey % 4 AS board_type, line_no AS det_id,
       l_returnflag AS kind, l_quantity AS x, l_tax * 600 AS y,
       cast((l_suppkey * 37) % 360 AS double) AS angle, l_extendedprice / 2000 AS size
FROM v_line""",
    "v_roi": """
SELECT e.vec_id AS image_id, q.roi_id, q.x, q.y, 4 AS width, 4 AS height
FROM embeddings e CROSS JOIN (VALUES (0, 0, 0), (1, 4, 0), (2, 0, 4), (3, 4, 4)) AS q(roi_id, x, y)""",
    "v_score": """
SELECT image_id, 'mean' AS detector, avg(v) AS score FROM v_pixel GROUP BY image_id
UNION ALL
SELECT image_id, 'max' AS detector, max(v) AS score FROM v_pixel GROUP BY image_id""",
    "v_byte": "SELECT image_id, grp, ch, y, x, floor(v * 255) AS v FROM v_pixel",
    "v_colour": """
SELECT vec_id AS image_id, label AS grp, cast(c AS int) AS ch, cast(i // 8 AS int) AS y, cast(i % 8 AS int) AS x,
       floor((cast(embedding[(i + c * 21) % 64 + 1] AS double) + 1) / 2 * 255) AS v
FROM embeddings CROSS JOIN range(3) AS a(c) CROSS JOIN range(64) AS b(i)""",
    "v_pixel": """
SELECT vec_id AS image_id, label AS grp, 0 AS ch, cast((i - 1) // 8 AS int) AS y, cast((i - 1) % 8 AS int) AS x,
       (cast(v AS double) + 1) / 2 AS v
FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings)""",
}


def _names_in(sql: str) -> list[str]:
    found = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            found.append(name)
    return found


def duckdb_prefix(sql: str) -> str:
    """Common table expressions for every view the statement uses, inner views first."""
    done: list[str] = []

    def visit(name: str) -> None:
        for inner in _names_in(VIEWS[name]):
            if inner != name:
                visit(inner)
        if name not in done:
            done.append(name)

    for name in _names_in(sql):
        visit(name)
    return ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in done)


class Tables:
    """Tables and views of one data folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            return self._view(name)
        raise AttributeError(name)

    def _view(self, name: str) -> DataFrame:
        if name == "v_line":
            return ordered(
                self.lineitem, ["l_orderkey"], ["l_partkey", "l_extendedprice"], number="line_no",
            )
        if name == "v_model_version":
            base = self.spark.sql(
                "SELECT o_orderkey AS id, concat('model-', cast(o_custkey % 20 AS string)) AS model_name,"
                " o_orderkey % 4 <> 0 AS evidence_passed, o_orderkey % 5 <> 0 AS run_completed FROM {o}",
                o=self.orders,
            )
            return ordered(base, ["model_name"], ["id"], number="version")
        if name == "v_promotion":
            base = self.spark.sql(
                "SELECT event_id AS id, user_id % 20 AS model_id,"
                " CASE WHEN event_type IN ('view', 'click') THEN 'candidate' ELSE 'champion' END AS alias,"
                " event_id % 7 + 1 AS next_version, ts AS created_at FROM {e}",
                e=self.events,
            )
            return ordered(
                base, ["model_id", "alias"], ["id"],
                previous={"previous_version": "next_version"},
            )
        if name == "v_component_golden":
            # Only the lines of the golden orders are numbered; they are all that stays of the lines.
            first = self.spark.sql(
                "SELECT min(l_orderkey) AS first FROM (SELECT l_orderkey, count(*) AS n FROM {l} GROUP BY l_orderkey) c"
                " WHERE n = 7 GROUP BY l_orderkey % 4",
                l=self.lineitem,
            )
            lines = self.lineitem.join(first, F.col("l_orderkey") == F.col("first"), "left_semi")
            numbered = ordered(lines, ["l_orderkey"], ["l_partkey", "l_extendedprice"], number="line_no")
            return self.spark.sql(re.sub(r"\bJOIN \(.*", "", VIEWS[name].replace("v_line", "{v}"), flags=re.S), v=numbered)
        if name == "v_roi":
            corners = F.array(*[
                F.struct(F.lit(i).alias("roi_id"), F.lit(x).alias("x"), F.lit(y).alias("y"))
                for i, x, y in ((0, 0, 0), (1, 4, 0), (2, 0, 4), (3, 4, 4))
            ])
            return self.embeddings.select(F.col("vec_id").alias("image_id"), F.inline(corners)).select(
                "*", F.lit(4).alias("width"), F.lit(4).alias("height")
            )
        if name == "v_pixel":
            return self.v_scanline.select(
                "image_id", "grp", "ch", "y", F.posexplode("row").alias("x", "v")
            )
        sql = VIEWS[name]
        used = {n: getattr(self, n) for n in (*TABLES, *VIEWS) if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)}
        for n in used:
            sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", sql)
        return self.spark.sql(sql, **used)

    @property
    def v_scanline(self) -> DataFrame:
        """Each 64-vector as an 8 x 8 single-channel image, one row per scanline."""
        return self.embeddings.select(
            F.col("vec_id").alias("image_id"),
            F.col("label").alias("grp"),
            F.lit(0).alias("ch"),
            F.posexplode(
                F.transform(
                    F.sequence(F.lit(0), F.lit(7)),
                    lambda y: F.transform(
                        F.slice("embedding", y * 8 + 1, 8), lambda v: (v.cast("double") + 1) / 2
                    ),
                )
            ).alias("y", "row"),
        ).select("image_id", "grp", "ch", "y", F.lit(8).alias("width"), "row")

    @property
    def v_byte_scanline(self) -> DataFrame:
        """Images as whole numbers 0..255."""
        return to_bytes(self.v_scanline)

    @property
    def v_colour_scanline(self) -> DataFrame:
        """Three byte channels per image: the vector read from positions 0, 21 and 42."""
        rows = self.embeddings.select(
            F.col("vec_id").alias("image_id"), F.col("label").alias("grp"),
            F.posexplode(F.array(F.lit(0), F.lit(21), F.lit(42))).alias("ch", "_from"), "embedding",
        )
        cells = F.transform(
            F.sequence(F.lit(0), F.lit(7)),
            lambda y: F.transform(
                F.sequence(F.lit(0), F.lit(7)),
                lambda x: F.floor(
                    (F.get(F.col("embedding"), F.pmod(y * 8 + x + F.col("_from"), F.lit(64))).cast("double") + 1) / 2 * 255.0
                ).cast("double"),
            ),
        )
        return rows.select("image_id", "grp", "ch", F.posexplode(cells).alias("y", "row")).select(
            "image_id", "grp", "ch", "y", F.lit(8).alias("width"), "row"
        )
