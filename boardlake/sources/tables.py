"""Fixed schemas of the inspection tables and scans that apply them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, I, S, D, B, TS = (
    T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


SCHEMAS: dict[str, T.StructType] = {
    "users": _schema(
        ("id", L, False), ("username", S, False), ("full_name", S, False), ("role", S, False),
        ("is_active", B, False), ("created_at", TS, False),
    ),
    "recipes": _schema(
        ("id", L, False), ("slug", S, False), ("name", S, False), ("is_active", B, False), ("created_at", TS, False),
    ),
    "inspection_results": _schema(
        ("id", L, False), ("board_serial", S, False), ("lot", S, False), ("recipe_id", L, False),
        ("recipe_name", S, False), ("operator_id", L, False), ("result", S, False), ("defect_count", I, False),
        ("score", T.FloatType(), True), ("cycle_time_ms", I, True), ("review_decision", S, True),
        ("reviewed_by", L, True), ("reviewed_at", TS, True), ("inspected_at", TS, False),
    ),
    "defects": _schema(
        ("id", L, False), ("result_id", L, False), ("defect_type", S, False), ("severity", S, False),
        ("confidence", T.FloatType(), True), ("location_x", T.FloatType(), True), ("location_y", T.FloatType(), True),
        ("width", T.FloatType(), True), ("height", T.FloatType(), True), ("description", S, True),
        ("detected_at", TS, False),
    ),
    "inspection_images": _schema(
        ("id", L, False), ("result_id", L, False), ("image_type", S, False), ("relative_path", S, False),
        ("file_size_bytes", L, True), ("width_px", I, True), ("height_px", I, True), ("sha256_hash", S, True),
        ("media_type", S, True), ("defect_id", L, True), ("captured_at", TS, False),
    ),
    "audit_events": _schema(
        ("id", L, False), ("actor_id", L, True), ("action", S, False), ("method", S, False), ("path", S, False),
        ("resource_type", S, False), ("resource_id", S, True), ("request_id", S, False), ("status_code", I, False),
        ("result", S, False), ("created_at", TS, False),
    ),
    "inspection_runs": _schema(
        ("id", S, False), ("station_id", S, True), ("status", S, False), ("result_id", L, True),
        ("evidence_sha256", S, True), ("error_code", S, True), ("created_at", TS, False),
    ),
    "inspection_node_runs": _schema(
        ("run_id", S, False), ("node_id", S, False), ("algorithm_id", S, False), ("status", S, False),
        ("duration_ms", I, True), ("error_code", S, True),
    ),
    "commissioning_profiles": _schema(
        ("id", S, False), ("station_id", S, False), ("version", I, False), ("deployment_mode", S, False),
        ("calibration_id", S, True), ("is_active", B, False), ("created_at", TS, False),
    ),
    "calibration_records": _schema(
        ("id", S, False), ("station_id", S, False), ("camera_id", S, False), ("image_count", I, False),
        ("coverage_percent", D, False), ("reprojection_error_pixels", D, False), ("status", S, False),
        ("valid_until", TS, False),
    ),
    "integration_outbox_events": _schema(
        ("idempotency_key", S, False), ("channel", S, False), ("event_type", S, False), ("result_id", L, True),
        ("status", S, False), ("created_at", TS, False),
    ),
    "model_versions": _schema(
        ("id", L, False), ("model_id", S, False), ("version", I, False), ("artifact_sha256", S, False),
        ("run_id", S, False), ("created_at", TS, False),
    ),
    "model_promotion_events": _schema(
        ("id", L, False), ("model_id", S, False), ("alias", S, False), ("next_version", I, False),
        ("previous_version", I, True), ("actor_id", L, True), ("created_at", TS, False),
    ),
    "settings_versions": _schema(
        ("id", L, False), ("document_id", L, False), ("revision", I, False), ("payload", S, False),
        ("checksum_sha256", S, False), ("created_by", L, True), ("created_at", TS, False),
    ),
    "settings_activations": _schema(
        ("id", L, False), ("document_id", L, False), ("version_id", L, False), ("idempotency_key", S, False),
        ("created_at", TS, False),
    ),
}


def scan(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Parquet scan with the declared schema; no inference, missing columns read as null."""
    return spark.read.schema(SCHEMAS[table]).parquet(path)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast a frame to a declared schema, adding absent nullable columns as null."""
    schema = SCHEMAS[table]
    required = [f.name for f in schema if not f.nullable and f.name not in df.columns]
    if required:
        raise ValueError(f"Table {table} lacks required columns {required}.")
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def schema_catalog(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """Columns, types and nullability of tables, one row per column (metadata only)."""
    rows = [
        (name, i, f.name, f.dataType.simpleString(), f.nullable)
        for name, df in frames.items()
        for i, f in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(
        rows, "table_name string, ordinal int, column_name string, data_type string, nullable boolean"
    )
