"""Run, model and settings lineage queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import audit, scoring
from ..functions.digests import canonical_flat_json, canonical_json, canonical_settings_json, tree_digest_sql
from ..functions.documents import document_diff, flatten
from ..operators import lineage as op
from ..operators import settings
from ..sources.storage import fresh_path
from .catalog import query
from .views import TABLES

EXPORTED_AT = "2026-01-01T00:00:00Z"


def settings_sources(t):
    """Documents, versions with their checksums, and activations."""
    versions = t.v_stored_version.drop("l_returnflag", "l_quantity")
    return t.v_stored_document, versions.withColumn("checksum", settings.payload_checksum(F.col("payload"))), t.v_stored_activation


def exported(t, documents, versions, activations):
    root = fresh_path(t.spark, "settings-export")
    settings.write_export(documents, versions, activations, root, EXPORTED_AT, compression="gzip")
    return root


@query("a04_envelope_scan", """
SELECT 'documents' AS collection, count(*) AS row_count, count(DISTINCT id) AS document_count, sum(current_revision)::bigint AS revision_sum, count(owner_user_id) AS n_texts FROM v_stored_document
UNION ALL SELECT 'versions', count(*), count(DISTINCT document_id), sum(revision)::bigint, count(reason) FROM v_stored_version
UNION ALL SELECT 'activations', count(*), count(DISTINCT document_id), sum(observed_target_revision)::bigint, count(completed_at) FROM v_stored_activation
""")
def envelope_scan(t):
    back = settings.read_export(t.spark, exported(t, *settings_sources(t)))

    def told(name, rows, document, revision, text):
        return rows.agg(
            F.lit(name).alias("collection"), F.count(F.lit(1)).alias("row_count"), F.countDistinct(document).alias("document_count"),
            F.sum(revision).alias("revision_sum"), F.count(text).alias("n_texts"),
        )

    return told("documents", back.documents, "id", "current_revision", "owner_user_id").unionByName(
        told("versions", back.versions, "document_id", "revision", "reason")).unionByName(
        told("activations", back.activations, "document_id", "observed_target_revision", "completed_at"))


KEYS_SQL = """
SELECT id || ':' || channel || ':inspection-completed:v1' AS idempotency_key, result_id, channel, created_at FROM (
 SELECT id, result_id, created_at, 'plc' AS channel FROM v_run WHERE status = 'completed' AND plc_enabled
 UNION ALL SELECT id, result_id, created_at, 'mes' FROM v_run WHERE status = 'completed' AND mes_enabled)
"""


@query("a08_outbox_events", f"""
WITH k AS ({KEYS_SQL}) SELECT idempotency_key, result_id, channel FROM k
WHERE NOT (created_at < TIMESTAMP '1995-01-01' AND channel = 'plc')
""")
def outbox_events(t):
    runs = t.v_run
    stored = op.outbox_events(runs.where("created_at < timestamp_ntz'1995-01-01'")).where("channel = 'plc'")
    return op.outbox_events(runs, stored)


def _item_sql(alias: str, collection: str, **texts: str) -> str:
    """Canonical JSON of a row in SQL; ``texts`` gives fields that are JSON or computed."""
    out = []
    for name, column, kind, type_ in sorted(settings.COLLECTIONS[collection]):
        value = f"{alias}.{column}"
        if column in texts:
            text = texts[column]
        elif kind == settings.TIME:
            text = f"""'"' || strftime({value}, '%Y-%m-%dT%H:%M:%S') || '"'"""
        elif type_ == "string":
            text = f"""'"' || replace({value}, '"', '\\"') || '"'"""
        else:
            text = f"{value}::varchar"
        out.append(f"""'"{name}":' || coalesce({text}, 'null')""")
    return "'{' || " + " || ',' || ".join(out) + " || '}'"


PAYLOAD_SQL = """'{"limits":{"max":' || v.l_quantity::int || ',"min":' || v.revision || '},"mode":"' || v.l_returnflag || '"}'"""
ARTIFACT_SQL = f"""
docs AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY scope, subject_id, document_key, owner_user_id NULLS FIRST, id) AS nth FROM v_stored_document),
items AS MATERIALIZED (
  SELECT 'd' AS c, nth, {_item_sql('d', 'documents')} AS item FROM docs d
  UNION ALL SELECT 'v', row_number() OVER (ORDER BY d.nth, v.revision, v.id), {_item_sql('v', 'versions', payload=PAYLOAD_SQL, checksum=f"""'"' || sha256({PAYLOAD_SQL}) || '"'""")}
    FROM v_stored_version v JOIN docs d ON d.id = v.document_id
  UNION ALL SELECT 'a', row_number() OVER (ORDER BY d.nth, a.created_at, a.id), {_item_sql('a', 'activations', diagnostics="""CASE a.status WHEN 'failed' THEN '["slow",1]' ELSE '[]' END""")}
    FROM v_stored_activation a JOIN docs d ON d.id = a.document_id),
parts AS MATERIALIZED (SELECT (nth - 1) // {settings.PART_ITEMS} AS part, '{{"activations":[' || coalesce(string_agg(item, ',' ORDER BY nth) FILTER (c = 'a'), '')
   || '],"documents":[' || coalesce(string_agg(item, ',' ORDER BY nth) FILTER (c = 'd'), '') || '],"exportedAt":"{EXPORTED_AT}","formatVersion":1,"part":'
   || (nth - 1) // {settings.PART_ITEMS} || ',"versions":[' || coalesce(string_agg(item, ',' ORDER BY nth) FILTER (c = 'v'), '') || ']}}' AS line FROM items GROUP BY part)
"""


@query("a09_settings_export", f"""
WITH {ARTIFACT_SQL} SELECT 'sha256' AS algorithm, 1::int AS "formatVersion", item_count AS "partCount", (SELECT count(*) FROM items WHERE c = 'd') AS "documentCount",
  (SELECT count(*) FROM items WHERE c = 'v') AS "versionCount", (SELECT count(*) FROM items WHERE c = 'a') AS "activationCount", digest AS checksum
FROM ({tree_digest_sql('parts', [], 'part', 'line')})
""")
def settings_export(t):
    return settings.read_export(t.spark, exported(t, *settings_sources(t))).manifest


@query("h15_artifact_issues", f"""
WITH {ARTIFACT_SQL.replace("v.l_quantity::int", "(v.l_quantity::int + CASE WHEN v.id % 97 = 0 THEN 1 ELSE 0 END)", 1)},
 k AS (SELECT v.id, d.document_key || '/' || v.schema_version AS actual FROM v_stored_version v JOIN v_stored_document d ON d.id = v.document_id WHERE d.document_key = 'recipe-7' AND v.schema_version = 2)
SELECT 'version-checksum' AS issue, 'versions' AS collection, id::varchar AS id, sha256({PAYLOAD_SQL}) AS declared, sha256({PAYLOAD_SQL.replace('v.l_quantity::int', '(v.l_quantity::int + 1)')}) AS actual
  FROM v_stored_version v WHERE id % 97 = 0
UNION ALL SELECT 'count', 'activations', NULL, ((SELECT count(*) FROM v_stored_activation) + 3)::varchar, (SELECT count(*) FROM v_stored_activation)::varchar
UNION ALL SELECT 'unknown-schema', 'versions', id::varchar, NULL, actual FROM k
""")
def artifact_issues(t):
    """Changed payloads, a wrong count and a schema that is not known, found in an artifact."""
    documents, versions, activations = settings_sources(t)
    changed = F.when(F.col("id") % 97 == 0, F.regexp_replace("payload", r'"max": \d+', F.concat(F.lit('"max": '), (F.regexp_extract("payload", r'"max": (\d+)', 1).cast("int") + 1).cast("string"))))
    back = settings.read_export(t.spark, exported(t, documents, versions.withColumn("payload", F.coalesce(changed, "payload")), activations))
    told = back.manifest.withColumn("activationCount", F.col("activationCount") + 3)
    known = documents.select("document_key").distinct().withColumn("schema_version", F.explode(F.array(F.lit(1), F.lit(2))))
    known = known.where("not (document_key = 'recipe-7' and schema_version = 2)")
    return settings.verify_export(replace(back, manifest=told), known)


@query("c06_exported_documents", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""")
def exported_documents(t):
    exported = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(exported, "o_custkey", "left_semi")


def settings_pair(t):
    """Two documents per event that differ in a value, an array tail and an added object."""
    e = t.events
    return e.select(
        "event_id",
        F.concat(
            F.lit('{"type": "'), F.when(F.col("event_type") == "error", "ERR").otherwise(F.col("event_type")), F.lit('", "props": '),
            "props", F.lit(', "tags": ['), F.col("user_id").cast("string"),
            F.when(F.col("value") > 100, "").otherwise(', "x"'), F.lit("]"),
            F.when(F.col("event_type") == "purchase", ', "extra": {"b": [1, 2], "a": 1}').otherwise(""), F.lit("}"),
        ).alias("submitted"),
        F.concat(
            F.lit('{"tags": ['), F.col("user_id").cast("string"), F.lit(', "x"], "type": "'), "event_type", F.lit('", "props": '),
            "props", F.lit("}"),
        ).alias("current"),
    )


@query("c08_document_diff", """
SELECT event_id, '$.type' AS path, '"ERR"' AS submitted, '"error"' AS current FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, '$.tags[1]', NULL, '"x"' FROM events WHERE value > 100
UNION ALL SELECT event_id, '$.extra', '{"a":1,"b":[1,2]}', NULL FROM events WHERE event_type = 'purchase'
""")
def settings_diff(t):
    return document_diff(settings_pair(t), "event_id", "submitted", "current")


def model_artifacts(t):
    o = t.orders
    artifacts = o.where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("artifact_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("run_id"),
    )
    versions = t.v_model_version.select("id", "model_name", "version", "evidence_passed").join(
        o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("run_id")), "id"
    ).withColumn("artifact_id", F.col("id"))
    runs = t.customer.where("c_nationkey <> 3").select(
        F.col("c_custkey").alias("run_id"), (F.col("c_acctbal") > 0).alias("run_completed")
    )
    return versions, artifacts, runs


@query("c09_version_integrity", """
SELECT v.id, v.model_name, CASE WHEN a.o_orderkey IS NULL THEN 'artifact-missing'
  WHEN a.o_orderpriority = '1-URGENT' THEN 'artifact-of-other-run' WHEN c.c_custkey IS NULL THEN 'run-missing'
  WHEN NOT c.c_acctbal > 0 THEN 'run-not-completed' WHEN NOT v.evidence_passed THEN 'evidence-not-passed' ELSE 'ok' END AS issue
FROM v_model_version v JOIN orders o ON o.o_orderkey = v.id
LEFT JOIN orders a ON a.o_orderkey = v.id AND a.o_orderstatus <> 'P'
LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_nationkey <> 3
""")
def version_integrity(t):
    return op.version_integrity(*model_artifacts(t)).select("id", "model_name", "issue")


ALIAS_SQL = """
SELECT model_id, alias, arg_max(next_version, id) AS version FROM v_promotion GROUP BY model_id, alias
"""


def model_versions(t):
    return t.v_model_version.select(
        F.regexp_replace("model_name", "^model-", "").cast("bigint").alias("model_id"), "version", "id"
    )


@query("c10_alias_resolution", f"""
SELECT a.model_id, a.alias, a.version, coalesce(sha256(cast(v.id AS varchar)), 'none') AS artifact_sha256, v.id IS NOT NULL AS is_resolved
FROM ({ALIAS_SQL}) a LEFT JOIN v_model_version v ON v.model_name = 'model-' || a.model_id AND v.version = a.version
  AND v.evidence_passed
""")
def alias_resolution(t):
    passed = t.v_model_version.where("evidence_passed").select(
        F.regexp_replace("model_name", "^model-", "").cast("bigint").alias("model_id"), "version", "id"
    )
    found = op.resolve_aliases(op.alias_table(t.v_promotion), passed)
    return found.select(
        "model_id", "alias", "version",
        F.coalesce(F.sha2(F.col("version_id").cast("string"), 256), F.lit("none")).alias("artifact_sha256"), "is_resolved",
    )


VALID_CALIBRATION = "image_count >= 10 AND coverage_percent >= 70 AND reprojection_error_pixels <= 1"


@query("c14_calibration_validity", f"""
SELECT r.id, r.station_id, coalesce(CASE WHEN c.valid_until > r.created_at THEN c.id END, 'none') AS calibration_id,
  coalesce(c.valid_until > r.created_at, false) AS is_calibrated
FROM v_run r LEFT JOIN (SELECT station_id, max(valid_until) AS valid_until, arg_max(id, (valid_until, id)) AS id FROM v_calibration
  WHERE {VALID_CALIBRATION} GROUP BY station_id) c ON c.station_id = r.station_id
""")
def calibration_validity(t):
    return op.valid_calibration(t.v_run, t.v_calibration.where(VALID_CALIBRATION)).withColumn(
        "calibration_id", F.coalesce("calibration_id", F.lit("none"))
    )


@query("c15_event_versions", """
SELECT p.id, p.model_id, p.alias, coalesce(n.id, -1) AS next_id, coalesce(b.id, -1) AS previous_id, u.full_name AS actor
FROM v_promotion p LEFT JOIN v_model_version n ON n.model_name = 'model-' || p.model_id AND n.version = p.next_version
LEFT JOIN v_model_version b ON b.model_name = 'model-' || p.model_id AND b.version = p.previous_version
LEFT JOIN v_user u ON u.id = p.id % 1000
""")
def event_versions(t):
    events = t.v_promotion.withColumn("actor_id", F.col("id") % 1000)
    actors = t.v_user.select(F.col("id").alias("actor_id"), F.col("full_name").alias("actor"))
    return op.with_both_versions(events, model_versions(t), actors).select(
        "id", "model_id", "alias", F.coalesce("next_id", F.lit(-1)).alias("next_id"),
        F.coalesce("previous_id", F.lit(-1)).alias("previous_id"), "actor",
    )


@query("c17_null_safe_identity", """
WITH r AS (SELECT o_orderkey, o_orderstatus AS scope, o_orderpriority AS key,
                  CASE WHEN o_totalprice > 100000 THEN o_custkey END AS owner_id FROM orders),
     d AS (SELECT scope, key, owner_id, min(o_orderkey) AS document_id, max(o_orderkey) AS current_version_id FROM r GROUP BY ALL)
SELECT r.o_orderkey, d.document_id, d.current_version_id FROM r LEFT JOIN d
 ON d.scope = r.scope AND d.key = r.key AND d.owner_id IS NOT DISTINCT FROM r.owner_id
""")
def null_safe_identity(t):
    requests = t.orders.select(
        "o_orderkey", F.col("o_orderstatus").alias("scope"), F.col("o_orderpriority").alias("key"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_custkey")).alias("owner_id"),
    )
    documents = requests.groupBy("scope", "key", "owner_id").agg(
        F.min("o_orderkey").alias("document_id"), F.max("o_orderkey").alias("current_version_id")
    )
    return op.null_safe_lookup(requests, documents, ["scope", "key", "owner_id"]).select(
        "o_orderkey", "document_id", "current_version_id"
    )


@query("d17_registry_payload", f"""
SELECT v.model_name, (v.version - 1) // 1000 AS page, count(*) AS version_count,
  string_agg(v.version || ':' || v.id, ',' ORDER BY v.version) AS versions,
  coalesce(max(a.aliases), '') AS aliases
FROM v_model_version v LEFT JOIN (SELECT 'model-' || model_id AS model_name, string_agg(alias || '=' || version, ',' ORDER BY alias) AS aliases
  FROM ({ALIAS_SQL}) GROUP BY model_id) a ON a.model_name = v.model_name
GROUP BY v.model_name, (v.version - 1) // 1000
""")
def registry_payload(t):
    v = t.v_model_version
    pages = v.groupBy("model_name", F.floor((F.col("version") - 1) / 1000).cast("bigint").alias("page")).agg(
        F.count(F.lit(1)).alias("version_count"), F.array_sort(F.collect_list(F.struct("version", "id"))).alias("_v")
    )
    listed = F.array_join(F.transform("_v", lambda x: F.concat_ws(":", x["version"].cast("string"), x["id"].cast("string"))), ",")
    # Aliases are a fixed small set, so the map of a model is bounded.
    aliases = op.alias_table(t.v_promotion).groupBy(
        F.concat(F.lit("model-"), F.col("model_id").cast("string")).alias("model_name")
    ).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("alias", "version")))).alias("_a"))
    shown = F.array_join(
        F.transform(F.map_entries("_a"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","
    )
    return pages.join(aliases, "model_name", "left").select(
        "model_name", "page", "version_count", listed.alias("versions"), F.coalesce(shown, F.lit("")).alias("aliases")
    )


@query("d18_node_run_summary", """
SELECT event_type, count(*) AS run_count, count(*) FILTER (WHERE value > 200) AS faulted_count,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type
""")
def node_run_summary(t):
    return op.node_summary(t.events, "event_type", "value", F.col("value") > 200).select(
        "event_type", "run_count", "faulted_count", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95")
    )


@query("e01_latest_per_key", """
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_order, max(o_orderdate) AS latest_date
FROM orders GROUP BY o_custkey
""")
def latest_per_key(t):
    at = F.struct("o_orderdate", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(
        F.max_by("o_orderkey", at).alias("latest_order"), F.max("o_orderdate").alias("latest_date")
    )


@query("e02_next_version_numbers", """
SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders
""")
def next_version_numbers(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return op.version_numbers(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "o_custkey", "version"
    )


@query("e07_rollback_target", """
SELECT model_id, alias, max(id) AS source_event, arg_max(previous_version, id) AS target_version
FROM v_promotion WHERE previous_version IS NOT NULL GROUP BY model_id, alias
""")
def rollback_target(t):
    return op.rollback_targets(t.v_promotion)


def event_log(t, *columns):
    return t.events.select("event_id", "user_id", *columns)


@query("e08_activation_chain", """
SELECT event_id, user_id, event_type, nullif(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), event_type) AS previous_profile
FROM events
""")
def activation_chain(t):
    return op.activation_chain(event_log(t, "event_type"), "user_id", ["event_id"], "event_type")


@query("e09_revision_gaps", """
SELECT document_id, id, revision, expected_revision FROM (
 SELECT *, coalesce(lag(revision) OVER (PARTITION BY document_id ORDER BY revision, id), 0) + 1 AS expected_revision FROM v_settings_version)
WHERE revision <> expected_revision
""")
def revision_gaps(t):
    return op.revision_gaps(
        t.v_settings_version, "document_id", "revision", ["revision", "id"]
    ).select("document_id", "id", "revision", "expected_revision")


# Which job state each event type of the log stands for.
STATE_OF_EVENT = {
    "signup": "queued", "view": "preparing-dataset", "click": "validating", "purchase": "training", "error": "failed",
}
STATE_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE_OF_EVENT.items()) + " END"
PAIRS = ", ".join(f"'{a}>{b}'" for a, nexts in op.ALLOWED_TRANSITIONS.items() for b in nexts)


def job_log(t):
    return event_log(t, "ts", "value", F.expr(STATE_CASE).alias("status"))


@query("e10_transition_check", f"""
SELECT event_id, user_id, status, CASE WHEN p IS NULL THEN 'ok' WHEN p IN ('completed', 'failed', 'cancelled') THEN 'after-terminal'
  WHEN p || '>' || status IN ({PAIRS}) THEN 'ok' ELSE 'illegal-transition' END AS issue
FROM (SELECT event_id, user_id, {STATE_CASE} AS status, lag({STATE_CASE}) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
""")
def transition_check(t):
    return op.check_transitions(job_log(t), "user_id", "status", ["event_id"]).select(
        "event_id", "user_id", "status", "issue"
    )


STAGE_LIST = "[" + ", ".join(f"'{s}'" for s in op.STAGES) + "]"


@query("e11_progress_check", f"""
SELECT event_id, user_id, CASE WHEN s = 0 THEN 'unsupported-stage' WHEN s < ls THEN 'stage-regressed'
  WHEN s = ls AND value <= lv THEN 'units-not-growing' ELSE 'ok' END AS issue
FROM (SELECT *, lag(s) OVER w AS ls, lag(value) OVER w AS lv FROM (
  SELECT event_id, user_id, value, coalesce(list_position({STAGE_LIST}, {STATE_CASE}), 0) AS s FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
""")
def progress_check(t):
    return op.check_progress(job_log(t), "user_id", "status", "value", ["event_id"]).select(
        "event_id", "user_id", "issue"
    )


@query("g02_canonical_json_nested", """
SELECT event_id, j AS canonical, sha256(j) AS checksum_sha256 FROM (SELECT event_id,
 '{' || CASE WHEN event_type = 'purchase' THEN '"extra":{"a":1,"b":[1,2]},' ELSE '' END || '"props":' || replace(props, ' ', '') || ',"tags":[' || user_id ||
   CASE WHEN value > 100 THEN '' ELSE ',"x"' END || '],"type":"' || CASE WHEN event_type = 'error' THEN 'ERR' ELSE event_type END || '"}' AS j FROM events)
""")
def canonical_json_nested(t):
    done = settings_pair(t).select("event_id", canonical_json("submitted").alias("canonical"))
    return done.withColumn("checksum_sha256", F.sha2("canonical", 256))


@query("g02_settings_checksum", """
SELECT id, j AS canonical, sha256(j) AS checksum_sha256 FROM (SELECT o_orderkey AS id,
 '{"größe":{"é":' || o_custkey || ',"ü":null},"名":"' || o_orderpriority || '"}' AS j FROM orders)
""")
def settings_checksum(t):
    """Nested documents with letters beyond ASCII, in the form of settings checksums."""
    text = F.concat(
        F.lit('{"名": "'), "o_orderpriority", F.lit('", "größe": {"ü": null, "é": '), F.col("o_custkey").cast("string"), F.lit("}}"),
    )
    done = t.orders.select(F.col("o_orderkey").alias("id"), canonical_settings_json(text).alias("canonical"))
    return done.withColumn("checksum_sha256", F.sha2(F.col("canonical").cast("binary"), 256))


@query("g02_canonical_json_flat", """
SELECT o_orderkey, j AS canonical, sha256(j) AS checksum_sha256 FROM (SELECT o_orderkey,
 '{"customer":"' || o_custkey || '","owner":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderpriority || '"' END
 || ',"status":"' || o_orderstatus || '"}' AS j FROM orders)
""")
def canonical_json_flat(t):
    m = F.create_map(
        F.lit("status"), F.col("o_orderstatus"), F.lit("owner"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")), F.lit("customer"), F.col("o_custkey").cast("string"),
    )
    done = t.orders.select("o_orderkey", canonical_flat_json(m).alias("canonical"))
    return done.withColumn("checksum_sha256", F.sha2("canonical", 256))


@query("g03_flatten_json", """
SELECT event_id, '$.props.k' AS path, regexp_extract(props, '[0-9]+') AS value FROM events
UNION ALL SELECT event_id, '$.tags[0]', cast(user_id AS varchar) FROM events
UNION ALL SELECT event_id, '$.tags[1]', '"x"' FROM events
UNION ALL SELECT event_id, '$.type', '"' || event_type || '"' FROM events
""")
def flatten_json(t):
    return flatten(settings_pair(t), ["event_id"], "current")


@query("g04_resource_parts", r"""
WITH p AS (SELECT page_id, list_filter(string_split(CASE WHEN page_id % 5 = 0 THEN '/api' ELSE '' END ||
   regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
 r AS (SELECT page_id, CASE WHEN parts[1] = 'api' THEN parts[2:] ELSE parts END AS parts FROM p)
SELECT page_id, coalesce(parts[1], 'application') AS resource_type, parts[2] AS resource_id FROM r
""")
def resource_parts(t):
    path = F.concat(
        F.when(F.col("page_id") % 5 == 0, "/api").otherwise(""), F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1)
    )
    kind, key = audit.resource_parts(path)
    return t.pages.select("page_id", kind.alias("resource_type"), key.alias("resource_id"))


METHOD_CASE = "CASE event_type WHEN 'signup' THEN 'POST' WHEN 'click' THEN 'PUT' WHEN 'purchase' THEN 'PATCH' WHEN 'error' THEN 'DELETE' ELSE 'GET' END"


@query("g05_audit_action", f"""
SELECT event_id, CASE method WHEN 'POST' THEN 'create' WHEN 'PUT' THEN 'update' WHEN 'PATCH' THEN 'update' WHEN 'DELETE' THEN 'delete' END AS action,
  CASE WHEN 200 + cast(floor(value) AS bigint) < 400 THEN 'success' ELSE 'failure' END AS result
FROM (SELECT *, {METHOD_CASE} AS method FROM events)
""")
def audit_action(t):
    return t.events.select(
        "event_id", audit.action(F.expr(METHOD_CASE)).alias("action"),
        audit.outcome(200 + F.floor("value")).alias("result"),
    )


@query("g14_restart_recovery", """
SELECT id, CASE WHEN status IN ('moving', 'capturing', 'executing') THEN 'faulted' WHEN status IN ('queued', 'precheck') THEN 'cancelled' ELSE status END AS recovered_status,
  CASE WHEN status IN ('moving', 'capturing', 'executing') THEN 'restart-during-physical-operation'
       WHEN status IN ('queued', 'precheck') THEN 'restart-before-execution' END AS error_code FROM v_run
""")
def restart_recovery(t):
    status, code = op.recovered_status(F.col("status"))
    return t.v_run.select("id", status.alias("recovered_status"), code.alias("error_code"))


@query("g16_calibration_status", f"""
SELECT id, station_id, CASE WHEN {VALID_CALIBRATION} AND valid_until > DATE '1997-01-01' THEN 'valid' ELSE 'failed' END AS status FROM v_calibration
""")
def calibration_status(t):
    return op.calibration_status(t.v_calibration, F.lit("1997-01-01").cast("date")).select("id", "station_id", "status")


@query("g16_station_readiness", """
SELECT station_id, reasons = '' AS ready, reasons FROM (
 SELECT c_custkey AS station_id, concat_ws(',', CASE WHEN mode IS NULL THEN 'no-active-commissioning-profile' END,
   CASE WHEN mode IN ('hardware-pilot', 'production') AND valid_until IS NULL THEN 'missing-calibration' END,
   CASE WHEN mode IN ('hardware-pilot', 'production') AND valid_until <= DATE '1997-01-01' THEN 'expired-calibration' END) AS reasons
 FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN NULL WHEN 'BUILDING' THEN 'production' WHEN 'FURNITURE' THEN 'hardware-pilot'
   ELSE 'simulation' END AS mode FROM customer) c LEFT JOIN v_calibration k ON k.id = 'cal-' || c.c_custkey)
""")
def station_readiness(t):
    mode = F.expr(
        "CASE c_mktsegment WHEN 'MACHINERY' THEN NULL WHEN 'BUILDING' THEN 'production'"
        " WHEN 'FURNITURE' THEN 'hardware-pilot' ELSE 'simulation' END"
    )
    profiles = t.customer.select(
        F.col("c_custkey").alias("station_id"), mode.alias("deployment_mode"),
        F.concat(F.lit("cal-"), F.col("c_custkey").cast("string")).alias("calibration_id"),
    )
    return op.station_readiness(profiles, t.v_calibration, F.lit("1997-01-01").cast("date"))


@query("g17_retention_verdict", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR days IS NULL OR date_diff('day', o_orderdate, TIMESTAMP '1998-01-01') <= days
  THEN 'preserve' ELSE 'delete' END AS verdict
FROM orders LEFT JOIN (VALUES ('1-URGENT', 1000), ('2-HIGH', 500), ('5-LOW', 100)) AS r(kind, days) ON kind = o_orderpriority
""")
def retention_verdict(t):
    days = {"1-URGENT": 1000, "2-HIGH": 500, "5-LOW": 100}
    limits = t.spark.createDataFrame(
        [(k, d * 86400) for k, d in days.items()], "o_orderpriority string, max_age_seconds bigint"
    )
    age = scoring.age_seconds(F.lit("1998-01-01 00:00:00").cast("timestamp"), F.col("o_orderdate"))
    return op.retention_verdict(
        t.orders, limits, age, F.col("o_orderstatus") == "P", "o_orderpriority"
    ).select("o_orderkey", "verdict")


@query("g24_compatible_entries", """
SELECT o_orderkey, '{"framework":"' || o_orderpriority || '"' || CASE WHEN o_orderstatus <> 'P' THEN ',"status":"' || o_orderstatus || '"' ELSE '' END || '}' AS compatibility
FROM orders
""")
def compatible_entries(t):
    text = F.concat(
        F.lit('{"framework":"'), "o_orderpriority", F.lit('","secret":"x","status":"'),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise(""), F.lit('","task":""}'),
    )
    kept = scoring.compatible_entries(
        F.from_json(text, "map<string,string>"), ["task", "inputSchema", "outputSchema", "framework", "status"]
    )
    return t.orders.select("o_orderkey", canonical_flat_json(kept).alias("compatibility"))


ITEM = "concat_ws(':', cast(event_id AS string), event_type, props)"


@query("h06_replay_comparison", f"""
WITH a AS ({tree_digest_sql(f'(SELECT user_id, event_id, {ITEM} AS item FROM events)', ['user_id'], 'event_id', 'item')}),
 b AS ({tree_digest_sql(f"(SELECT user_id, event_id, CASE WHEN value > 300 THEN 'x' ELSE {ITEM} END AS item FROM events)", ['user_id'], 'event_id', 'item')})
SELECT a.user_id, a.digest, a.digest = b.digest AS replay_matches FROM a JOIN b ON b.user_id = a.user_id
""")
def replay_comparison(t):
    e = t.events
    item = F.expr(ITEM)
    fresh = op.evidence_digests(e, "user_id", ["event_id"], item)
    stored = op.evidence_digests(
        e, "user_id", ["event_id"], F.when(F.col("value") > 300, "x").otherwise(item)
    )
    return op.replay_comparison(stored, fresh, "user_id")


@query("h07_reproducibility_manifest", """
SELECT o_orderkey, '{"dataset":"' || o_custkey || '","parameters":{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus
  || '"},"run":' || o_orderkey || ',"schemaVersion":1}' AS manifest FROM orders
""")
def reproducibility_manifest(t):
    doc = F.struct(
        F.col("o_custkey").cast("string").alias("dataset"),
        F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).alias("parameters"),
        F.col("o_orderkey").alias("run"), F.lit(1).alias("schemaVersion"),
    )
    return t.orders.select("o_orderkey", F.to_json(doc).alias("manifest"))


@query("h08_alias_table", ALIAS_SQL)
def alias_table(t):
    return op.alias_table(t.v_promotion)


@query("h09_idempotent_activation", """
SELECT event_id, first_id, CASE WHEN event_id = first_id THEN 'created' WHEN props = p THEN 'replayed' ELSE 'conflict' END AS outcome
FROM (SELECT event_id, props, min(event_id) OVER w AS first_id, first_value(props) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS p
      FROM events WINDOW w AS (PARTITION BY user_id, event_type))
""")
def idempotent_activation(t):
    requests = t.events.select("event_id", "user_id", "event_type", "props")
    return op.idempotent_outcomes(requests, ["user_id", "event_type"], "event_id", "props").select(
        "event_id", "first_id", "outcome"
    )


@query("h11_review_state", """
SELECT i.id, i.result, r.d AS current_decision, coalesce(r.n, 0) AS review_count FROM v_inspection i LEFT JOIN (
 SELECT result_id, arg_max(decision, (created_at, id)) AS d, count(*) AS n FROM v_review GROUP BY result_id) r ON r.result_id = i.id
""")
def review_state(t):
    return op.review_state(t.v_inspection.select("id", "result"), t.v_review).withColumn(
        "review_count", F.coalesce("review_count", F.lit(0))
    )


# Columns and types of the given tables.
GIVEN_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,"
                " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def completeness_sql(tables: list[str], typed: bool) -> str:
    parts = []
    for table in tables:
        for i, column in enumerate(GIVEN_COLUMNS[table].split(", "), 1):
            name, kind = column.split(" ")
            shown = f"'{kind}' AS data_type, " if typed else ""
            parts.append(
                f"SELECT '{table}' AS table_name, '{name}' AS column_name, {i} AS ordinal, {shown}count(*) AS row_count,"
                f" count(*) - count({name}) AS null_count FROM {table}"
            )
    return " UNION ALL ".join(parts)


CATALOGED = ["customer", "documents", "events", "labels"]


@query("h13_table_catalog", completeness_sql(CATALOGED, False))
def table_catalog(t):
    return op.column_completeness({n: getattr(t, n) for n in CATALOGED}).drop("data_type")


@query("h13_full_table_catalog", completeness_sql(list(TABLES), True))
def full_table_catalog(t):
    return op.column_completeness({n: getattr(t, n) for n in TABLES})


@query("h14_copy_forward_rollback", """
SELECT document_id, new_revision, source_id, source_revision, created_by FROM (
 SELECT document_id, max(revision) OVER (PARTITION BY document_id) + 1 AS new_revision, id AS source_id, revision AS source_revision, created_by,
   row_number() OVER (PARTITION BY document_id ORDER BY revision, id) AS n FROM v_settings_version) WHERE n = 1
""")
def copy_forward_rollback(t):
    return op.copy_forward(t.v_settings_version, "document_id", F.lit(True))


@query("h15_export_verification", """
WITH d AS (SELECT id, sha256(cast(created_by AS varchar)) AS checksum FROM v_settings_version WHERE revision < 7),
 a AS (SELECT id, sha256(cast(created_by AS varchar) || CASE WHEN document_id < 200 THEN '!' ELSE '' END) AS checksum FROM v_settings_version WHERE revision > 1)
SELECT coalesce(d.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'missing' WHEN d.id IS NULL THEN 'undeclared' ELSE 'checksum-mismatch' END AS issue
FROM d FULL OUTER JOIN a ON a.id = d.id WHERE a.id IS NULL OR d.id IS NULL OR d.checksum <> a.checksum
""")
def export_verification(t):
    v = t.v_settings_version
    by = F.col("created_by").cast("string")
    declared = v.where("revision < 7").select("id", F.sha2(by, 256).alias("checksum"))
    changed = F.concat(by, F.when(F.col("document_id") < 200, "!").otherwise(""))
    actual = v.where("revision > 1").select("id", F.sha2(changed, 256).alias("checksum"))
    return op.export_issues(declared, actual, "id")
