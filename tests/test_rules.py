import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from boardlake.functions import audit, scoring
from boardlake.functions.digests import canonical_json, canonical_settings_json, tree_digest
from boardlake.operators import components as comp
from boardlake.operators import extensions as ext
from boardlake.operators import lineage as lin
from boardlake.operators import scores as sc
from boardlake.sources import storage
from boardlake.sources.exports import export_records
from boardlake.sources.tables import SCHEMAS, conform, scan


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_resource_parts(spark):
    paths = {"/api/v1/x": ("v1", "x"), "/": ("application", None), "/recipes/7/lines": ("recipes", "7"), "api": ("application", None)}
    for path, want in paths.items():
        kind, key = audit.resource_parts(F.lit(path))
        assert tuple(one(spark, kind, key)) == want


def test_precheck_order(spark):
    good = dict(
        byte_length=F.lit(5), sha=F.lit("a" * 64), observed_sha=F.lit("a" * 64), blurred=F.lit(False), registered=F.lit(True),
        in_position=F.lit(True), age=F.lit(10.0), tolerance=60.0,
    )
    assert one(spark, scoring.precheck_code(**good))[0] is None
    assert one(spark, scoring.precheck_code(**{**good, "age": F.lit(-1.0)}))[0] == "stale-pose"
    assert one(spark, scoring.precheck_code(**{**good, "age": F.lit(-1.0), "blurred": F.lit(True)}))[0] == "blurred"
    assert one(spark, scoring.precheck_code(**{**good, "sha": F.lit("b"), "observed_sha": F.lit("b")}))[0] == "checksum-invalid"


def test_boundaries_of_decisions(spark):
    at = F.lit(0.5)
    assert one(spark, scoring.pass_at_most(at, 0.5), scoring.fail_at_least(at, 0.5), scoring.bounded_score(F.lit(float("nan"))))[:] == ("PASS", "FAIL", 0.0)
    assert one(spark, scoring.fail_at_least(F.lit(None).cast("double"), 0.5), scoring.fail_at_least(at, 0.5, F.lit("PASS")))[:] == ("PASS", "PASS")
    assert one(spark, scoring.switch_case(F.lit("b"), [("a", "x"), ("b", "y"), ("b", "z")]))[0] == "y"


def test_canonical_json_keeps_python_numbers(spark):
    doc = '{"b": 0.00001, "a": {"y": null, "x": [1, 2.0]}}'
    got = spark.createDataFrame([(doc,)], "t string").select(canonical_json("t")).first()[0]
    assert got == json.dumps(json.loads(doc), sort_keys=True, separators=(",", ":")) and "1e-05" in got


def test_tree_digest_depends_on_order_and_all_rows(spark):
    df = spark.range(25).withColumn("k", F.col("id") % 2)
    args = (["k"], ["id"], F.col("id").cast("string"))
    base = {r["k"]: r["digest"] for r in tree_digest(df, *args, fanout=3, levels=4).collect()}
    hot = {r["k"]: r["digest"] for r in tree_digest(df, *args, fanout=3, levels=4, hot_rows=4).collect()}
    less = {r["k"]: r["digest"] for r in tree_digest(df.where("id <> 11"), *args, fanout=3, levels=4).collect()}
    assert base == hot and base[0] == less[0] and base[1] != less[1]


def test_transitions_and_progress(spark):
    log = spark.createDataFrame(
        [(1, 1, "queued"), (1, 2, "preparing-dataset"), (1, 3, "failed"), (1, 4, "queued"), (2, 1, "queued"), (2, 2, "training")],
        "job int, seq int, status string",
    )
    got = lin.check_transitions(log, "job", "status", ["seq"]).orderBy("job", "seq").collect()
    assert [r["issue"] for r in got] == ["ok", "ok", "ok", "after-terminal", "ok", "illegal-transition"]
    steps = spark.createDataFrame([(1, 1, "training", 5), (1, 2, "training", 5), (1, 3, "validating", 9), (1, 4, "other", 1)], "job int, seq int, status string, units int")
    got = lin.check_progress(steps, "job", "status", "units", ["seq"]).orderBy("seq").collect()
    assert [r["issue"] for r in got] == ["ok", "units-not-growing", "stage-regressed", "unsupported-stage"]


def test_rollback_uses_latest_event_with_a_previous(spark):
    events = spark.createDataFrame(
        [(1, 1, "champion", 1, None), (2, 1, "champion", 2, 1), (3, 1, "champion", 1, 2), (4, 1, "candidate", 5, None)],
        "id int, model_id int, alias string, next_version int, previous_version int",
    )
    got = lin.rollback_targets(events).collect()
    assert [(r["alias"], r["source_event"], r["target_version"]) for r in got] == [("champion", 3, 2)]


def test_outbox_is_idempotent(spark):
    runs = spark.createDataFrame([("r1", 1, "completed", True, True), ("r2", 2, "faulted", True, True)], "id string, result_id int, status string, plc_enabled boolean, mes_enabled boolean")
    first = lin.outbox_events(runs)
    assert first.count() == 2 and lin.outbox_events(runs, first).count() == 0


def test_angles_wrap_around(spark):
    assert one(spark, comp.angle_deviation(F.lit(359.0), F.lit(1.0)))[0] == pytest.approx(-2.0)


def test_component_matching_is_mutual(spark):
    golden = spark.createDataFrame([(1, 1, "R", 0.0, 0.0, 0.0), (1, 2, "R", 50.0, 0.0, 0.0)], "board_type int, ref int, kind string, x double, y double, angle double")
    seen = spark.createDataFrame([(7, 1, 1, "R", 0.5, 0.0, 0.0), (7, 1, 2, "R", 0.9, 0.0, 0.0)], "board_id bigint, board_type int, det_id bigint, kind string, x double, y double, angle double")
    got = {(r["ref"], r["det_id"], r["state"]) for r in comp.component_report(seen, golden, 5.0).collect()}
    assert got == {(1, 1, "matched"), (2, -1, "missing"), (-1, 2, "extra")}


def test_auroc_and_accuracy(spark):
    df = spark.createDataFrame([("d", 0.1, False), ("d", 0.4, False), ("d", 0.4, True), ("d", 0.8, True)], "det string, s double, ng boolean")
    assert sc.auroc(df, "det", "s", F.col("ng")).first()["auroc"] == pytest.approx(0.875)
    assert sc.auroc(df, "det", "s", F.col("ng"), hot_rows=1).first()["auroc"] == pytest.approx(0.875)
    assert sc.accuracy(spark.createDataFrame([], "label string, predicted string")).first()["accuracy"] is None


def test_parameters_and_registry(spark):
    declared = {"limit": ext.Parameter(float, 0.5, 0.0, 1.0), "mode": ext.Parameter(str, "a", options=("a", "b"))}
    assert ext.resolve(declared, {}) == {"limit": 0.5, "mode": "a"}
    for bad in ({"limit": 2.0}, {"limit": "x"}, {"mode": "c"}, {"other": 1}, {"limit": True}):
        with pytest.raises(ValueError):
            ext.resolve(declared, bad)
    r = ext.Registry()
    r.register(ext.Operator("double", lambda df: df.withColumn("v", F.col("id") * 2), ("id",), ("v",)))
    assert r.run("double", spark.range(2)).orderBy("id").collect()[1]["v"] == 2
    with pytest.raises(ValueError):
        r.register(ext.Operator("double", lambda df: df, (), ()))
    r.register(ext.Operator("broken", lambda df: df, ("id",), ("v",)))
    with pytest.raises(ValueError):
        r.run("broken", spark.range(1))
    with pytest.raises(ValueError):
        r.run("double", spark.range(1).withColumnRenamed("id", "x"))


def test_side_input_is_verified(spark):
    path, digest, count = ext.store_artifact(spark.range(5), "side", "id")
    assert ext.load_artifact(spark, path, "id", digest, count).count() == 5
    with pytest.raises(ValueError):
        ext.load_artifact(spark, path, "id", "0" * 64, count)


def test_schemas_and_export(spark, tmp_path):
    df = spark.createDataFrame([("r", "n", True)], "slug string, name string, is_active boolean")
    with pytest.raises(ValueError):
        conform(df, "recipes")
    full = df.withColumn("id", F.lit(1)).withColumn("created_at", F.current_timestamp())
    out = conform(full, "recipes")
    assert out.columns == SCHEMAS["recipes"].fieldNames()
    out.write.parquet(str(tmp_path / "recipes"))
    assert scan(spark, "recipes", str(tmp_path / "recipes")).first()["slug"] == "r"
    rows = spark.createDataFrame([(1, 'a"b', "n", "PASS", 0, None, "t")], "id int, board_serial string, recipe_name string, result string, defect_count int, score double, inspected_at string")
    export_records(rows, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert '"1","a""b","n","PASS","0","","t"' in text


class _Session:
    """Stands in for a cluster session with its own settings."""

    def __init__(self, master, folder=None):
        self.conf = {storage.CHECKPOINT_SETTING: folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app"})()


def test_shared_folder_comes_from_the_session():
    assert storage.shared_folder(_Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert storage.fresh_path(_Session("yarn", "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    with pytest.raises(RuntimeError):
        storage.shared_folder(_Session("yarn"))


def test_settings_form_keeps_letters_beyond_ascii(spark):
    df = spark.createDataFrame([('{"b": {"z": null, "a": "\u00e9"}, "a": 1}',), (None,)], "t string")
    got = [tuple(r) for r in df.select(canonical_settings_json("t"), canonical_json("t")).collect()]
    assert got == [('{"a":1,"b":{"a":"\u00e9","z":null}}', '{"a":1,"b":{"a":"\\u00e9","z":null}}'), (None, None)]


def test_matching_goes_on_after_the_best_pairs(spark):
    golden = spark.createDataFrame([(1, "r", 1, 0.0, 0.0, 0.0), (1, "r", 2, 3.0, 0.0, 0.0)], "board_type int, kind string, ref int, x double, y double, angle double")
    seen = spark.createDataFrame(
        [(7, 1, "r", 10, 1.4, 0.0, 0.0), (7, 1, "r", 11, -2.0, 0.0, 0.0), (7, 1, "r", 12, 1.7, 0.0, 0.0), (8, 1, "r", 13, 1.0, 0.0, 0.0), (8, 1, "r", 14, 0.5, 0.0, 0.0)],
        "board_id int, board_type int, kind string, det_id long, x double, y double, angle double",
    )
    got = {(r["board_id"], r["ref"], r["det_id"]) for r in comp.match_components(seen, golden, 5.0).collect()}
    # Detection 13 comes second at its nearest reference and takes the other one.
    assert got == {(7, 1, 10), (7, 2, 12), (8, 1, 14), (8, 2, 13)}
    none = comp.match_components(seen.where("false"), golden, 5.0)
    assert none.count() == 0


def test_listed_boards_without_detections_miss_everything(spark):
    golden = spark.createDataFrame([(1, "r", 1, 0.0, 0.0, 0.0)], "board_type int, kind string, ref int, x double, y double, angle double")
    seen = spark.createDataFrame([(7, 1, "r", 10, 1.0, 0.0, 0.0)], "board_id int, board_type int, kind string, det_id long, x double, y double, angle double")
    boards = spark.createDataFrame([(7, 1), (8, 1)], "board_id int, board_type int")
    got = {(r["board_id"], r["state"]) for r in comp.component_report(seen, golden, 5.0, boards).collect()}
    assert got == {(7, "matched"), (8, "missing")}
    counts = {(r["board_id"], r["deviation"]) for r in comp.count_deviation(seen, golden, boards).collect()}
    assert counts == {(7, 0), (8, 1)}


def _pieces(spark, golden, seen):
    columns = "board_type int, ref int, kind string, x double, y double, angle double, size double"
    g = spark.createDataFrame([(1, *r, 0.0, 1.0) for r in golden], columns)
    o = spark.createDataFrame([(b, 1, d, k, x, y, 0.0, 1.0) for b, d, k, x, y in seen],
                              "board_id int, board_type int, det_id long, kind string, x double, y double, angle double, size double")
    return g, o


def test_assignment_has_the_least_total_cost(spark):
    rng = random.Random(11)
    golden = [(r, rng.choice("ab"), rng.uniform(0, 10), rng.uniform(0, 10)) for r in range(1, 6)]
    seen = [(b, d, rng.choice("ab"), rng.uniform(0, 10), rng.uniform(0, 10)) for b in range(60) for d in range(rng.randrange(0, 7))]
    cost = comp.MatchCost(tolerance=6.0, kind=1.5, unmatched=5.0)
    g, o = _pieces(spark, golden, seen)
    got = {}
    for r in comp.match_components(o, g, cost).collect():
        got.setdefault(r["board_id"], {})[r["ref"]] = r["det_id"]
    for b in range(60):
        dets = [(d, k, x, y) for bb, d, k, x, y in seen if bb == b]

        def total(pairs):
            out = 0.0
            for (r, gk, gx, gy), pick in zip(golden, pairs):
                if pick is not None:
                    d, k, x, y = pick
                    dist = math.hypot(x - gx, y - gy)
                    if dist > 6.0:
                        return math.inf
                    out += dist + 1.5 * (k != gk) - 5.0
            return out

        options = itertools.permutations([*dets, *[None] * 5], 5)
        best = min(total(p) for p in set(options))
        mine = got.get(b, {})
        pairs = [next((d for d in dets if d[0] == mine.get(r)), None) for r, *_ in golden]
        assert len(set(mine.values())) == len(mine)
        assert total(pairs) == pytest.approx(best, abs=1e-5)


def test_far_exchanges_are_found():
    # Every reference wants the detection of the next one; only the last has another choice.
    refs, dets, costs = [], [], []
    for r in range(50):
        refs += [r, r]
        dets += [r, r + 1]
        costs += [10 if r else 1000, 1]
    pairs = comp.least_assignment(refs, dets, costs, 10_000)
    assert pairs == [(r, r + 1) for r in range(50)]
    refs, dets, costs = [*refs, 50], [*dets, 50], [*costs, 1]
    assert sum(c for r, d, c in zip(refs, dets, costs) if (r, d) in comp.least_assignment(refs, dets, costs, 10_000)) == 1000 + 49 * 10 + 1
    assert comp.least_assignment([1, 1, 2], ["a", "b", "a"], [1, 2, 2], 2) == [(1, "a")]


def test_a_wrong_object_is_named(spark):
    g, o = _pieces(spark, [(1, "r", 0.0, 0.0), (2, "c", 9.0, 0.0)], [(7, 10, "c", 0.5, 0.0), (7, 11, "r", 30.0, 0.0)])
    boards = spark.createDataFrame([(7, 1), (8, 1)], "board_id int, board_type int")
    got = {(r["board_id"], r["ref"], r["state"], r["seen_kind"]) for r in comp.component_report(o, g, comp.MatchCost(4.0, kind=1.0), boards).collect()}
    assert got == {(7, 1, "wrong", "c"), (7, 2, "missing", None), (7, -1, "extra", "r"), (8, 1, "missing", None), (8, 2, "missing", None)}


def test_candidates_of_a_component_are_bounded(spark):
    g, o = _pieces(spark, [(1, "r", 0.0, 0.0), (2, "r", 1.0, 0.0)], [(7, d, "r", d / 1000, 0.0) for d in range(500)])
    assert comp.pair_costs(o, g, comp.MatchCost(5.0)).count() == 4
    assert {(r["ref"], r["det_id"]) for r in comp.match_components(o, g, 5.0).collect()} == {(1, 0), (2, 499)}


def test_a_misplaced_component_breaks_its_edges(spark):
    rng = random.Random(3)
    golden = [(r, "r", 10.0 * (r % 3), 10.0 * (r // 3)) for r in range(9)]
    seen = []
    for b in range(60):
        for r, k, x, y in golden:
            off = 4.0 if (b, r) == (59, 4) else 0.0
            seen.append((b, r, k, x + rng.gauss(0, 0.2) + off, y + rng.gauss(0, 0.2)))
    g, o = _pieces(spark, golden, seen)
    edges = comp.relation_graph(g, 12.0, 4)
    assert {(r["ref"], r["other"]) for r in edges.collect()} == {(r, r + d) for r in range(9) for d in (1, 3) if r + d < 9 and (d == 3 or r % 3 < 2)}
    f = comp.edge_features(comp.match_components(o, g, 5.0), edges)
    model = comp.fit_relations(f.where("board_id < 50"))
    assert model.agg(F.min("samples")).first()[0] == 50
    suspects = comp.relation_suspects(comp.relation_scores(f.where("board_id >= 50"), model), 6.0)
    assert [(r["board_id"], r["ref"]) for r in suspects.where("suspect").collect()] == [(59, 4)]
    assert comp.relation_scores(f, comp.fit_relations(f.where("board_id < 20"))).count() == 0
    spots = comp.fit_positions(comp.match_components(o, g, 5.0).where("board_id < 50"), 0.01)
    far = comp.position_deviation(comp.match_components(o, g, 5.0), spots).where("deviation > 8").select("board_id", "ref").collect()
    assert [tuple(r) for r in far] == [(59, 4)]


def test_the_report_reads_matches_it_is_given_and_finds_them_once_itself(spark, monkeypatch):
    g = spark.createDataFrame([(0, 1, "R", 0.0, 0.0, 0.0), (0, 2, "R", 3.0, 0.0, 0.0), (0, 3, "R", 40.0, 0.0, 0.0)], "board_type int, ref int, kind string, x double, y double, angle double")
    # On board 1 both want detection 1, on board 2 nobody is in another's way.
    o = spark.createDataFrame(
        [(1, 0, 1, "R", 1.0, 0.0, 0.0), (1, 0, 2, "R", 6.0, 0.0, 0.0), (2, 0, 1, "R", 0.5, 0.0, 0.0), (2, 0, 2, "R", 3.5, 0.0, 0.0), (2, 0, 3, "R", 40.0, 1.0, 0.0)],
        "board_id int, board_type int, det_id int, kind string, x double, y double, angle double")
    asked = []
    choose = comp.match_components
    monkeypatch.setattr(comp, "match_components", lambda *a: asked.append(1) or choose(*a))
    cost = comp.MatchCost(5.0, unmatched=20.0)
    alone = comp.component_report(o, g, cost)
    rows = sorted((r["board_id"], r["ref"], r["det_id"], r["state"]) for r in alone.collect())
    assert rows == [(1, 1, 1, "matched"), (1, 2, 2, "matched"), (1, 3, -1, "missing"), (2, 1, 1, "matched"), (2, 2, 2, "matched"), (2, 3, 3, "matched")]
    assert "ArrowEvalPython" not in alone._jdf.queryExecution().executedPlan().toString() and len(asked) == 1
    given = comp.component_report(o, g, cost, None, choose(o, g, cost))
    assert sorted(map(tuple, given.collect())) == sorted(map(tuple, alone.collect())) and len(asked) == 1
