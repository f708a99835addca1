import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boardlake.operators import vectors as op


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)).round(3)
    x[100:140] = x[0]  # a third of the cloud in copies, so ties and a crowded cell occur
    labels = rng.integers(0, 3, 300)
    pdf = pd.DataFrame({"id": range(300), "label": labels, "f": list(x)})
    return x, labels, spark.createDataFrame(pdf, "id bigint, label int, f array<double>").cache()


def brute(x, metric, k):
    out = {}
    for i, q in enumerate(x):
        if metric == "manhattan":
            d = np.abs(x - q).sum(axis=1)
        elif metric == "cosine":
            d = 1 - (x @ q) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))
        else:
            d = ((x - q) ** 2).sum(axis=1)
            d = d if metric == "squared" else np.sqrt(d)
        order = [j for j in np.lexsort((np.arange(len(x)), d.round(12))) if j != i][:k]
        out[i] = [round(float(d[j]), 9) for j in order]
    return out


@pytest.mark.parametrize("metric", op.METRICS)
@pytest.mark.parametrize("small", [1 << 30, 0])
def test_nearest_matches_brute_force(cloud, metric, small):
    x, _, df = cloud
    got = op.nearest(
        df, df, "id", "id", "f", 4, metric=metric, exclude_self=True, small_side_bytes=small, pivots=7, block_rows=60
    ).toPandas()
    want = brute(x, metric, 4)
    assert len(got) == 300 * 4
    assert not (got["id"] == got["neighbour_id"]).any()
    for i, group in got.sort_values(["id", "rank"]).groupby("id"):
        assert np.allclose(group["distance"].to_numpy(), want[i], atol=1e-8)


def test_both_paths_agree_on_ties(cloud):
    _, _, df = cloud
    a = op.nearest(df, df, "id", "id", "f", 5, order="label").toPandas().sort_values(["id", "rank"], ignore_index=True)
    b = op.nearest(df, df, "id", "id", "f", 5, order="label", small_side_bytes=0, pivots=5, block_rows=50).toPandas()
    b = b.sort_values(["id", "rank"], ignore_index=True)
    pd.testing.assert_frame_equal(a, b)


def test_neighbour_count_is_checked(cloud):
    _, _, df = cloud
    with pytest.raises(ValueError):
        op.nearest(df, df, "id", "id", "f", 301)
    with pytest.raises(ValueError):
        op.nearest(df, df, "id", "id", "f", 1, metric="hamming")


def test_hashing_finds_only_true_pairs(cloud):
    _, _, df = cloud
    pairs = op.nearest_by_hashing(df, df, "f", 0.5, 1.0).select("datasetA.id", "distance").toPandas()
    assert len(pairs) >= 300 and (pairs["distance"] <= 0.5).all()


def test_weighted_vote_prefers_exact_sample(spark):
    s = spark.createDataFrame([(0, "dark", [0.0]), (1, "bright", [1.0]), (2, "bright", [0.9])], "id bigint, label string, f array<double>")
    q = spark.createDataFrame([(9, [0.0])], "id bigint, f array<double>")
    found = op.nearest(q, s, "id", "id", "f", 3)
    assert op.object_vote(found, "id", weighted=True).first()["predicted"] == "dark"
    assert op.object_vote(found, "id").first()["predicted"] == "bright"
    assert op.tabular_vote(found, "id").first()["predicted"] == "bright"


def separated(spark, n=120):
    rng = np.random.default_rng(1)
    y = np.arange(n) % 2
    x = rng.normal(size=(n, 3)) * 0.3 + y[:, None] * 3
    return x, y, spark.createDataFrame(pd.DataFrame({"id": range(n), "label": y, "f": list(x)}), "id bigint, label int, f array<double>")


def test_library_classifiers_separate_clear_classes(spark):
    _, y, df = separated(spark)
    for predicted in (
        op.logistic_classifier(df, df, "id", "f", "label"), op.linear_svm(df, df, "id", "f", "label"),
        op.gaussian_naive_bayes(df, df, "id", "f").withColumn("predicted", F.col("predicted").cast("int")),
        op.nearest_centroid(df, df, "id", "f").withColumn("predicted", F.col("predicted").cast("int")),
    ):
        got = predicted.orderBy("id").toPandas()["predicted"].to_numpy()
        assert (got == y).mean() > 0.98


def test_kmeans_orders_clusters_by_brightness(spark):
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0.1, 0.11, 0.5, 0.52, 0.9, 0.91])], "id bigint, f array<double>")
    got = {r["id"]: (r["cluster"], r["mask"]) for r in op.kmeans_clusters(df, ["id"], "f", 3, [2]).collect()}
    assert [got[i][0] for i in range(6)] == [0, 0, 1, 1, 2, 2]
    assert [got[i][1] for i in range(6)] == [0, 0, 0, 0, 255, 255]


def test_pca_error_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 5)) @ np.diag([3, 2, 1, 0.3, 0.1])
    df = spark.createDataFrame(pd.DataFrame({"id": range(80), "f": list(x)}), "id bigint, f array<double>")
    got = op.pca_anomaly(df, df, "id", "f", 2).orderBy("id").toPandas()
    c = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    err = ((c - c @ vt[:2].T @ vt[:2]) ** 2).mean(axis=1)
    assert np.allclose(got["error"], err, atol=1e-9)
    assert np.allclose(got["anomaly"], np.clip(err / np.percentile(err, 95), 0, 1), atol=1e-9)


def test_coreset_is_greedy_k_center(cloud):
    x, _, df = cloud
    got = op.coreset(df, "id", "f", 5).orderBy("step").toPandas()["id"].tolist()
    want, far = [0], np.full(len(x), np.inf)
    for _ in range(4):
        far = np.minimum(far, np.sqrt(((x - x[want[-1]]) ** 2).sum(axis=1)))
        want.append(int(np.argmax(far)))
    assert got == want


def test_failed_items_policy(spark):
    df = spark.range(4)
    good, failed = op.split_failed_items(df, {"odd": F.col("id") % 2 == 1})
    assert good.count() == 2 and failed.count() == 2
    with pytest.raises(ValueError):
        op.split_failed_items(df, {"odd": F.col("id") % 2 == 1}, policy="fail")


@pytest.mark.parametrize("metric", op.METRICS)
@pytest.mark.parametrize("width", [1, 2, 20])
def test_leaves_give_the_neighbours_of_a_full_scan_ties_included(metric, width):
    rng = np.random.default_rng(width)
    x = rng.integers(1, 9, size=(1500, width)).astype(float)
    x[700:900] = x[0]
    q = np.concatenate([x[:60], rng.normal(size=(60, width)) * 20])
    row, near, d = op._leaves_nearest(metric, op._sample_leaves(metric, x, 5), q, 5)
    for i in range(len(q)):
        full = op._paired(metric, np.repeat(q[i:i + 1], len(x), axis=0), x)
        assert near[row == i].tolist() == np.lexsort((np.arange(len(x)), full))[:5].tolist()


def test_few_dimensions_visit_few_samples(monkeypatch):
    seen = []
    make = op._rough_distances

    def counted(metric, index, q):
        rough, own, error = make(metric, index, q)
        return lambda cols: (seen.append(len(q) * len(cols)), rough(cols))[1], own, error

    monkeypatch.setattr(op, "_rough_distances", counted)
    x = np.random.default_rng(0).normal(size=(50_000, 2))
    op._leaves_nearest("euclidean", op._sample_leaves("euclidean", x, 3), x[:5000], 3)
    assert sum(seen) < 0.1 * 5000 * 50_000


def test_blocks_grow_with_the_rows_up_to_a_size():
    assert op._rows_per_block(1000, 64, 400) == 400
    assert op._rows_per_block(720_000, 64, 400) == 45_000
    assert op._rows_per_block(10**9, 64, 400) == op.SMALL_SIDE_BYTES // (64 * 8 + 64)


@pytest.mark.parametrize("metric", op.METRICS)
@pytest.mark.parametrize("width", [2, 20])
def test_vectors_that_are_no_numbers_take_no_part(metric, width):
    x = np.random.default_rng(3).normal(size=(400, width))
    y = x.copy()
    y[::7, 0] = np.nan
    row, near, _ = op._leaves_nearest(metric, op._sample_leaves(metric, y, 3), y, 3)
    good = np.flatnonzero(np.arange(400) % 7 != 0)
    assert set(row) == set(good) == set(near[np.append(True, np.diff(row) != 0)]) and np.bincount(row)[good].tolist() == [3] * len(good)
    nothing = op._sample_leaves(metric, y[::7], 3)
    assert len(op._leaves_nearest(metric, nothing, x, 3)[0]) == 0


def test_vectors_move_in_single_precision_only_where_that_is_the_same_number():
    v = np.array([[0.5, -2.0, 3.0], [0.1, 0.5, 1.0], [np.float32(0.1), 1.0, 0.0], [1e300, 1.0, 0.0], [-0.0, 1e-50, 1.0]])
    stored = op._stored(v)
    assert [len(x) for x in stored] == [12, 24, 12, 24, 24]
    back = op._restored(pd.Series(stored, dtype=object), 3)
    assert (back == v).all() and (np.signbit(back) == np.signbit(v)).all()
    assert op._restored(pd.Series([], dtype=object), 3).shape == (0, 3)


def test_blocks_on_a_side_do_not_grow_with_the_rows():
    for rows in (120_000, 720_000):
        assert -(-rows // op._rows_per_block(rows, 64, op.BLOCK_ROWS, 6)) <= 7


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_rows_without_numbers_hide_no_neighbours_in_cells(spark, bad):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2)).round(3)
    x[::40, 0] = bad
    df = spark.createDataFrame(pd.DataFrame({"id": range(400), "f": list(x)}), "id bigint, f array<double>").cache()
    one = op.nearest(df, df, "id", "id", "f", 5, exclude_self=True)
    two = op.nearest(df, df, "id", "id", "f", 5, exclude_self=True, small_side_bytes=0, pivots=16, block_rows=30)
    a, b = (d.toPandas().sort_values(["id", "rank"], ignore_index=True) for d in (one, two))
    pd.testing.assert_frame_equal(a, b)


def test_rows_that_ask_and_are_asked_move_once_per_meeting(spark, monkeypatch):
    sent = []
    make = op._to_meetings
    monkeypatch.setattr(op, "_to_meetings", lambda home: sent.append(make(home)) or sent[-1])
    x = np.random.default_rng(7).normal(size=(1200, 20))
    df = spark.createDataFrame(pd.DataFrame({"id": range(1200), "f": list(x)}), "id bigint, f array<double>").cache()
    got = op.nearest(df, df, "id", "id", "f", 4, exclude_self=True, small_side_bytes=0, pivots=64, block_rows=240)
    want = brute(x, "euclidean", 4)
    for i, group in got.toPandas().sort_values(["id", "rank"]).groupby("id"):
        assert np.allclose(group["distance"].to_numpy(), want[i], atol=1e-8)
    moved = sent[0].toPandas()
    # Five blocks at most, and in 20 dimensions no bound skips one: a row goes to the meetings with the other four.
    assert moved["block"].nunique() <= 5 and len(moved) <= 4 * 1200
    assert not moved.duplicated(["_sid", "meeting"]).any()


@pytest.mark.parametrize("metric", op.METRICS)
def test_queries_and_samples_of_two_tables_keep_their_ids(spark, metric):
    rng = np.random.default_rng(9)
    s, q = rng.normal(size=(500, 3)), rng.normal(size=(90, 3)) * 2
    s[50:250] = s[0]
    big = 2**60 + 1
    samples = spark.createDataFrame(pd.DataFrame({"sid": big + np.arange(500), "f": list(s)}), "sid bigint, f array<double>").cache()
    queries = spark.createDataFrame(pd.DataFrame({"qid": [f"q{i}" for i in range(90)], "f": list(q)}), "qid string, f array<double>").cache()
    one = op.nearest(queries, samples, "qid", "sid", "f", 3, metric=metric)
    two = op.nearest(queries, samples, "qid", "sid", "f", 3, metric=metric, small_side_bytes=0, pivots=9, block_rows=40)
    assert one.dtypes == two.dtypes
    a, b = (d.toPandas().sort_values(["qid", "rank"], ignore_index=True) for d in (one, two))
    assert len(a) == 270 and a["neighbour_id"].min() >= big
    pd.testing.assert_frame_equal(a, b)


def test_small_cells_share_a_block_and_large_ones_are_cut():
    group_of, counts = op._shared_blocks({c: 10 for c in range(64)}, 128)
    assert counts == [1] * 5 and list(group_of) == sorted(group_of) and sorted(set(group_of.values())) == [0, 1, 2, 3, 4]
    group_of, counts = op._shared_blocks({0: 30, 1: 500, 2: 40, 3: 90}, 100)
    assert group_of[1] not in (group_of[0], group_of[2], group_of[3]) and counts[group_of[1]] == 5
    assert op._blocks_for(12) == 5 and op._blocks_for(1) == 4 and op._blocks_for(10_000) == op.MAX_BLOCKS
