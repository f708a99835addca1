from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardlake.operators import golden as gold
from boardlake.operators import images as im
from boardlake.operators import scores as sc


def scanlines(spark, images, grp=0):
    rows = [
        (i, grp if np.isscalar(grp) else grp[i], 0, y, image.shape[1], [float(v) for v in image[y]])
        for i, image in enumerate(images) for y in range(image.shape[0])
    ]
    return spark.createDataFrame(rows, "image_id bigint, grp int, ch int, y int, width int, row array<double>")


def as_array(df, image_id=0, column="row"):
    lines = df.where(F.col("image_id") == image_id).orderBy("y").select(column).collect()
    return np.array([r[0] for r in lines])


def golden_of(spark, image):
    return scanlines(spark, [image]).select("grp", "ch", "y", F.col("row").alias("other_row"))


RAMP = np.tile(np.arange(32) / 255.0, (32, 1))


def test_equal_images_score_zero(spark):
    lines, golden = scanlines(spark, [RAMP]), golden_of(spark, RAMP)
    maps = [
        gold.absolute_difference(lines, golden), gold.structural_similarity(lines, golden, 11),
        gold.cross_correlation(lines, golden, 32), gold.gradient_difference(lines, golden), gold.edge_difference(lines, golden, 0.1),
    ]
    for m in maps:
        assert gold.image_scores(m).first()["score"] == pytest.approx(0.0, abs=1e-9)


def test_defect_is_localised(spark):
    reference = np.zeros((48, 48))
    reference[8:40, 8:40] = 80 / 255
    seen = reference.copy()
    seen[20:28, 20:28] = 1.0
    lines, golden = scanlines(spark, [seen]), golden_of(spark, reference)
    for m in (gold.absolute_difference(lines, golden), gold.structural_similarity(lines, golden, 11), gold.gradient_difference(lines, golden)):
        a = as_array(m, column="map")
        assert a[18:30, 18:30].mean() > a[:8, :8].mean() + 0.05


def test_median_mad_map(spark):
    ok = [np.full((24, 24), 0.25 + d) for d in (-0.02, 0.0, 0.02, -0.02, 0.02)]
    bad = np.full((24, 24), 0.25)
    bad[4:8, 4:8] = 0.9
    model = gold.fit_median_mad(scanlines(spark, ok))
    assert model.first()["median"] == pytest.approx(0.25) and model.first()["mad"] == pytest.approx(0.02)
    cells = gold.robust_map(scanlines(spark, [bad]), model)
    cells = as_array(cells, column="map")
    assert cells[4:8, 4:8].mean() > 0.9 and cells[12:, 12:].max() == pytest.approx(0.0)


def test_colour_mahalanobis_matches_numpy(spark):
    rng = np.random.default_rng(4)
    images = rng.random((12, 3, 4, 5))
    rows = [(i, 0, c, y, 5, images[i, c, y].tolist()) for i in range(12) for c in range(3) for y in range(4)]
    lines = spark.createDataFrame(rows, "image_id bigint, grp int, ch int, y int, width int, row array<double>")
    got = gold.colour_mahalanobis_map(lines, gold.fit_colour_gaussian(lines))
    got = np.stack([as_array(got, i, "map") for i in range(12)])
    for y in range(4):
        for x in range(5):
            v = images[:, :, y, x]
            cov = np.cov(v.T, bias=True) + 0.001 * np.eye(3)
            d = v - v.mean(axis=0)
            want = 1 - np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d))
            assert np.allclose([got[i, y, x] for i in range(12)], want, atol=1e-9)


@pytest.mark.parametrize("method", ["sqdiff", "sqdiff-normed", "ccorr-normed", "ccoeff-normed"])
def test_template_is_found(spark, method):
    rng = np.random.default_rng(6)
    patch = rng.random((10, 12))
    image = np.full((64, 64), 0.1)
    image[31:41, 22:34] = patch
    templates = spark.createDataFrame([(0, patch.tolist())], "grp int, template array<array<double>>")
    r = gold.template_matches(scanlines(spark, [image]), templates, 10, method).first()
    assert (r["x"], r["y"], r["width"], r["height"]) == (22, 31, 12, 10) and r["quality"] == pytest.approx(1.0, abs=1e-6)


def test_mask_xor_and_fusion(spark):
    a, b = np.zeros((10, 10)), np.zeros((10, 10))
    a[0] = 255
    m = gold.mask_xor(scanlines(spark, [a]), golden_of(spark, b))
    assert gold.image_scores(m).first()["score"] == pytest.approx(0.1)
    s = spark.createDataFrame([(1, 0.1), (1, 0.7), (1, 0.2)], "item int, score double")
    f = sc.fuse(s, "item", "score").first()
    assert f["maximum"] == 0.7 and f["mean"] == pytest.approx(1 / 3) and f["is_bounded"]
    assert not sc.fuse(s.union(spark.createDataFrame([(1, 1.5)], "item int, score double")), "item", "score").first()["is_bounded"]


def flood(mask):
    label, out = 0, np.zeros(mask.shape, int)
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        label += 1
        out[start], todo = label, deque([start])
        while todo:
            y, x = todo.popleft()
            for yy in range(max(0, y - 1), min(mask.shape[0], y + 2)):
                for xx in range(max(0, x - 1), min(mask.shape[1], x + 2)):
                    if mask[yy, xx] and not out[yy, xx]:
                        out[yy, xx] = label
                        todo.append((yy, xx))
    return out


def snake(n):
    """One winding component with a long way from end to end."""
    m = np.zeros((n, n))
    m[::2] = 255
    for i, y in enumerate(range(1, n, 2)):
        m[y, -1 if i % 2 == 0 else 0] = 255
    return m


def test_components_of_long_and_random_shapes(spark):
    rng = np.random.default_rng(8)
    masks = [snake(41), (rng.random((41, 41)) < 0.35) * 255.0, np.zeros((41, 41)), np.full((41, 41), 255.0)]
    got = im.component_shapes(im.connected_components(scanlines(spark, masks))).toPandas()
    for i, m in enumerate(masks):
        want = flood(m)
        areas = sorted(np.bincount(want.ravel())[1:].tolist())
        assert sorted(got[got["image_id"] == i]["area"].tolist()) == areas


def test_borders(spark):
    line = scanlines(spark, [np.arange(12.0).reshape(3, 4)])
    assert np.allclose(as_array(im.box_blur(line, 3))[0, 0], np.mean([5, 4, 5, 1, 0, 1, 5, 4, 5]))
    assert as_array(im.median_blur(line, 3))[0, 0] == 1.0
    assert as_array(im.erode(line))[0].tolist() == [0, 0, 1, 2] and as_array(im.dilate(line))[2].tolist() == [9, 10, 11, 11]
    assert as_array(im.pad(line, 0, 0, 2, 2, "reflect"))[0].tolist() == [1, 0, 0, 1, 2, 3, 3, 2]
    assert as_array(im.pad(line, 1, 0, 0, 1, "wrap"))[0].tolist() == [8, 9, 10, 11, 8]
    with pytest.raises(ValueError):
        im.gaussian_blur(line, 4, 1.0)


def test_constant_image_edge_cases(spark):
    line = scanlines(spark, [np.full((4, 4), 7.0)])
    assert (as_array(im.equalize(line)) == 7.0).all()
    assert (as_array(im.normalize(line, 0, 255)) == 0.0).all()
    assert (as_array(im.otsu(line)) == 0.0).all()


def test_hsv_of_primary_colours(spark):
    rows = [(0, c, 0, 3, row) for c, row in enumerate([[255.0, 0.0, 0.0], [0.0, 255.0, 0.0], [0.0, 0.0, 255.0]])]
    lines = spark.createDataFrame(rows, "image_id bigint, ch int, y int, width int, row array<double>")
    got = {r["ch"]: r["row"] for r in im.to_hsv(lines).collect()}
    assert got[0] == [120.0, 60.0, 0.0] and got[1] == [255.0] * 3 and got[2] == [255.0] * 3


def test_shape_mismatch_is_reported(spark):
    a, b = scanlines(spark, [np.zeros((3, 3)), np.zeros((4, 3)), np.zeros((3, 2))]), golden_of(spark, np.zeros((3, 3)))
    assert sorted(r[0] for r in im.shape_mismatches(a, b, ["grp", "ch"]).collect()) == [1, 2]


def big(seed, shape=(333, 70)):
    return np.random.default_rng(seed).integers(0, 256, shape).astype(float)


@pytest.mark.parametrize("rows", [7, 64])
@pytest.mark.parametrize("size", [3, 11])
def test_strips_give_what_the_whole_image_gives(spark, monkeypatch, rows, size):
    """Many strips, fewer rows than the neighbourhood in the last one."""
    monkeypatch.setattr(im, "STRIP_ROWS", rows)
    image, r = big(1), size // 2
    lines = scanlines(spark, [image, image[:5], image[:1]]).withColumn("note", F.lit("kept"))
    k = im.gaussian_kernel(size, 2.0)
    for i, part in enumerate([image, image[:5], image[:1]]):
        wide = np.pad(part, r, "reflect" if min(part.shape) > 1 else "reflect")
        want = im.separable(wide, k, k)
        got = im.gaussian_blur(lines, size, 2.0)
        assert got.columns == [c for c in lines.columns if c != "row"] + ["row"]
        assert np.allclose(as_array(got, i), want)
    want = im.extreme(np.pad(image, r, constant_values=-np.inf), size, np.maximum)
    assert np.array_equal(as_array(im._extreme(lines, size, True)), want)
    assert np.array_equal(want, np.max(im.shifted(np.pad(image, r, constant_values=-np.inf), size), axis=0))


def test_a_strip_brings_each_row_once_and_its_halo(spark, monkeypatch):
    monkeypatch.setattr(im, "STRIP_ROWS", 32)
    lines = scanlines(spark, [big(2, (128, 8))])
    gathered = im.strips(lines, 2, 2)
    assert gathered.count() == 4
    assert gathered.agg(F.sum(F.size("_ys"))).first()[0] == 128 + 3 * 4


def test_components_across_many_strips(spark, monkeypatch):
    monkeypatch.setattr(im, "STRIP_ROWS", 4)
    rng = np.random.default_rng(9)
    masks = [snake(61), (rng.random((80, 40)) < 0.4) * 255.0, np.full((40, 3), 255.0)]
    labelled = im.connected_components(scanlines(spark, masks))
    got = im.component_shapes(labelled).toPandas()
    for i, m in enumerate(masks):
        areas = sorted(np.bincount(flood(m).ravel())[1:].tolist())
        assert sorted(got[got["image_id"] == i]["area"].tolist()) == areas
    first = labelled.groupBy("image_id", "component").agg(F.min("node").alias("n")).where("n <> component")
    assert first.count() == 0


def test_templates_across_strips(spark, monkeypatch):
    monkeypatch.setattr(im, "STRIP_ROWS", 8)
    rng = np.random.default_rng(6)
    image, patch = np.full((64, 30), 0.1), rng.random((10, 12))
    image[37:47, 15:27] = patch
    templates = spark.createDataFrame([(0, patch.tolist())], "grp int, template array<array<double>>")
    r = gold.template_matches(scanlines(spark, [image]), templates, 10, "sqdiff").first()
    assert (r["x"], r["y"], r["quality"]) == (15, 37, 1.0)


def test_line_votes_count_every_pixel(spark):
    mask = (np.random.default_rng(5).random((20, 30)) < 0.2) * 255.0
    got = im.line_votes(scanlines(spark, [mask, mask]), 1).toPandas()
    assert got[got["image_id"] == 1].groupby("theta")["votes"].sum().eq(int((mask > 0).sum())).all()
    straight = np.zeros((20, 30))
    straight[7] = 255
    best = im.line_votes(scanlines(spark, [straight]), 25).toPandas()
    assert (90, 7, 30) in set(best[["theta", "rho", "votes"]].itertuples(index=False, name=None))
