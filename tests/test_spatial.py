import numpy as np
import pytest
from pyspark.sql import functions as F

from scanforge.operators import decode, geom, histogram, image, profile, refine, sample, spatial


@pytest.fixture(scope="module")
def cloud(spark):
    xyz = np.random.default_rng(1).normal(size=(300, 3)) * 0.2
    return xyz, spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, X double, Y double, Z double")


def distances(xyz):
    return np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))


def test_radius_pairs_against_brute_force(cloud):
    xyz, df = cloud
    got = {(r.point_id, r.nbr_id) for r in spatial.radius_pairs(df, df, 0.1).collect()}
    assert got == set(zip(*map(list, np.nonzero(distances(xyz) <= 0.1)), strict=True))


@pytest.mark.parametrize("k", [1, 7, 299, 400])
def test_knn_against_brute_force(cloud, k):
    xyz, df = cloud
    d = distances(xyz)
    want = {(i, r + 1, j) for i in range(20) for r, j in enumerate(np.lexsort((np.arange(300), d[i]))[:k])}
    got = {(r.point_id, r["rank"], r.nbr_id) for r in spatial.knn(df.where("point_id < 20"), df, k, 0.05).collect()}
    assert got == want


def test_knn_of_nothing(spark, cloud):
    assert spatial.knn(cloud[1].limit(0), cloud[1], 3, 0.1).count() == 0


def test_few_points_use_the_base_radius(cloud):
    few = cloud[1].limit(20)
    out = spatial.adaptive_neighbours(few, 0.05)
    assert out.agg(F.max("dist")).first()[0] <= 0.05


def test_plane_and_line(spark):
    rng = np.random.default_rng(0)
    disc = [(i, float(np.sqrt(r) * np.cos(a)), float(np.sqrt(r) * np.sin(a)), 1.0) for i, (r, a) in enumerate(zip(rng.random(400) * 0.01, rng.random(400) * 7, strict=True))]
    df = spark.createDataFrame(disc, "point_id long, X double, Y double, Z double")
    f = geom.geometric_features(df, 0.2, 0.2, 400).agg(F.max("curvature"), F.min("nz"), F.max("nz")).first()
    assert f[0] < 1e-9 and f[1] < -0.999999 and f[2] < -0.999999  # towards the origin, under the plane
    line = spark.createDataFrame([(i, i * 0.001, 0.0, 0.0) for i in range(100)], "point_id long, X double, Y double, Z double")
    assert geom.geometric_features(line).agg(F.min("anisotropy")).first()[0] > 0.999999


def test_eigenvalues_against_numpy(cloud):
    xyz, df = cloud
    rows = geom.eigen_features(geom.covariances(spatial.adaptive_neighbours(df, 0.1))).where("n_nbrs > 3").collect()
    edges = {}
    for r in spatial.adaptive_neighbours(df, 0.1).collect():
        edges.setdefault(r.point_id, []).append(r.nbr_id)
    for r in rows:
        assert np.allclose(np.linalg.eigvalsh(np.cov(xyz[edges[r.point_id]].T)), (r.l1, r.l2, r.l3), atol=1e-12)


def test_circles_voxels_and_rotation(spark, cloud):
    xyz, df = cloud
    c = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.1, 0.0)], "centre_id int, cx double, cy double")
    got = {(r.centre_id, r.n) for r in spatial.in_circles(df, c, 0.15).groupBy("centre_id").agg(F.count("*").alias("n")).collect()}
    assert got == {(k, int((np.hypot(xyz[:, 0] - x, xyz[:, 1]) <= 0.15).sum())) for k, x in ((1, 0.0), (2, 0.1))}
    kept = spatial.voxel_sample(df, 0.2).count()
    assert 0 < kept <= spatial.voxel_means(df, 0.2).count()
    assert spatial.voxel_means(df, 0.2, "minimum").agg(F.sum("n")).first()[0] == 300
    (a, b), (c_, d) = geom.plot_rotation(df)
    assert abs(a * d - b * c_ - 1) < 1e-9


def test_density_bins_skip_small_ones(spark):
    rows = [(f"{n}", i, float(i) * 0.01, 0.0, 0.0) for n in (9, 10, 11) for i in range(n)]
    df = spark.createDataFrame(rows, "bin string, point_id long, X double, Y double, Z double")
    out = profile.binned_density(df, ("bin",), 0.05, F.least(F.lit(50), F.floor(F.col("n") / 2)))
    assert {r.bin for r in out.collect()} == {"10", "11"}
    same = df.withColumn("X", F.lit(0.0))
    assert profile.binned_density(same, ("bin",), 0.05, F.floor(F.col("n") / 2)).where("density is not null").count() == 0
    with pytest.raises(ValueError):
        profile.range_bins(df.withColumn("range", F.col("X")), 0.3, 1.0)


def test_roughness_of_nan_only_label(spark):
    df = spark.createDataFrame([("a", 1, float("nan")), ("a", 2, 1.0)], "scan_id string, class_id int, v double")
    out = {(r.scan_id, r.class_id): (r.median, r.valid, r.nan_count) for r in profile.value_by_label(df, "v", "class_id", "scan_id").collect()}
    assert out[(None, 1)] == (None, 0, 1) and out[("a", 2)] == (1.0, 1, 0)


def test_histogram_last_bin_is_closed_and_constant_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(21)], "v double")
    assert [r.n for r in histogram.histogram(df, "v", 20).orderBy("bin").collect()] == [1] * 19 + [2]
    assert histogram.histogram(df.withColumn("v", F.lit(3.0)), "v", 4).orderBy("bin").first().n == 21


def test_votes(spark):
    rows = [(0, 0.0, 0), (1, 0.1, 2), (2, 0.2, 2), (3, 5.0, 0), (4, 5.1, 0), (5, 5.2, 0)]
    df = spark.createDataFrame([(i, x, 0.0, 0.0, k) for i, x, k in rows], "point_id long, X double, Y double, Z double, class_id int")
    out = {r.point_id: r.vote for r in refine.vote(df, 3, 2 / 3, 0.15).collect()}
    assert out == {0: 2, 1: 2, 2: 2, 3: 0, 4: 0, 5: 0}  # an own share at the threshold stays


def test_merge_rules(spark):
    df = spark.createDataFrame([(0, 5, 3, 0.1), (1, 2, 3, 0.9), (1, 2, 3, 0.85), (3, 2, 3, 0.9)], "label int, vote int, rf_label int, rf_confidence double")
    assert [r.label_refined for r in refine.merge(df).collect()] == [3, 3, 2, 2]


def test_encoder_wrap_and_tail(spark):
    values = [16380, 4, 10, 20, 30, 25, 40, 35, 50]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "scan_id string, line long, encoder long")
    got = [r.increment for r in decode.encoder_steps(df).orderBy("line").collect()]
    assert got == [0, 7, 6, 10, 10, 10, 15, 15, 15]


def test_samples(spark):
    df = spark.createDataFrame([(i, 0 if i < 5 else 1) for i in range(200)], "id long, class_id int")
    out = sample.stratified_sample(df, "class_id", 50, ["id"], 0.05)
    counts = {r.class_id: r.n for r in histogram.class_counts(out, "class_id").collect()}
    assert counts == {0: 5, 1: 45}  # the rare class is smaller than its quota
    again = sample.exact_sample(df.repartition(3), 20, ["id"])
    assert {r.id for r in again.collect()} == {r.id for r in sample.exact_sample(df, 20, ["id"]).collect()} and again.count() == 20
    drawn = sample.weighted_resample(df.withColumn("w", F.col("id") * 1.0), "w", "id", 500, "id")
    assert drawn.count() == 500


def test_components(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 2)) @ np.array([[3, 1, 0], [0, 1, 2]]) + rng.normal(size=(400, 3)) * 0.01
    df = spark.createDataFrame([(i // 20, i % 20, *map(float, v)) for i, v in enumerate(base)], "y_pix int, x_pix int, a double, b double, c double")
    out = image.pca(df, ["a", "b", "c"]).agg(F.var_samp("PCA1"), F.var_samp("PCA2"), F.var_samp("PCA3"), F.corr("PCA1", "PCA2")).first()
    assert out[0] > out[1] > out[2] and abs(out[3]) < 1e-9
    assert image.mnf(df, ["a", "b", "c"]).select("MNF1", "MNF2", "MNF3").count() == 400
    ica = image.ica(df, ["a", "b", "c"], 2)
    assert abs(ica.agg(F.corr("ICA1", "ICA2")).first()[0]) < 1e-6


def test_equalise_keeps_order_and_void(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (2.0,), (10.0,)], "v double")
    got = sorted(r.v for r in image.equalise(df, "v").collect())
    assert got[0] > 0 and got == sorted(got) and got[-1] == 1.0


def test_spatial_batches_split_oversized_cells(spark):
    import math

    import numpy as np

    from scanforge.operators import geom

    def split(p, per, most, top=True):
        low, span = p.min(0), p.max(0) - p.min(0)
        if not top and (len(p) <= most or span.max() <= 1e-6):
            return [len(p)]
        target = math.ceil(len(p) / per)
        div = [max(1, math.ceil(math.ceil(target ** (1 / 3)) * (r / span.sum()) * 3)) for r in span]
        if math.prod(div) > 2 * target:
            div = [max(1, int(d * (2 * target / math.prod(div)) ** (1 / 3))) for d in div]
        if not top and max(div) == 1:
            div = [2 if r == span.max() else 1 for r in span]
        cells = np.floor((p - low) / ((span + 1e-6) / div)).astype(int)
        return [n for c in np.unique(cells, axis=0) for n in split(p[(cells == c).all(1)], max(1, most // 2), most, False)]

    rng = np.random.default_rng(5)
    p = np.concatenate([rng.random((400, 3)) * [20, 10, 3], rng.random((400, 3)) * 0.01 + 1])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "point_id long, X double, Y double, Z double")
    got = [r.n for r in geom.spatial_batches(df, 100, 60).groupBy("batch_x", "batch_y", "batch_z", "batch_path").agg({"*": "count"}).toDF("x", "y", "z", "path", "n").collect()]
    assert sorted(got) == sorted(split(p, 100, 60)) and max(got) <= 60 and sum(got) == len(p)
