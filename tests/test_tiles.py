"""Tiles of rasters, of two clouds and of clusters, and what belongs to one scan of many, against plain runs."""

import math
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanforge import tables
from scanforge.operators import blobs, decode, geom, image, points, profile, raster, raster_tiles, refine, segments, sets, spatial, tiles, trees
from scanforge.streaming import scans


def rows_of(spark, frame, schema):
    return spark.createDataFrame(frame, schema)


def test_median_by_tiles(spark):
    rng = np.random.default_rng(0)
    image_ = np.where(rng.random((30, 41)) < 0.1, np.nan, rng.random((30, 41)))
    there = rng.random((30, 41)) > 0.05
    rows = [(k, y, x, None if np.isnan(image_[y, x]) else float(image_[y, x]) + (k == "b")) for k in ("a", "b") for y in range(30) for x in range(41) if there[y, x]]
    df = spark.createDataFrame(rows, "scan_id string, y_pix int, x_pix int, v double")
    got = {(r.scan_id, r.y_pix, r.x_pix): r.v for r in raster_tiles.median(df, "v", 2, ("scan_id",), side=8).collect()}
    assert set(got) == {r[:3] for r in rows}
    known = np.where(there, image_, np.nan)
    for (k, y, x), v in got.items():
        near = known[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3]
        assert v == pytest.approx(np.nanmedian(near) + (k == "b"), abs=1e-12)


def plain_maxima(image_, sigmas, threshold):
    """Maxima of the scaled Laplacian by dense matrices over the whole image."""
    n = len(image_)
    cube = np.empty((n, n, len(sigmas)))
    for k, sigma in enumerate(sigmas):
        radius = int(4 * sigma + 0.5)
        x = np.arange(-radius, radius + 1)
        g = np.exp(-x * x / (2 * sigma * sigma))
        g /= g.sum()
        smooth, second = np.zeros((n, n)), np.zeros((n, n))
        for at, w, w2 in zip(x, g, g * (x * x - sigma * sigma) / sigma**4, strict=True):
            place = (np.arange(n) + at) % (2 * n)
            place = np.where(place < n, place, 2 * n - 1 - place)
            np.add.at(smooth, (np.arange(n), place), w)
            np.add.at(second, (np.arange(n), place), w2)
        cube[..., k] = -(second @ image_ @ smooth.T + smooth @ image_ @ second.T) * sigma * sigma
    found = {}
    for y, x, k in np.argwhere(cube > threshold):
        if cube[y, x, k] == cube[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2, max(0, k - 1) : k + 2].max():
            found[y, x, round(sigmas[k], 9)] = cube[y, x, k]
    return found


@pytest.mark.parametrize("side, most_sigma", [(16, 5.0), (256, 5.0), (16, 14.0)])
def test_blob_maxima_by_tiles(spark, side, most_sigma):
    rng = np.random.default_rng(1)
    images = {k: rng.integers(0, 256, (50, 50)) for k in ("a", "b")}
    images["a"][10:18, 20:28] = 255
    df = spark.createDataFrame([(k, x, y, int(v[y, x])) for k, v in images.items() for y in range(50) for x in range(50)], "scan_id string, gx int, gy int, grey int")
    got = blobs.log_maxima(df, 50, 2.0, most_sigma, 4, 0.05, ("scan_id",), side).collect()
    for k, v in images.items():
        want = plain_maxima(v / 255, np.linspace(2.0, most_sigma, 4), 0.05)
        own = {(r.y_pix, r.x_pix, round(r.sigma, 9)): r.strength for r in got if r.scan_id == k}
        assert set(own) == set(want) and want
        assert all(own[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_positions_by_scan(spark):
    rng = np.random.default_rng(2)
    frames = []
    for scan, hole in (("a", (12.0, 14.0)), ("b", (35.0, 33.0))):
        xy = rng.random((60_000, 2)) * 50
        xy = xy[np.hypot(xy[:, 0] - hole[0], xy[:, 1] - hole[1]) > 2.5]
        frames.append(pd.DataFrame({"scan_id": scan, "X": xy[:, 0] + (scan == "b") * 1000, "Y": xy[:, 1]}))
    found = blobs.scanner_positions(spark.createDataFrame(pd.concat(frames)), 96, 2.5, 6, 5, 0.2, ("scan_id",)).where("position_id = 0").collect()
    assert {r.scan_id: (round((r.X - (r.scan_id == "b") * 1000) / 5), round(r.Y / 5)) for r in found} == {"a": (2, 3), "b": (7, 7)}


@pytest.fixture(scope="module")
def two_clouds(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(size=(400, 3)) * 0.3, rng.normal(size=(1500, 3)) * 0.002, [[5.0, 5.0, 5.0]]])
    q = np.concatenate([rng.normal(size=(30, 3)) * 0.4, rng.normal(size=(30, 3)) * 0.01, [[-3.0, 0.0, 0.0], [0.02, 0.0, 0.0]]])
    frame = lambda xyz: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xyz)], "point_id long, X double, Y double, Z double")
    return q, p, frame(q), frame(p)


def nearest(q, p, k, axes=3):
    d = np.sqrt(((q[:, None, :axes] - p[None, :, :axes]) ** 2).sum(2))
    return {(i, r + 1, int(j)) for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(p)), d[i]))[:k])}


@pytest.mark.parametrize("crowded, chunk", [(60_000, 20_000), (40, 100)])
def test_queries_of_another_cloud(two_clouds, monkeypatch, crowded, chunk):
    q, p, queries, cloud = two_clouds
    monkeypatch.setattr(tiles, "MOST_POINTS", crowded)  # 40: a dense cluster is divided until halos shrink
    monkeypatch.setattr(spatial, "CHUNK", chunk)
    monkeypatch.setattr(spatial, "radius_pairs", None)  # no list of pairs
    got = {(r.point_id, r["rank"], r.nbr_id) for r in spatial.knn(queries, cloud, 5, 0.05).collect()}
    assert got == nearest(q, p, 5)


def test_queries_in_the_plane_and_by_scan(spark, two_clouds):
    q, p, queries, cloud = two_clouds
    scans = F.explode(F.array(F.lit("a"), F.lit("b"), F.lit(None).cast("string"))).alias("scan_id")
    got = spatial.knn(queries.select("*", scans), cloud.select("*", scans), 3, 0.1, ("scan_id",), ("X", "Y")).collect()
    for scan in ("a", "b", None):
        assert {(r.point_id, r["rank"], r.nbr_id) for r in got if r.scan_id == scan} == nearest(q, p, 3, 2)


def test_a_small_scan_leaves_the_others_alone(spark, monkeypatch):
    rng = np.random.default_rng(5)
    xyz = rng.random((500, 3)) * 0.5
    rows = [("large", i, *map(float, v)) for i, v in enumerate(xyz)] + [(s, i, 0.01 * i, 0.0, 0.0) for s in ("small", None) for i in range(5)]
    df = spark.createDataFrame(rows, "scan_id string, point_id long, X double, Y double, Z double")
    most = []
    pairs = spatial.radius_pairs
    monkeypatch.setattr(spatial, "radius_pairs", lambda q, p, r, *a: most.append((q.count(), r)) or pairs(q, p, r, *a))
    both = spatial.adaptive_neighbours(df, 0.025, by=("scan_id",))
    alone = spatial.adaptive_neighbours(df.where("scan_id = 'large'"), 0.025, by=("scan_id",))
    as_set = lambda d: {(r.point_id, r.nbr_id) for r in d.collect()}
    assert as_set(both.where("scan_id = 'large'")) == as_set(alone)
    for where in ("scan_id = 'small'", "scan_id IS NULL"):
        assert as_set(both.where(where)) == {(i, j) for i in range(5) for j in range(5) if abs(i - j) <= 2}
    assert most == [(10, 0.025)]  # only the small scans, within the base radius
    sums = geom.covariances(both, ("scan_id",)).orderBy("scan_id", "point_id").select("n_nbrs", "cxx").collect()
    tiled = spatial.neighbour_covariances(df, 0.025, by=("scan_id",)).orderBy("scan_id", "point_id").select("n_nbrs", "cxx").collect()
    assert [r.n_nbrs for r in sums] == [r.n_nbrs for r in tiled] and np.allclose([r.cxx for r in sums], [r.cxx for r in tiled], atol=1e-12)


def plain_clusters(rows, eps, least):
    out = {}
    for scan in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == scan]
        x = np.array([r[2:] for r in own])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        core, name = (d <= eps).sum(1) >= least, list(range(len(own)))
        for i in range(len(own)):
            for j in range(i):
                if core[i] and core[j] and d[i, j] <= eps and name[i] != name[j]:
                    old, new = max(name[i], name[j]), min(name[i], name[j])
                    name = [new if v == old else v for v in name]
        for i, r in enumerate(own):
            near = [(d[i, j], j) for j in range(len(own)) if core[j] and d[i, j] <= eps]
            out[scan, r[1]] = (own[name[i if core[i] else min(near)[1]]][1]) if near else -1
    return out


@pytest.mark.parametrize("eps, least", [(0.1, 5), (0.2, 3)])
def test_clusters_of_scans_with_the_same_ids(spark, eps, least):
    rng = np.random.default_rng(4)
    rows = []
    for scan, n in (("a", 120), ("b", 200), (None, 40)):
        xyz = np.concatenate([rng.normal(size=(n // 2, 3)) * 0.3, rng.normal(size=(n - n // 2, 3)) * 0.05 + rng.integers(0, 2, (n - n // 2, 1))])
        rows += [(scan, i, *map(float, v)) for i, v in enumerate(xyz)]
    df = spark.createDataFrame(rows, "scan_id string, point_id long, X double, Y double, Z double")
    assert {(r.scan_id, r.point_id): r.cluster for r in segments.clusters(df, eps, least, ("scan_id",)).collect()} == plain_clusters(rows, eps, least)


def test_dense_clusters_apart(spark):
    """Two dense sheets just beyond and just within eps of each other: joined only by points across cells."""
    rng = np.random.default_rng(6)
    for gap, n in ((0.11, 2), (0.0995, 1)):
        xyz = np.concatenate([np.c_[rng.random((400, 2)) * 0.3, np.zeros(400)], np.c_[rng.random((400, 2)) * 0.3, np.full(400, gap)], [[0.15, 0.15, 0.0], [0.15, 0.15, gap]]])
        df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xyz)], "point_id long, X double, Y double, Z double")
        assert segments.clusters(df, 0.1, 10).select("cluster").distinct().count() == n


def test_bins_of_each_scan(spark):
    rows = [(s, i, far * i / 29, 0.0, z + i / 10) for s, far, z in (("a", 1.0, 0.0), ("b", 99.0, 5.0)) for i in range(30)]
    df = spark.createDataFrame(rows, "scan_id string, point_id long, X double, Y double, Z double")
    bins = profile.range_bins(df.withColumn("range", F.col("X")), 0.1, 0.5, by=("scan_id",)).where("bin = 5").groupBy("scan_id").agg(F.max("bin_centre").alias("c")).collect()
    assert {r.scan_id: r.c for r in bins} == {"a": 0.75, "b": 49.75}
    heights = profile.density_by_height(df, 1.0, 0.5, ("scan_id",)).groupBy("scan_id").agg(F.min("label").alias("low")).collect()
    assert {r.scan_id: r.low for r in heights} == {"a": "0.00m", "b": "5.00m"}
    voxels = spatial.voxel_means(df, 0.5, "minimum", ("scan_id",)).groupBy("scan_id").agg(F.min("vz").alias("v")).collect()
    assert {r.scan_id: r.v for r in voxels} == {"a": 0, "b": 0}
    kept = points.with_stats(df.withColumn("scan_id", F.nullif("scan_id", F.lit("b"))), "scan_id", n=F.count("*"))
    assert kept.count() == 60  # rows of no scan stay


def test_batches_of_each_scan(spark):
    rows = [(s, i, float(i % 10) * far, float(i // 10), 0.0) for s, far in (("a", 1.0), ("b", 50.0)) for i in range(100)]
    df = spark.createDataFrame(rows, "scan_id string, point_id long, X double, Y double, Z double")
    both = geom.spatial_batches(df, 30, 40, ("scan_id",))
    for scan in ("a", "b"):
        alone = geom.spatial_batches(df.where(F.col("scan_id") == scan), 30, 40)
        assert both.where(F.col("scan_id") == scan).orderBy("point_id").select("batch_x", "batch_y", "batch_path").collect() == alone.orderBy("point_id").select("batch_x", "batch_y", "batch_path").collect()


def test_noise_runs_over_row_ends(spark):
    rng = np.random.default_rng(7)
    images = {k: rng.random((6, 5)) for k in ("a", "b")}
    df = spark.createDataFrame([(k, y, x, float(v[y, x])) for k, v in images.items() for y in range(6) for x in range(5)], "scan_id string, y_pix int, x_pix int, c double")
    got = image.noise(df, ["c"], by=("scan_id",)).collect()
    for k, v in images.items():
        assert np.allclose(sorted(r.c for r in got if r.scan_id == k), np.sort(np.diff(v.ravel())), atol=1e-15)


def test_ica_says_whether_it_converged(spark):
    rng = np.random.default_rng(8)
    mixed = rng.laplace(size=(400, 3)) @ rng.normal(size=(3, 3))
    df = spark.createDataFrame([(i // 20, i % 20, *map(float, v)) for i, v in enumerate(mixed)], "y_pix int, x_pix int, a double, b double, c double")
    with pytest.warns(UserWarning, match="still move"):
        image.ica(df, ["a", "b", "c"], rounds=1)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        image.ica(df, ["a", "b", "c"])


def test_trees_grow_until_leaves_are_pure(spark):
    rng = np.random.default_rng(9)
    x = rng.random((300, 2))
    label = 1 + (np.floor(x[:, 0] * 12).astype(int) + np.floor(x[:, 1] * 12).astype(int)) % 2  # a chessboard: shallow trees can't tell
    df = spark.createDataFrame([(i, float(a), float(b), int(c), int(c)) for i, ((a, b), c) in enumerate(zip(x, label, strict=True))], "point_id long, u double, v double, label int, vote int")
    right = lambda depth: refine.forest(df, ["u", "v"], 20, depth=depth)[0].where("rf_label = label").count()
    assert right(30) > 0.9 * 300 > right(2)


def test_leaves_of_just_k_points_are_not_compared_with_all(monkeypatch):
    rng = np.random.default_rng(12)
    n, k = 12_800, 50  # halved eight times: leaves of 50
    xyz, ids, real, compared = rng.random((n, 3)), np.arange(n), np.partition, []
    monkeypatch.setattr(tiles.np, "partition", lambda a, *r, **o: (compared.append(a.size), real(a, *r, **o))[1])
    got = {int(i): f.tolist() for own, found, _ in tiles.nearest_by_leaves(xyz, ids, ids >= 0, k, 100.0) for i, f in zip(own, found, strict=True)}
    monkeypatch.undo()
    assert len(got) == n
    for i in range(0, n, 99):
        assert got[i] == np.lexsort((ids, np.sqrt(((xyz - xyz[i]) ** 2).sum(1))))[:k].tolist()
    assert sum(compared) < n * n / 2


def test_deeper_trees_take_no_more_jobs(spark):
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(i, *map(float, x), c, c) for i, (x, c) in enumerate(zip(rng.random((300, 2)), rng.integers(1, 4, 300).tolist(), strict=True))], "point_id long, u double, v double, label int, vote int")

    def jobs(depth):
        spark.sparkContext.setJobGroup(f"forest-{depth}", "")
        refine.forest(df, ["u", "v"], 20, depth=depth)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{depth}"))

    try:
        assert jobs(30) <= jobs(2)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def plain_tree(bins, cls, n, key, level, depth, weights):
    """(rows, class counts) of each leaf, one node at a time."""
    rows = [(key, level, np.arange(len(bins)))]
    while rows:
        key, level, at = rows.pop()
        total = np.array([n[at][cls[at] == c].sum() for c in range(len(weights))])
        gini = lambda c: ((c * weights) ** 2).sum() / (c * weights).sum()
        best = (1e-12, None)
        if level < depth and (total > 0).sum() > 1:
            for f in trees._asked(key, bins.shape[1])[0]:
                for cut in range(bins[:, f].max() + 1):
                    left = np.array([n[at][(cls[at] == c) & (bins[at, f] <= cut)].sum() for c in range(len(weights))])
                    if 0 < left.sum() < total.sum() and (gain := gini(left) + gini(total - left) - gini(total)) > best[0] + 1e-9:
                        best = (gain, (f, cut))
        if best[1] is None:
            yield at, total
            continue
        right = bins[at, best[1][0]] > best[1][1]
        left_key, right_key = trees._children(key)
        rows += [(left_key[None], level + 1, at[~right]), (right_key[None], level + 1, at[right])]


@pytest.mark.parametrize("depth", [3, 30])
def test_forest_equals_plain_trees_however_nodes_are_dealt(spark, depth):
    rng = np.random.default_rng(11)
    values = np.column_stack([rng.normal(size=400), rng.integers(0, 3, 400), rng.random(400)])
    values[::17, 0] = np.nan
    cls = np.where(rng.random(400) < 0.2, -1, (values[:, 1] + (values[:, 2] > 0.5) + (rng.random(400) < 0.3)).astype(int) % 3)
    df = spark.createDataFrame([(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(values, cls, strict=True))], "_row long, a double, b double, c double, cls int")
    weights = [1.0, 0.5, 3.0]

    def got(local):
        out = trees.votes(df, ["a", "b", "c"], F.col("cls"), F.col("_row"), weights, 6, 5, depth, 16, local)
        return sorted(map(tuple, out.collect()))

    whole = got(1000)
    assert [r[0] for r in whole] == list(range(400))
    for local in (60, 0):  # some nodes, and all nodes, split by counts over all tasks
        assert [r[:2] for r in got(local)] == [r[:2] for r in whole]
        assert np.allclose([r[2] for r in got(local)], [r[2] for r in whole], atol=1e-12)

    cuts = trees.thresholds(df.where("cls >= 0"), ["a", "b", "c"], 16)
    assert cuts[1].tolist() == [0.5, 1.5]
    bins = np.column_stack([np.searchsorted(c, values[:, i], "left") for i, c in enumerate(cuts)])
    hashes = np.array([r[0] for r in df.orderBy("_row").select(F.xxhash64("_row")).collect()]).view(np.uint64)
    rec = np.zeros(400, np.dtype([("cls", int), ("hash", "<u8")]))
    rec["cls"], rec["hash"] = cls, hashes
    shares = np.zeros((400, 3))
    for t in range(6):
        n = trees._drawn(rec, 5, t).astype(int)
        assert n.sum() / (cls >= 0).sum() == pytest.approx(1, abs=0.2)
        for at, total in plain_tree(bins, cls, n, trees._root(5, t), 0, depth, np.array(weights)):
            shares[at] += total * weights / (total * weights).sum()
    assert np.allclose(shares.max(1) / 6, [r[2] for r in whole], atol=1e-12)


def test_forest_of_repeated_and_missing_values(spark):
    rows = [(1, 0.0, None, 1, 1)] * 30 + [(None, 1.0, None, 2, 2)] * 30 + [(3, float("nan"), None, 0, None), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "point_id long, u double, v double, label int, vote int")
    out = refine.forest(df, ["u", "v"], 5)[0].collect()
    assert len(out) == 62 and all(0 < r.rf_confidence <= 1 for r in out)
    with pytest.raises(ValueError, match="reliable"):
        refine.forest(df.where("label = 0"), ["u", "v"], 5)


def plain_resize(array, new, kind):
    """Along the first axis."""
    old = len(array)
    scale = old / new
    wide, support = max(1.0, scale), {"bilinear": 1.0, "bicubic": 2.0}[kind]

    def weight(x):
        if kind == "bilinear":
            return max(0.0, 1 - x)
        return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0

    out = []
    for i in range(new):
        c = (i + 0.5) * scale
        at = [j for j in range(old) if math.floor(c - support * wide + 0.5) <= j < math.floor(c + support * wide + 0.5)]
        w = np.array([weight(abs(j + 0.5 - c) / wide) for j in at])
        out.append((w / w.sum()) @ array[at])
    return np.array(out)


@pytest.mark.parametrize("kind", ["bilinear", "bicubic"])
@pytest.mark.parametrize("new", [(7, 31), (40, 5), (12, 17)])
def test_filtered_resize(spark, kind, new):
    rng = np.random.default_rng(10)
    images = {k: rng.random((12, 17)) * 255 for k in ("a", "b")}
    df = spark.createDataFrame([(k, y, x, float(v[y, x])) for k, v in images.items() for y in range(12) for x in range(17)], "scan_id string, y_pix int, x_pix int, v double")
    for as_bytes in (False, True):
        got = raster.resize(df, 12, 17, *new, ["v"], kind=kind, as_bytes=as_bytes).collect()
        for k, v in images.items():
            rounded = (lambda a: np.clip(np.floor(a + 0.5), 0, 255)) if as_bytes else (lambda a: a)
            want = rounded(plain_resize(rounded(plain_resize(v.T, new[1], kind)).T, new[0], kind))
            out = np.full(new, np.nan)
            for r in got:
                if r.scan_id == k:
                    out[r.y_pix, r.x_pix] = r.v
            assert np.allclose(out, want, atol=1e-9)
    same = raster.resize(df, 12, 17, 12, 17, ["v"]).where("scan_id = 'a' and y_pix = 3 and x_pix = 4").first()
    assert same.v == pytest.approx(images["a"][3, 4], abs=1e-9)


def test_encoder_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(tables, "RANGE_ROWS", 7)
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for scan, n in (("a", 60), ("b", 23), (None, 4)):
        values = np.cumsum(rng.integers(0, 3000, n)) % 16384
        values[-3:] = values[-3:][::-1]  # a fall in the last lines
        before, turned = 0, 0
        for i, v in enumerate(values.tolist()):
            step = 0 if i == 0 else v - values[i - 1]
            if step < 0:
                step = before if i >= n - 5 else 16383 + step
            before, turned = int(step), turned + int(step)
            want[scan, i] = (before, turned / 250)
            rows.append((scan, i, v))
    df = spark.createDataFrame(rows, "scan_id string, line long, encoder long").repartition(5)
    got = decode.running_azimuth(decode.encoder_steps(df)).collect()
    assert {(r.scan_id, r.line): r.increment for r in got} == {k: v[0] for k, v in want.items()}
    assert all(r.turned == pytest.approx(want[r.scan_id, r.line][1], abs=1e-9) for r in got) and len(got) == len(rows)


def test_label_statistics_of_arriving_scans(spark, tmp_path):
    rng = np.random.default_rng(12)
    schema = "scan_id string, label int, v double"
    rows = [(f"s{k}", int(rng.integers(0, 3)), float("nan") if i % 17 == 0 else float(rng.normal())) for k in range(6) for i in range(80)]
    want = sorted(map(str, profile.value_by_label(spark.createDataFrame(rows, schema), "v", "label", "scan_id").collect()))
    source, state = tmp_path / "in", tmp_path / "state"
    source.mkdir()
    started = lambda: scans.LabelStatistics(scans.scan_stream(spark, str(source), schema), "v", "label", str(state))
    for part in ((4, 1), (0, 5, 2, 3)):  # out of order, and a new start between
        for k in part:
            (source / f"s{k}.csv").write_text("scan_id,label,v\n" + "".join(f"{s},{c},{'NaN' if np.isnan(v) else repr(v)}\n" for s, c, v in rows if s == f"s{k}"))
        stats = started()
        stats.advance()
    stats.advance()  # nothing new
    assert sorted(map(str, stats.result().collect())) == want


def test_sets(spark):
    a = spark.createDataFrame([(1, 2, "x"), (1, None, "x"), (None, 3, None)], "p int, q int, s string")
    b = spark.createDataFrame([(3,), (1,), (1,), (None,)], "other int")
    values = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert values(sets.distinct_ids("id", a.select("p"), a.select("q"), b)) == [(1,), (2,), (3,)]
    assert values(sets.label_domain(a, ["p", "q"])) == [(1,), (2,), (3,)]
    assert values(sets.label_domain(a, ["p", "q"], by=("s",))) == sorted([("x", 1), ("x", 2), (None, 3)], key=str)
    assert values(sets.common_values(a.select("p"), b)) == [(1,), (None,)] and values(sets.common_values(a.select("q"), b)) == [(3,), (None,)]
