"""Neighbourhoods by tiles, exact quantiles and numbering, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanforge import tables
from scanforge.operators import geom, quantile, sample, spatial, tiles


def frame(spark, xyz, scans=None):
    rows = [(str(scans[i]) if scans is not None else "s", i, *map(float, p)) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "scan_id string, point_id long, X double, Y double, Z double")


def brute_edges(xyz, base, most, k, nth, factor):
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    out = set()
    for i in range(len(xyz)):
        order = np.lexsort((np.arange(len(xyz)), d[i]))
        order = order[d[i][order] <= most]
        radius = base if len(xyz) < nth else min(max(factor * d[i][order[nth - 1]], base), most) if len(order) >= nth else most
        out |= {(i, int(j)) for n, j in enumerate(order[:k]) if d[i][j] <= radius}
    return out


def clouds():
    rng = np.random.default_rng(8)
    dense = rng.normal(size=(900, 3)) * 0.004  # far denser than the radius
    lonely = rng.random((60, 3)) * 3 - 1.5
    grid = np.stack(np.meshgrid(*[np.arange(6) * 0.05] * 3), -1).reshape(-1, 3)  # many equal distances
    return {"dense": np.concatenate([dense, lonely]), "ties": np.concatenate([grid, grid[:5]]), "few": lonely[:10]}


@pytest.mark.parametrize("kind", ["dense", "ties", "few"])
@pytest.mark.parametrize("most_points", [60_000, 120])
def test_tiles_against_brute_force(spark, monkeypatch, kind, most_points):
    monkeypatch.setattr(tiles, "MOST_POINTS", most_points)  # the small one makes several levels and shrunken halos
    monkeypatch.setattr(tiles, "LEAF", 16)
    xyz = clouds()[kind]
    df = frame(spark, xyz)
    got = [(r.point_id, r.nbr_id) for r in spatial.adaptive_neighbours(df, 0.05, 0.2, 30).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_edges(xyz, 0.05, 0.2, 30, 21, 1.5)
    cov = {r.point_id: r for r in spatial.neighbour_covariances(df, 0.05, 0.2, 30).collect()}
    edges = {}
    for i, j in got:
        edges.setdefault(i, []).append(j)
    assert cov.keys() == set(range(len(xyz)))
    for i, r in cov.items():
        assert r.n_nbrs == len(edges[i])
        if r.n_nbrs > 1:
            want = np.cov(xyz[edges[i]].T)
            assert np.allclose([r.cxx, r.cyy, r.czz, r.cxy, r.cyz, r.cxz], [want[0, 0], want[1, 1], want[2, 2], want[0, 1], want[1, 2], want[0, 2]], atol=1e-15, rtol=1e-9)


def test_a_dense_cloud_costs_points_times_neighbours(spark, monkeypatch):
    """100 000 points within the smallest radius: measured distances stay near those wanted, and so do the rows sent."""
    rng = np.random.default_rng(1)
    xyz = rng.random((4000, 3)) * 0.04
    measured = []
    inner = np.partition
    monkeypatch.setattr(tiles.np, "partition", lambda a, *x, **k: (measured.append(a.size), inner(a, *x, **k))[1])
    found = sum(len(own) for own, _, _ in tiles.nearest_by_leaves(xyz, np.arange(len(xyz)), np.ones(len(xyz), bool), 50, 0.2))
    assert found == len(xyz) and sum(measured) < 50 * 60 * len(xyz) < len(xyz) ** 2
    assert spatial.adaptive_neighbours(frame(spark, xyz), 0.05).count() == 50 * len(xyz)


def test_scans_do_not_mix(spark):
    rng = np.random.default_rng(2)
    xyz = rng.random((200, 3)) * 0.3
    df = frame(spark, xyz, [i % 2 for i in range(200)])
    got = {(r.point_id, r.nbr_id) for r in spatial.adaptive_neighbours(df, 0.05, by=("scan_id",)).collect()}
    want = {(2 * i + s, 2 * j + s) for s in (0, 1) for i, j in brute_edges(xyz[s::2], 0.05, 0.2, 50, 21, 1.5)}
    assert got == want
    batch = spatial.buffered_batch(df, df.where("point_id in (0, 1)"), 5, 0.1, ("scan_id",))
    rows = {r.point_id: r.is_core for r in batch.collect()}
    assert len(rows) == 10 and sum(rows.values()) == 2 and all(i % 2 == 0 or i % 2 == 1 for i in rows)


def test_hybrid_and_population_features(spark):
    rng = np.random.default_rng(4)
    xyz = np.concatenate([rng.random((120, 3)) * 0.2, [[5.0, 5, 5], [9, 9, 9]]])
    df = frame(spark, xyz)
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    got = {}
    for r in spatial.hybrid_neighbours(df, 0.05, 30).collect():
        got.setdefault(r.point_id, set()).add(r.nbr_id)
    for i in range(len(xyz)):
        order = np.lexsort((np.arange(len(xyz)), d[i]))
        near = [j for j in order[:30] if d[i][j] <= 0.05]
        assert got[i] == set(near if len(near) > 3 else order[:10]) - {i}
    assert geom.hybrid_features(df, 0.05).count() == len(xyz)
    a, b = (f.where("point_id = 3").first() for f in (geom.population_features(df), geom.eigen_features(spatial.neighbour_covariances(df, 0.05))))
    assert np.isclose(a.cxx * a.n_nbrs, b.cxx * (b.n_nbrs - 1)) and a.n_nbrs == b.n_nbrs


@pytest.mark.parametrize("direct", [10_000_000, 50])
def test_quantiles_equal_numpy(spark, monkeypatch, direct):
    monkeypatch.setattr(quantile, "DIRECT", direct)
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=2000), "b": np.r_[np.full(900, 7.0), rng.random(100)], "c": rng.lognormal(0, 20, 700), "d": np.array([1.0]), "e": np.array([np.nan, np.nan])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"q0": 0.0, "q1": 0.013, "q2": 0.5, "q3": 0.999, "q4": 1.0}
    out = {r.g: r for r in quantile.quantiles(df, {k: (F.col("v"), p) for k, p in shares.items()}, ("g",)).collect()}
    for g, vs in groups.items():
        known = vs[~np.isnan(vs)]
        for k, p in shares.items():
            assert (g not in out or out[g][k] is None) if not len(known) else np.isclose(out[g][k], np.quantile(known, p), rtol=1e-12), (g, k)
    whole = quantile.quantiles(df, {"q": (F.col("v"), 0.25)}).first().q
    assert np.isclose(whole, np.nanquantile([v for _, v in rows if v is not None], 0.25), rtol=1e-12)


def test_numbering_spans_ranges(spark, monkeypatch):
    monkeypatch.setattr(tables, "RANGE_ROWS", 30)
    rows = [(k % 3 if k % 5 else None, k * 37 % 100, k) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, v int, id int").repartition(4)
    got = {r.id: (r.place, r.place_count, r.before) for r in tables.numbered_within(df, ["g"], ["v", "id"], {"before": "v"}, "place").collect()}
    for g in (None, 0, 1, 2):
        own = sorted((v, i) for h, v, i in rows if h == g)
        upto = 0
        for k, (v, i) in enumerate(own):
            assert got[i] == (k, len(own), upto)
            upto += v
    assert sorted(r.id for r in sample.stride_sample(df.where("g = 1"), 7, ["v", "id"], ["g"]).collect()) == sorted(i for k, (_, i) in enumerate(sorted((v, i) for g, v, i in rows if g == 1)) if k % 7 == 0)
    assert tables.numbered(df.limit(0), ["v"]).count() == 0
