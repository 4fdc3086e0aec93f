"""Normals along a spanning forest against a plain run, and on shapes with known sides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanforge.operators import geom, orient


def plain_parities(edges):
    """Kruskal: node -> (tree's nodes, turned relative to the tree's least node)."""
    tree = {}
    for w, a, b, turn in sorted((w, min(a, b), max(a, b), t) for a, b, w, t in edges):
        for x in (a, b):
            tree.setdefault(x, {x: False})
        if tree[a] is not tree[b]:
            turned = tree[a][a] ^ turn ^ tree[b][b]
            tree[a].update({x: v ^ turned for x, v in tree[b].items()})
            for x in tree[b]:
                tree[x] = tree[a]
    return {x: (frozenset(t), t[x] ^ t[min(t)]) for x, t in tree.items()}


@pytest.mark.parametrize("seed", [0, 1])
def test_forest_against_kruskal(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (90, 2)) if a != b}
    edges = [(a, b, float(rng.integers(0, 6)) / 4, bool(rng.integers(0, 2))) for a, b in sorted(pairs)]  # many ties
    rows = orient.spanning_parities(spark.createDataFrame(edges, "a long, b long, w double, turn boolean")).collect()
    want = plain_parities(edges)
    assert {r.node for r in rows} == set(want)
    roots = {r.node: (r.root, r.turned) for r in rows}
    for node, (nodes, turned) in want.items():
        assert {x for x in roots if roots[x][0] == roots[node][0]} == nodes
        assert roots[node][1] ^ roots[min(nodes)][1] == turned


def test_forest_of_nothing(spark):
    assert orient.spanning_parities(spark.createDataFrame([], "a long, b long, w double, turn boolean")).count() == 0


def test_sphere_and_folded_plane(spark):
    """Two scans with the same ids: all normals of a sphere look out; a plane folded over keeps one side."""
    rng = np.random.default_rng(3)
    ball = rng.normal(size=(500, 3))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    t = np.linspace(0, np.pi, 24)
    line = np.r_[np.c_[np.linspace(0, 1.5, 16), np.zeros(16)], np.c_[1.5 + 0.75 * np.sin(t), 0.75 - 0.75 * np.cos(t)], np.c_[np.linspace(1.5, 0, 16), np.full(16, 1.5)]]  # a floor, a bend, the plane back over it
    fold = np.c_[np.repeat(line[:, 0], 12), np.tile(np.linspace(0, 1, 12), len(line)), np.repeat(line[:, 1], 12)]
    rows = [("ball", i, *map(float, v * 2 + [10, 0, 0])) for i, v in enumerate(ball)] + [("fold", i, *map(float, v)) for i, v in enumerate(fold)]
    df = spark.createDataFrame(rows, "scan_id string, point_id long, X double, Y double, Z double")
    out = geom.hybrid_normals(df, 0.6, 10, ("scan_id",), orient="forest").toPandas()
    normals = {s: g.sort_values("point_id")[["nx", "ny", "nz"]].to_numpy() for s, g in out.groupby("scan_id")}
    assert ((normals["ball"] * ball).sum(1) > 0.5).all()
    floor, roof = normals["fold"][: 15 * 12], normals["fold"][-15 * 12 :]
    assert (floor[:, 2] < -0.9).all() and (roof[:, 2] > 0.9).all()  # the same side, turned over
    toward = geom.hybrid_normals(df.where("scan_id = 'fold'"), 0.6, 10, ("scan_id",)).agg(F.count("*")).first()[0]
    assert toward == len(fold)
