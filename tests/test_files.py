"""Readers and writers that must lose nothing, file listings, and the steps from file to file."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanforge.operators import blobs, files, image, raster
from scanforge.plans import steps
from scanforge.sources import binary, text


def test_equal_names_in_two_folders_stay_apart(spark, tmp_path):
    for k in ("one", "two"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "scan.csv").write_text(f"Classification,Y,X,Intensity,Z\n{1 if k == 'one' else 2},2,{k == 'two'},7.0,3\n".replace("True", "9").replace("False", "8"))
        (tmp_path / k / "scan.label").write_text("5\n")
        np.arange(4, dtype="<f4").tofile(tmp_path / k / "p.bin")
    out = {r.scan_id: (r.X, r.Intensity, r.class_id, r.point_id) for r in text.read_forest(spark, str(tmp_path / "*" / "scan.csv")).collect()}
    assert out == {"one/scan.csv": (8.0, 7, 1, 0), "two/scan.csv": (9.0, 7, 2, 0)}
    assert {r.scan_id for r in text.read_labels(spark, [str(tmp_path / k / "scan.label") for k in ("one", "two")]).collect()} == {"one/scan.label", "two/scan.label"}
    labelled = text.read_labelled(spark, str(tmp_path / "*" / "scan.csv"), str(tmp_path / "*" / "scan.label"), ["X"])
    assert {(r.scan_id, r.label) for r in labelled.collect()} == {("one/scan", 5), ("two/scan", 5)}
    assert {r.scan_id for r in binary.read_kitti(spark, str(tmp_path / "*" / "p.bin")).collect()} == {"one/p.bin", "two/p.bin"}
    assert {r.class_id for r in text.read_class_ids(spark, [str(tmp_path / "one" / "scan.csv"), str(tmp_path / "two" / "scan.label")], "Classification").collect()} == {1, 5}


def test_fields_are_read_by_name_and_never_lost(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Y,X,Z,zenith,azimuth,rangemeter,Return Number,Intensity\n2,1,3,90,45,4,1,123.0\n")
    r = text.read_mangrove(spark, str(tmp_path / "a.txt")).first()
    assert (r.X, r.Y, r.Intensity, r["Return Number"], r.point_id) == (1.0, 2.0, 123, 1, 0)
    (tmp_path / "b.txt").write_text("1,2,3,90,45,4,,1\n")
    assert text.read_mangrove(spark, str(tmp_path / "b.txt")).first().Intensity is None
    for bad in ("1,2,3,90,45,4,12.5,1\n", "1,2,3,90,45,4,x,1\n"):
        (tmp_path / "c.txt").write_text(bad)
        with pytest.raises(Exception, match="column Intensity"):
            text.read_mangrove(spark, str(tmp_path / "c.txt")).collect()
    (tmp_path / "d.csv").write_text("east,north,up\n1,2,3\n4,5,6\n")
    assert [(r.point_id, r.X, r.Z) for r in text.read_xyz(spark, str(tmp_path / "d.csv"), "east", "north", "up").orderBy("point_id").collect()] == [(0, 1.0, 3.0), (1, 4.0, 6.0)]


def test_las_names_doubles_and_compression(spark, tmp_path):
    rng = np.random.default_rng(0)
    f = pd.DataFrame({"scan_id": ["scan.1", "scan.2"] * 20, "point_id": np.arange(40), "X": rng.random(40), "Y": rng.random(40) + 500_000, "Z": rng.random(40), "Intensity": 5, "class_id": 1, "r": 1, "g": 2, "b": 3})
    df = spark.createDataFrame(f)
    rows = binary.write_scans(df.repartition(3), str(tmp_path / "las")).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows) == ["scan.1.las", "scan.2.las"] and [r.n for r in rows] == [20, 20]
    back = binary.read_las(spark, str(tmp_path / "las"), fill_intensity=False).orderBy("scan_id", "point_id").toPandas()
    want = f.sort_values(["scan_id", "point_id"])
    assert list(back.scan_id) == ["scan.1.las"] * 20 + ["scan.2.las"] * 20 and np.allclose(back[["X", "Y", "Z"]], want[["X", "Y", "Z"]], atol=6e-4)
    binary.write_scans(df, str(tmp_path / "ply"), "ply").collect()
    raw = (tmp_path / "ply" / "scan.1.ply").read_bytes()
    head, body = raw.split(b"end_header\n", 1)
    assert b"property double X" in head and b"element vertex 20" in head
    first = np.frombuffer(body, dtype=[("point_id", "<i4"), ("X", "<f8"), ("Y", "<f8"), ("Z", "<f8"), ("Intensity", "<i4"), ("class_id", "<i4"), ("r", "<i4"), ("g", "<i4"), ("b", "<i4")])
    assert first["Y"].tolist() == want.Y[:20].tolist()  # not a bit is lost
    packed = bytearray((tmp_path / "las" / "scan.1.las").read_bytes())
    packed[104] |= 0x80
    (tmp_path / "z.laz").write_bytes(packed)
    with pytest.raises(Exception, match="LAZ"):
        binary.read_las(spark, str(tmp_path / "z.laz")).count()


def test_png_kinds():
    import struct
    import zlib

    def png(depth, colour, lines, palette=b""):
        chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
        head = chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, depth, colour, 0, 0, 0))
        return b"\x89PNG\r\n\x1a\n" + head + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + x for x in lines))) + chunk(b"IEND", b"")

    two_bits = png(2, 3, [bytes([0b00011000]), bytes([0b11000100])], bytes(range(12)))
    assert binary.png_array(two_bits).tolist() == [[[0, 1, 2], [3, 4, 5], [6, 7, 8]], [[9, 10, 11], [0, 1, 2], [3, 4, 5]]]
    assert binary.png_array(png(16, 0, [struct.pack(">3H", 1, 500, 65535)] * 2))[0, :, 0].tolist() == [1, 500, 65535]


def test_cube_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    cube = rng.random((4, 5, 2)).astype(np.float32)
    rows = [(s, y, x, *map(float, cube[y, x] + k)) for k, s in enumerate(("a/1", "b")) for y in range(4) for x in range(5)]
    df = spark.createDataFrame(rows, "scan_id string, y_pix int, x_pix int, intensity double, PCA1 double")
    binary.write_cube(df.repartition(4), str(tmp_path / "cubes"), ["intensity", "PCA1"], 4, 5).collect()
    assert (np.load(tmp_path / "cubes" / "a" / "1.npy") == cube).all()
    binary.write_cube_metadata(image.channel_metadata(df, ["intensity", "PCA1"]), str(tmp_path / "meta"), 4, 5)
    about = binary.read_cube_metadata(spark, str(tmp_path / "meta"))
    assert about["shape"] == [4, 5, 2] and [c["channel"] for c in about["channels"]] == ["intensity", "PCA1"] and about["channels"][1]["note"] == "principal component"
    back = binary.read_cube(spark, str(tmp_path / "cubes" / "b.npy"), metadata=str(tmp_path / "meta"))
    assert back.count() == 20 and np.isclose(back.agg(F.sum("PCA1")).first()[0], (cube[..., 1] + 1).sum(), rtol=1e-6)
    with pytest.raises(Exception, match="canvas"):
        binary.write_cube(df.where("x_pix < 4"), str(tmp_path / "bad"), ["PCA1"], 4, 5).collect()


def test_profiles_manifests_and_decoded_rows(spark, tmp_path):
    df = spark.createDataFrame([("s", 0, 0.5, 1.0)], "scan_id string, bin int, bin_centre double, density double")
    text.write_profile(str(tmp_path / "p"), df.drop("scan_id"), df, df.select("scan_id", F.col("bin_centre").alias("height"), "density"), density_type="volumetric", z_range=[0, 1])
    found, about = text.read_profile(spark, str(tmp_path / "p"))
    assert sorted(found) == ["density_vs_range", "density_vs_range_per_scan", "vertical_density"] and found["vertical_density"].first().height == 0.5
    assert about["mode"] == "aggregate" and about["n_scans"] == 1 and about["density_type"] == "volumetric"
    for p in ("img/x001_image.npy", "img/x002_image.npy", "img/x002_mask.png", "pcd/x001_color.csv", "other/x001_image.npy"):
        (tmp_path / "d" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / p).write_text("x")
    ids = spark.createDataFrame([("val", 0, "x002_"), ("train", 1, "x001_"), ("train", 0, "x009_"), ("test", 0, "x001_")], "split string, place int, id string")
    manifest = files.split_manifest(files.listing(spark, str(tmp_path / "d")), ids)
    text.write_manifest(manifest, str(tmp_path / "manifest"))
    whole = json.loads(next((tmp_path / "manifest").glob("part-*")).read_text())
    assert {k: {s: [p.rsplit("/", 2)[1:] for p in v] for s, v in x.items()} for k, x in whole.items()} == {
        "img": {"train": [["img", "x001_image.npy"]], "val": [["img", "x002_image.npy"]]}, "mask": {"val": [["img", "x002_mask.png"]]}, "pcd": {"train": [["pcd", "x001_color.csv"]]},
    }
    listed = spark.createDataFrame([(f"/b/scan_{k}/f.las",) for k in (10, 9, 100)] + [("/b/scan_1/f.txt",)], "path string")
    assert files.chosen_inputs(listed, ".las", 0, 2, numeric=True) == ["/b/scan_9/f.las", "/b/scan_10/f.las"]
    rows = spark.createDataFrame([("a", 0, 0, 1, 1.0, 2.0, 3.0, 90.0, 45.0, 4.0, 7), ("a", 0, 0, 2, 1.0, 2.0, 3.0, 90.0, 45.0, 5.0, 8)], "scan_id string, line int, pulse int, return_number int, X double, Y double, Z double, zenith double, azimuth double, rangemeter double, Intensity int")
    text.write_decoded(rows, str(tmp_path / "decoded"))
    written = b"".join(p.read_bytes() for p in sorted((tmp_path / "decoded" / "scan_id=a").glob("part-*")))
    assert written == b"1.0,2.0,3.0,90.0,45.0,4.0,7,1\r\n1.0,2.0,3.0,90.0,45.0,5.0,8,2\r\n"
    text.write_matrix(spark, ((1.0, 0.0), (0.5, 2.0)), str(tmp_path / "m"))
    assert next((tmp_path / "m").glob("part-*")).read_text() == "1.0 0.0\n0.5 2.0\n"


def test_nearest_fill_by_scan_and_without_labels(spark):
    rows = [("a", 0, x, 1 if x == 0 else 2 if x == 9 else None) for x in range(10)] + [("b", 0, x, None) for x in range(3)]
    df = spark.createDataFrame(rows, "scan_id string, y_pix int, x_pix int, class_id int")
    got = {(r.scan_id, r.x_pix): r.class_id for r in raster.fill_from_nearest(df).collect()}
    assert [got["a", x] for x in range(10)] == [1] * 5 + [2] * 5 and len(got) == 13 and got["b", 1] is None


def test_blobs_find_holes(spark):
    rng = np.random.default_rng(0)
    xy = rng.random((200_000, 2)) * 50
    centres = np.array([[12.0, 14.0], [35.0, 33.0]])
    away = np.sqrt(((xy[:, None] - centres[None]) ** 2).sum(2)).min(1)
    kept = xy[(away > 1.6)]
    df = spark.createDataFrame(pd.DataFrame({"X": np.round(kept[:, 0], 3), "Y": np.round(kept[:, 1], 3)}))
    near = blobs.scanner_positions(df, 256, 4, 10, 5, 0.1).toPandas()
    assert len(near) >= 2
    best = near.head(2)[["X", "Y"]].to_numpy()
    assert sorted(np.abs(best - c).max(1).min() < 1.0 for c in centres) == [True, True]
    assert blobs.shared_area((0, 0, 1.0), (0, 0, 2.0)) == 1.0 and blobs.shared_area((0, 0, 1.0), (9, 0, 1.0)) == 0.0


def test_local_equalise(spark):
    rng = np.random.default_rng(0)
    v = np.r_[np.zeros(40), rng.random(536) + 1].reshape(24, 24)
    rows = [("s", y, x, float(v[y, x])) for y in range(24) for x in range(24)]
    df = spark.createDataFrame(rows, "scan_id string, y_pix int, x_pix int, v double")
    got = {(r.y_pix, r.x_pix): r.v for r in image.local_equalise(df, "v", 24, 24, 1, 1.0).collect()}
    seen = v[v != 0]
    level = np.minimum(np.floor((v - seen.min()) / (seen.max() - seen.min()) * 256), 255)
    for (y, x), g in got.items():  # one tile without a limit is the plain cumulative share
        assert g == 0 if v[y, x] == 0 else abs(g - (level[v != 0] <= level[y, x]).mean()) < 1e-9
    tiled = [r.v for r in image.local_equalise(df, "v", 24, 24, 4, 0.02).collect()]
    assert all(0 <= g <= 1 + 1e-9 for g in tiled) and sum(g == 0 for g in tiled) >= 40


def scan_rows(rng, n=260):
    return rng.random(n) * 4 - 2, rng.random(n) * 4 - 2, rng.random(n) * 2 - 1, rng.integers(1, 99, n), rng.integers(1, 8, n)


@pytest.mark.parametrize("dataset", ["FORESTSEMANTIC", "SEMANTIC3D", "INLUT3D"])
def test_steps_on_two_scans_of_each_data_set(spark, tmp_path, dataset, monkeypatch):
    monkeypatch.setitem(steps.CANVASES, dataset, ((0.0, 180.0), (0.0, 360.0), 15.0, 15.0))  # a small canvas
    rng, scale = np.random.default_rng(5), {"a": 1, "b": 1000}
    (tmp_path / "in").mkdir()
    for name, k in scale.items():
        x, y, z, i, c = scan_rows(rng)
        if dataset == "FORESTSEMANTIC":
            (tmp_path / "in" / f"{name}.csv").write_text("X,Y,Z,Intensity,Classification\n" + "".join(f"{p:.4f},{q:.4f},{r:.4f},{int(s) * k},{t}\n" for p, q, r, s, t in zip(x, y, z, i, c, strict=True)))
        elif dataset == "SEMANTIC3D":
            (tmp_path / "in" / f"{name}.txt").write_text("".join(f"{p:.4f} {q:.4f} {r:.4f} {int(s) * k} 10 200 {t}\n" for p, q, r, s, t in zip(x, y, z, i, c, strict=True)))
        else:
            (tmp_path / "in" / f"{name}.pts").write_text(f"{len(x)}\n" + "".join(f"{p:.4f} {q:.4f} {r:.4f} {s} 0 0 {t} 1\n" for p, q, r, s, t in zip(x, y, z, i, c, strict=True)))
    config = {"dataset": dataset, "input": {"base": str(tmp_path / "in")}, "output": str(tmp_path / "out"), "calc_geom_feature": {"base_radius": 0.3, "max_radius": 0.8}, "color_groups": ["izr", "pca"]}
    out = steps.run(spark, config, ["calc_geom_feature", "spherical_projection", "back_projection"])
    features, cube = out["calc_geom_feature"], out["spherical_projection"]
    spans = features.groupBy("scan_id").agg(F.min("Intensity").alias("lo"), F.max("Intensity").alias("hi"), F.count("*").alias("n")).collect()
    assert len(spans) == 2 and all((r.lo, r.hi) == (0.0, 1.0) and r.n > 200 for r in spans)  # each scan by its own extremes
    order = image.channel_order(dataset == "SEMANTIC3D")
    assert cube.columns[3 : 3 + len(order)] == order and len(order) == (24 if dataset == "SEMANTIC3D" else 21)
    assert [r.n for r in cube.groupBy("scan_id").agg(F.count("*").alias("n")).collect()] == [12 * 24] * 2  # every pixel of the canvas
    void = cube.where("density = 0").first()
    assert void.intensity == 0 and (dataset != "SEMANTIC3D" or np.isclose(void.r, 180 / 255))
    if dataset == "SEMANTIC3D":
        assert "class_id" not in cube.columns  # these files carry no labels
    else:
        seen = {r.class_id for r in cube.where("density > 0").select("class_id").distinct().collect()}
        assert void.class_id == 0 and (7 in seen) == (dataset == "INLUT3D")  # class 7 leaves forest scans only
    pcs = cube.groupBy("scan_id").agg(F.var_pop("PCA1").alias("a"), F.var_pop("PCA2").alias("b"), F.corr("PCA1", "PCA2").alias("r")).collect()
    assert all(r.a >= r.b and abs(r.r) < 1e-6 for r in pcs)
    assert out["back_projection"].where("PCA1 IS NULL").count() == 0
