import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanforge.operators import decode
from scanforge.plans import steps
from scanforge.schema import canvas_size, colour_map, label_map
from scanforge.sources import binary, text
from scanforge.streaming import scans


def test_mangrove_with_and_without_header(spark, tmp_path):
    row = "1,2,3,90,45,4,100,1"
    (tmp_path / "a.txt").write_text("X,Y,Z,zenith,azimuth,rangemeter,Intensity,Return Number\n" + row + "\n")
    (tmp_path / "b.txt").write_text(row + "\n" + row + "\n")
    counts = {r.scan_id: r.n for r in text.read_mangrove(spark, str(tmp_path)).groupBy("scan_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {"a.txt": 1, "b.txt": 2}
    lost = {r.scan_id: r.n for r in text.read_mangrove(spark, str(tmp_path), header_row_lost=True).groupBy("scan_id").agg(F.count("*").alias("n")).collect()}
    assert lost == {"a.txt": 1, "b.txt": 1}
    flipped = text.read_mangrove(spark, str(tmp_path / "a.txt"), flip=True).first()
    assert (flipped.Z, flipped.elevation) == (-3.0, 0.0)


def test_positions_follow_the_file(spark, tmp_path):
    (tmp_path / "a.label").write_text("".join(f"{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        rows = text.read_labels(spark, str(tmp_path / "a.label")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5000 and all(r.point_id == r.label for r in rows)


def test_pts_semantic3d_and_features(spark, tmp_path):
    (tmp_path / "a.pts").write_text("2\n1 2 3 255 0 0 4 7\n4 5 6 0 0 0 5 8\n")
    out = text.read_pts(spark, str(tmp_path / "a.pts")).orderBy("point_id").collect()
    assert [(r.point_id, r.X, r.class_id, round(r.Intensity, 6)) for r in out] == [(0, 1.0, 4, round(1 / 3, 6)), (1, 4.0, 5, 0.0)]
    (tmp_path / "s.txt").write_text("1 2 3 9 1 2 3\n4 5 6 8 1 2 3\n")
    (tmp_path / "s.labels").write_text("0\n8\n")
    (tmp_path / "short.labels").write_text("0\n")
    assert sorted(r.label for r in text.read_semantic3d(spark, str(tmp_path / "s.txt"), str(tmp_path / "s.labels")).collect()) == [0, 8]
    (tmp_path / "f.csv").write_text("x,Y,Z\n1,2,3\n")
    assert text.read_features(spark, str(tmp_path / "f.csv"), ["X", "Z"]).first().X == 1.0
    with pytest.raises(ValueError, match="W"):
        text.read_features(spark, str(tmp_path / "f.csv"), ["W"])
    with pytest.raises(ValueError, match="unknown data set"):
        text.read_points(spark, str(tmp_path), "NOPE")


def test_las_and_ply_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    f = pd.DataFrame({"X": rng.random(50), "Y": rng.random(50), "Z": rng.random(50), "Intensity": np.arange(50), "class_id": np.arange(50) % 3, "r": np.arange(50), "g": np.arange(50), "b": np.arange(50)})
    (tmp_path / "one.las").write_bytes(binary.las_bytes(f))
    out = binary.read_las(spark, str(tmp_path / "one.las")).orderBy("point_id").toPandas()
    assert np.allclose(out[["X", "Y", "Z"]], f[["X", "Y", "Z"]], atol=6e-4) and list(out["class_id"]) == list(f["class_id"]) and out["r_unit"].max() == 1
    df = spark.createDataFrame(f.assign(scan_id="s"))
    rows = binary.write_scans(df, str(tmp_path / "out")).collect()
    assert rows[0].n == 33  # class 0 is left out
    assert binary.read_las(spark, rows[0].path, fill_intensity=False).count() == 33
    assert binary.write_scans(df, str(tmp_path / "ply"), "ply", None).first().n == 50
    assert (tmp_path / "ply" / "s.ply").read_bytes().startswith(b"ply\nformat binary_little_endian")


def test_kitti_masks_and_cubes(spark, tmp_path):
    np.arange(8, dtype="<f4").tofile(tmp_path / "a.bin")
    assert [r.Intensity for r in binary.read_kitti(spark, str(tmp_path / "a.bin")).orderBy("point_id").collect()] == [3.0, 7.0]
    mask = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (binary.png_array(binary.png_bytes(mask))[..., 0] == mask).all()
    df = spark.createDataFrame([("m", y, x, int(mask[y, x])) for y in range(3) for x in range(4)], "scan_id string, y_pix int, x_pix int, class_id int")
    path = binary.write_masks(df, str(tmp_path / "png"), 3, 4).first().path
    assert {(r.y_pix, r.x_pix, r.class_id) for r in binary.read_masks(spark, path).collect()} == {(y, x, int(mask[y, x])) for y in range(3) for x in range(4)}
    np.save(tmp_path / "c.npy", np.arange(12.0).reshape(2, 3, 2))
    assert binary.read_cube(spark, str(tmp_path / "c.npy"), ["u", "v"]).agg(F.sum("v")).first()[0] == 36


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", i, float(i), 0.0, 0.0, 1, i % 3) for i in range(100)], "scan_id string, point_id long, X double, Y double, Z double, Intensity int, label int")
    text.write_labels(df.repartition(3), str(tmp_path / "labels"))
    got = [int(x) for p in sorted((tmp_path / "labels" / "scan_id=a").glob("part-*")) for x in p.read_text().split()]
    assert got == [i % 3 for i in range(100)]
    text.write_ascii_pcd(df, str(tmp_path / "pcd"))
    first = sorted((tmp_path / "pcd").glob("part-*"))[0].read_text()
    assert first.startswith("# .PCD") and "POINTS 100" in first
    text.write_profile(str(tmp_path / "profile"), df.select("scan_id", "X"), k=5)
    back, meta = text.read_profile(spark, str(tmp_path / "profile"))
    assert back["density_vs_range"].count() == 100 and meta["k"] == 5 and meta["mode"] == "single"


def test_label_and_colour_maps(spark, tmp_path):
    (tmp_path / "maps.json").write_text(json.dumps({"DATASETS": {"S": {"COLOR_TO_INDEX": {"0.6,0,1.0": 1}, "CLASS_NAMES": {"1": "Stem"}}}}))
    colours, names = label_map(spark, str(tmp_path / "maps.json"), "S")
    assert colours.first().asDict() == {"r": 153, "g": 0, "b": 255, "class_id": 1} and names.first().name == "Stem"
    (tmp_path / "labels.json").write_text(json.dumps([{"code": 1, "color": [255, 0, 51]}, {"code": 18, "color": [1, 1, 1]}]))
    assert colour_map(spark, str(tmp_path / "labels.json")).first().asDict() == {"code": 1, "r": 1.0, "g": 0.0, "b": 0.2}
    assert canvas_size((0, 135), (0, 360), 0.25, 0.25) == (540, 1440)


def test_raw_scan_to_returns(spark):
    head = " ".join(["0"] * 19 + ["64"])
    block = lambda name, values: f"{name} 3F800000 0 0 9C4 2 {values} "
    line = head + " " + block("DIST1", "3E8 7D0") + block("DIST2", "0 BB8") + block("RSSI1", "A B") + block("RSSI2", "0 C")
    files = spark.createDataFrame([("a", line + "\x03broken\x03" + line)], "scan_id string, value string")
    out = decode.decode(files).orderBy("line", "pulse", "return_number").collect()
    assert [(r.line, r.pulse, r.return_number, r.rangemeter, r.n_returns) for r in out] == [(0, 0, 1, 1.0, 1), (0, 1, 1, 2.0, 2), (0, 1, 2, 3.0, 2), (2, 0, 1, 1.0, 1), (2, 1, 1, 2.0, 2), (2, 1, 2, 3.0, 2)]
    assert decode.scan_info(decode.parse_lines(decode.scan_lines(files))).first().asDict() == {"scan_id": "a", "n_lines": 2, "most_pulses": 2, "n_pulses": 4, "n_valid": 4}


def test_running_stats_equal_batch(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("label,v\n" + "".join(f"{i % 2},{i + k}\n" for i in range(10)))
    stream = scans.scan_stream(spark, str(tmp_path), "label int, v double")
    out = {r.label: (r.valid, r.mean) for r in scans.drain(scans.running_stats(stream, "v", "label"), "running_stats").collect()}
    assert out == {0: (15, 5.0), 1: (15, 6.0)}


def test_unknown_steps_are_refused(spark):
    with pytest.raises(ValueError, match="unknown steps"):
        steps.run(spark, {"dataset": "FORESTSEMANTIC"}, ["nope"])
