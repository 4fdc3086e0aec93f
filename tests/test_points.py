import math

import pytest
from pyspark.sql import functions as F

from scanforge.operators import generate, points, raster


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


XYZ = "X double, Y double, Z double"


def test_angles_of_edge_points(spark):
    rows = [(0.0, 0.0, 0.0), (-1.0, -1.0, 0.0), (0.0, 0.0, -2.0)]
    a, b, c = points.add_angles(frame(spark, rows, XYZ)).collect()
    assert (a.zenith, a.rangemeter, a.azimuth) == (0, 0, 0)
    assert (round(b.azimuth, 9), round(b.zenith, 9), round(b.elevation, 9)) == (225, 90, 0)
    assert (round(c.zenith, 9), round(c.elevation, 9), c.rangemeter) == (180, -90, 2)


def test_angles_need_coordinates_and_refuse_a_second_time(spark):
    with pytest.raises(ValueError, match="missing"):
        points.add_angles(frame(spark, [(1.0,)], "X double"))
    done = points.add_angles(frame(spark, [(1.0, 2.0, 3.0)], XYZ))
    with pytest.raises(ValueError, match="already"):
        points.add_angles(done)


def test_cut_keeps_both_bounds(spark):
    df = frame(spark, [(0.01, 1.0), (0.009, 1.0), (5.0, 2.0), (9.0, 3.0)], "rangemeter double, Intensity double")
    assert sorted(r.rangemeter for r in points.cut_outliers(df, 0.0).collect()) == [0.01, 5.0, 9.0]


def test_intensity_ignores_nan_and_incomplete_rows_go(spark):
    df = frame(spark, [(1.0, 2.0), (float("nan"), 1.0), (3.0, None), (5.0, 4.0)], "Intensity double, v double")
    out = points.drop_incomplete(points.normalise_intensity(df)).collect()
    assert [(r.Intensity, r.v) for r in out] == [(0.0, 2.0), (1.0, 4.0)]


def test_pixels_are_clipped(spark):
    df = frame(spark, [("a", 360.0, -45.0), ("a", 0.0, 45.0), ("a", -3.0, 44.9)], "scan_id string, azimuth double, elevation double")
    out = points.to_pixels(df, 18, 72, 5.0, 5.0).collect()
    assert sorted((r.x_pix, r.y_pix) for r in out) == [(0, 0), (0, 1), (71, 17)]


def test_upward_normal_colour_and_flip(spark):
    df = frame(spark, [(0.0, 0.0, 1.0)], "nx double, ny double, nz double")
    r = points.normal_colours(df).first()
    assert (max(r.n_r, r.n_g, r.n_b), round(min(r.n_r, r.n_g, r.n_b), 6)) == (1.0, 0.4)
    down = points.normal_colours(frame(spark, [(0.0, 0.0, -1.0)], "nx double, ny double, nz double")).first()
    assert max(down.n_r, down.n_g, down.n_b) == 1.0
    with pytest.raises(ValueError):
        points.check_normals(frame(spark, [(0.0, 0.0, 1.5)], "nx double, ny double, nz double"))


def test_rotation_keeps_distances_and_recentre_moves_the_mean(spark):
    df = frame(spark, [(1.0, 2.0, 3.0), (4.0, 6.0, 5.0)], XYZ)
    c, s = math.cos(0.3), math.sin(0.3)
    a, b = points.rotate_xy(df, ((c, -s), (s, c))).collect()
    assert math.isclose(math.dist((a.X, a.Y), (b.X, b.Y)), 5.0)
    at = frame(spark, [(1, 1.0, 2.0)], "position_id int, tx double, ty double")
    out = points.recentre(df, at).collect()
    assert (out[0].X, out[0].Y) == (0.0, 0.0) and sum(r.Z for r in out) == 0


def test_validation_and_channels(spark):
    bad = frame(spark, [(1.0, -1.0, 0.0, 1.0)], "Intensity double, azimuth double, zenith double, rangemeter double")
    with pytest.raises(ValueError, match="azimuth"):
        points.assert_valid(bad)
    with pytest.raises(ValueError, match="no channels"):
        points.select_channels(bad, ["x"])
    with pytest.raises(ValueError, match="unknown colour group"):
        points.colour_group(bad, "nope")


def test_ball_gives_one_return_a_pixel(spark):
    ball = generate.ball(spark, 5, (5, 175)).drop("azimuth", "zenith").withColumn("scan_id", F.lit("a"))
    px = points.to_pixels(points.add_angles(ball), 36, 72, 5.0, 5.0)
    assert px.count() == 72 * 35


def test_nearest_per_pixel_ties_and_nan(spark):
    rows = [("a", 0, 0, 2, 1.0), ("a", 0, 0, 1, 1.0), ("a", 0, 0, 3, float("nan")), ("a", 0, 1, 4, None)]
    df = frame(spark, rows, "scan_id string, y_pix int, x_pix int, point_id int, rangemeter double")
    out = {(r.y_pix, r.x_pix): (r.point_id, r.density) for r in raster.nearest_per_pixel(df.withColumn("p", F.col("point_id")), ["point_id"], ["p"]).collect()}
    assert out == {(0, 0): (1, 3), (0, 1): (4, 1)}


def test_mode_tie_takes_the_least(spark):
    df = frame(spark, [("a", 0, 0, 3), ("a", 0, 0, 2)], "scan_id string, y_pix int, x_pix int, label int")
    assert raster.mode_per_pixel(df, "label").first().label == 2


def test_labels_must_match_in_length(spark):
    pts = frame(spark, [("a", 0), ("a", 1), ("a", 2)], "scan_id string, point_id long")
    with pytest.raises(ValueError, match="length"):
        raster.attach_labels(pts, frame(spark, [("a", 0, 1), ("a", 1, 1)], "scan_id string, point_id long, label int"))


def test_last_palette_entry_wins(spark):
    px = frame(spark, [(1, 1, 1), (200, 0, 0)], "r int, g int, b int")
    assert [r.class_id for r in raster.match_palette(px, [(0, 0, 0, 4), (2, 2, 2, 7)]).collect()] == [7, 0]


def test_densify_lookup_and_fill(spark):
    df = frame(spark, [("a", 0, 1, 5)], "scan_id string, y_pix int, x_pix int, class_id int")
    dense = raster.densify(df, 2, 2, {"class_id": 9})
    assert sorted((r.y_pix, r.x_pix, r.class_id) for r in dense.collect()) == [(0, 0, 9), (0, 1, 5), (1, 0, 9), (1, 1, 9)]
    holes = frame(spark, [(0, 0, 5), (0, 3, None), (9, 9, 2)], "y_pix int, x_pix int, class_id int")
    assert {(r.y_pix, r.x_pix): r.class_id for r in raster.fill_from_nearest(holes).collect()} == {(0, 0): 5, (0, 3): 5, (9, 9): 2}


def test_median_blur(spark):
    df = frame(spark, [(y, x, float(y == 1 and x == 1)) for y in range(3) for x in range(3)], "y_pix int, x_pix int, v double")
    assert {r.v for r in raster.median_blur(df, "v", 1).collect()} == {0.0}
