"""The steps from a scan to its image channels and back, and a runner by name."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.operators import files, geom, image, points, raster, refine
from scanforge.schema import CANVASES, canvas_size
from scanforge.session import session
from scanforge.sources import text
from scanforge.tables import written

#: Fixed values by data set: class of an unseen pixel, the class that projections leave out, and the colour of unseen pixels.
VOID = {"SEMANTIC3D": 9}
LEFT_OUT = {"FORESTSEMANTIC": 7}
VOID_RGB = {"r": 180 / 255, "g": 170 / 255, "b": 255 / 255}
#: Contrast: how many percent each end of the values loses.
STRETCH = {"intensity_adjusted": 0.1, "z_inv_adjusted": 0.0, "range_adjusted": 0.0}
SHAPES = ("curvature", "anisotropy", "planarity")


def calc_geom_feature(df: DataFrame, config: dict) -> DataFrame:
    """Cleaned points with neighbourhood features, each scan by itself."""
    f = config.get("calc_geom_feature", {})
    cleaned = written(points.clean(df, f.get("cut_percent", 0.6)), "cleaned")
    by = ("scan_id",) if "scan_id" in cleaned.columns else ()
    features = geom.geometric_features(cleaned, f.get("base_radius", 0.05), f.get("max_radius", 0.2), f.get("max_neighbors", 50), by)
    return cleaned.join(features.select(*by, "point_id", *SHAPES, "roughness", "nx", "ny", "nz"), [*by, "point_id"])


def prepared(df: DataFrame, dataset: str) -> DataFrame:
    """Points with pixels, normal colours, inverted height and 0-1 colours; values checked; the left-out class dropped after its elevation counted."""
    v_fov, h_fov, v_res, h_res = CANVASES[dataset.upper()]
    height, width = canvas_size(v_fov, h_fov, v_res, h_res)
    px = points.to_pixels(df, height, width, v_res, h_res)
    px = points.assert_valid(points.invert_height(points.normal_colours(px)))
    if dataset.upper() == "SEMANTIC3D" and "r" in px.columns:
        px = points.unit_rgb(px)
    if dataset.upper() in LEFT_OUT and "class_id" in px.columns:
        px = points.drop_class(px, LEFT_OUT[dataset.upper()])
    return px


def projection_channels(px: DataFrame, dataset: str, height: int, width: int) -> DataFrame:
    """The dense raster of prepared points: raw and adjusted intensity, height and range, shapes scaled to 0-1, normal colours, density, and where there are any, colours and the class mask."""
    coloured = all(c in px.columns for c in "rgb") and dataset.upper() == "SEMANTIC3D"
    raw = {"Intensity": "intensity", "Z": "z_inv", "rangemeter": "range"}
    names = [*raw, *SHAPES, "n_r", "n_g", "n_b", *("rgb" if coloured else ()), *(["class_id"] if "class_id" in px.columns else [])]
    flat = raster.nearest_per_pixel(px, names, ["point_id"]).withColumnsRenamed(raw)
    fills: dict[str, object] = {c: 0.0 for c in [*raw.values(), *SHAPES, "n_r", "n_g", "n_b"]} | {"density": 0}
    fills |= VOID_RGB if coloured else {}
    fills |= {"class_id": VOID.get(dataset.upper(), 0)} if "class_id" in names else {}
    dense = raster.densify(flat, height, width, fills)
    dense = dense.withColumns({a: F.col(a.removesuffix("_adjusted")) for a in STRETCH})
    for name, percent in STRETCH.items():
        # each contrast reads its image several times: written once, the plans don't multiply
        stretched = written(image.stretch(written(dense, "channels"), name, percent), "channels")
        dense = image.equalise(stretched, name)
    return image.min_max_scale(written(dense, "channels"), list(SHAPES))


def spherical_projection(df: DataFrame, config: dict) -> DataFrame:
    """The image cube's channels of every pixel of the canvas, in order, with density and the class mask; each scan is an image of its own."""
    dataset = config["dataset"]
    v_fov, h_fov, v_res, h_res = CANVASES[dataset.upper()]
    channels = written(projection_channels(prepared(df, dataset), dataset, *canvas_size(v_fov, h_fov, v_res, h_res)), "projection")
    cube = image.assemble_cube(channels)
    more = [c for c in ("density", "class_id") if c in channels.columns]
    return cube.join(channels.select("scan_id", "y_pix", "x_pix", *more), ["scan_id", "y_pix", "x_pix"])


def normal_image(px: DataFrame, height: int, width: int) -> DataFrame:
    """Normal colours of the nearest points, black where nothing was seen."""
    flat = raster.nearest_per_pixel(px, ["n_r", "n_g", "n_b"], ["point_id"])
    return raster.densify(flat, height, width, {"n_r": 0.0, "n_g": 0.0, "n_b": 0.0})


def back_projection(df: DataFrame, channels: DataFrame, config: dict) -> DataFrame:
    """Points with their pixel's colours; black outside the image."""
    v_fov, h_fov, v_res, h_res = CANVASES[config["dataset"].upper()]
    px = points.to_pixels(df, *canvas_size(v_fov, h_fov, v_res, h_res), v_res, h_res)
    wanted = [c for g in config.get("color_groups", ["izr"]) for c in points.colour_group(channels, g)]
    px = px.drop(*[c for c in wanted if c in px.columns])
    return raster.look_up_pixels(px, channels, dict.fromkeys(wanted, 0.0))


def refine_labels(df: DataFrame, config: dict) -> DataFrame:
    r = config.get("refine", {})
    return refine.refine(df, r.get("features", ["curvature", "anisotropy", "planarity", "roughness"]), r.get("k", 50), r.get("threshold", 0.8), r.get("confidence", 0.85))


STEPS: dict[str, Callable[..., DataFrame]] = {
    "calc_geom_feature": calc_geom_feature,
    "spherical_projection": spherical_projection,
    "back_projection": back_projection,
    "refine_labels": refine_labels,
}


def read_input(spark: SparkSession, config: dict) -> DataFrame:
    """The points of ``config["input"]``: a path, or a listing {"base", "suffix", "selected_scans": [from, to], "numeric"} of files in order."""
    given = config["input"]
    if isinstance(given, dict):
        first, last = given.get("selected_scans") or (0, None)
        given = files.chosen_inputs(files.listing(spark, given["base"]), given.get("suffix", ""), first, last, given.get("numeric", False))
        if not given:
            raise ValueError("no input files")
    return text.read_points(spark, given, config["dataset"])


def run(spark: SparkSession, config: dict, steps: list[str]) -> dict[str, DataFrame]:
    """The named steps over ``config["input"]``, each a table under ``config["output"]``, stopping at the first error."""
    unknown = [s for s in steps if s not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps {unknown}; there are {list(STEPS)}")
    out: dict[str, DataFrame] = {}
    frame = read_input(spark, config)
    for step in steps:
        args = (out["calc_geom_feature"], out["spherical_projection"]) if step == "back_projection" else (frame,)
        made = STEPS[step](*args, config)
        path = f"{config['output']}/{step}"
        made.write.mode("overwrite").parquet(path)
        out[step] = spark.read.parquet(path)
        frame = out[step] if step == "calc_geom_feature" else frame
    return out


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--config", required=True, help="JSON file")
    parser.add_argument("--steps", nargs="+", default=["calc_geom_feature", "spherical_projection"], choices=list(STEPS))
    args = parser.parse_args(argv)
    with open(args.config) as f:
        run(session(), json.load(f), args.steps)


if __name__ == "__main__":
    main()
