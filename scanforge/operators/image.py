"""Whole-image statistics, contrast and component analysis of rasters in wide form."""

from __future__ import annotations

import random
import warnings
from collections.abc import Callable, Iterator
from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanforge.operators.histogram import histogram
from scanforge.operators.points import scans_of, with_stats
from scanforge.operators.quantile import with_quantiles
from scanforge.tables import join_groups, join_on, written


def min_max_scale(df: DataFrame, channels: list[str], by: str | None = "scan_id") -> DataFrame:
    """Each channel to 0-1 over the scan's (dense) image."""
    stats = {f"_lo_{c}": F.min(c) for c in channels} | {f"_hi_{c}": F.max(c) for c in channels}
    scaled = {c: (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + 1e-8) for c in channels}
    return with_stats(df, scans_of(df, by), **stats).withColumns(scaled).drop(*stats)


def z_score(df: DataFrame, channels: list[str], by: str | None = "scan_id") -> DataFrame:
    """Population z-scores of the scan's image; a constant channel is divided by 1e-8."""
    stats = {f"_m_{c}": F.avg(c) for c in channels} | {f"_s_{c}": F.stddev_pop(c) for c in channels}
    sd = lambda c: F.when(F.col(f"_s_{c}") == 0, 1e-8).otherwise(F.col(f"_s_{c}"))
    return with_stats(df, scans_of(df, by), **stats).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / sd(c) for c in channels}).drop(*stats)


def correlations(df: DataFrame, channels: list[str]) -> DataFrame:
    """(a, b, r) for each pair of channels, from one pass."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in combinations(channels, 2)]
    return df.agg(F.array(*pairs).alias("p")).select(F.inline("p"))


def stretch(df: DataFrame, value: str, percent: float, void: float = 0.0, by: str | None = "scan_id") -> DataFrame:
    """Values of the scan that aren't void, clipped to two percentiles and scaled to 0-1; void stays."""
    scan = scans_of(df, by)
    seen = F.when(F.col(value) != void, F.col(value))
    df = with_quantiles(df, {"_lo": (seen, percent / 100), "_hi": (seen, 1 - percent / 100)}, (scan,) if scan else ())
    cut = F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi"))
    scaled = (cut - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return df.withColumn(value, F.when(F.col(value) == void, F.col(value)).otherwise(F.coalesce(scaled, F.lit(0.0)))).drop("_lo", "_hi")


def equalise(df: DataFrame, value: str, void: float = 0.0, bins: int = 256, by: str | None = "scan_id") -> DataFrame:
    """Histogram equalisation: the cumulative share of the scan's non-void values, linear between bin centres.

    Left of the first centre the first share holds, so void pixels get that share too.
    A scan's table of ``bins`` shares is one row.
    """
    scan = scans_of(df, by)
    keys = [scan] if scan else []
    seen = df.where(F.col(value) != void)
    counts = histogram(seen, value, bins, scan)
    running = counts.withColumn("cdf", F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")) / F.sum("n").over(Window.partitionBy(*keys)))  # ``bins`` rows a scan
    shares = running.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "cdf"))), lambda x: x["cdf"]).alias("_cdf"))
    span = seen.groupBy(*keys).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    df = join_groups(df, span.join(shares, keys), keys, "left", nulls=False) if keys else df.crossJoin(F.broadcast(span)).crossJoin(F.broadcast(shares))
    width = F.nullif((F.col("_hi") - F.col("_lo")) / bins, F.lit(0.0))
    at = F.coalesce((F.col(value) - F.col("_lo")) / width - 0.5, F.lit(0.0))
    at = F.least(F.greatest(at, F.lit(0.0)), F.lit(bins - 1.0))
    below = F.least(F.floor(at), F.lit(bins - 2)).cast("int")
    left, right = F.get("_cdf", below), F.get("_cdf", below + 1)
    # a scan without any value that isn't void stays as it is
    return df.withColumn(value, F.coalesce(left + (right - left) * (at - below), F.col(value).cast("double"))).drop("_lo", "_hi", "_cdf")


def local_equalise(df: DataFrame, value: str, height: int, width: int, tiles: int = 8, clip: float = 0.01, bins: int = 256, void: float = 0.0, by: str | None = "scan_id") -> DataFrame:
    """Contrast-limited equalisation by tiles: each tile's histogram of non-void values is cut at ``clip`` of its pixels (one at least), what is cut is spread over all bins, and a pixel's value is interpolated between the shares of the four tiles around it.

    Values are first scaled to the scan's extremes.  A tile's shares are one row of ``bins`` numbers; void stays void.
    """
    scan = scans_of(df, by)
    keys = [scan] if scan else []
    seen = F.when(F.col(value) != void, F.col(value).cast("double"))
    df = with_stats(written(df, "to-equalise"), scan, _lo=F.min(seen), _hi=F.max(seen))
    level = F.when(seen.isNotNull(), F.least(F.floor((seen - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins), F.lit(bins - 1))).cast("int")
    tile = lambda c, n: F.least(F.floor(F.col(c) * tiles / n), F.lit(tiles - 1)).cast("int")
    df = df.withColumns({"_b": level, "_ty": tile("y_pix", height), "_tx": tile("x_pix", width)})
    counts = df.where("_b IS NOT NULL").groupBy(*keys, "_ty", "_tx", "_b").agg(F.count("*").alias("n"))
    rows = counts.groupBy(*keys, "_ty", "_tx").agg(F.map_from_entries(F.collect_list(F.struct("_b", "n"))).alias("m"), F.sum("n").alias("all"))  # ``bins`` entries at most
    rows = rows.withColumn("most", F.greatest(F.lit(1.0), F.lit(clip) * F.col("all")))
    each = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)).cast("double"))
    rows = rows.withColumn("h", each)
    over = F.aggregate("h", F.lit(0.0), lambda a, x: a + F.greatest(x - F.col("most"), F.lit(0.0)))
    rows = rows.withColumn("spread", over / bins)
    share = F.transform("h", lambda x: (F.least(x, F.col("most")) + F.col("spread")) / F.col("all"))
    running = F.aggregate(share, F.array().cast("array<double>"), lambda a, x: F.array_append(a, x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0))))
    shares = rows.select(*keys, F.struct("_ty", "_tx").alias("t"), running.alias("cdf"))
    tables = shares.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("t._ty") * tiles + F.col("t._tx"), "cdf"))).alias("_tables"))  # tiles x tiles rows
    df = join_groups(df, tables, keys, "left", nulls=False) if keys else df.crossJoin(F.broadcast(tables))  # one row
    at = lambda c, n: (F.col(c) + 0.5) * tiles / n - 0.5
    y, x = at("y_pix", height), at("x_pix", width)
    clipped = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(tiles - 1)).cast("int")
    y0, x0 = F.floor(y), F.floor(x)
    look = lambda ty, tx: F.get(F.try_element_at("_tables", clipped(ty) * tiles + clipped(tx)), F.col("_b"))
    total = weight = F.lit(0.0)
    for dy, wy in ((0, 1 - (y - y0)), (1, y - y0)):
        for dx, wx in ((0, 1 - (x - x0)), (1, x - x0)):
            found = look(y0 + dy, x0 + dx)  # a tile without values has no share
            total = total + F.coalesce(found * wy * wx, F.lit(0.0))
            weight = weight + F.when(found.isNotNull(), wy * wx).otherwise(F.lit(0.0))
    made = F.least(total / F.nullif(weight, F.lit(0.0)), F.lit(1.0))
    return df.withColumn(value, F.when(F.col("_b").isNull(), F.lit(void)).otherwise(F.coalesce(made, F.lit(0.0)))).drop("_lo", "_hi", "_b", "_ty", "_tx", "_tables")


def log_contrast(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn(value, F.log1p(value))


def _keyed(df: DataFrame, by: str | None) -> DataFrame:
    """``df`` with the image it belongs to as ``_image``, never NULL."""
    scan = scans_of(df, by)
    return df.withColumn("_image", F.coalesce(F.to_json(F.struct(F.col(scan))), F.lit("")) if scan else F.lit(""))


def covariances(df: DataFrame, channels: list[str]) -> DataFrame:
    """(_image, cov): the channels' covariance matrix of each image, row by row, from one aggregate."""
    n = len(channels)
    upper = {(i, j): F.coalesce(F.covar_samp(channels[i], channels[j]), F.lit(0.0)) for i in range(n) for j in range(i, n)}
    return df.groupBy("_image").agg(F.array(*[upper[min(i, j), max(i, j)] for i in range(n) for j in range(n)]).alias("cov"))


def _oriented(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest loading positive."""
    return vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])])


def _solved(rows: DataFrame, columns: list[str], solve: Callable[..., np.ndarray]) -> DataFrame:
    """(_image, weights): ``solve`` of each image's square matrices, a small row each."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            matrices = [[np.reshape(v, (int(len(v) ** 0.5), -1)) for v in frame[c]] for c in columns]
            yield pd.DataFrame({"_image": frame["_image"], "weights": [np.asarray(solve(*m), dtype=np.float64).ravel().tolist() for m in zip(*matrices, strict=True)]})

    return rows.select("_image", *columns).mapInPandas(each, "_image string, weights array<double>")


def _projected(df: DataFrame, channels: list[str], weights: DataFrame, names: list[str]) -> DataFrame:
    """``names`` as weighted sums of the channels; ``weights`` hold a row of channels x names for each image."""

    def component(k: int) -> Column:
        terms = [F.get("weights", i * len(names) + k) * F.col(c) for i, c in enumerate(channels)]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    return join_groups(df, weights, ["_image"], nulls=False).withColumns({n: component(k) for k, n in enumerate(names)}).drop("weights")


def _principal(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(cov)
    top = values.argsort()[::-1][:k]
    return values[top], vectors[:, top]


def pca(df: DataFrame, channels: list[str], k: int = 3, by: str | None = "scan_id") -> DataFrame:
    """PCA1 .. PCAk of each image's z-scored channels; signs make the largest loading positive."""
    scaled = _keyed(z_score(df, channels, by), by)
    weights = _solved(covariances(scaled, channels), ["cov"], lambda cov: _oriented(_principal(cov, k)[1]))
    return _projected(scaled, channels, weights, [f"PCA{i + 1}" for i in range(k)]).drop("_image")


def noise(df: DataFrame, channels: list[str], order: tuple[str, ...] = ("y_pix", "x_pix"), by: tuple[str, ...] = ()) -> DataFrame:
    """Differences of neighbours in raster order, H * W - 1 of an image; a window holds one image row, and each row hands its last pixel on to the next."""
    *outer, inner = order
    lines = [*by, *outer]
    pixel = F.struct(*[F.col(c).cast("double").alias(c) for c in channels])
    last = df.groupBy(*lines).agg(F.max_by(pixel, inner).alias("_last"))
    carried = last.select(*lines, F.lag("_last").over(Window.partitionBy(*by).orderBy(*outer)).alias("_carried"))  # one row an image row
    inside = df.select(*lines, pixel.alias("_own"), F.lag(pixel).over(Window.partitionBy(*lines).orderBy(inner)).alias("_prior"))
    both = join_on(inside, carried, lines).withColumn("_prior", F.coalesce("_prior", "_carried")).where("_prior is not null")
    return both.select(*by, *[(F.col("_own")[c] - F.col("_prior")[c]).alias(c) for c in channels])


def mnf(df: DataFrame, channels: list[str], k: int = 3, order: tuple[str, ...] = ("y_pix", "x_pix"), by: str | None = "scan_id") -> DataFrame:
    """MNF1 .. MNFk: each image's directions of greatest signal to noise, the symmetric generalised eigenproblem."""
    scaled = _keyed(z_score(df, channels, by), by)
    both = covariances(scaled, channels).join(covariances(noise(scaled, channels, order, ("_image",)), channels).withColumnRenamed("cov", "rest"), "_image")

    def solve(signal: np.ndarray, rest: np.ndarray) -> np.ndarray:
        root = np.linalg.inv(np.linalg.cholesky(rest + 1e-9 * np.eye(len(channels))))
        return _oriented(root.T @ _principal(root @ signal @ root.T, k)[1])

    return _projected(scaled, channels, _solved(both, ["cov", "rest"], solve), [f"MNF{i + 1}" for i in range(k)]).drop("_image")


def ica(df: DataFrame, channels: list[str], k: int = 3, rounds: int = 200, seed: int = 0, tolerance: float = 1e-4, by: str | None = "scan_id") -> DataFrame:
    """ICA1 .. ICAk of each image by the fixed point with tanh: each round is one aggregate over the whitened components of all images at once.

    Rounds end when no direction turns by more than the tolerance (of its cosine).  A warning says so if some images still move after the last.
    """
    scaled = _keyed(z_score(df, channels, by), by)
    names = [f"_w{i}" for i in range(k)]

    def whiten(cov: np.ndarray) -> np.ndarray:
        values, vectors = _principal(cov, k)
        return vectors / np.sqrt(np.maximum(values, 1e-12))

    white = written(_projected(scaled, channels, _solved(covariances(scaled, channels), ["cov"], whiten), names), "ica-white")  # each round reads it
    first = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    unmix = written(white.select("_image").distinct().select("_image", F.array(*map(F.lit, map(float, first.ravel()))).alias("unmix")), "ica-unmix")

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, moved = [], []
            for old, moments in zip(frame["unmix"], frame["moments"], strict=True):
                old, m = np.reshape(old, (k, k)), np.asarray(moments)
                u, _, v = np.linalg.svd(m[: k * k].reshape(k, k) - m[k * k :][:, None] * old)
                out.append((u @ v).ravel().tolist())
                moved.append(float(np.abs(np.abs(np.einsum("ij,ij->i", u @ v, old)) - 1).max()))
            yield pd.DataFrame({"_image": frame["_image"], "unmix": out, "moved": moved})

    for _ in range(rounds):
        mixed = join_groups(white.select("_image", *names), unmix, ["_image"], nulls=False)
        outputs = [sum((F.get("unmix", i * k + j) * F.col(names[j]) for j in range(1, k)), F.get("unmix", i * k) * F.col(names[0])) for i in range(k)]
        tanh = [F.tanh(o) for o in outputs]
        moments = F.array(*[F.avg(t * F.col(n)) for t in tanh for n in names], *[F.avg(1 - t * t) for t in tanh])
        sums = mixed.groupBy("_image").agg(F.first("unmix").alias("unmix"), moments.alias("moments"))
        unmix = written(sums.mapInPandas(step, "_image string, unmix array<double>, moved double"), "ica-unmix")
        if (unmix.agg(F.max("moved")).first()[0] or 0.0) < tolerance:
            break
    else:
        warnings.warn(f"ICA: {unmix.where(F.col('moved') >= tolerance).count()} image(s) still move after {rounds} rounds", stacklevel=2)
    turned = F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)), lambda i: F.get("unmix", (i % k) * k + F.floor(i / k).cast("int")))
    weights = unmix.select("_image", turned.alias("weights"))
    return _projected(white, names, weights, [f"ICA{i + 1}" for i in range(k)]).drop("_image", *names)


#: The image cube's channels in order; colours come first where there are any.
RAW, FEATURES, NORMALS = ("intensity", "z_inv", "range"), ("intensity_adjusted", "z_inv_adjusted", "range_adjusted", "curvature", "anisotropy", "planarity"), ("n_r", "n_g", "n_b")


def channel_order(true_rgb: bool = False) -> list[str]:
    """The image cube's channels in order: 21, or 24 with colours."""
    return [*(("r", "g", "b") if true_rgb else ()), *RAW, *FEATURES, *NORMALS, *[f"{p}{i}" for p in ("PCA", "MNF", "ICA") for i in (1, 2, 3)]]


def assemble_cube(channels: DataFrame, keys: tuple[str, ...] = ("scan_id", "y_pix", "x_pix"), k: int = 3) -> DataFrame:
    """keys and the cube's channels in order, from dense channels: components of the features and normals are added.

    Components are fitted to each scan's own image, all scans in the same passes.
    """
    on = [c for c in keys if c in channels.columns]
    true_rgb = all(c in channels.columns for c in "rgb")
    bands = [*FEATURES, *NORMALS]
    narrow, made = channels.select(*on, *bands), channels
    for fit in (pca, mnf, ica):
        parts = fit(narrow, bands, k)
        made = made.join(parts.select(*on, *[c for c in parts.columns if c[:3] in ("PCA", "MNF", "ICA")]), on)
    return made.select(*on, *channel_order(true_rgb))


#: Notes on channels by what their names hold, the first that fits.
NOTES = (
    ("intensity", "strength of the return"), ("z_inv", "depth under the scan's lowest point"), ("range", "distance to the scanner"), ("curvature", "share of the least eigenvalue"),
    ("anisotropy", "share of the greatest eigenvalue over the middle one"), ("planarity", "share of the middle eigenvalue over the least"), ("n_", "normal as colour"),
    ("PCA", "principal component"), ("MNF", "component by signal to noise"), ("ICA", "independent component"),
)


def channel_metadata(df: DataFrame, channels: list[str], bins: int = 20) -> DataFrame:
    """channel, place, type, note, counts of its histogram and a sparkline of them: one pass for the spans, one for all counts."""
    marks = "▁▂▃▄▅▆▇█"
    kinds = dict(df.dtypes)
    note = {c: next((text for part, text in NOTES if part in c), "") for c in channels}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in channels])).alias("x")
    counts = histogram(df.select(each).select("x.*"), "value", bins, "channel")
    rows = counts.groupBy("channel").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias("counts"))
    level = lambda x: F.least(F.floor(x * len(marks) / F.nullif(F.array_max("counts"), F.lit(0))), F.lit(len(marks) - 1)).cast("int")
    line = F.array_join(F.transform("counts", lambda x: F.substr(F.lit(marks), level(x) + 1, F.lit(1))), "")
    known = df.sparkSession.createDataFrame([(c, k, kinds[c], note[c]) for k, c in enumerate(channels)], "channel string, place int, type string, note string")
    return known.join(rows, "channel").select("channel", "place", "type", "note", "counts", line.alias("sparkline"))


#: The two triples that are always shown.
FIXED_TRIPLES = (("intensity_adjusted", "z_inv_adjusted", "range_adjusted"), ("curvature", "anisotropy", "planarity"))


def rgb_combinations(channels: list[str], n: int = 3, seed: int = 617, fixed: tuple[tuple[str, str, str], ...] = FIXED_TRIPLES) -> list[tuple[str, str, str]]:
    """``n`` seeded draws from all ordered triples of channels, and the fixed triples that the channels allow."""
    drawn = random.Random(seed).sample(list(permutations(channels, 3)), n)
    return [*drawn, *[t for t in fixed if set(t) <= set(channels)]]


def component_permutations(prefix: str) -> list[tuple[str, ...]]:
    return list(permutations([f"{prefix}{i}" for i in (1, 2, 3)]))
