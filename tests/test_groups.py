"""Groups that are few and large, samples cut by counting, manifests of long ids, and whole scans in pieces."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from scanforge import tables
from scanforge.operators import generate, image, points, profile, quantile, raster, sample, spatial
from scanforge.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_statistics_of_few_scans_deal_no_points(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 3).alias("scan_id"), F.col("id").cast("double").alias("X"))
    df = df.withColumn("scan_id", F.nullif("scan_id", F.lit(2)))
    want = {(None, 998.0), (0, 999.0), (1, 997.0)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = points.with_stats(df, "scan_id", top=F.max("X"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        assert {(r.scan_id, r.top) for r in got.collect()} == want and got.count() == 1000
        numbered = tables.numbered_within(df, ["scan_id"], ["X"], row="i")
        assert "BroadcastHashJoin" in numbered._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(tables, "SENT_ROWS", 2)  # many groups are dealt by key
        got = points.with_stats(df, "scan_id", top=F.max("X"))
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert {(r.scan_id, r.top) for r in got.collect()} == want and got.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_images_and_balls_of_few_scans_deal_nothing_by_scan(spark):
    df = spark.range(2 * 24 * 24).select((F.col("id") % 2).alias("scan_id"), (F.floor(F.col("id") / 2) % 24).cast("int").alias("y_pix"), F.floor(F.col("id") / 48).cast("int").alias("x_pix"), (F.col("id") % 97).cast("double").alias("v"))
    xyz = df.select("scan_id", F.col("x_pix").cast("double").alias("X"), F.col("y_pix").cast("double").alias("Y"), F.col("v").alias("Z"))
    made = {"tiled": lambda: image.local_equalise(df, "v", 24, 24, 4, 0.02), "whole": lambda: image.equalise(df, "v"), "balls": lambda: generate.balls(xyz, step=90)}
    want = {k: {tuple(r) for r in f().collect()} for k, f in made.items()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for k, f in made.items():
            got = f()
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, k
            assert {tuple(r) for r in got.collect()} == want[k] and len(want[k]) > 1, k
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_without_auto_broadcast(spark, made):
    """What ``made`` returns, and its plan, while Spark broadcasts nothing by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = made()
        return got, got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_few_groups_of_other_operators_deal_nothing_by_group(spark):
    df = spark.range(300).select((F.col("id") % 2).cast("string").alias("scan_id"), F.col("id").alias("point_id"), *[(F.col("id") * p % 61 / 61).alias(a) for a, p in (("X", 7), ("Y", 11), ("Z", 13))])
    bands = df.select("scan_id", "point_id", (F.col("point_id") / 20).cast("int").alias("y_pix"), (F.col("point_id") % 20).cast("int").alias("x_pix"), "X", "Y", "Z", F.sin("point_id").alias("W"))
    pixels = bands.select("scan_id", "y_pix", "x_pix", F.when(F.col("point_id") % 5 < 3, F.col("point_id") % 4).alias("class_id"))
    small = df.where("scan_id = '0' OR point_id < 9")
    channels = ["X", "Y", "Z", "W"]
    made = {
        "components of images": lambda: image.pca(bands, channels),
        "components of one image": lambda: image.pca(bands, channels, by=None),
        "classes": lambda: sample.stratified_sample(bands.withColumn("k", F.col("point_id") % 3), "k", 40, ["point_id"]),
        "weights": lambda: sample.weighted_resample(bands, "X", "X", 20, "point_id", by="scan_id").select("scan_id", "draw", "point_id"),
        "sizes": lambda: spatial._by_size(small, 20, ("scan_id",))[0].select("point_id"),
    }
    joins = {k: plan_without_auto_broadcast(spark, f) for k, f in made.items()}
    for k, (got, plan) in joins.items():
        # the draws of a sample meet their bucket, of which there are 1024
        assert "Broadcast" in plan and "Cartesian" not in plan and plan.count("SortMergeJoin") <= (k == "weights"), k
        # sums of doubles differ in their last digits from run to run
        rounded = [F.round(c, 6) if t == "double" else F.col(c) for c, t in got.dtypes]
        assert {tuple(r) for r in got.select(*rounded).collect()} == {tuple(r) for r in made[k]().select(*rounded).collect()} and got.count() > 0, k
    calls = {
        profile: lambda: profile.density_by_height(df, 0.5, 0.2, ("scan_id",)),
        raster: lambda: raster.fill_from_nearest(pixels),
    }
    for module, call in calls.items():
        seen = []
        with pytest.MonkeyPatch.context() as m:
            m.setattr(module, "join_groups", lambda *a, **k: seen.append(a[2]) or tables.join_groups(*a, **k))
            call()
        assert seen, module.__name__


def test_quantiles_of_a_null_group_beyond_the_direct_size(spark, monkeypatch):
    df = spark.range(3000).select(F.nullif(F.col("id") % 2, F.lit(1)).alias("g"), F.col("id").cast("double").alias("v"))
    wanted = {"q": (F.col("v"), 0.25)}
    want = {r.g: r.q for r in quantile.quantiles(df, wanted, ("g",)).collect()}
    monkeypatch.setattr(quantile, "DIRECT", 50)
    got = {r.g: r.q for r in quantile.quantiles(df, wanted, ("g",)).collect()}
    assert got == want and set(got) == {None, 0}


def test_samples_cut_by_counting_equal_the_sorted_ones(spark, monkeypatch):
    monkeypatch.setattr(sample, "FEW", 5)
    df = spark.range(700).select(F.floor(F.col("id") / 3).alias("key"), "id", F.when(F.col("id") % 7 < 5, F.col("id") % 7 < 2).alias("label"))
    drawn = df.withColumn("_u", sample.draw(42, "key")).collect()
    for ranked in (1_000_000, 1):
        monkeypatch.setattr(sample, "RANKED", ranked)
        for n in (0, 6, 350, 699, 700, 900):
            got = sorted(r.key for r in sample.exact_sample(df, n, ["key"]).collect())
            assert got == sorted(r.key for r in sorted(drawn, key=lambda r: (r["_u"], r.key))[:n])
    assert sample.fraction_sample(df, 0.005, ["key"]).count() == 4  # 3.5, half to even
    assert sample.fraction_sample(df.limit(0), 0.5, ["key"]).count() == 0
    split = sample.train_split(df, "label", ["key"], 0.8)
    assert split.columns == [*df.columns, "is_train"] and split.count() == 700
    for label in (None, False, True):
        own = sorted((r for r in drawn if r.label is label), key=lambda r: (r["_u"], r.key))
        got = sorted(r.key for r in split.where("is_train").collect() if r.label is label)
        assert got == sorted(r.key for r in own[: int(len(own) * 0.8 + 0.5)])


def as_rows(frame, columns):
    return sorted(map(tuple, frame[columns].astype(str).itertuples(index=False)))


def test_manifest_of_ids_beyond_four_digits(spark, tmp_path):
    c = duckdb.connect()
    ids = "SELECT unnest([0, 7, 9999, 10000, 10001, 12345, 12346, 123450]) AS doc_id"
    c.sql(f"COPY (SELECT doc_id, 'src' || doc_id % 2 AS source, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE 'de' END AS lang FROM ({ids})) TO '{tmp_path}/documents.parquet'")
    c.sql(f"COPY (SELECT doc_id, (doc_id % 2)::INT AS quality, (doc_id % 5 = 0)::INT AS toxic FROM ({ids}) WHERE doc_id <> 7) TO '{tmp_path}/labels.parquet'")
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, want = catalog.queries()["j11_manifest"](spark, str(tmp_path)).toPandas(), c.sql(catalog.oracle_sql()["j11_manifest"]).df()
    assert as_rows(got, list(want.columns)) == as_rows(want, list(want.columns)) and len(want) > 14


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_a_scan_is_a_whole_event_type(spark):
    out = catalog.queries()["g_decode_scan"](spark, DATA).groupBy("scan_id").agg(F.max("line").alias("top")).collect()
    events = spark.read.parquet(f"{DATA}/events.parquet")
    lines = events.groupBy("event_type").agg(F.count_distinct(F.floor(F.col("event_id") / 10)).alias("n")).collect()
    assert {r.scan_id: r.top + 1 for r in out} == {r.event_type: r.n for r in lines}


#: Queries whose points meet their scan's statistics or raster.
OF_SCANS = [
    "a1_nearest_per_pixel",
    "a2_nearest_and_density",
    "j2_pixel_lookup",
    "p7_pixel_map",
    "u6_pixel_columns",
    "p9_normalise_invert",
    "p20_channels",
    "a4_pixel_mean",
    "a5_wrapped_mean",
    "i15_median_blur",
    "p11_drop_class",
]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", OF_SCANS)
def test_queries_of_scans_deal_no_points_by_scan(spark, name):
    query = catalog.queries()[name]
    got, plan = plan_without_auto_broadcast(spark, lambda: query(spark, DATA))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert got.count() == query(spark, DATA).count() > 0
