"""Queries of sources and sinks (written to the shared folder and read again) and of whole jobs, with SQL where SQL says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonegrain.functions.columns import no_nan, tidy
from zonegrain.operators import learn
from zonegrain.plans import jobs
from zonegrain.plans import views as T
from zonegrain.plans.views import sql
from zonegrain.sources import files, shared

QUERIES, ORACLE = {}, {}


def _add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLE[name] = oracle


def slices_round_trip(s, d):
    at = shared.scratch(s, "slices")
    files.write_slices(files.slices(T.voxels(s, d)), at)
    return files.voxels(s.read.schema("sample int, z int, height int, width int, data binary").parquet(at))


def sheet_round_trip(s, d):
    at = shared.scratch(s, "sheet")
    means = T.features(s, d).join(T.grades(s, d), "sample").groupBy(F.concat(F.lit("g"), "group_id").alias("sample"), "bin").agg(tidy(F.avg("val"), 6).alias("val"))
    files.write_sheet(means, at)
    return files.sheet(s, at)


def results_round_trip(s, d):
    at = shared.scratch(s, "results")
    files.append_results(T.grades(s, d).select(F.col("sample").cast("string").alias("sample"), F.col("grade").cast("double").alias("grade")), at)
    return files.results(s, at)


def zone_round_trip(s, d):
    at = shared.scratch(s, "zones")
    zones = T.images(s, d).select(F.element_at(F.array(*map(F.lit, jobs.ZONES)), F.pmod("image", F.lit(3)).cast("int") + 1).alias("zone"), F.col("image").alias("sample"), "y", "x", "val")
    files.write_by_zone(zones, at)
    return jobs.picked(files.zone_images(s, at, "deep", "sample long, y int, x int, val int"), "Deep zone of the sample")


_add("slices_round_trip", slices_round_trip, sql("V", " SELECT sample, y, x, z, val FROM V"))
_add("sheet_round_trip", sheet_round_trip, sql("FE G", " SELECT 'g' || group_id AS sample, bin, round(avg(val), 6) + 0.0 AS val FROM FE JOIN G USING (sample) GROUP BY ALL"))
_add("results_round_trip", results_round_trip, sql("G", " SELECT sample::VARCHAR AS sample, grade::DOUBLE AS grade FROM G"))
_add("zone_round_trip", zone_round_trip, sql("I", " SELECT image AS sample, y, x, val, 'deep' AS zone FROM I WHERE image % 3 = 1"))
_PATHS = lambda s, d: T.grades(s, d).select(F.explode(F.array(*(F.concat(F.lit("/data/"), F.pmod("sample", F.lit(7)), F.lit("_"), "group_id", F.lit(f"/{k}/"), "sample", F.lit(".png")) for k in ("imgs", "masks")))).alias("path")).where("not (path like '%/masks/%3.png')")
_add("image_catalog", lambda s, d: files.catalog(_PATHS(s, d)), sql("G", " SELECT '/data/' || p || '/imgs/' || sample || '.png' AS image, '/data/' || p || '/masks/' || sample || '.png' AS mask, p AS sample_id, split_part(p, '_', 1) AS subject_id FROM (SELECT sample, (sample % 7) || '_' || group_id AS p FROM G) WHERE sample % 10 <> 3"))
_add("sibling_files", lambda s, d: files.siblings(T.grades(s, d).select(F.concat(F.lit("/r/rec"), F.pmod("group_id", F.lit(3)), F.lit("_"), F.lpad(F.col("sample").cast("string"), 6, "0"), F.when(F.col("grade") == 0, ".bmp").otherwise(".png")).alias("path")), "/r/rec1_000001.png"), sql("G", " SELECT '/r/rec1_' || lpad(sample::VARCHAR, 6, '0') || '.png' AS path FROM G WHERE group_id % 3 = 1 AND grade <> 0"))
_add("nan_to_zero", lambda s, d: T.features(s, d).select("sample", "bin", tidy(no_nan(F.when(F.pmod(F.col("sample") + F.col("bin"), F.lit(5)) == 0, float("nan")).otherwise(F.col("val"))), 6).alias("val")), sql("FE", " SELECT sample, bin, CASE WHEN (sample + bin) % 5 = 0 THEN 0.0 ELSE round(val, 6) + 0.0 END AS val FROM FE"))
_add("every_tenth_slice", lambda s, d: T.voxels(s, d).where("z % 10 = 0"), sql("V", " SELECT * FROM V WHERE z % 10 = 0"))
_add("first_rows", lambda s, d: learn.first_rows(T.regression_rows(s, d).select("row_id", "group_id"), 1000, "row_id"), sql("L", " SELECT row_id, group_id, row_id <= (SELECT max(row_id) FROM (SELECT row_id FROM L ORDER BY row_id LIMIT 1000)) AS train FROM L"))


# --- whole jobs: the zones of each label's volume are its images ---
def _zones(s, d):
    return jobs.zone_images(T.voxels(s, d), 8, {"surf": (-1, 6), "deep": (6, 14), "calc": (14, 22)})


def _parameters(s, sets=((3, 3, 1, 1, 8, 2, 1, 3, 3, 3),)):
    rows = [(zone, *p) for p in sets for zone in ("calc", "deep", "surf")]
    return s.createDataFrame(rows, files.PARAMETERS)


def _grades_of_labels(s, d):
    return T.voxels(s, d).select("sample").distinct().select("sample", F.pmod("sample", F.lit(4)).cast("int").alias("group_id"), F.pmod(F.col("sample") * 3, F.lit(4)).cast("int").alias("grade"))


def _run(part: str):
    return lambda s, d: jobs.grading(_zones(s, d), _grades_of_labels(s, d), _parameters(s), 2, crop=False, tables=(part,))[part]  # 8 by 8: nothing to crop


_add("zone_features", lambda s, d: jobs.zone_features(_zones(s, d), _parameters(s)))
_add("grading_predictions", _run("predictions"))
_add("grading_metrics", _run("metrics"))
_add("grading_curves", _run("curves"))
_add("grading_intervals", _run("intervals"))


def _tidy_error(t):
    return t.withColumn("error", tidy(F.col("error"), 6))


def texture_search(s, d):
    names = ["par_id", "ks1", "ks2", "sigma1", "sigma2", "N", "large", "small", "wc", "wl", "ws"]
    sets = s.createDataFrame([(0, 3, 3, 1, 1, 8, 2, 1, 3, 3, 3), (1, 5, 3, 2, 1, 8, 2, 1, 1, 3, 1)], names)
    return _tidy_error(jobs.texture_search(_zones(s, d), _grades_of_labels(s, d), sets, 2, crop=False))


_add("texture_search", texture_search)


def feature_model(s, d):
    """The model of all features, stored and read again, as weights of features."""
    _, model = jobs.graded(T.features(s, d), T.grades(s, d), 5)
    at = shared.scratch(s, "models")
    files.write_by_zone(jobs.stored_model(model, "surf"), at)
    return jobs.weight_report(files.models(s, at, learn.MODEL), model["samples"]).withColumn("weight", tidy(F.col("weight"), 6))


_add("feature_model", feature_model)


# --- sheets by title, parameter sheets, boxes of slices, previews, names of slices ---
def parameter_sheet(s, d):
    """Grades written as a sheet with a header line and a text cell, and read by the rule for parameter sheets."""
    at = shared.scratch(s, "sheets")
    rows = T.grades(s, d).orderBy("sample").select(F.concat_ws(",", "sample", F.when(F.col("grade") == 3, "none").otherwise(F.col("grade").cast("string"))).alias("value"), F.col("sample").alias("o"))
    head = s.createDataFrame([("sample,grade", -1)], "value string, o long")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("o").select("value").write.text(at)
    return files.matrix(s, at)


def sheet_titles(s, d):
    at = shared.scratch(s, "sheets")
    T.grades(s, d).select(F.concat(F.lit("s"), "sample").alias("ID"), "group_id", "grade").write.csv(at, header=True)
    return files.titled(s, at, ["grade"])


_add("parameter_sheet", parameter_sheet, sql("G", ", N AS (SELECT row_number() OVER (ORDER BY sample) - 1 AS row, sample, CASE WHEN grade = 3 THEN 0 ELSE grade END AS grade FROM G) SELECT row, 0 AS col, sample::DOUBLE AS val FROM N UNION ALL SELECT row, 1, grade::DOUBLE FROM N"))
_add("sheet_titles", sheet_titles, sql("G", " SELECT 's' || sample AS name, 'grade' AS title, grade::DOUBLE AS val FROM G"))
_BOXES = lambda s, d: T.voxels(s, d).where("val > 200").groupBy("sample", "z").agg(*(f(c).alias(f"{c}{i}") for c in "xy" for i, f in ((1, F.min), (2, F.max))))
_add("boxed_scan", lambda s, d: files.boxed(T.voxels(s, d), _BOXES(s, d), True), sql("V", ", B AS (SELECT sample, z, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM V WHERE val > 200 GROUP BY ALL) SELECT sample, y - y1 AS y, x - x1 AS x, z, val FROM V JOIN B USING (sample, z) WHERE (x2 > 0 OR y2 > 0) AND x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2"))
_add("previews", lambda s, d: files.previews(T.images(s, d).select(F.lit("surf").alias("zone"), F.col("image").alias("sample"), "y", "x", "val")), sql("I", ", E AS (SELECT image, min(val) AS lo, max(val) AS hi FROM I GROUP BY image) SELECT 'surf' AS zone, image AS sample, y, x, CASE WHEN hi > lo THEN floor((val - lo)::DOUBLE / (hi - lo) * 255 + 1e-9)::INT ELSE 0 END AS val FROM I JOIN E USING (image)"))
_add("slice_names", lambda s, d: files.named_slices(T.voxels(s, d).withColumn("val", F.col("val") > 128), "part_").select("sample", "z", "height", "width", "name", F.md5("data").alias("md5")), sql("V", " SELECT sample, z, 8 AS height, 8 AS width, 'part_' || lpad(z::VARCHAR, 8, '0') || '.png' AS name, md5(unhex(string_agg(CASE WHEN val > 128 THEN 'FF' ELSE '00' END, '' ORDER BY y, x))) AS md5 FROM V GROUP BY sample, z"))
