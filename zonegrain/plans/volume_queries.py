"""Queries over volumes and images as long tables, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonegrain.functions import columns as C
from zonegrain.operators import brick
from zonegrain.operators import volume as V
from zonegrain.plans import views as T
from zonegrain.plans.views import sql

QUERIES, ORACLE = {}, {}


def _add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLE[name] = oracle


def _tidy(df, *cols):
    return df.withColumns({c: C.tidy(F.col(c)) for c in cols})


#: Threshold of each sample, by SQL; whole-number sums, ties to the lowest.
OTSU = "OT AS (SELECT sample, arg_max(val, b ORDER BY b DESC, val) AS threshold FROM (SELECT sample, val, CASE WHEN n > n0 THEN (s0 * n - s * n0) * (s0 * n - s * n0) / (n0 * (n - n0)) ELSE -1.0 END AS b FROM (SELECT sample, val, sum(c) OVER w AS n0, sum(c * val) OVER w AS s0, sum(c) OVER a AS n, sum(c * val) OVER a AS s FROM (SELECT sample, val, count(*)::DOUBLE AS c FROM V GROUP BY ALL) WINDOW w AS (PARTITION BY sample ORDER BY val), a AS (PARTITION BY sample))) GROUP BY sample)"
OTSU = OTSU.replace("arg_max(val, b ORDER BY b DESC, val)", "first(val ORDER BY b DESC, val)")

_add("threshold_voxels", lambda s, d: V.threshold(T.voxels(s, d), 100, 150), sql("V", " SELECT sample, y, x, z, CASE WHEN val BETWEEN 100 AND 150 THEN 255 ELSE val END AS val FROM V"))
_add("crop_rebase", lambda s, d: V.crop(T.voxels(s, d), [2, 5, 1, 6, 3, 20]), sql("V", " SELECT sample, y - 2 AS y, x - 1 AS x, z - 3 AS z, val FROM V WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6 AND z BETWEEN 3 AND 20"))
for _axis, (_r, _c) in enumerate((("x", "z"), ("y", "z"), ("y", "x"))):
    _add(f"slice_axis{_axis}", lambda s, d, a=_axis: V.slice_axis(T.voxels(s, d), 5, a), sql("V", f" SELECT sample, {_r} AS row, {_c} AS col, val FROM V WHERE {'yxz'[_axis]} = 5"))
_add("flip_z", lambda s, d: V.flip(T.voxels(s, d)), sql("V", " SELECT sample, y, x, (max(z) OVER (PARTITION BY sample) + min(z) OVER (PARTITION BY sample) - z)::INT AS z, val FROM V"))
_add("permute_axes", lambda s, d: V.permute(T.voxels(s, d), ("x", "z", "y")), sql("V", " SELECT sample, x AS y, z AS x, y AS z, val FROM V"))
_add("vector_to_volume", lambda s, d: V.vector_to_volume(T.features(s, d).select("sample", F.col("bin").alias("pos"), C.tidy(F.col("val")).alias("val")), 4, 4), sql("FE", " SELECT sample, ((bin % 16) // 4)::INT AS y, (bin % 4)::INT AS x, (bin // 16)::INT AS z, round(val, 6) + 0.0 AS val FROM FE"))
_add("volume_to_vector", lambda s, d: V.volume_to_vector(T.voxels(s, d), 8, 8), sql("V", " SELECT sample, (z * 64 + y * 8 + x)::BIGINT AS pos, val FROM V"))
_add("line_artefact", lambda s, d: V.remove_artefacts(T.voxels(s, d), 1.5, 20.0), sql("V", " SELECT sample, y, x, z, CASE WHEN z >= greatest(0, floor(x * 1.5 + 20.0)) THEN 0 ELSE val END AS val FROM V"))
_add("minmax_scale", lambda s, d: V.minmax_to_byte(T.images(s, d)), sql("I", " SELECT image, y, x, (CASE WHEN max(val) OVER w > min(val) OVER w THEN floor((val - min(val) OVER w) * 255.0::DOUBLE / (max(val) OVER w - min(val) OVER w)) ELSE 0 END)::INT AS val FROM I WINDOW w AS (PARTITION BY image)"))
_add("normalise_intensity", lambda s, d: T.voxels(s, d).select("sample", "y", "x", "z", C.tidy(C.normalised(F.col("val"), 128.0, 32.0)).alias("val"), C.normalised(F.col("val"), 128.0).alias("centred"), C.normalised(F.col("val")).alias("plain")), sql("V", " SELECT sample, y, x, z, round((val - 128.0::DOUBLE) / 32.0, 6) + 0.0 AS val, val - 128.0::DOUBLE AS centred, val::DOUBLE AS plain FROM V"))
_add("binary_target", lambda s, d: T.grades(s, d).withColumn("target", C.binary_target(F.col("grade"))), sql("G", " SELECT *, (grade > 1)::INT AS target FROM G"))
_add("name_parse", lambda s, d: T.table(s, d, "pages").select("page_id", C.sample_name(F.col("url")).alias("sample"), C.subject_name(F.concat(F.col("url"), F.lit("_sub3"))).alias("subject"), C.without_sub_image(F.concat(F.substring_index("url", "/", -1), F.lit("_sub3"))).alias("parent")), "SELECT page_id, regexp_replace(regexp_replace(split_part(url, '/', -1), '[.][^.]*$', ''), '_[^_]*$', '') AS sample, split_part(split_part(url || '_sub3', '/', -1), '_', 1) AS subject, split_part(url, '/', -1) AS parent FROM pages")
_add("mask_subtract", lambda s, d: V.mask_minus(T.voxels(s, d), T.mask(s, d)), sql("V", " SELECT * FROM V WHERE val <= 140"))
_add("mask_intersect", lambda s, d: V.mask_and(T.voxels(s, d), T.mask(s, d).where("p < 0.6")), sql("V", " SELECT * FROM V WHERE val > 140 AND val / 255.0::DOUBLE < 0.6"))
_add("target_transform", lambda s, d: T.grades(s, d).select("sample", C.tidy(C.backward(C.forward(F.col("grade") + 1, "exp") * 1.5, "exp")).alias("from_exp"), C.tidy(C.backward(C.forward(F.col("grade") + 1, "log") * 1.5, "log")).alias("from_log")), sql("G", " SELECT sample, round(ln(exp(grade + 1) * 1.5), 6) + 0.0 AS from_exp, round(exp(ln(grade + 1) * 1.5), 6) + 0.0 AS from_log FROM G"))
_add("prediction_clip", lambda s, d: T.features(s, d).where("bin = 0").select("sample", C.tidy(C.clipped(F.col("val") * 10, 3.0)).alias("clipped"), C.tidy(C.no_nan(F.when(F.col("val") > 0, F.col("val")).otherwise(F.lit(float("nan"))))).alias("no_nan")), sql("FE", " SELECT sample, round(least(greatest(val * 10, 0), 3.0), 6) + 0.0 AS clipped, round(CASE WHEN val > 0 THEN val ELSE 0 END, 6) + 0.0 AS no_nan FROM FE WHERE bin = 0"))

# --- depth, surfaces and zones ---


def zone_mean_std(s, d):
    v = T.voxels(s, d)
    below = V.first_below(v, 10, V.otsu(v, ["sample"]))
    return _tidy(V.mean_std(below), "mean", "std", "val")


_MS = "round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS std, round(mean + sd, 6) + 0.0 AS val"
_STATS = "SELECT sample, y, x, count(*) AS n, sum(val) / (count(*) + 1e-9) AS mean, CASE WHEN count(*) > 1 THEN sqrt(greatest(var_pop(val) * count(*), 0) / (count(*) - 1 + 1e-9)) ELSE 0 END AS sd"
_add("zone_mean_std", zone_mean_std, sql("V", f", {OTSU}, R AS (SELECT V.*, row_number() OVER (PARTITION BY sample, y, x ORDER BY z) AS r FROM V JOIN OT USING (sample) WHERE val > threshold), A AS ({_STATS} FROM R WHERE r <= 10 GROUP BY ALL) SELECT sample, y, x, n, {_MS} FROM A"))
_add("masked_mean_std", lambda s, d: _tidy(V.mean_std(T.voxels(s, d).where("val > 0"), 110), "mean", "std", "val"), sql("V", f", K AS (SELECT DISTINCT sample, y, x FROM V WHERE val > 0), A AS ({_STATS} FROM V WHERE val > 110 GROUP BY ALL) SELECT sample, y, x, coalesce(n, 0) AS n, coalesce(round(mean, 6) + 0.0, 0.0) AS mean, coalesce(round(sd, 6) + 0.0, 0.0) AS std, coalesce(round(mean + sd, 6) + 0.0, 0.0) AS val FROM K LEFT JOIN A USING (sample, y, x)"))
_add("first_n_mean_sd", lambda s, d: _tidy(V.first_n_stats(T.voxels(s, d).withColumn("val", F.when(F.col("val") > 120, F.col("val")).otherwise(0)), 12), "mean", "sd"), sql("V", ", R AS (SELECT sample, y, x, val, row_number() OVER (PARTITION BY sample, y, x ORDER BY z DESC) AS r FROM V WHERE val > 120), A AS (SELECT sample, y, x, avg(val) AS mean, coalesce(stddev_samp(val), 0) AS sd FROM R WHERE r <= 12 GROUP BY ALL) SELECT sample, y, x, coalesce(round(mean, 6) + 0.0, 0.0) AS mean, coalesce(round(sd, 6) + 0.0, 0.0) AS sd FROM (SELECT DISTINCT sample, y, x FROM V) LEFT JOIN A USING (sample, y, x)"))
_add("all_nonzero_mean_sd", lambda s, d: _tidy(V.first_n_stats(T.voxels(s, d), 0, 2, 8), "mean", "sd"), sql("V", " SELECT sample, y, x, round(avg(val), 6) + 0.0 AS mean, round(coalesce(stddev_samp(val), 0), 6) + 0.0 AS sd FROM V WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 AND val > 0 GROUP BY ALL"))
_add("projection_count", lambda s, d: V.projection(T.voxels(s, d), 128), sql("V", " SELECT sample, y, x, sum((val > 128)::BIGINT)::BIGINT AS n_above, sum(val)::BIGINT AS total FROM V GROUP BY ALL"))
_add("sample_centre", lambda s, d: V.centre(T.voxels(s, d), 150), sql("V", ", W AS (SELECT sample, y, x, sum((val > 150)::INT) AS n FROM V GROUP BY ALL HAVING n > 0) SELECT sample, round(avg(y))::INT AS mean_y, round(avg(x))::INT AS mean_x, floor(sum(y * n)::DOUBLE / sum(n))::INT AS mass_y, floor(sum(x * n)::DOUBLE / sum(n))::INT AS mass_x FROM W GROUP BY sample"))
_add("centre_crop", lambda s, d: V.centre_crop(T.voxels(s, d), 150, 4), sql("V", ", W AS (SELECT sample, y, x, sum((val > 150)::INT) AS n FROM V GROUP BY ALL), K AS (SELECT sample, greatest(min(y), least(floor(sum(y * n)::DOUBLE / sum(n))::INT - 2, max(y) - 3)) AS y1, greatest(min(x), least(floor(sum(x * n)::DOUBLE / sum(n))::INT - 2, max(x) - 3)) AS x1 FROM W GROUP BY sample) SELECT sample, y - y1 AS y, x - x1 AS x, z, val FROM V JOIN K USING (sample) WHERE y BETWEEN y1 AND y1 + 3 AND x BETWEEN x1 AND x1 + 3"))
_add("otsu_sample", lambda s, d: V.otsu(T.voxels(s, d), ["sample"]), sql("V", f", {OTSU} SELECT sample, threshold FROM OT"))


def _otsu_by(keys: str) -> str:
    return OTSU.replace("OT AS (SELECT sample,", f"O_{keys.split(', ')[1]} AS (SELECT {keys},").replace("(SELECT sample, val,", f"(SELECT {keys}, val,").replace("PARTITION BY sample", f"PARTITION BY {keys}").replace("GROUP BY sample)", f"GROUP BY {keys})")


_add("otsu_slice", lambda s, d: V.otsu(T.voxels(s, d), ["sample", "z"]), sql("V", f", {_otsu_by('sample, z')} SELECT sample, z, threshold FROM O_z"))
_add("otsu_volume", lambda s, d: V.otsu_volume(T.voxels(s, d)), sql("V", f", {_otsu_by('sample, x')}, {_otsu_by('sample, y')} SELECT sample, floor((tx + ty) / 2)::INT AS threshold FROM (SELECT sample, avg(threshold) AS tx FROM O_x GROUP BY sample) JOIN (SELECT sample, avg(threshold) AS ty FROM O_y GROUP BY sample) USING (sample)"))
_add("tile_average", lambda s, d: _tidy(V.tile_means(T.voxels(s, d), 4, 2), "val"), sql("V", " SELECT sample, (y // 4)::INT AS tile_y, (x // 2)::INT AS tile_x, z, round(avg(val), 6) + 0.0 AS val FROM V GROUP BY ALL"))
_add("surface_index", lambda s, d: V.surface(T.voxels(s, d), 150).join(V.surface(T.voxels(s, d), 150, True).withColumnRenamed("surface", "last"), V.COLUMN), sql("V", " SELECT sample, y, x, coalesce(min(z) FILTER (val > 150), 0) AS surface, coalesce(max(z) FILTER (val > 150 AND z > 0), 0) AS last FROM V GROUP BY ALL"))
ZONES = {"surf": (0, 4), "deep": (4, 10), "calc": (-5, 0)}
_add("zone_slabs", lambda s, d: V.slabs(T.voxels(s, d), V.surface(T.voxels(s, d), 150), ZONES), sql("V", ", F AS (SELECT sample, y, x, coalesce(min(z) FILTER (val > 150), 0) AS f FROM V GROUP BY ALL) SELECT zone, sample, y, x, z - f - a - 1 AS z, val FROM V JOIN F USING (sample, y, x), (VALUES ('surf', 0, 4), ('deep', 4, 10), ('calc', -5, 0)) t(zone, a, b) WHERE z - f > a AND z - f <= b"))
_add("tissue_depth", lambda s, d: _tidy(V.tissue_depth(T.voxels(s, d), 150), "depth"), sql("V", ", F AS (SELECT sample, y, x, coalesce(max(z) FILTER (val > 150), 0) - coalesce(min(z) FILTER (val > 150), 0) AS d FROM V GROUP BY ALL) SELECT sample, round(avg(d), 6) + 0.0 AS depth, floor(avg(d) * 0.6::DOUBLE)::INT AS deep_depth FROM F GROUP BY sample"))
_add("surface_range", lambda s, d: V.surface_range(T.voxels(s, d), 150), sql("V", ", F AS (SELECT sample, y, x, coalesce(min(z) FILTER (val > 150), 0) AS f FROM V GROUP BY ALL) SELECT sample, min(f) - 50 AS z1, max(f) + 50 AS z2 FROM F GROUP BY sample"))
_add("volume_extent", lambda s, d: V.extent(T.voxels(s, d)), sql("V", " SELECT sample, min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max, min(z) AS z_min, max(z) AS z_max FROM V GROUP BY sample"))
_add("slice_boxes", lambda s, d: V.slice_boxes(T.voxels(s, d), 150), sql("V", " SELECT sample, z, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM V WHERE val > 150 GROUP BY ALL"))
_BX = ", K AS (SELECT sample, z::DOUBLE AS z, min(x)::DOUBLE AS x1 FROM V WHERE val > 150 GROUP BY ALL)"
_add("edge_line_angle", lambda s, d: _tidy(V.edge_angle(V.slice_boxes(T.voxels(s, d), 150)), "angle", "slope", "intercept"), sql("V", _BX + " SELECT sample, round(degrees(0.5 * atan2(2 * covar_pop(z, x1), var_pop(z) - var_pop(x1))), 6) + 0.0 AS angle, round(regr_slope(x1, z), 6) + 0.0 AS slope, round(regr_intercept(x1, z), 6) + 0.0 AS intercept FROM K GROUP BY sample"))
_add("pca_angle", lambda s, d: _tidy(V.plane_angle(T.voxels(s, d).where("val > 150"), "z", "x"), "angle"), sql("V", " SELECT sample, round(degrees(0.5 * atan2(2 * covar_pop(z::DOUBLE, x::DOUBLE), var_pop(z::DOUBLE) - var_pop(x::DOUBLE))), 6) + 0.0 AS angle FROM V WHERE val > 150 GROUP BY sample"))
_add("void_test_zones", lambda s, d: V.void_zones(T.voxels(s, d), V.surface(T.voxels(s, d), 160), 4, 5, 2, 240), sql("V", """, F AS (SELECT sample, y, x, coalesce(min(z) FILTER (val > 160), 0) AS f FROM V GROUP BY ALL), D AS (SELECT sample, max(z) + 1 AS depth FROM V GROUP BY sample),
B AS (SELECT sample, y, x, depth, CASE WHEN f < 4 THEN 4 WHEN depth - f < 5 THEN depth - 5 ELSE f - 2 END AS base FROM F JOIN D USING (sample)),
W AS (SELECT sample, y, x, depth, base, base > 4 AND bool_or(z BETWEEN base - 3 AND base AND val < 120) AS void, coalesce(max(z) FILTER (val >= 240 AND z > 4 AND z <= CASE WHEN base - 4 > 2 THEN base - 2 ELSE base END), 4) AS tissue FROM V JOIN B USING (sample, y, x) GROUP BY sample, y, x, depth, base),
X AS (SELECT *, CASE WHEN void THEN tissue ELSE base END AS e, CASE WHEN void AND base < depth - 5 THEN base + 2 ELSE base END AS st FROM W)
SELECT 'deep' AS zone, sample, y, x, (z - e + 4)::INT AS z, val, void::INT AS void FROM V JOIN X USING (sample, y, x) WHERE z < e AND z >= e - 4 UNION ALL
SELECT 'calc', sample, y, x, (z - st)::INT, val, void::INT FROM V JOIN X USING (sample, y, x) WHERE z >= st AND z < st + 5"""))
_add("drop_detect", lambda s, d: V.drop_cut(T.voxels(s, d), (0, 7, 0, 7), 140, 0, 1_000_000, 2, 10, 700.0, 1.0, 5), sql("V", """, N AS (SELECT sample, y AS ry, x AS rx, z, sum(CASE WHEN val > 140 THEN val ELSE 0 END) AS n FROM V WHERE y < 4 AND x < 4 GROUP BY ALL), D AS (SELECT sample, max(z) + 1 AS depth FROM V GROUP BY sample),
W AS (SELECT *, sum(n) OVER (PARTITION BY sample, ry, rx ORDER BY z RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING) > 700 AS flag FROM N), K AS (SELECT *, lag(flag) OVER (PARTITION BY sample, ry, rx ORDER BY z) AS was FROM W WHERE z % 2 = 0),
S AS (SELECT sample, ry, rx, min(z) AS stop FROM K WHERE was AND NOT flag AND z > 2 GROUP BY ALL), L AS (SELECT sample, ry, rx, coalesce(max(z) FILTER (flag AND (stop IS NULL OR z < stop)), 0) AS last FROM K LEFT JOIN S USING (sample, ry, rx) GROUP BY ALL)
SELECT sample, ry, rx, (CASE WHEN last = 0 THEN depth ELSE least(last + 5, depth) END)::INT AS cut FROM L JOIN D USING (sample)"""))
_add("fill_below", lambda s, d: V.fill_below(T.mask(s, d).drop("p"), T.voxels(s, d).where("val > 180")), sql("V M", ", F AS (SELECT sample, z, x, min(y) AS f FROM V WHERE val > 180 GROUP BY ALL) SELECT M.sample, M.y, M.x, M.z, M.val FROM M LEFT JOIN F USING (sample, z, x) WHERE f IS NULL OR M.y < f"))
_add("series_median", lambda s, d: V.running_median(T.series(s, d), "user_id", "pos", "value").select("event_id", C.tidy(F.col("median")).alias("median")), sql("E", ", P AS (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM E) SELECT event_id, round(list_sort(l || CASE len(l) WHEN 5 THEN [] WHEN 4 THEN [0.0] WHEN 3 THEN [0.0, 0.0] WHEN 2 THEN [0.0, 0.0, 0.0] ELSE [0.0, 0.0, 0.0, 0.0] END)[3], 6) + 0.0 AS median FROM P"))
_add("mask_apply", lambda s, d: V.apply_mask(T.voxels(s, d), T.mask(s, d).drop("val"), 0.6), sql("V", " SELECT sample, y, x, z, CASE WHEN val > 140 AND val / 255.0::DOUBLE > 0.6 THEN val ELSE 0 END AS val FROM V"))
_add("mask_ensemble", lambda s, d: _tidy(V.mean_mask(T.mask(s, d), V.permute(T.mask(s, d).drop("val").withColumnRenamed("p", "val"), ("x", "y", "z")).withColumnRenamed("val", "p"), 0.55), "p"), sql("V M", " SELECT sample, y, x, z, round(sum(p) / 2, 6) + 0.0 AS p FROM (SELECT sample, y, x, z, p FROM M UNION ALL SELECT sample, x, y, z, p FROM M) GROUP BY ALL HAVING sum(p) / 2 >= 0.55"))
_add("grid_fit", lambda s, d: V.place_mask(T.mask(s, d).drop("val"), 3, 20), sql("V M", " SELECT sample, y, x, z + 3 AS z, floor(p * 255)::INT AS val FROM M WHERE z + 3 < 20"))
_add("region_cut", lambda s, d: V.region_cut(T.voxels(s, d), V.tile_means(T.voxels(s, d), 4, 4).groupBy("sample", "tile_y", "tile_x").agg(F.max_by("z", F.struct("val", "z")).alias("cut")).select("sample", (F.col("tile_y") * 4).alias("y1"), (F.col("tile_y") * 4 + 4).alias("y2"), (F.col("tile_x") * 4).alias("x1"), (F.col("tile_x") * 4 + 4).alias("x2"), "cut")), sql("V", ", A AS (SELECT sample, y // 4 AS ty, x // 4 AS tx, z, avg(val) AS m FROM V GROUP BY ALL), K AS (SELECT sample, ty, tx, first(z ORDER BY m DESC, z DESC) AS cut FROM A GROUP BY ALL) SELECT V.* FROM V JOIN K ON V.sample = K.sample AND V.y // 4 = ty AND V.x // 4 = tx WHERE z < cut"))
_add("rescale", lambda s, d: _tidy(V.scale_means(T.voxels(s, d), 4), "val"), sql("V", " SELECT sample, (y // 4)::INT AS y, (x // 4)::INT AS x, (z // 4)::INT AS z, round(avg(val), 6) + 0.0 AS val FROM V GROUP BY ALL"))
_add("rotate_volume", lambda s, d: _tidy(V.rotated(T.voxels(s, d), F.col("sample") * 2.0, 4), "val"), sql("V", """, W AS (SELECT * FROM V), K AS (SELECT sample, (min(y) + max(y)) / 2.0::DOUBLE AS cy, (min(x) + max(x)) / 2.0::DOUBLE AS cx, CASE WHEN sample * 2 >= 4 THEN sample * 2.0::DOUBLE ELSE 0 END * (pi() / 180) AS a FROM W GROUP BY sample),
P AS (SELECT sample, y, x, z, round(cy + cos(a) * (y - cy) + sin(a) * (x - cx), 9) AS fy, round(cx - sin(a) * (y - cy) + cos(a) * (x - cx), 9) AS fx FROM W JOIN K USING (sample)),
N AS (SELECT sample, y, x, z, (floor(fy) + dy)::INT AS ny, (floor(fx) + dx)::INT AS nx, CASE dy WHEN 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END * CASE dx WHEN 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END AS w FROM P, range(0, 2) t(dy), range(0, 2) u(dx))
SELECT N.sample, N.y, N.x, N.z, round(sum(w * coalesce(W.val, 0)), 6) + 0.0 AS val FROM N LEFT JOIN W ON N.sample = W.sample AND ny = W.y AND nx = W.x AND N.z = W.z WHERE w > 0 GROUP BY ALL"""))
_add("rotate_volume_whole", lambda s, d: _tidy(V.rotated(T.voxels(s, d), F.col("sample") * 3.0, 4), "val"), ORACLE["rotate_volume"].replace("sample * 2", "sample * 3"))

# --- bricks ---


def _over(source: str, column: str, size: tuple[int, int, int], *steps: str) -> str:
    """SQL of boxes over a column of source (sample, y, x, z), one step (max, min) after the other."""
    for f in steps:
        for axis, n in zip("yxz", size, strict=True):
            others = ", ".join(a for a in "yxz" if a != axis)
            source = f"(SELECT * REPLACE ({f}({column}) OVER (PARTITION BY sample, {others} ORDER BY {axis} RANGE BETWEEN {n // 2} PRECEDING AND {n - 1 - n // 2} FOLLOWING) AS {column}) FROM {source})"
    return source


_add("cube_dilate", lambda s, d: brick.dilate(T.voxels(s, d), (3, 3, 3)), sql("V", f" SELECT * FROM {_over('V', 'val', (3, 3, 3), 'max')}"))
_add("cube_close", lambda s, d: brick.close(T.voxels(s, d), (1, 3, 6)), sql("V", f" SELECT * FROM {_over('V', 'val', (1, 3, 6), 'max', 'min')}"))
_add("mask_suppressed", lambda s, d: brick.suppressed(T.voxels(s, d), F.col("val") > 178, F.col("val") > 165, F.col("val") > 100, (3, 3, 3)), sql("V", f""", T AS (SELECT sample, y, x, z, val, (val > 165 AND val <= 178)::INT AS o FROM V), R AS (SELECT sample, y, x, z, val, (val > 178 AND o = 0)::INT AS r FROM {_over('T', 'o', (3, 3, 3), 'max', 'min')})
SELECT sample, y, x, z, CASE WHEN r = 1 AND val > 100 THEN 255 ELSE 0 END AS val FROM {_over('R', 'r', (3, 3, 3), 'max')}"""))
_add("turn_grown", lambda s, d: brick.turned(T.voxels(s, d), F.col("sample") * 3.0, "y", grown=True, least=4, most=20).withColumn("val", F.when(F.col("val") == 0, 0.0).otherwise(C.tidy(F.col("val")))), sql("V", """, E AS (SELECT sample, min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1, CASE WHEN sample * 3 BETWEEN 4 AND 20 THEN sample * 3.0::DOUBLE ELSE 0 END * (pi() / 180) AS a FROM V GROUP BY sample),
K AS (SELECT *, (x0 + x1) / 2.0::DOUBLE AS cx, (z0 + z1) / 2.0::DOUBLE AS cz, round((abs(cos(a)) * (x1 - x0) + abs(sin(a)) * (z1 - z0)) / 2, 9) AS hx, round((abs(cos(a)) * (z1 - z0) + abs(sin(a)) * (x1 - x0)) / 2, 9) AS hz FROM E),
X AS (SELECT *, unnest(range(ceil(cx - hx)::BIGINT, floor(cx + hx)::BIGINT + 1)) AS x FROM K), Z AS (SELECT *, unnest(range(ceil(cz - hz)::BIGINT, floor(cz + hz)::BIGINT + 1)) AS z FROM X),
P AS (SELECT sample, x, z, round(cx + cos(a) * (x - cx) + sin(a) * (z - cz), 9) AS fx, round(cz - sin(a) * (x - cx) + cos(a) * (z - cz), 9) AS fz FROM Z),
N AS (SELECT sample, x, z, (floor(fx) + dx)::INT AS nx, (floor(fz) + dz)::INT AS nz, CASE dx WHEN 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END * CASE dz WHEN 0 THEN 1 - (fz - floor(fz)) ELSE fz - floor(fz) END AS w FROM P, range(0, 2) t(dx), range(0, 2) u(dz))
SELECT N.sample, y.y, N.x::INT AS x, N.z::INT AS z, round(sum(w * coalesce(V.val, 0)), 6) + 0.0 AS val FROM N JOIN (SELECT DISTINCT sample, y FROM V) y ON N.sample = y.sample LEFT JOIN V ON N.sample = V.sample AND y.y = V.y AND nx = V.x AND nz = V.z GROUP BY ALL"""))
