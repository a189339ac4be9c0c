"""Queries of models, segmentation, names, results and composed jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from zonegrain.functions.columns import tidy
from zonegrain.operators import learn, margin, orient, regions, resample, segment, selection, spectral, study, volume
from zonegrain.plans import image_queries, jobs, volume_queries
from zonegrain.sources import shared
from zonegrain.plans import views as T
from zonegrain.plans.study_queries import _FOLD, _LCG, _ONE
from zonegrain.plans.views import sql
from zonegrain.sources import files
from zonegrain.streaming import arrivals

QUERIES, ORACLE = {}, {}


def _add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLE[name] = oracle


def _tidy(df, *cols, digits=6):
    return df.withColumns({c: tidy(F.col(c), digits) for c in cols})


def _fe3(s, d):
    return study.rows_of(T.features(s, d).where("bin < 3")).join(T.grades(s, d), "sample").select(F.col("sample").alias("row_id"), "group_id", "x", (F.col("grade") > 1).cast("int").alias("y"))


def _pca(s, d):
    f = T.features(s, d)
    return learn.project(study.rows_of(f), learn.pca(f, 4)).select("sample", F.posexplode("scores").alias("component", "score")).withColumn("score", tidy(F.col("score"), 5))


_add("pca_scores", _pca)


def _score(s, d):
    rows = study.rows_of(T.features(s, d).where("bin < 2")).withColumn("zone", F.when(F.col("sample") % 2 == 0, "surf").otherwise("deep"))
    m = rows.groupBy("zone").agg(*(f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(2) for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    models = m.select("zone", F.array("m0", "m1").alias("mean"), F.expr("array(array(1d, 0d), array(0d, 1d))").alias("eigvec"), F.array("s0", "s1").alias("sv"), F.expr("array(0.5d, -0.25d)").alias("w_lin"), F.expr("array(1d, 2d)").alias("w_log"), F.lit(1.5).alias("b_lin"), F.lit(0.1).alias("b_log"))
    return _tidy(learn.score_model(rows, models), "pred_lin", "pred_log")


_add("score_model", _score, sql("FE", ", X AS (SELECT sample, CASE WHEN sample % 2 = 0 THEN 'surf' ELSE 'deep' END AS zone, max(val) FILTER (bin = 0) AS a, max(val) FILTER (bin = 1) AS b FROM FE GROUP BY sample), Z AS (SELECT sample, zone, (a - avg(a) OVER w) / stddev_samp(a) OVER w AS p, (b - avg(b) OVER w) / stddev_samp(b) OVER w AS q FROM X WINDOW w AS (PARTITION BY zone)) SELECT sample, zone, round(0.5 * p - 0.25 * q + 1.5, 6) + 0.0 AS pred_lin, round(1 / (1 + exp(-(p + 2 * q + 0.1))), 6) + 0.0 AS pred_log, (p + 2 * q + 0.1 > 0.5)::INT AS label FROM Z"))
_add("logistic_logo", lambda s, d: _tidy(learn.logistic_logo(_fe3(s, d), 3).select("row_id", "y", "probability"), "probability", digits=5))
_add("lda_logo", lambda s, d: learn.lda(_fe3(s, d), 3, [0, 1]).select("row_id", "y", "label"))
_add("svm_logo", lambda s, d: margin.svm_logo(_fe3(s, d), 3, [0, 1]).select("row_id", "y", "label"))
_add("linear_explain", lambda s, d: _tidy(learn.explained(_ONE(s, d), 1).drop("bin"), "value", digits=3), sql("L", _FOLD + " SELECT row_id, round(c / (2 * g) * (x0 - mx), 3) + 0.0 AS value FROM L JOIN C USING (group_id)"))
ALPHAS = {0: 0.0, 1: 0.5, 2: 2.0}
_add("param_search", lambda s, d: _tidy(study.best_set(selection.alpha_errors(_ONE(s, d), 1, ALPHAS), ["group_id"]).withColumn("error", F.col("error") / 1e6), "error", digits=4), sql("L", _FOLD + ", P AS (SELECT i AS par_id, a FROM (VALUES (0, 0.0), (1, 0.5), (2, 2.0)) t(i, a)), E AS (SELECT par_id, group_id, avg((y - (my + c / ((1 + a) * g) * (x0 - mx))) ** 2) AS error FROM L JOIN C USING (group_id), P GROUP BY ALL) SELECT group_id, first(par_id ORDER BY error, par_id) AS par_id, round(min(error) / 1e6, 4) + 0.0 AS error FROM E GROUP BY group_id"))
_add("param_sets", lambda s, d: study.parameter_sets(T.grades(s, d).select(F.col("sample").alias("id"))).select("par_id", "ks1", "sigma1", "large"), sql("G", f", D AS (SELECT sample AS id, 3 + 2 * ({_LCG('sample * 15485863 + 42')} % 12) AS ks1, 3 + {_LCG('sample * 15485863 + 2 * 32452843 + 42')} % 25 AS large FROM G) SELECT id AS par_id, ks1, 1 + {_LCG('id * 15485863 + 6 * 32452843 + 42')} % ks1 AS sigma1, large FROM D"))

# --- segmentation ---
_CC = ", P AS (SELECT sample, y, x, z, z::BIGINT * 1099511627776 + y * 1048576 + x AS id FROM V WHERE {}), N AS (SELECT a.sample, a.id AS a, b.id AS b FROM P a JOIN P b ON a.sample = b.sample AND abs(a.y - b.y) + abs(a.x - b.x) + abs(a.z - b.z) = 1), R AS (SELECT sample, id AS root, id AS node FROM P UNION SELECT R.sample, R.root, N.b FROM R JOIN N ON N.sample = R.sample AND N.a = R.node), C AS (SELECT sample, node, min(root) AS label FROM R GROUP BY ALL)"
_add("largest_component", lambda s, d: segment.largest_component(T.voxels(s, d).where("val > 175")), sql("V", _CC.format("val > 175") + ", Z AS (SELECT sample, label, count(*) AS n FROM C GROUP BY ALL), T AS (SELECT sample, first(label ORDER BY n DESC, label) AS label FROM Z GROUP BY sample) SELECT C.sample, P.y, P.x, P.z FROM C JOIN T ON C.sample = T.sample AND C.label = T.label JOIN P ON P.sample = C.sample AND P.id = C.node", True))
_add("components", lambda s, d: segment.components(T.voxels(s, d).where("val > 175")).groupBy("sample", "label").agg(F.count("*").alias("voxels")), sql("V", _CC.format("val > 175") + " SELECT sample, label, count(*) AS voxels FROM C GROUP BY sample, label", True))
_add("components_whole", lambda s, d: segment.components(T.voxels(s, d).where("val > 175")).groupBy("sample").agg(F.countDistinct("label").alias("components"), F.count("*").alias("voxels")), sql("V", _CC.format("val > 175") + " SELECT sample, count(DISTINCT label) AS components, count(*) AS voxels FROM C GROUP BY sample", True))
_add("slice_bounding_boxes", lambda s, d: segment.bounding_boxes(T.voxels(s, d).where("val > 140"), 3), sql("V", ", P AS (SELECT sample, y, x, z, z::BIGINT * 1099511627776 + y * 1048576 + x AS id FROM V WHERE val > 140), N AS (SELECT a.sample, a.id AS a, b.id AS b FROM P a JOIN P b ON a.sample = b.sample AND a.z = b.z AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.id <> b.id), R AS (SELECT sample, id AS root, id AS node FROM P UNION SELECT R.sample, R.root, N.b FROM R JOIN N ON N.sample = R.sample AND N.a = R.node), C AS (SELECT sample, node, min(root) AS label FROM R GROUP BY ALL), B AS (SELECT P.sample, z, label, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, count(*) AS area FROM C JOIN P ON P.sample = C.sample AND P.id = C.node GROUP BY ALL), T AS (SELECT sample, z, first({'x1': x1, 'x2': x2, 'y1': y1, 'y2': y2, 'area': area} ORDER BY (x2 - x1 + 1) * (y2 - y1 + 1) DESC, label) AS b FROM B GROUP BY sample, z) SELECT sample, z, CASE WHEN b.area > 3 THEN b.x1 ELSE 0 END AS x1, CASE WHEN b.area > 3 THEN b.x2 ELSE 0 END AS x2, CASE WHEN b.area > 3 THEN b.y1 ELSE 0 END AS y1, CASE WHEN b.area > 3 THEN b.y2 ELSE 0 END AS y2 FROM T", True))
_add("kmeans_segment", lambda s, d: segment.kmeans(T.images(s, d)).groupBy("image", "cluster").agg(F.count("*").alias("n")))


def smooth(tiles: np.ndarray) -> np.ndarray:
    """A stand-in for a user's model: the sigmoid of each pixel against the mean of its tile."""
    tiles = tiles.astype(float)
    return 1 / (1 + np.exp(-(tiles - tiles.mean((1, 2), keepdims=True)) / 32))


_add("score_tiles", lambda s, d: _tidy(segment.score_tiles(T.big_image(s, d), smooth, 16), "p", digits=4), sql("B", ", T AS (SELECT *, ty * 8 AS y0, tx * 8 AS x0 FROM (SELECT DISTINCT greatest(y // 8 - 1, 0) AS ty FROM B UNION SELECT DISTINCT y // 8 FROM B) a, (SELECT DISTINCT greatest(x // 8 - 1, 0) AS tx FROM B UNION SELECT DISTINCT x // 8 FROM B) b), M AS (SELECT ty, tx, sum(val) / 256.0::DOUBLE AS m FROM B JOIN T ON y BETWEEN y0 AND y0 + 15 AND x BETWEEN x0 AND x0 + 15 GROUP BY ALL) SELECT image, y, x, round(avg(1 / (1 + exp(-(val - m) / 32.0::DOUBLE))), 4) + 0.0 AS p FROM B JOIN T ON y BETWEEN y0 AND y0 + 15 AND x BETWEEN x0 AND x0 + 15 JOIN M USING (ty, tx) GROUP BY image, y, x"))
_A = lambda i: _LCG(f"image * 7919 + {42 + i}")
_add("augment", lambda s, d: segment.augment(T.images(s, d), 8), sql("I", f" SELECT image, y, (CASE WHEN {_A(0)} % 2 = 0 THEN 7 - x ELSE x END)::INT AS x, floor(255 * pow(val / 255.0::DOUBLE, CASE WHEN {_A(1)} % 2 = 0 THEN 0.5 + ({_A(2)} % 1000) * 0.0015::DOUBLE ELSE 1.0 END) + 1e-9)::INT AS val FROM I"))
_add("sampled_pixels", lambda s, d: segment.sampled_pixels(T.images(s, d), 10), sql("I", f", R AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY {_LCG('y::BIGINT * 65537 + x * 257')}, y, x) AS r FROM I) SELECT image, y, x, val FROM R WHERE r <= 10"))
_add("pixel_graph", lambda s, d: _tidy(segment.graph_edges(T.images(s, d)), "weight"), sql("I", ", S AS (SELECT image, stddev_pop(val) AS sd FROM I GROUP BY image), N AS (SELECT image::BIGINT * 1099511627776 + y::BIGINT * 1048576 + x AS id, * FROM I) SELECT a.id AS src, b.id AS dst, round(exp(-abs(b.val - a.val) / greatest(sd, 1e-9)), 6) + 0.0 AS weight FROM N a JOIN N b ON a.image = b.image AND ((b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x)) JOIN S ON S.image = a.image"))

# --- names, results and streams ---
_add("pending_samples", lambda s, d: files.selected(T.table(s, d, "documents").select(F.col("source").alias("sample")), ["src1*", "*3"], T.table(s, d, "documents").where("doc_id % 7 = 0 and source like '%5'").select(F.col("source").alias("sample")).distinct()), "SELECT DISTINCT source AS sample FROM documents WHERE (source LIKE 'src1%' OR source LIKE '%3') AND source NOT IN (SELECT source FROM documents WHERE doc_id % 7 = 0 AND source LIKE '%5')")
_add("resolved_paths", lambda s, d: files.resolved(T.table(s, d, "pages").select(F.col("page_id").cast("string").alias("sample")).withColumn("path", F.explode(F.array(F.concat(F.lit("/a/"), "sample"), F.concat(F.lit("/a/"), "sample", F.lit("/"), "sample", F.lit("_Rec")), F.when(F.col("sample").cast("long") % 2 == 0, F.concat(F.lit("/a/"), "sample", F.lit("/Registration")))))).where("path is not null")), "SELECT page_id::VARCHAR AS sample, '/a/' || page_id || CASE WHEN page_id % 2 = 0 THEN '/Registration' ELSE '/' || page_id || '_Rec' END AS path FROM pages")
_add("latest_result", lambda s, d: arrivals.latest(T.table(s, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]), "SELECT user_id, event_type, max(ts) AS ts, last(event_id ORDER BY ts, event_id) AS event_id, last(value ORDER BY ts, event_id) AS value FROM events GROUP BY ALL")


def stream_results(s, d):
    """Events as arriving files: scored by a stream, then the latest of each user."""
    at = shared.scratch(s, "arrivals")
    events = T.table(s, d, "events")
    arrivals.score_arrivals(s, d, events.schema, lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("ts")), f"{at}/out", f"{at}/failed", f"{at}/state", "events.parquet")
    return s.read.schema("user_id long, n long, ts timestamp, batch long").parquet(f"{at}/out").groupBy("user_id").agg(F.sum("n").alias("n"), F.max("ts").alias("ts"))


_add("stream_results", stream_results, "SELECT user_id, count(*)::BIGINT AS n, max(ts) AS ts FROM events GROUP BY user_id")

# --- jobs ---
_add("zone_images", lambda s, d: _tidy(jobs.zone_images(T.voxels(s, d), 6, {"surf": (-1, 4), "deep": (4, 9)}), "val"), sql("V", ", W AS (SELECT sample, y, x, sum((val > 128)::INT) AS n FROM V GROUP BY ALL), K AS (SELECT sample, greatest(min(y), least(floor(sum(y * n)::DOUBLE / sum(n))::INT - 3, max(y) - 5)) AS y1, greatest(min(x), least(floor(sum(x * n)::DOUBLE / sum(n))::INT - 3, max(x) - 5)) AS x1 FROM W GROUP BY sample), V2 AS (SELECT sample, y - y1 AS y, x - x1 AS x, z, val FROM V JOIN K USING (sample) WHERE y BETWEEN y1 AND y1 + 5 AND x BETWEEN x1 AND x1 + 5), " + volume_queries.OTSU.replace("FROM V GROUP", "FROM V2 GROUP") + ", F AS (SELECT sample, y, x, coalesce(min(z) FILTER (val > threshold), 0) AS f FROM V2 JOIN OT USING (sample) GROUP BY ALL) SELECT zone, sample, y, x, round(avg(val) + coalesce(stddev_samp(val), 0), 6) + 0.0 AS val FROM V2 JOIN F USING (sample, y, x), (VALUES ('surf', -1, 4), ('deep', 4, 9)) t(zone, a, b) WHERE z - f > a AND z - f <= b GROUP BY ALL"))
_add("grade_samples", lambda s, d: _tidy(jobs.graded(T.features(s, d), T.grades(s, d))[0], "raw", "prediction", digits=4))
_add("noise_report", lambda s, d: jobs.noise_report(T.images(s, d), T.grades(s, d).select(F.col("sample").alias("image"), F.col("grade").alias("dataset"), F.col("group_id").alias("zone"))).withColumn("mse", tidy(F.col("mse"), 9)), image_queries.ORACLE["noise_rollup"].replace("SELECT grade, group_id, round", "SELECT grade AS dataset, group_id AS zone, round"))
_add("zone_table", lambda s, d: jobs.zone_table({"surf": T.table(s, d, "pages").where("page_id % 2 = 0").select(F.col("url").alias("path")), "deep": T.table(s, d, "pages").where("page_id % 2 = 1").select(F.col("url").alias("path"))}, T.grades(s, d).select(F.explode(F.array(F.lit("surf"), F.lit("deep"))).alias("zone"), F.col("sample").cast("int").alias("pos"), F.concat(F.lit("n"), F.col("sample")).alias("name"))), "WITH U AS (SELECT CASE WHEN page_id % 2 = 0 THEN 'surf' ELSE 'deep' END AS zone, url AS path FROM pages), P AS (SELECT zone, path, (row_number() OVER (PARTITION BY zone ORDER BY path) - 1)::INT AS pos FROM U) SELECT zone, path, pos, 'n' || pos AS name FROM P WHERE pos IN (SELECT vec_id FROM embeddings)")


# --- what earlier modules left ---
def _pad_image(s, d):
    from zonegrain.operators import stencil

    return stencil.padded(T.images(s, d), 2)


_add("pad_image", _pad_image, sql("I", " SELECT g.image, g.y::INT AS y, g.x::INT AS x, coalesce(val, 0) AS val FROM (SELECT image, y, x FROM (SELECT DISTINCT image FROM I), range(-2, 10) a(y), range(-2, 10) b(x)) g LEFT JOIN I USING (image, y, x)"))
_add("zone_params", lambda s, d: T.grades(s, d).withColumn("zone", F.element_at(F.array(F.lit("surf"), F.lit("deep"), F.lit("calc")), F.pmod("sample", F.lit(3)).cast("int") + 1)).join(F.broadcast(study.parameter_sets(T.grades(s, d).where("sample < 3").select(F.col("sample").alias("id"))).withColumn("zone", F.element_at(F.array(F.lit("surf"), F.lit("deep"), F.lit("calc")), F.col("par_id").cast("int") + 1)).select("zone", "ks1", "large")), "zone").select("sample", "zone", "ks1", "large"), sql("G", f", D AS (SELECT sample AS id, 3 + 2 * ({_LCG('sample * 15485863 + 42')} % 12) AS ks1, 3 + {_LCG('sample * 15485863 + 2 * 32452843 + 42')} % 25 AS large FROM G WHERE sample < 3) SELECT sample, ['surf', 'deep', 'calc'][sample % 3 + 1] AS zone, ks1, large FROM G JOIN D ON sample % 3 = D.id"))


def _roc_band(s, d):
    t = T.scored_rows(s, d)
    return study.mean_band(study.bootstrap_curves(t, "y", "score", "doc_id", 20), 101).withColumns({c: tidy(F.col(c), 5) for c in ("mean", "sd", "upper")})


_add("mean_roc_band", _roc_band)


def _angle_search(s, d):
    return volume.angle_search(volume.scale_means(T.voxels(s, d), 2), [-20.0, -10.0, 0.0, 10.0, 20.0], 128).withColumn("loss", tidy(F.col("loss"), 5))


_add("angle_search", _angle_search)


def _forest(s, d):
    return _tidy(learn.forest_logo(_fe3(s, d), 3).select("row_id", "y", "probability"), "probability", digits=5)


_add("forest_logo", _forest)
_add("void_columns", lambda s, d: T.voxels(s, d).groupBy("sample", "y", "x").agg(F.array_sort(F.collect_list(F.struct("z", "val"))).alias("l")).select("sample", "y", "x", F.exists("l", lambda e: e["val"] < 60).alias("void"), F.size(F.filter("l", lambda e: e["val"] > 150)).alias("bright")), sql("V", " SELECT sample, y, x, bool_or(val < 60) AS void, count(*) FILTER (val > 150) AS bright FROM V GROUP BY ALL"))


# --- choices, nested hold-outs and resampling ---
def _one_bin_each(s, d):
    """Every bin is a parameter set of one feature; a fifth of the samples is left out at a time."""
    features = T.features(s, d).select(F.col("bin").alias("par_id"), "sample", F.lit(0).alias("bin"), "val")
    grades = T.grades(s, d).withColumn("split", F.pmod("sample", F.lit(5)))
    return _tidy(study.best_set(selection.split_errors(features, grades, 1, 0.1), ["split"]), "error", digits=5)


_add("set_search", _one_bin_each, sql("FE G", ", X AS (SELECT bin AS par_id, sample % 5 AS split, group_id, val AS x, grade::DOUBLE AS y FROM FE JOIN G USING (sample)), C AS (SELECT par_id, split, group_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM X GROUP BY ALL), A AS (SELECT par_id, group_id, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(xx) AS xx, sum(xy) AS xy, sum(yy) AS yy FROM C GROUP BY ALL), S AS (SELECT DISTINCT par_id, split FROM C), R AS (SELECT S.par_id, S.split, A.group_id, A.n - coalesce(C.n, 0) AS n, A.sx - coalesce(C.sx, 0) AS sx, A.sy - coalesce(C.sy, 0) AS sy, A.xx - coalesce(C.xx, 0) AS xx, A.xy - coalesce(C.xy, 0) AS xy, A.yy - coalesce(C.yy, 0) AS yy FROM S JOIN A USING (par_id) LEFT JOIN C ON C.par_id = S.par_id AND C.split = S.split AND C.group_id = A.group_id), W AS (SELECT *, sum(n) OVER w - n AS tn, sum(sx) OVER w - sx AS tx, sum(sy) OVER w - sy AS ty, sum(xx) OVER w - xx AS txx, sum(xy) OVER w - xy AS txy FROM R WINDOW w AS (PARTITION BY par_id, split)), M AS (SELECT *, (txy - tx * ty / tn) / (1.1 * (txx - tx * tx / tn)) AS a FROM W WHERE n > 0), E AS (SELECT par_id, split, sum(yy - 2 * a * xy - 2 * b * sy + a * a * xx + 2 * a * b * sx + n * b * b) / sum(n) AS error FROM (SELECT *, ty / tn - a * tx / tn AS b FROM M) GROUP BY ALL) SELECT split, first(par_id ORDER BY error, par_id) AS par_id, round(min(error), 5) + 0.0 AS error FROM E GROUP BY split"))


def _kfold(s, d):
    rows = T.features(s, d).where("bin = 0").join(T.grades(s, d), "sample").select(F.col("sample").alias("row_id"), F.array("val").alias("x"), F.col("grade").alias("y"))
    return _tidy(selection.kfold_inside_loo(rows, 1, 4), "prediction", digits=5)


_add("kfold_loo", _kfold, sql("FE G", ", X AS (SELECT sample AS row_id, val AS x, grade::DOUBLE AS y, row_number() OVER (ORDER BY sample) - 1 AS r FROM FE JOIN G USING (sample) WHERE bin = 0), U AS (SELECT r + 1 AS r, sum(1) OVER w AS n, sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x * x) OVER w AS xx, sum(x * y) OVER w AS xy FROM X WINDOW w AS (ORDER BY r) UNION ALL SELECT 0, 0, 0, 0, 0, 0), N AS (SELECT count(*) AS n FROM X), K AS (SELECT k, k * ((n - 1) // 4) + least(k, (n - 1) % 4) AS a, (k + 1) * ((n - 1) // 4) + least(k + 1, (n - 1) % 4) AS b FROM N, range(0, 4) t(k)), F AS (SELECT X.row_id, X.x, X.y, T.n - 1 - (h.n - l.n) + i AS n, T.sx - X.x - (h.sx - l.sx) + i * X.x AS sx, T.sy - X.y - (h.sy - l.sy) + i * X.y AS sy, T.xx - X.x * X.x - (h.xx - l.xx) + i * X.x * X.x AS xx, T.xy - X.x * X.y - (h.xy - l.xy) + i * X.x * X.y AS xy FROM (SELECT X.*, a + (a >= r)::INT AS lo, b + (b >= r)::INT AS hi, (a + (a >= r)::INT <= r AND r < b + (b >= r)::INT)::INT AS i FROM X, K) X JOIN U l ON l.r = lo JOIN U h ON h.r = hi JOIN U T ON T.r = (SELECT n FROM N)) SELECT row_id, y, round(avg(sy / n + (xy - sx * sy / n) / (xx - sx * sx / n) * (x - sx / n)), 5) + 0.0 AS prediction FROM F GROUP BY row_id, y"))
_BOOT = 25


def _bootstrap(s, d):
    drawn = resample.bootstrap(T.scored_rows(s, d).select("doc_id", "y", (F.col("score") / 1000).alias("score")), "y", "score", "doc_id", ("auc", "average_precision", "mse"), _BOOT, draw=F.col("doc_id"))
    return _tidy(drawn, "value")


_W = "".join(f" + (u >= {int(v)})::INT" for v in resample._STEPS)
_ROUND = lambda a, b: f"{b} AS (SELECT * EXCLUDE (u), (xor(u, u >> 16) * 73244475) & 4294967295 AS u FROM {a})"
_add("bootstrap_metrics", _bootstrap, sql("S", f", P AS (SELECT S.doc_id, y, score / 1000.0::DOUBLE AS score, r, (doc_id * 2654435761 + r * 40503 + 42) & 4294967295 AS u FROM S, range(0, {_BOOT}) t(r) WHERE y IS NOT NULL AND score IS NOT NULL), {_ROUND('P', 'P1')}, {_ROUND('P1', 'P2')}, P3 AS (SELECT * EXCLUDE (u), (xor(u, u >> 16) + r) & 4294967295 AS u FROM P2), {_ROUND('P3', 'P4')}, {_ROUND('P4', 'P5')}, W AS (SELECT doc_id, y, score, r, (0{_W}) AS w FROM (SELECT * EXCLUDE (u), xor(u, u >> 16) AS u FROM P5)), V AS (SELECT r, score, sum(w * y)::DOUBLE AS p, sum(w * (1 - y))::DOUBLE AS q FROM W GROUP BY ALL), C AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM V WINDOW w AS (PARTITION BY r ORDER BY score DESC)), A AS (SELECT r, sum(q * (tp - p + p / 2)) / (sum(p) * sum(q)) AS auc, sum(p * tp / greatest(tp + fp, 1)) / sum(p) AS average_precision FROM C GROUP BY r), M AS (SELECT r, sum(w * (y - score) * (y - score)) / sum(w) AS mse FROM W GROUP BY r) SELECT 'auc' AS metric, r::INT AS replicate, round(auc, 6) + 0.0 AS value FROM A UNION ALL SELECT 'average_precision', r::INT, round(average_precision, 6) + 0.0 FROM A UNION ALL SELECT 'mse', r::INT, round(mse, 6) + 0.0 FROM M"))

# --- regions ---
_ON = lambda s, d: T.images(s, d).select("image", "y", "x", (F.col("val") > 128).cast("int").alias("on"))
_PX = ", P AS (SELECT image, y, x, (val > 128)::INT AS o, y::BIGINT * 2147483648 + x AS id FROM I)"
_REACH = ", N AS (SELECT a.image, a.id AS a, b.id AS b FROM P a JOIN P b ON a.image = b.image AND {} AND a.o = {o} AND b.o = {o} AND a.id <> b.id), R AS (SELECT image, id AS root, id AS node FROM P WHERE o = {o} UNION SELECT R.image, R.root, N.b FROM R JOIN N ON N.image = R.image AND N.a = R.node), L AS (SELECT image, node, min(root) AS label FROM R GROUP BY ALL)"
_add("labelled_regions", lambda s, d: regions.labelled(_ON(s, d)), sql("I", _PX + _REACH.format("abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1", o=1) + " SELECT P.image, y, x, o AS \"on\", coalesce(label, -1) AS label FROM P LEFT JOIN L ON L.image = P.image AND L.node = P.id", True))
_add("filled_regions", lambda s, d: regions.filled(_ON(s, d)), sql("I", _PX + _REACH.format("abs(a.y - b.y) + abs(a.x - b.x) = 1", o=0) + ", E AS (SELECT DISTINCT L.image, label FROM L JOIN P ON P.image = L.image AND P.id = L.node WHERE y IN (0, 7) OR x IN (0, 7)) SELECT P.image, y, x, CASE WHEN E.label IS NULL THEN 1 ELSE 0 END AS \"on\" FROM P LEFT JOIN L ON L.image = P.image AND L.node = P.id LEFT JOIN E ON E.image = P.image AND E.label = L.label", True))
_add("outlines", lambda s, d: _tidy(regions.outlines(_ON(s, d).select("image", "y", "x", F.when(F.col("on") == 1, F.lit(7)).otherwise(-1).cast("long").alias("label"))), "area", "cy", "cx"), sql("I", _PX + ", Q AS (SELECT a.image, a.y AS ay, a.x AS ax, sum(b.o) AS n, sum(b.o * b.y)::DOUBLE AS sy, sum(b.o * b.x)::DOUBLE AS sx FROM P a JOIN P b ON a.image = b.image AND b.y - a.y IN (0, 1) AND b.x - a.x IN (0, 1) GROUP BY ALL), A AS (SELECT image, sum(CASE n WHEN 4 THEN 1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS area, sum(CASE n WHEN 4 THEN 1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END * sy / greatest(n, 1)) AS my, sum(CASE n WHEN 4 THEN 1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END * sx / greatest(n, 1)) AS mx FROM Q GROUP BY image), B AS (SELECT image, min(y) AS y1, max(y) AS y2, min(x) AS x1, max(x) AS x2, count(*) AS pixels FROM P WHERE o = 1 GROUP BY image) SELECT image, 7 AS label, round(area, 6) + 0.0 AS area, round(CASE WHEN area > 0 THEN my / area END, 6) + 0.0 AS cy, round(CASE WHEN area > 0 THEN mx / area END, 6) + 0.0 AS cx, y1, y2, x1, x2, pixels FROM A JOIN B USING (image)"))
_add("corner_crop", lambda s, d: regions.corner_crop(T.images(s, d)))
_add("spectral_clusters", lambda s, d: spectral.spectral_clusters(T.images(s, d), 2))
_add("orientation", lambda s, d: _tidy(orient.find_angles(volume.scale_means(T.voxels(s, d), 2).withColumn("val", F.col("val") - 128), alpha=0.5, steps=60), "a", "b", "loss", digits=4))


# --- sub-images ---
def _sub_images(s, d, name):
    """Features of each sample's image and of its mirrored one as two sub-images; samples of even number train, odd ones test."""
    f = T.features(s, d).select("sample", F.explode(F.array(F.struct(F.lit(0).alias("sub"), "bin"), F.struct(F.lit(1).alias("sub"), (63 - F.col("bin")).alias("bin")))).alias("k"), "val").select("sample", "k.sub", "k.bin", "val")
    return jobs.parts_grading(f.where("sample % 2 = 0"), f.where("sample % 2 = 1"), T.grades(s, d), rate=1e-3, tables=(name,))[name]


_add("parts_predictions", lambda s, d: _tidy(_sub_images(s, d, "predictions"), "prediction", digits=5))
_add("parts_metrics", lambda s, d: _tidy(_sub_images(s, d, "metrics"), "value", digits=5))
