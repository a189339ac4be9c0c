"""Queries of joins, metrics, curves, hold-out fits and resampling, with SQL where SQL says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonegrain.functions.columns import tidy
from zonegrain.operators import descent
from zonegrain.operators import study as S
from zonegrain.plans import views as T
from zonegrain.plans.views import sql

QUERIES, ORACLE = {}, {}


def _add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLE[name] = oracle


def _tidy(df, *cols, digits=6):
    return df.withColumns({c: tidy(F.col(c), digits) for c in cols})


def _rows(s, d):
    return T.regression_rows(s, d)


_add("features_with_grades", lambda s, d: _tidy(S.with_grades(T.features(s, d), T.grades(s, d)), "val"), sql("FE G", " SELECT FE.sample, bin, round(val, 6) + 0.0 AS val, group_id, grade FROM FE JOIN G ON FE.sample = G.sample"))
_add("unmatched_samples", lambda s, d: S.unmatched(T.features(s, d).where("sample % 3 <> 0"), T.grades(s, d).where("sample % 5 <> 0")), sql("G", " SELECT sample, CASE WHEN sample % 3 <> 0 THEN 'grade' ELSE 'features' END AS missing FROM G WHERE (sample % 3 <> 0) <> (sample % 5 <> 0)"))
_add("replicate_grades", lambda s, d: S.repeated_grades(T.grades(s, d), 4), sql("G", " SELECT G.*, i::INT AS sub FROM G, range(0, 4) t(i)"))
_add("tile_images", lambda s, d: S.tiles(T.big_image(s, d), 3, 3, 100, 20), sql("B", ", P AS (SELECT greatest((max(y) + 1 - 100) // 3, 1)::INT AS sy, ((64 - 20) // 3)::INT AS sx FROM B) SELECT image, (i * 3 + j)::INT AS sub, (y - i * sy)::INT AS y, (x - j * sx)::INT AS x, val FROM B, P, range(0, 3) a(i), range(0, 3) b(j) WHERE y >= i * sy AND y < i * sy + 100 AND x >= j * sx AND x < j * sx + 20"))
_add("tile_to_edge", lambda s, d: S.tiles(T.images(s, d), 3, 3, 4, 4, True), sql("I", " SELECT image, (i * 3 + j)::INT AS sub, (y - i * 2)::INT AS y, (x - j * 2)::INT AS x, val FROM I, range(0, 3) a(i), range(0, 3) b(j) WHERE y >= i * 2 AND y < i * 2 + 4 AND x >= j * 2 AND x < j * 2 + 4"))
_add("merge_halves", lambda s, d: S.merge_halves(T.images(s, d).where("x < 5"), T.images(s, d).where("x < 5").withColumn("val", 255 - F.col("val")), 3), sql("I", " SELECT image, y, x, val FROM I WHERE x < 3 UNION ALL SELECT image, y, x + 3, 255 - val FROM I WHERE x < 5"))
_P = lambda s, d: T.features(s, d).select("sample", F.col("bin").alias("sub"), F.col("val").alias("prediction"))
_add("combine_subimages", lambda s, d: _tidy(S.combined(_P(s, d)).withColumnRenamed("prediction", "mean").join(S.combined(_P(s, d), F.max).withColumnRenamed("prediction", "most"), "sample").join(S.combined(_P(s, d), F.median).withColumnRenamed("prediction", "middle"), "sample"), "mean", "most", "middle"), sql("FE", " SELECT sample, round(avg(val), 6) + 0.0 AS mean, round(max(val), 6) + 0.0 AS most, round(median(val), 6) + 0.0 AS middle FROM FE GROUP BY sample"))
_Z = lambda s, d: T.features(s, d).withColumn("val", F.when(F.col("bin").isin(2, 10, 12, 20), 0.0).otherwise(F.col("val")))
_add("zero_bin_drop", lambda s, d: _tidy(S.without_zero_bins(_Z(s, d)), "val"), sql("FE", " SELECT sample, bin, round(val, 6) + 0.0 AS val FROM FE WHERE bin NOT IN (2, 10, 12, 20)"))
_add("standardise_features", lambda s, d: _tidy(S.standardised(T.features(s, d)), "val"), sql("FE", ", A AS (SELECT bin, avg(val) AS m, stddev_pop(val) AS s FROM FE GROUP BY bin) SELECT sample, bin, round((val - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) + 0.0 AS val FROM FE JOIN A USING (bin)"))
_add("centre_by_sample", lambda s, d: _tidy(S.standardised(T.features(s, d), "sample", False), "val"), sql("FE", " SELECT sample, bin, round(val - avg(val) OVER (PARTITION BY sample), 6) + 0.0 AS val FROM FE"))
_add("gram_matrix", lambda s, d: _tidy(S.gram(T.features(s, d)), "val"), sql("FE", " SELECT a.bin AS i, b.bin AS j, round(sum(a.val * b.val), 6) + 0.0 AS val FROM FE a JOIN FE b ON a.sample = b.sample AND a.bin <= b.bin GROUP BY ALL"))
_add("confusion", lambda s, d: S.confusion(T.scored_rows(s, d).withColumn("p", (F.col("score") >= 1000).cast("int")), "y", "p", 3), sql("S", ", C AS (SELECT y, (score >= 1000)::INT AS p, count(*) AS n FROM S GROUP BY ALL) SELECT a::INT AS actual, b::INT AS predicted, coalesce(n, 0) AS n FROM range(0, 3) t(a), range(0, 3) u(b) LEFT JOIN C ON C.y = a AND C.p = b".replace("FROM range(0, 3) t(a), range(0, 3) u(b) LEFT", "FROM (SELECT a, b FROM range(0, 3) t(a), range(0, 3) u(b)) LEFT")))
_add("dice", lambda s, d: _tidy(S.dice(T.mask(s, d), T.voxels(s, d).where("val between 130 and 170"), ["sample", "y", "x", "z"], ["sample"]), "dice"), sql("V", " SELECT sample, round(2.0 * sum((val > 140 AND val BETWEEN 130 AND 170)::INT) / (sum((val > 140)::INT) + sum((val BETWEEN 130 AND 170)::INT) + 1e-9), 6) + 0.0 AS dice FROM V GROUP BY sample"))
_add("regression_metrics", lambda s, d: _tidy(S.regression_metrics(_rows(s, d).withColumn("p", F.get("x", F.lit(0)) * 1500.0), "y", "p").withColumns({"mse": F.col("mse") / 1e6, "abs_error": F.col("abs_error") / 1e6}), "mse", "r2", "abs_error"), sql("L", " SELECT round(avg((y - x0 * 1500.0) ** 2) / 1e6, 6) + 0.0 AS mse, round(1 - sum((y - x0 * 1500.0) ** 2) / (var_pop(y) * count(y)), 6) + 0.0 AS r2, round(sum(abs(y - x0 * 1500.0)) / 1e6, 6) + 0.0 AS abs_error FROM L"))
_add("class_metrics", lambda s, d: _tidy(S.class_metrics(T.scored_rows(s, d).withColumn("score", F.col("score") / 2000.0), "y", "score"), "precision", "recall", "f1", "accuracy"), sql("S", ", C AS (SELECT sum((y = 1 AND score >= 1000)::INT) AS tp, sum((y = 0 AND score >= 1000)::INT) AS fp, sum((y = 1 AND score < 1000)::INT) AS fn, count(*) AS n FROM S) SELECT round(tp / (tp + fp), 6) + 0.0 AS precision, round(tp / (tp + fn), 6) + 0.0 AS recall, round(2 * tp / (2 * tp + fp + fn), 6) + 0.0 AS f1, (tp + fn)::BIGINT AS support, round((n - fp - fn) / n, 6) + 0.0 AS accuracy FROM C"))
_RANK = lambda v, t: f"(rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0)"
_add("spearman", lambda s, d: _tidy(S.spearman(_rows(s, d).withColumn("q", F.get("x", F.lit(0))), "q", "y").drop("p"), "rho"), sql("L", f" SELECT round(corr(a, b), 6) + 0.0 AS rho, count(*) AS n FROM (SELECT {_RANK('x0', 'L')} AS a, {_RANK('y', 'L')} AS b FROM L)"))
_add("wilcoxon_stat", lambda s, d: _tidy(S.wilcoxon(_rows(s, d).withColumn("q", F.get("x", F.lit(0)) * 1490), "y", "q").drop("p"), "statistic", "z"), sql("L", f", D AS (SELECT y - x0 * 1490 AS d FROM L WHERE y - x0 * 1490 <> 0), R AS (SELECT d, {_RANK('abs(d)', 'D')} AS r FROM D) SELECT round(s, 6) + 0.0 AS statistic, n, round((s - n * (n + 1) / 4.0::DOUBLE) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - t / 48), 6) + 0.0 AS z FROM (SELECT least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END))::DOUBLE AS s, count(*) AS n FROM R), (SELECT sum(c::DOUBLE ** 3 - c) AS t FROM (SELECT count(*) AS c FROM D GROUP BY abs(d)))"))
_ROC = ", C AS (SELECT score, sum(y)::BIGINT AS p, sum(1 - y)::BIGINT AS q FROM S GROUP BY score), R AS (SELECT score, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM C WINDOW w AS (ORDER BY score DESC))"
_add("roc_points", lambda s, d: _tidy(S.roc_points(T.scored_rows(s, d), "y", "score"), "tpr", "fpr", "precision"), sql("S", _ROC + " SELECT score AS threshold, p, q, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / np, 6) + 0.0 AS tpr, round(fp / nq, 6) + 0.0 AS fpr, round(tp / (tp + fp), 6) + 0.0 AS precision FROM R"))
_add("auc", lambda s, d: _tidy(S.auc(T.scored_rows(s, d), "y", "score"), "auc"), sql("S", f", R AS (SELECT y, {_RANK('score', 'S')} AS r FROM S) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) + 0.0 AS auc FROM R"))
_add("average_precision", lambda s, d: _tidy(S.average_precision(T.scored_rows(s, d), "y", "score"), "average_precision", "baseline"), sql("S", _ROC + " SELECT round(sum(p * tp / (tp + fp)) / any_value(np), 6) + 0.0 AS average_precision, round(any_value(np) / (any_value(np) + any_value(nq)), 6) + 0.0 AS baseline FROM R"))
_add("class_weights", lambda s, d: _tidy(S.class_weights(T.scored_rows(s, d), "y"), "weight"), sql("S", " SELECT y AS label, count(*) AS n, round(min(count(*)) OVER () / count(*), 6) + 0.0 AS weight FROM S GROUP BY y"))
_add("grade_hist", lambda s, d: T.grades(s, d).groupBy(F.width_bucket(F.col("grade").cast("double"), F.lit(0.0), F.lit(4.0), F.lit(4)).cast("int").alias("bucket")).agg(F.count("*").alias("n")), sql("G", " SELECT grade + 1 AS bucket, count(*) AS n FROM G GROUP BY ALL"))
_add("curve_resample", lambda s, d: _tidy(S.curve_at(S.roc_points(T.scored_rows(s, d), "y", "score"), 101), "tpr"), sql("S", _ROC + ", P AS (SELECT fp / nq AS f1, max(tp / np) AS t1 FROM R GROUP BY ALL), K AS (SELECT coalesce(lag(f1) OVER w, 0) AS f0, coalesce(lag(t1) OVER w, 0) AS t0, f1, t1 FROM P WINDOW w AS (ORDER BY f1)) SELECT 0 AS g, 0.0::DOUBLE AS tpr UNION ALL SELECT g::INT, round(t0 + (g / 100.0::DOUBLE - f0) / (f1 - f0) * (t1 - t0), 6) + 0.0 FROM K, range(1, 101) t(g) WHERE g >= floor(f0 * 100) + 1 AND g <= floor(f1 * 100 + 1e-9)"))

# --- hold-out fits: one predictor in closed form by SQL; more of them are held against refits in the tests ---
_ONE = lambda s, d: _rows(s, d).withColumn("x", F.array(F.get("x", F.lit(0))))
_FOLD = ", F AS (SELECT group_id, count(*)::DOUBLE AS n, sum(x0) AS sx, sum(y) AS sy, sum(x0 * x0) AS xx, sum(x0 * y) AS xy FROM L GROUP BY group_id), A AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(xx) AS xx, sum(xy) AS xy FROM F), D AS (SELECT group_id, A.n - F.n AS n, A.sx - F.sx AS sx, A.sy - F.sy AS sy, A.xx - F.xx AS xx, A.xy - F.xy AS xy FROM F, A), C AS (SELECT group_id, n, xx - sx * sx / n AS g, xy - sx * sy / n AS c, sx / n AS mx, sy / n AS my FROM D)"
_add("ridge_logo", lambda s, d: _tidy(S.predict(_ONE(s, d), S.fold_models(_ONE(s, d), 1), 1).select("row_id", "prediction"), "prediction", digits=3), sql("L", _FOLD + " SELECT row_id, round(my + c / (2 * g) * (x0 - mx), 3) + 0.0 AS prediction FROM L JOIN C USING (group_id)"))
_add("ols_logo", lambda s, d: _tidy(S.fold_models(_ONE(s, d), 1, 0.0).select("group_id", F.get("w", F.lit(0)).alias("slope"), F.get("w", F.lit(1)).alias("intercept")), "slope", "intercept", digits=3), sql("L", _FOLD + " SELECT group_id, round(c / g, 3) + 0.0 AS slope, round(my - c / g * mx, 3) + 0.0 AS intercept FROM C"))
_add("lasso_logo", lambda s, d: _tidy(S.fold_models(_ONE(s, d), 1, 20.0, lasso=True).select("group_id", F.get("w", F.lit(0)).alias("slope")), "slope", digits=3), sql("L", _FOLD + " SELECT group_id, round(sign(c) * greatest(abs(c / sqrt(g)) - 20.0 * n, 0) / sqrt(g), 3) + 0.0 AS slope FROM C"))
_add("ridge_loo", lambda s, d: _tidy(S.predict(_fe(s, d), S.fold_models(_fe(s, d), 1, 0.5, False), 1).select("row_id", "prediction"), "prediction"), sql("FE G", ", L AS (SELECT sample AS row_id, sample AS group_id, val AS x0, grade::DOUBLE AS y FROM FE JOIN G USING (sample) WHERE bin = 3)" + _FOLD + " SELECT row_id, round(my + c / (g + 0.5) * (x0 - mx), 6) + 0.0 AS prediction FROM L JOIN C USING (group_id)"))
_add("ridge_logo_three", lambda s, d: _tidy(S.fold_models(_rows(s, d), 3).select("group_id", *(F.get("w", F.lit(i)).alias(f"w{i}") for i in range(4))), "w0", "w1", "w2", "w3", digits=3))
_add("fold_coef_mean", lambda s, d: _tidy(S.coefficient_means(S.fold_models(_ONE(s, d), 1, 0.0)), "coef", digits=3), sql("L", _FOLD + " SELECT 0 AS bin, round(avg(c / g), 3) + 0.0 AS coef FROM C UNION ALL SELECT 1, round(avg(my - c / g * mx), 3) + 0.0 FROM C"))
_add("fold_assign", lambda s, d: S.group_folds(_rows(s, d), 5), sql("L", ", K AS MATERIALIZED (SELECT group_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, group_id) AS r FROM L GROUP BY group_id), D(r, loads, fold) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], 0 UNION ALL SELECT D.r + 1, list_transform(D.loads, lambda x, i: x + CASE WHEN i = list_position(D.loads, list_min(D.loads)) THEN K.n ELSE 0 END), list_position(D.loads, list_min(D.loads)) - 1 FROM D JOIN K ON K.r = D.r + 1) SELECT group_id, n, fold::INT AS fold FROM K JOIN D USING (r)", True))


def _fe(s, d):
    return T.features(s, d).where("bin = 3").join(T.grades(s, d), "sample").select(F.col("sample").alias("row_id"), F.col("sample").alias("group_id"), F.array("val").alias("x"), F.col("grade").cast("double").alias("y"))


_add("knn_loo", lambda s, d: _tidy(S.knn(S.rows_of(T.features(s, d)).join(T.grades(s, d).select("sample", F.col("grade").alias("y")), "sample")), "prediction"), sql("FE G", ", D AS (SELECT a.sample, b.sample AS other, sum((a.val - b.val) ** 2) AS d2 FROM FE a JOIN FE b ON a.bin = b.bin AND a.sample <> b.sample GROUP BY ALL), R AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY d2, other) AS r FROM D), W AS (SELECT R.sample, grade, CASE WHEN min(d2) OVER (PARTITION BY R.sample) = 0 THEN (d2 = 0)::INT ELSE 1 / sqrt(d2) END AS w FROM R JOIN G ON R.other = G.sample WHERE r <= 5) SELECT sample, round(sum(w * grade) / sum(w), 6) + 0.0 AS prediction FROM W GROUP BY sample"))

# --- resampling ---
_LCG = lambda e: "(((((({e}) % 2147483647) * 48271 + 11) % 2147483647 * 48271 + 11) % 2147483647 * 48271 + 11) % 2147483647)".replace("{e}", e)
_add("bootstrap_auc", lambda s, d: _tidy(S.bootstrap_auc(T.scored_rows(s, d), "y", "score", "doc_id", 50), "auc"), sql("S", f", N AS (SELECT y, score, row_number() OVER (PARTITION BY y ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY y) AS n FROM S), P AS (SELECT rep, N.y, {_LCG('rep * 1000003 + i * 7919 + y * 104729 + 42')} % n AS i FROM N, range(0, 50) t(rep)), Q AS (SELECT rep, N.y, N.score FROM P JOIN N ON P.y = N.y AND P.i = N.i), R AS (SELECT rep, y, rank() OVER (PARTITION BY rep ORDER BY score) + (count(*) OVER (PARTITION BY rep, score) - 1) / 2.0 AS r FROM Q) SELECT rep::INT AS replicate, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) + 0.0 AS auc FROM R GROUP BY rep"))
_add("bootstrap_auc_ci", lambda s, d: _tidy(S.interval(S.bootstrap_auc(T.scored_rows(s, d), "y", "score", "doc_id", 50), "auc"), "mean", "low", "high"), f"WITH A AS ({ORACLE['bootstrap_auc'].replace('round(', '(').replace(', 6) + 0.0 AS auc', ') AS auc')}) SELECT round(avg(auc), 6) + 0.0 AS mean, round(quantile_cont(auc, 0.02), 6) + 0.0 AS low, round(quantile_cont(auc, 0.97), 6) + 0.0 AS high FROM A")

# --- descent, and parts of samples ---
_add("descent_fit", lambda s, d: _tidy(descent.descent_model(_ONE(s, d), 1, 1e-4, 200).select(F.get("w", F.lit(0)).alias("slope"), F.get("w", F.lit(1)).alias("intercept")), "slope", "intercept", digits=3), sql("L", ", A AS (SELECT count(*)::DOUBLE AS n, sum(x0)::DOUBLE AS sx, sum(y)::DOUBLE AS sy, sum(x0 * x0)::DOUBLE AS xx, sum(x0 * y)::DOUBLE AS xy FROM L), R AS (SELECT 0 AS t, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b, n, sx, sy, xx, xy FROM A UNION ALL SELECT t + 1, w - 2e-4::DOUBLE / n * (xx * w + sx * b - xy), b - 2e-4::DOUBLE / n * (sx * w + n * b - sy), n, sx, sy, xx, xy FROM R WHERE t < 200) SELECT round(w, 3) + 0.0 AS slope, round(b, 3) + 0.0 AS intercept FROM R WHERE t = 200", True))
_WHOLE = lambda s, d: _rows(s, d).groupBy("group_id").agg(*(F.avg(F.get("x", F.lit(i)).cast("double")).alias(f"x{i}") for i in range(2))).select("group_id", F.array("x0", "x1").alias("x"))
_PARTS = ", F AS (SELECT group_id, count(*)::DOUBLE AS n, sum(x0)::DOUBLE AS s0, sum(x1)::DOUBLE AS s1, sum(y)::DOUBLE AS sy, sum(x0 * x0)::DOUBLE AS g00, sum(x0 * x1)::DOUBLE AS g01, sum(x1 * x1)::DOUBLE AS g11, sum(x0 * y)::DOUBLE AS c0, sum(x1 * y)::DOUBLE AS c1 FROM L GROUP BY group_id), A AS (SELECT sum(n) AS n, sum(s0) AS s0, sum(s1) AS s1, sum(sy) AS sy, sum(g00) AS g00, sum(g01) AS g01, sum(g11) AS g11, sum(c0) AS c0, sum(c1) AS c1 FROM F), D AS (SELECT F.group_id, F.s0 / F.n AS x0, F.s1 / F.n AS x1, A.n - F.n AS n, (A.s0 - F.s0) / (A.n - F.n) AS m0, (A.s1 - F.s1) / (A.n - F.n) AS m1, (A.sy - F.sy) / (A.n - F.n) AS my, A.g00 - F.g00 AS g00, A.g01 - F.g01 AS g01, A.g11 - F.g11 AS g11, A.c0 - F.c0 AS c0, A.c1 - F.c1 AS c1 FROM F, A), E AS (SELECT *, g00 - n * m0 * m0 + 1 AS p, g01 - n * m0 * m1 AS q, g11 - n * m1 * m1 + 1 AS r, c0 - n * m0 * my AS u, c1 - n * m1 * my AS v FROM D)"
for _name, _centred, _less in (("parts_loo", True, " - {}"), ("parts_loo_plain", False, "")):
    _add(_name, lambda s, d, c=_centred: _tidy(descent.parts_loo(_WHOLE(s, d), _rows(s, d), 2, centred=c).select("group_id", "prediction"), "prediction", digits=2), sql("L", _PARTS + f" SELECT group_id, round(my + (u * r - v * q) / (p * r - q * q) * (x0{_less.format('m0')}) + (v * p - u * q) / (p * r - q * q) * (x1{_less.format('m1')}), 2) + 0.0 AS prediction FROM E"))
