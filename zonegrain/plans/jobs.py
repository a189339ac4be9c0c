"""Composed jobs: from volumes to zone images, to features, to predictions and metrics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonegrain.operators import descent, learn, order, regions, resample, selection, stencil, study, volume
from zonegrain.sources import shared


#: What titles of zone images begin with.
ZONES = ("surf", "deep", "calc")


def zone_images(v: DataFrame, side: int, zones: dict[str, tuple[int, int]], centre_at: float = 128) -> DataFrame:
    """zone, sample, y, x, val: a centred crop, the surface at each sample's own threshold, and the mean + std image of each zone below it."""
    crop = volume.centre_crop(v, centre_at, side)
    t = volume.otsu(crop, ["sample"])
    hit = F.when(F.col("val") > F.col("threshold"), F.col("z"))
    top = crop.join(t, "sample").groupBy(*volume.COLUMN).agg(F.coalesce(F.min(hit), F.lit(0)).alias("surface"))
    slabs = volume.slabs(crop, top, zones)
    stats = slabs.groupBy("zone", *volume.COLUMN).agg(F.avg("val").alias("m"), F.coalesce(F.stddev_samp("val"), F.lit(0.0)).alias("s"))
    return stats.select("zone", *volume.COLUMN, (F.col("m") + F.col("s")).alias("val"))


def texture_features(images: DataFrame, **parameters) -> DataFrame:
    """sample, bin, val of images (image, y, x, val)."""
    return stencil.mrelbp(images, **parameters).select(F.col("image").alias("sample"), "bin", "val")


def picked(images: DataFrame, title: str) -> DataFrame:
    """The images (zone, ...) of the zone that a title begins with; an error for any other title."""
    zone = title[:4].lower()
    if zone not in ZONES:
        raise ValueError(f"a title begins with one of {', '.join(ZONES)}: {title!r}")
    return images.where(F.col("zone") == zone)


#: Zones whose images are cropped where a corner has no tissue.
CROPPED = ("deep", "calc")


def prepared(images: DataFrame, crop: bool = True, median: bool = False) -> DataFrame:
    """Zone images (zone, sample, y, x, val) without empty corners in the deep and calcified zones, and with a 3 * 3 median if asked for."""
    named = F.concat_ws("/", "zone", F.col("sample").cast("string"))
    t = images.select(named.alias("image"), "y", "x", F.col("val").cast("double").alias("val"))
    if crop:
        t = shared.saved(t, "uncropped")
        some = F.substring_index("image", "/", 1).isin(*CROPPED)
        t = t.where(~some).unionByName(regions.corner_crop(t.where(some)).select("image", "y", "x", "val"))
    if median:
        t = stencil.median_filter(t, 3)
    kind = dict(images.dtypes)["sample"]
    return t.select(F.substring_index("image", "/", 1).alias("zone"), F.expr("substring(image, instr(image, '/') + 1)").cast(kind).alias("sample"), "y", "x", "val")


def _sets(table: DataFrame, columns: list[str]) -> list[dict]:
    """Parameter sets (a bounded list) as dictionaries."""
    return [{c: r[c] for c in (*columns, *stencil.SET)} for r in table.orderBy(*columns).collect()]


def _textures(images: DataFrame, sets: list[dict]) -> DataFrame:
    """zone, sample, par_id, bin, val of zone images, by every set that its zone has."""
    kind = dict(images.dtypes)["sample"]
    named = images.select(F.concat_ws("/", "zone", F.col("sample").cast("string")).alias("image"), "y", "x", F.col("val").cast("double").alias("val"))
    found = stencil.texture_sets(named, sets, by_zone=True)
    return found.select(F.substring_index("image", "/", 1).alias("zone"), F.expr("substring(image, instr(image, '/') + 1)").cast(kind).alias("sample"), "par_id", "bin", "val")


def zone_features(images: DataFrame, parameters: DataFrame, crop: bool = False, median: bool = False) -> DataFrame:
    """zone, sample, bin, val of zone images (zone, sample, y, x, val) by the parameters of their zone (a row for each zone).

    Local standardisation, then median-robust patterns as shares of all bins. Zones without parameters are left out; a zone
    other than surf, deep and calc is an error.
    """
    sets = [{**p, "par_id": 0} for p in _sets(parameters, ["zone"])]
    for p in sets:
        if p["zone"] not in ZONES:
            raise ValueError(f"a zone is one of {', '.join(ZONES)}: {p['zone']!r}")
    mine = images.where(F.col("zone").isin([p["zone"] for p in sets]))
    mine = prepared(mine, crop, median) if crop or median else mine
    return _textures(mine, sets).drop("par_id")


def graded(features: DataFrame, grades: DataFrame, n: int = 5, alpha: float = 0.1, limit: float = 1) -> tuple[DataFrame, dict]:
    """sample, actual, raw, prediction (raw within the grades' range), probability; and the PCA model with the models of all folds.

    Zero bins are dropped, scores are whitened; ridge (penalty on columns over their norm) and logistic models (of grades above
    the limit) are fitted without the sample's group.
    """
    kept = study.without_zero_bins(features)
    model = learn.pca(kept, n)
    k = len(model["sv"])
    rows = learn.project(study.rows_of(kept), model).join(grades, "sample").select(F.col("sample").alias("row_id"), "group_id", F.col("scores").alias("x"), F.col("grade").cast("double").alias("y"))
    rows = shared.saved(rows, "scores")
    linear = study.fold_models(rows, k, alpha, True)
    binary = rows.withColumn("y", (F.col("y") > limit).cast("double"))
    logistic = learn.logistic_folds(binary, k)
    chance = learn.logistic_logo(binary, k, models=logistic).select("row_id", "probability")
    raw = study.predict(rows, linear, k).join(chance, "row_id")
    top = grades.agg(F.max("grade").cast("double").alias("top"))
    out = raw.join(F.broadcast(top)).select(F.col("row_id").alias("sample"), F.col("y").alias("actual"), F.col("prediction").alias("raw"), F.least(F.greatest("prediction", F.lit(0.0)), "top").alias("prediction"), "probability")
    return out, {**model, "linear": linear, "logistic": logistic, "samples": rows.count()}


def noise_report(images: DataFrame, sets: DataFrame) -> DataFrame:
    """Means of mse and psnr by data set and zone, with totals. sets: image, dataset, zone."""
    n = stencil.noise(images, 3).join(sets, "image")
    return n.rollup("dataset", "zone").agg(F.avg("mse").alias("mse"), F.count("*").alias("n"))


def zone_table(listings: dict[str, DataFrame], names: DataFrame) -> DataFrame:
    """Folder listings (path) of several zones as one table with the names (zone, pos, name) by order of file name."""
    out = None
    for zone, listing in listings.items():
        one = listing.select(F.lit(zone).alias("zone"), "path")
        out = one if out is None else out.unionByName(one)
    return order.numbered(out, ["zone"], ["path"], "pos").withColumn("pos", F.col("pos").cast("int")).join(names, ["zone", "pos"])


def metrics(t: DataFrame, limit: float = 1, threshold: float = 0.5) -> DataFrame:
    """name, value of rows (actual, raw, probability).

    mse, r2, abs_error, rho and statistic with their chances are those of the raw linear predictions, before they are cut to the
    grades' range. auc, average_precision, baseline, precision, recall, f1, support, accuracy and the confusion counts (tn, fp,
    fn, tp) are those of the logistic probability, against grades above the limit; a probability above the threshold is positive.
    """
    t = shared.saved(t.select("actual", "raw", "probability", (F.col("actual") > limit).cast("int").alias("y"), (F.col("probability") > threshold).cast("int").alias("label")), "metrics")
    long = lambda df: df.select(*(F.col(c).cast("double").alias(c) for c in df.columns)).unpivot([], df.columns, "name", "value")
    counts = t.agg(*(F.count_if((F.col("y") == a) & (F.col("label") == b)).alias(n) for a, b, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))))
    parts = [study.regression_metrics(t, "actual", "raw"), study.spearman(t, "actual", "raw").select("rho", F.col("p").alias("rho_p")), study.wilcoxon(t, "actual", "raw").select("statistic", F.col("p").alias("statistic_p")), study.auc(t, "y", "probability"), study.average_precision(t, "y", "probability"), study.class_metrics(t, "y", "label"), counts]
    out = None
    for one in map(long, parts):
        out = one if out is None else out.unionByName(one)
    return out


def report(predictions: DataFrame) -> DataFrame:
    """sample, actual, prediction, difference, logistic, in order of sample."""
    return predictions.select("sample", "actual", "prediction", F.abs(F.col("actual") - F.col("prediction")).alias("difference"), F.col("probability").alias("logistic")).orderBy("sample")


def stored_model(model: dict, zone: str) -> DataFrame:
    """One row of learn.MODEL from what graded() returns: components, and the means over folds of linear and logistic weights.

    sv is over n_features - 1. The logistic models have no intercept, so that it is 0.
    """
    k = len(model["sv"])
    linear = [r["coef"] for r in study.coefficient_means(model["linear"]).orderBy("bin").collect()]
    logistic = [r["coef"] for r in study.coefficient_means(model["logistic"]).orderBy("bin").collect()]
    over = math.sqrt(max(model["samples"] - 1, 1) / max(len(model["bins"]) - 1, 1))
    row = (zone, k, [float(x) for x in model["mean"]], model["eigvec"], [float(x) * over for x in model["sv"]], linear[:-1], logistic, linear[-1], 0.0)
    return model["linear"].sparkSession.createDataFrame([row], learn.MODEL)


def weight_report(models: DataFrame, samples: int) -> DataFrame:
    """zone, kind, bin, weight of stored models, fitted on so many samples.

    linear_pca and logistic_pca: weights of components (bin). linear and logistic: each component times its deviation (over
    n_samples - 1) and its weight, summed, plus the mean of the feature (bin). pc1, pc2, ...: the components.
    """
    deviation = F.transform("sv", lambda s: s * F.sqrt((F.size("mean") - 1) / F.lit(float(max(samples - 1, 1)))))
    t = models.select("zone", "eigvec", "mean", "w_lin", "w_log", deviation.alias("sd"))
    out = None
    for kind, w in (("linear", "w_lin"), ("logistic", "w_log")):
        scaled = F.zip_with(w, "sd", lambda a, b: a * b)
        bins = t.select("zone", "eigvec", scaled.alias("w"), F.posexplode("mean").alias("bin", "m"))
        back = F.aggregate(F.zip_with("eigvec", "w", lambda e, v: F.get(e, F.col("bin")) * v), F.lit(0.0), lambda a, b: a + b)
        one = bins.select("zone", F.lit(kind).alias("kind"), "bin", (back + F.col("m")).alias("weight")).unionByName(t.select("zone", F.lit(f"{kind}_pca").alias("kind"), F.posexplode(w).alias("bin", "weight")))
        out = one if out is None else out.unionByName(one)
    components = t.select("zone", F.posexplode("eigvec").alias("c", "v")).select("zone", F.concat(F.lit("pc"), F.col("c") + 1).alias("kind"), F.posexplode("v").alias("bin", "weight"))
    return out.unionByName(components)


def grading(images: DataFrame, grades: DataFrame, parameters: DataFrame, n: int = 5, limit: float = 1, replicates: int = 2000, alpha: float = 0.1, crop: bool = True, tables: tuple[str, ...] = ("predictions", "metrics", "curves", "intervals", "models")) -> dict[str, DataFrame]:
    """From zone images (zone, sample, y, x, val), by zone: predictions, metrics, curves (ROC and precision against recall, of
    the logistic probability), intervals (of AUC and average precision, stratified resamples) and models; only the tables asked for."""
    features = shared.saved(zone_features(images, parameters, crop), "zone-features")
    out: dict[str, DataFrame] = {}
    for zone in [r[0] for r in parameters.select("zone").orderBy("zone").collect()]:
        found, model = graded(features.where(F.col("zone") == zone).drop("zone"), grades, n, alpha, limit)
        found = shared.saved(found, "predictions")
        scored = found.select("sample", (F.col("actual") > limit).cast("int").alias("y"), F.col("probability").alias("score"))
        make = {
            "predictions": lambda: report(found),  # noqa: B023
            "metrics": lambda: metrics(found, limit),  # noqa: B023
            "curves": lambda: study.roc_points(scored, "y", "score").select("threshold", "tpr", "fpr", "precision", F.col("tpr").alias("recall")),  # noqa: B023
            "intervals": lambda: resample.intervals(resample.bootstrap(scored, "y", "score", "sample", ("auc", "average_precision"), replicates)),  # noqa: B023
            "models": lambda: stored_model(model, zone).drop("zone"),  # noqa: B023
        }
        for name in tables:
            t = make[name]().withColumn("zone", F.lit(zone))
            out[name] = out[name].unionByName(t) if name in out else t
    return out


def full_grading(v: DataFrame, grades: DataFrame, parameters: DataFrame, side: int, zones: dict[str, tuple[int, int]], **options) -> dict[str, DataFrame]:
    """From stacks (voxels: sample, y, x, z, val) to all that grading() returns."""
    return grading(zone_images(v, side, zones), grades, parameters, **options)


def texture_search(images: DataFrame, grades: DataFrame, sets: DataFrame, n: float = 5, alpha: float = 0.1, by_split: bool = True, crop: bool = True) -> DataFrame:
    """zone, split, par_id, error: for each zone and each split left out, the parameter set (par_id and stencil.SET) with the least error.

    grades: sample, group_id, grade, and split (without it each sample is its own split). by_split False: one choice on all
    samples, split null. The error is that of groups held out of the rows that stay (selection.split_errors); a set that
    can't be fitted has 1e6. Images are read twice in all, whatever the number of sets and splits.
    """
    ready = prepared(images, crop)
    features = shared.saved(_textures(ready, _sets(sets, ["par_id"])), "textures-of-sets")
    if "split" not in grades.columns:
        grades = grades.withColumn("split", F.col("sample").cast("long"))
    errors = selection.split_errors(features, grades, n, alpha, ("zone", "par_id"), whole=not by_split)
    return study.best_set(errors, ["zone", "split"])


def parts_grading(train: DataFrame, test: DataFrame, grades: DataFrame, n: int = 15, rate: float = 1e-5, epochs: int = 5000, replicates: int = 2000, tables: tuple[str, ...] = ("predictions", "metrics", "intervals", "model")) -> dict[str, DataFrame]:
    """A model of sub-images for sub-images: predictions (set, sample, sub, actual, prediction), metrics and intervals by set, model.

    train, test: features (sample, sub, bin, val); grades (sample, grade) count for each sub-image of a sample. Components are
    whitened and those of the training set; the linear model is fitted by gradient descent. metrics (set, name, value): mse, r2,
    abs_error, rho and statistic with their chances, auc of predictions that round above 0 against grades above 0, and slope and
    intercept of predictions over grades. intervals are those of the mse over plain resamples. Only the tables asked for are made.
    """
    keyed = lambda t, name: t.select(F.lit(name).alias("set"), "sample", "sub", "bin", "val")
    listed = shared.saved(study.listed(keyed(train, "train").unionByName(keyed(test, "test")), ("set", "sample", "sub")), "part-rows")
    model = learn.pca_of(listed.where("set = 'train'"), n)
    k = len(model["sv"])
    rows = learn.project(listed.drop("at"), model).select("sample", "sub", F.col("scores").alias("x"), "set").join(grades.select("sample", F.col("grade").cast("double").alias("y")), "sample")
    rows = shared.saved(rows, "part-scores")
    fitted = shared.saved(descent.descent_model(rows.where("set = 'train'"), k, rate, epochs), "part-model")
    found = shared.saved(descent.predicted(rows, fitted, k).select("set", "sample", "sub", F.col("y").alias("actual"), "prediction"), "part-predictions")
    out: dict[str, DataFrame] = {k: t for k, t in (("predictions", found), ("model", fitted)) if k in tables}
    if "metrics" in tables:
        own = ("set",)
        signs = found.select("set", (F.col("actual") > 0).cast("int").alias("y"), (F.bround("prediction", 0) > 0).cast("int").alias("p"))
        line = found.groupBy("set").agg(F.regr_slope("prediction", "actual").alias("slope"), F.regr_intercept("prediction", "actual").alias("intercept"))
        values: list[tuple[str, str, float | None]] = []
        for t in (study.regression_metrics(found, "actual", "prediction", own), study.spearman(found, "actual", "prediction", own).select("set", "rho", F.col("p").alias("rho_p")), study.wilcoxon(found, "actual", "prediction", own).select("set", "statistic", F.col("p").alias("statistic_p")), study.auc(signs, "y", "p", own), line):
            got = {r["set"]: r for r in t.collect()}  # a row a set, so that no plan holds the steps of all metrics
            values += [(k, name, got[k][name] if k in got else None) for k in ("train", "test") for name in t.columns[1:]]
        cells = [F.struct(F.lit(name).alias("name"), F.lit(v).cast("double").alias("value"), F.lit(k).alias("set")) for k, name, v in values]
        out["metrics"] = found.sparkSession.range(1).select(F.inline(F.array(*cells)))
    if "intervals" in tables:
        for name in ("train", "test"):
            drawn = resample.bootstrap(found.where(F.col("set") == name), "actual", "prediction", F.concat_ws("/", F.col("sample").cast("string"), F.col("sub").cast("string")), ("mse",), replicates, stratified=False)
            t = resample.intervals(drawn).withColumn("set", F.lit(name))
            out["intervals"] = out["intervals"].unionByName(t) if "intervals" in out else t
    return out
