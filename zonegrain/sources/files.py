"""Stacks of images, zone images, sheets, parameters, models and results as Spark sources and sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonegrain.operators import order

PARAMETERS = "zone string, ks1 int, ks2 int, sigma1 int, sigma2 int, N int, large int, small int, wc int, wl int, ws int"
RESULTS = "sample string, grade double"


def stack(spark: SparkSession, root: str) -> DataFrame:
    """sample, z, height, width, data: 8-bit gray slices below root/<sample>/, whose names end in three digits, in order of name."""
    read = spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.*")
    named = read.where(F.lower("origin").rlike("[0-9]{3}[.](png|bmp|tif)$") & (F.col("nChannels") == 1)).withColumn("sample", F.element_at(F.split("origin", "/"), -2))
    # Names are numbered by themselves: no slice goes through that shuffle.
    z = order.numbered(named.select("sample", "origin"), ["sample"], ["origin"], "z").select("origin", F.col("z").cast("int").alias("z"))
    return named.join(z, "origin").select("sample", "z", "height", "width", "data")


def boxed(v: DataFrame, boxes: DataFrame, rebase: bool = False) -> DataFrame:
    """Voxels (sample, y, x, z, val) inside the box of their slice (sample, z, x1, x2, y1, y2: ends included); a box of zeros has none. rebase: places count from the box's corner."""
    some = boxes.where("x2 > 0 or y2 > 0").select("sample", "z", "x1", "x2", "y1", "y2")
    t = v.join(some, ["sample", "z"]).where("x between x1 and x2 and y between y1 and y2")
    y, x = (F.col("y") - F.col("y1"), F.col("x") - F.col("x1")) if rebase else (F.col("y"), F.col("x"))
    return t.select("sample", y.cast("int").alias("y"), x.cast("int").alias("x"), "z", "val")


def voxels(slices: DataFrame) -> DataFrame:
    """sample, y, x, z, val of slices with row-major bytes."""
    at = slices.select("sample", "z", "width", F.hex("data").alias("h"), F.explode(F.sequence(F.lit(0), F.octet_length("data") - 1)).alias("i"))
    return at.select("sample", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), "z", F.conv(F.substring("h", F.col("i") * 2 + 1, F.lit(2)), 16, 10).cast("int").alias("val"))


def slices(v: DataFrame, size: int = 256) -> DataFrame:
    """Voxels to slice rows: sample, z, height, width, data; a slice is one bounded row."""
    rows = v.groupBy("sample", "z").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "val"))), lambda e: F.lpad(F.hex(e["val"]), 2, "0")), "").alias("h"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    return rows.select("sample", "z", "height", "width", F.unhex("h").alias("data"))


def named_slices(v: DataFrame, prefix: str = "") -> DataFrame:
    """slices() with their file names: the prefix, the number in eight digits, .png. Boolean values are 0 and 255."""
    if dict(v.dtypes)["val"] == "boolean":
        v = v.withColumn("val", F.when(F.col("val"), 255).otherwise(0))
    return slices(v).withColumn("name", F.concat(F.lit(prefix), F.lpad(F.col("z").cast("string"), 8, "0"), F.lit(".png")))


def previews(zones: DataFrame) -> DataFrame:
    """Zone images (zone, sample, y, x, val) as bytes: each image from its least to its largest value, 0 to 255; an even image is 0."""
    ends = zones.groupBy("zone", "sample").agg(F.min("val").alias("lo"), F.max("val").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("val") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255 + 1e-9)).otherwise(0)
    return zones.join(ends, ["zone", "sample"]).select("zone", "sample", "y", "x", scaled.cast("int").alias("val"))


def write_slices(rows: DataFrame, path: str) -> None:
    rows.repartition("sample", "z").write.mode("overwrite").partitionBy("sample").parquet(path)


def siblings(listing: DataFrame, chosen: str) -> DataFrame:
    """Files (path) that share the chosen one's leading stem before its number, and its ending; by themselves if it has no number."""
    stem = lambda c: F.regexp_extract(F.substring_index(c, "/", -1), r"^(.*?)[0-9]+[.][^.]+$", 1)
    ending = lambda c: F.substring_index(c, ".", -1)
    numbered = F.lit(chosen).rlike(r"[0-9]+[.][^.]+$")
    return listing.where(F.when(numbered, (stem(F.col("path")) == stem(F.lit(chosen))) & (ending(F.col("path")) == ending(F.lit(chosen)))).otherwise(F.col("path") == chosen))


def resolved(listing: DataFrame) -> DataFrame:
    """sample, path: of a sample's folders the first of <s>/Registration, <s>/<s>/Registration, <s>/<s>_Rec, <s>."""
    p, s = F.col("path"), F.col("sample")
    rank = F.when(p.endswith(F.concat(s, F.lit("/"), s, F.lit("/Registration"))), 1).when(p.endswith(F.concat(s, F.lit("/Registration"))), 0).when(p.endswith(F.concat(s, F.lit("_Rec"))), 2).otherwise(3)
    return listing.groupBy("sample").agg(F.min_by("path", F.struct(rank, "path")).alias("path"))


def _glob(term: str) -> str:
    """A regular expression of a glob term: * is any run, ? any character, all else itself."""
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in term)


def selected(listing: DataFrame, terms: list[str], done: DataFrame | None = None) -> DataFrame:
    """Samples that match one of the glob terms and aren't done."""
    pattern = "|".join(f"(?:^{_glob(t)}$)" for t in terms)
    some = listing.where(F.col("sample").rlike(pattern)).distinct()
    return some if done is None else some.join(done, "sample", "left_anti")


def catalog(listing: DataFrame, least_subjects: int = 0) -> DataFrame:
    """image, mask, sample_id, subject_id from paths .../<sample>/imgs/<n>.png and .../<sample>/masks/<n>.png; raises with fewer subjects."""
    t = listing.withColumn("base", F.substring_index("path", "/", -1)).withColumn("kind", F.element_at(F.split("path", "/"), -2)).withColumn("sample_id", F.element_at(F.split("path", "/"), -3))
    pairs = t.where("kind = 'imgs'").select("sample_id", "base", F.col("path").alias("image")).join(t.where("kind = 'masks'").select("sample_id", "base", F.col("path").alias("mask")), ["sample_id", "base"])
    out = pairs.select("image", "mask", "sample_id", F.substring_index("sample_id", "_", 1).alias("subject_id"))
    if least_subjects and out.select("subject_id").distinct().count() < least_subjects:
        raise ValueError("fewer subjects than the training size")
    return out


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """sample, bin, val of a sheet with a column for each sample and a row for each bin."""
    wide = spark.read.csv(path, header=True)
    return wide.unpivot(["bin"], [c for c in wide.columns if c != "bin"], "sample", "val").select("sample", F.col("bin").cast("int").alias("bin"), F.col("val").cast("double").alias("val"))


def titled(spark: SparkSession, path: str, titles: list[str]) -> DataFrame:
    """name, title, val of a sheet's chosen columns; names are its first column."""
    wide = spark.read.csv(path, header=True)
    lost = [t for t in titles if t not in wide.columns]
    if lost:
        raise ValueError(f"the sheet lacks {', '.join(lost)}")
    name = wide.columns[0]
    return wide.select(F.col(name).alias("__name"), *titles).unpivot(["__name"], titles, "title", "val").select(F.col("__name").alias("name"), "title", F.col("val").cast("double").alias("val"))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """row, col, val of a sheet of numbers, with commas or (where a line has none) semicolons between them.

    If any cell is text the first line is a header and left out; other text cells count as 0.
    """
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    cells = F.when(F.contains("value", F.lit(",")), F.split("value", ",")).otherwise(F.split("value", ";"))
    t = order.numbered(lines.select("at", F.posexplode(cells).alias("col", "cell")), ["col"], ["at"], "row").withColumn("val", F.expr("try_cast(trim(cell) as double)"))
    header = t.agg(F.coalesce(F.max(F.col("val").isNull().cast("long")), F.lit(0)).alias("header"))
    return t.join(F.broadcast(header)).where("row >= header").select((F.col("row") - F.col("header")).alias("row"), F.col("col").cast("long").alias("col"), F.coalesce("val", F.lit(0.0)).alias("val"))


def write_sheet(features: DataFrame, path: str) -> None:
    wide = features.groupBy("bin").pivot("sample").agg(F.first("val")).orderBy("bin")
    wide.write.mode("overwrite").csv(path, header=True)


def parameters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARAMETERS).csv(path, header=True)


def write_by_zone(t: DataFrame, path: str) -> None:
    """Zone images or models; a reader that asks for a zone reads that zone."""
    t.write.mode("overwrite").partitionBy("zone").parquet(path)


def zone_images(spark: SparkSession, path: str, zone: str, schema: str = "sample string, y int, x int, val double") -> DataFrame:
    """The images that write_by_zone stored for one zone; only its folder is read."""
    return spark.read.schema(f"{schema}, zone string").parquet(path).where(F.col("zone") == zone)


def models(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The models that write_by_zone stored."""
    return spark.read.schema(schema).parquet(path)


def append_results(results: DataFrame, path: str) -> None:
    results.select("sample", "grade").write.mode("append").option("sep", ";").csv(path)


def results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULTS).option("sep", ";").csv(path)
