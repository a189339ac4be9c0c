"""The driver's tables seen as volumes, masks, images, features, regression rows, scored rows, series and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _level(e: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.lit(128.0) + F.lit(256.0) * e.cast("double")))).cast("int")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, y, x, z, val: the vectors of a label are the layers of its volume, 8 by 8."""
    order = Window.partitionBy("label").orderBy("vec_id")
    layers = table(spark, sf_dir, "embeddings").select(F.col("label").alias("sample"), (F.row_number().over(order) - 1).alias("z"), "embedding")
    return layers.select("sample", "z", F.posexplode("embedding").alias("i", "e")).select("sample", F.floor(F.col("i") / 8).cast("int").alias("y"), F.pmod("i", F.lit(8)).cast("int").alias("x"), F.col("z").cast("int").alias("z"), _level(F.col("e")).alias("val"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(spark, sf_dir).where("val > 140").withColumn("p", F.col("val") / 255.0)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, y, x, val: each vector as an image of 8 by 8."""
    flat = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "e"))
    return flat.select("image", F.floor(F.col("i") / 8).cast("int").alias("y"), F.pmod("i", F.lit(8)).cast("int").alias("x"), _level(F.col("e")).alias("val"))


def big_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, y, x, val: one image with a row for each vector."""
    flat = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return flat.select(F.lit(0).alias("image"), "y", F.col("x").cast("int").alias("x"), _level(F.col("e")).alias("val"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, bin, val."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("bin", "e")).select("sample", F.col("bin").cast("int").alias("bin"), F.col("e").cast("double").alias("val"))


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, group_id, grade."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.pmod("vec_id", F.lit(17)).cast("int").alias("group_id"), F.pmod("label", F.lit(4)).cast("int").alias("grade"))


def regression_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, group_id, x (array), y."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("row_id"), F.col("l_suppkey").alias("group_id"), F.array("l_quantity", "l_discount", "l_tax").alias("x"), F.col("l_extendedprice").alias("y"))


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, y, score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score"))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, pos, ts, event_type, value: the events of a user in order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "event_id", "ts", "event_type", "value")


# The same views in SQL.
_NUM = "greatest(0, least(255, floor(128.0 + 256.0 * CAST(embedding[i + 1] AS DOUBLE))))::INT"
SQL = {
    "V": f"V AS (SELECT label AS sample, (i // 8)::INT AS y, (i % 8)::INT AS x, z::INT AS z, {_NUM} AS val FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS z, embedding FROM embeddings) t0, range(0, 64) t1(i))",
    "M": "M AS (SELECT *, val / 255.0::DOUBLE AS p FROM V WHERE val > 140)",
    "I": f"I AS (SELECT vec_id AS image, (i // 8)::INT AS y, (i % 8)::INT AS x, {_NUM} AS val FROM embeddings, range(0, 64) t1(i))",
    "B": f"B AS (SELECT 0 AS image, vec_id::INT AS y, i::INT AS x, {_NUM} AS val FROM embeddings, range(0, 64) t1(i))",
    "FE": "FE AS (SELECT vec_id AS sample, i::INT AS bin, CAST(embedding[i + 1] AS DOUBLE) AS val FROM embeddings, range(0, 64) t1(i))",
    "G": "G AS (SELECT vec_id AS sample, (vec_id % 17)::INT AS group_id, (label % 4)::INT AS grade FROM embeddings)",
    "L": "L AS (SELECT l_orderkey * 16 + l_linenumber AS row_id, l_suppkey AS group_id, l_quantity AS x0, l_discount AS x1, l_tax AS x2, l_extendedprice AS y FROM lineitem)",
    "S": "S AS (SELECT l.doc_id, l.quality AS y, d.n_chars AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)",
    "E": "E AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id, ts, event_type, value FROM events)",
}


def sql(views: str, body: str, recursive: bool = False) -> str:
    """A query over the named views (V M I B FE G L S E)."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(SQL[v] for v in views.split()) + body
