"""Exact deduplication as a stateful stream.

Rows arrive as a stream of digests. State is keyed by the digest, lives on disk (RocksDB), has no watermark and never
expires; it holds the stable identifier (the largest doc_id so far), the content locator of that row and the number of
rows. Partial aggregation before the shuffle sends a row for each digest and task, so a group of copies of any size is
cheap. Texts don't pass through the stream. Where a digest was hit more than once, the full bytes are compared: texts of
hits are reduced to distinct (digest, text) on the map side and counted; a digest that stands for several texts is split
by its texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonegrain.llm import common

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State stores live on disk, and are closed after each batch: an open one holds some MB of disk, however small.
STATE = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
#: Digests of hits up to this many bytes are broadcast to find the texts to compare; beyond it a shuffled join does.
BROADCAST_BYTES = 32 << 20


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def start(spark: SparkSession, feed: str, schema, state: str, out: str, files_per_trigger: int | None = None) -> None:
    """Runs the stream over all files of the feed that its checkpoint (state) hasn't seen, and appends updated groups to out."""
    before = {k: spark.conf.get(k) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema)
        if files_per_trigger:
            stream = stream.option("maxFilesPerTrigger", files_per_trigger)
        groups = stream.parquet(feed).groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("group_size"))
        # A repeated batch replaces what its first try wrote.
        run = groups.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_trigger: int | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, keep_locator.

    Texts are equal when identical; a null text counts as empty, and a null doc_id as smaller than any other. Of equal texts the row with the largest doc_id stays (rows that
    repeat the doc_id too: one of them). No text length is special. An empty table gives no row. Other columns of docs
    aren't read, so their names may clash. digest may be weaker than the default: equal digests of different texts are
    told apart by their bytes.
    """
    spark = docs.sparkSession
    text = common.text_column(docs)
    rows = common.saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"), F.sha2(text, 256).alias("text_sha256"), F.input_file_name().alias("locator")), "digests")
    feed, out = rows.inputFiles(), common.scratch(spark, "groups")
    if not feed:
        return _empty(spark)
    start(spark, feed[0].rsplit("/", 1)[0], rows.schema, common.scratch(spark, "dedup-state"), out, files_per_trigger)
    found = spark.read.schema("digest binary, keep struct<doc_id: bigint, locator: string>, group_size bigint, batch long").parquet(out)
    groups = found.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("g")).select("digest", "g.keep", "g.group_size")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), digest(text).alias("digest"))
    clash = common.saved(_clashes(plain, groups.where("group_size > 1").select("digest")), "clashes")
    # Numbered before the join: above it, the rows of a digest would have to stay in one task.
    same = Window.partitionBy("doc_id", "digest").orderBy("locator")
    numbered = rows.withColumn("nth", F.row_number().over(same))
    result = numbered.join(groups, "digest").select("digest", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("keep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256", F.col("keep.locator").alias("keep_locator"))
    if clash.isEmpty():
        return result.drop("digest")
    whole = Window.partitionBy("digest", "text")
    first = F.row_number().over(whole.orderBy(F.desc("doc_id"))) == 1
    split = plain.join(clash, "digest", "left_semi").select("doc_id", F.max("doc_id").over(whole).alias("keep_id"), F.count("*").over(whole).alias("group_size"), first.alias("kept"), F.sha2("text", 256).alias("text_sha256"), F.lit(None).cast("string").alias("keep_locator"))
    return result.join(clash, "digest", "left_anti").drop("digest").unionByName(split)


def survivors(docs: DataFrame) -> DataFrame:
    """One row of docs for each text, that with the largest doc_id, with its columns as they are. A row without doc_id stays if its text has no row with one."""
    found = common.saved(deduplicate(docs).select("doc_id", "text_sha256", "keep_id", "kept"), "deduplicated")
    key = [F.sha2(common.text_column(docs), 256)]
    left = common.without(docs, found.where("not (doc_id <=> keep_id)").select("doc_id", "text_sha256"), key)
    # Rows that repeat the doc_id as well, or have none: one of each text stays.
    return common.once(left, found.where("doc_id <=> keep_id and not kept").select("doc_id", "text_sha256"), key)


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, keep_locator string")


def _clashes(plain: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests that stand for more than one text, by the full bytes of all hits."""
    hits = common.saved(hits, "hits")
    small = hits.count() * 64 <= BROADCAST_BYTES
    texts = plain.join(F.broadcast(hits) if small else hits, "digest", "left_semi").select("digest", "text").distinct()
    return texts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
