"""Threshold-scaled fingerprints: every shingle hash below a fixed fraction of the hash range is kept.

A sketch is a sorted array of 64-bit hashes of word 5-shingles (words: ``[^\\x20\\x09-\\x0D]+``; of fewer words the whole
sequence; of none an empty sketch). Its size follows the text, so sketches of very unequal texts can be compared by
containment, and the sketch of a union is the union of sketches. A text none of whose hashes lies below the fraction
keeps its smallest one. A hash is the first 16 hexadecimal digits of the MD5 of the shingle's words with spaces between, in
lower case: as text they order as the numbers do. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonegrain.llm import common

#: The share of the hash range that is kept.
FRACTION = 1 / 4
SHINGLE = 5


def _limit(fraction: float) -> str:
    """The hash at which the fraction of the range ends."""
    return f"{min(int(fraction * 2**64), 2**64 - 1):016x}"


def sketch(text: Column, fraction: float = FRACTION, size: int = SHINGLE) -> Column:
    """Sorted array of hashes of a text; null for null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    name = lambda shingle: F.substring(F.md5(F.array_join(shingle, " ").cast("binary")), 1, 16)
    # One expression that names its parts: each part is an element of a one-element array, so that it is computed once.
    hashes = _let(words, lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (size - 1))), lambda i: name(F.slice(w, i, F.lit(size))))).otherwise(F.array().cast("array<string>")))
    return _let(hashes, lambda s: _let(F.sort_array(F.array_distinct(F.filter(s, lambda x: x < F.lit(_limit(fraction))))), lambda kept: F.when((F.size(kept) > 0) | (F.size(s) == 0), kept).otherwise(F.array(F.array_min(s)))))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def to_string(sketched: Column) -> Column:
    return F.array_join(sketched, " ")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    common_ = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common_ / (F.size(a) + F.size(b) - common_))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of both texts' shingles together: hashes below the fraction, or else the smallest."""
    return _let(F.sort_array(F.array_union(a, b)), lambda u: _let(F.filter(u, lambda x: x < F.lit(_limit(fraction))), lambda kept: F.when((F.size(kept) > 0) | (F.size(u) == 0), kept).otherwise(F.slice(u, 1, 1))))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie at or below the key, by binary search."""
    if not bounds:
        return F.lit(0)
    n = 1 << len(bounds).bit_length()
    steps = [n >> i for i in range(1, n.bit_length())]
    table = F.array(*(F.lit(b).cast("long") for b in bounds))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) <= key), step).otherwise(0))


def with_next(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: each document with the next by descending doc_id, the last with the first.

    Ranges of doc_id are chosen by approximate quantiles, so that any distribution of ids is dealt evenly; a range takes
    what follows its last document from the first document of the next range.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    n = common.partitions(spark)
    # Rows without doc_id come last, dealt by a hash of their text.
    plain = plain.withColumn("order", F.coalesce("doc_id", F.pmod(F.xxhash64("text"), F.lit(1 << 40)) - F.lit(2**63 - 1)))
    quantiles = plain.agg(F.percentile_approx("order", [i / n for i in range(1, n)] or [0.5])).first()[0] or []
    ranged = plain.withColumn("range", _range_of(F.col("order"), sorted(set(quantiles))))
    # The first document of each range: one row a range.
    heads = ranged.groupBy("range").agg(F.min(F.struct(F.bitwise_not("order").alias("order"), "text")).alias("head"))
    around = Window.orderBy(F.desc("range"))
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = heads.select("range", F.coalesce(F.lead("head.text").over(around), F.first("head.text").over(whole)).alias("head_text")).withColumn("head_sketch", sketch(F.col("head_text"), fraction))
    order = Window.partitionBy("range").orderBy(F.desc("order"), "text")
    placed = ranged.repartition(n, "range").withColumn("sketch", sketch(F.col("text"), fraction)).select("*", F.lead("text").over(order).alias("next_text"), F.lead("sketch").over(order).alias("next_sketch"))
    return placed.join(follow, "range", "left").select("doc_id", "text", "sketch", F.coalesce("next_text", "head_text").alias("next_text"), F.coalesce("next_sketch", "head_sketch").alias("next_sketch"))


def fingerprint_edits(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs (doc_id, text).

    The edited text has the last floor(n_chars/3) code points replaced by the first as many (or all) of the next
    document. Null counts as empty; texts of any length count whole. Repeated doc_ids follow one another in order of
    text, rows without one come last, in order of a hash of the text. A single document is its own next; an empty table gives no row. Other columns aren't read.
    """
    rows = with_next(docs, fraction).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - third), F.left("next_text", third))
    rows = rows.withColumn("edited", edited).select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited"), fraction).alias("edited_sketch"))
    return rows.select("doc_id", "n_chars", "edited_sha256", to_string(F.col("sketch")).alias("fingerprint"), to_string(F.col("edited_sketch")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SKETCH = "list_transform(CASE WHEN len({w}) = 0 THEN [] ELSE range(1, greatest(2, len({w}) - 3)) END, lambda i: md5(array_to_string({w}[i:i + 4], ' '))[1:16])"
_KEPT = "list_sort(list_distinct(CASE WHEN len(list_filter({s}, lambda x: x < '4000000000000000')) > 0 OR len({s}) = 0 THEN list_filter({s}, lambda x: x < '4000000000000000') ELSE [list_min({s})] END))"
_LIKE = "CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS u, length(t) // 3 AS k FROM d),
e AS (SELECT doc_id, t, u, left(t, length(t) - k) || left(u, k) AS v FROM n),
w AS (SELECT *, {", ".join(f"list_filter(string_split_regex({x}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w{x}" for x in "tuv")} FROM e),
s AS (SELECT *, {", ".join(f"{_SKETCH.format(w='w' + x)} AS s{x}" for x in "tuv")} FROM w),
f AS (SELECT *, {", ".join(f"{_KEPT.format(s='s' + x)} AS f{x}" for x in "tuv")} FROM s)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(v) AS edited_sha256, array_to_string(ft, ' ') AS fingerprint, array_to_string(fv, ' ') AS edited_fingerprint,
       {_LIKE.format(a="ft", b="fv")} AS near_edited, {_LIKE.format(a="ft", b="fu")} AS near_next FROM f
"""
