"""What several training-data operators share: scratch tables in the shared folder, and vectorised words.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. The helpers work on Arrow string arrays and
treat null as the empty text; they cut each batch into slices of bounded bytes, so memory doesn't follow the batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step handles at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or a new local one for a local master alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, codec: str = "lz4", tasks: int | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, and survives lost executors. tasks: that write at most."""
    path = scratch(df.sparkSession, name)
    (df.coalesce(tasks) if tasks else df).write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, *counts: Column, tasks: int | None = None) -> tuple[DataFrame, dict]:
    """saved(df), and aggregates over its rows."""
    out = saved(df, name, tasks=tasks)
    return out, out.agg(*counts).first().asDict()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def remainder(key: str, m: int) -> Column:
    """crc32 of the key as text, modulo m; -1 for null."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(m)), F.lit(-1))


def text_column(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


#: Rows to drop, up to this many bytes (64 each), are broadcast; beyond it a shuffled join does the same.
BROADCAST_BYTES = 32 << 20


def text_keys(text: Column) -> list[Column]:
    """128 bits that tell a text from the others under its doc_id."""
    return [F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit(1), text).alias("text_b")]


def _among(docs: DataFrame, rows: DataFrame, keys: list[Column], how: str) -> DataFrame:
    """docs joined with rows (doc_id, then a column for each key): by id and text, as a doc_id may come again with another text."""
    names = [f"__k{i}" for i in range(len(keys) + 1)]
    rows = saved(rows.toDF(*names).distinct(), "rows")
    same = docs["doc_id"].cast("long").eqNullSafe(rows["__k0"])
    for name, key in zip(names[1:], keys, strict=True):
        same &= key == rows[name]
    small = rows.count() * 64 <= BROADCAST_BYTES
    return docs.join(F.broadcast(rows) if small else rows, same, how)


def labelled(docs: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Rows of docs (doc_id, text) with the columns of known (one row a doc_id), which is broadcast where it is small."""
    known = saved(known.where("doc_id is not null"), name)
    small = known.count() * 64 <= BROADCAST_BYTES
    return docs.select("doc_id", text_column(docs).alias("text")).join(F.broadcast(known) if small else known, "doc_id")


def without(docs: DataFrame, lost: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows of docs that aren't among the lost ones."""
    return _among(docs, lost, keys, "left_anti")


def once(docs: DataFrame, repeated: DataFrame, keys: list[Column]) -> DataFrame:
    """docs with one row of each doc_id and text that are among the repeated ones: any one, where other columns differ."""
    if repeated.isEmpty():
        return docs
    again = _among(docs, repeated, keys, "left_semi")
    one = again.groupBy("doc_id", *[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.any_value(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return without(docs, repeated, keys).unionByName(one)


def stretches(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Key and rows of each stretch of rows with the same key (a number)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        number = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b == a:
                continue
            if held and number[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = int(number[a])
    if held:
        yield last, pa.Table.from_batches(held)


# --- words in numpy ---------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BYTE[_SPACE] = 0
_R = 0x9E3779B97F4A7C15 | 1
_POW = np.cumprod(np.full(64, _R, np.uint64)).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = np.cumprod(np.full(max(n, 2 * len(_POW)), _R, np.uint64)).astype(np.uint64)
    return _POW


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and n+1 offsets; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes stay within the limit, or hold one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


@dataclass
class Words:
    """Words of some texts: counts of words by text, and 64-bit hashes, starts and ends by word."""

    counts: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """n+1 offsets into the words."""
        return np.concatenate([[0], np.cumsum(self.counts)])


_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def words(data: np.ndarray, offsets: np.ndarray, bare: bool = False) -> Words:
    """Words of the texts that lie at offsets[i]:offsets[i+1] of data (offsets[0] is 0); bare: hashes pass over ASCII punctuation."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.uint64), z, z, data, offsets)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    gap = np.ones(n + 1, bool)
    gap[1:] = space
    gap |= edge  # at i: a word may start at i
    starts = np.flatnonzero(gap[:-1] & ~space)
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return Words(counts, np.zeros(0, np.uint64), starts, ends, data, offsets)
    span = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n) - np.repeat(starts, span)
    val = _BYTE[LOWER[data[starts[0] :]]]
    length = (ends - starts).astype(np.uint64)
    if bare:
        drop = _PUNCT[data[starts[0] :]]
        val[drop] = 0
        gone = np.cumsum(drop)
        before = (gone - drop)[starts - starts[0]]
        place -= gone - drop - np.repeat(before, span)
        length -= np.add.reduceat(drop.astype(np.uint64), starts - starts[0])
    val *= _powers(int(span.max()))[place]
    hashes = mixed(np.add.reduceat(val, starts - starts[0]) + length)
    return Words(counts, hashes, starts, ends, data, offsets)


def word_slices(texts: pa.Array, limit: int = SLICE_BYTES, bare: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of each slice of the texts."""
    data, off = string_buffers(texts)
    for a, b in slices(off, limit):
        yield a, b, words(data[off[a] : off[b]], off[a : b + 1] - off[a], bare)
