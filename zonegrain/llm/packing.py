"""Concatenate and cut: token streams of documents are laid end to end and cut at every ``length`` tokens.

Two passes. The first tokenises each document once and stores its ids with the running total inside its partition;
the totals of the partitions (one number each) give by a prefix sum where each partition begins in the whole stream.
The second pass cuts every document at the multiples of ``length``: a document that crosses a cut gives a boundary
record on both sides. Only the last sequence is short. No shuffle moves text or ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonegrain.llm import common

TOKENIZER = "word_bpe_49k.json"
#: Units whose ids a task keeps at most; beyond it the table starts again. It bounds memory, not the result.
CACHE_UNITS = 300_000
#: Bytes of text that are encoded together: a unit that repeats inside is looked up once.
SLICE_BYTES = 4 << 20

# Bytes by kind. A word of letters, digits and marks alone is parted where the tokenizer parts it: runs of letters, single
# digits, runs of marks. A word with any other byte (an apostrophe, a control, a letter beyond Latin-1) is one unit.
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _MARK
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _ODD


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The file as found where this runs: each executor has its own copy of the vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Pieces of texts whose ids laid end to end are the ids of the texts, how many each text has, and which are odd words.

    The tokenizer drops white space and never joins across it, nor across letters, digits and marks. Texts lie at
    offsets[i]:offsets[i+1] of data.
    """
    n = len(data)
    if not n:
        return pa.array([], pa.string()), np.zeros(len(offsets) - 1, np.int64), np.zeros(0, bool)
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # letters of Latin-1, but for its times and division signs
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    kind[np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))] = _ODD  # a special token may begin here
    filled = kind != _SPACE
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = filled.copy()
    begins[1:] &= ~filled[:-1] | edge[1:n]
    part = begins.copy()
    part[1:] |= filled[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    word, starts = np.flatnonzero(begins), np.flatnonzero(part)
    odd_word = np.zeros(len(word), bool)
    odd_word[np.searchsorted(word, np.flatnonzero(kind == _ODD), "right") - 1] = True
    odd = odd_word[np.searchsorted(word, starts, "right") - 1] if odd_word.any() else np.zeros(len(starts), bool)
    keep = ~odd | begins[starts]
    starts, odd = starts[keep], odd[keep]
    counts = np.diff(np.searchsorted(starts, offsets))
    place = np.cumsum(filled) - 1
    ends = np.append(place[starts[1:]], int(filled.sum())) if len(starts) else np.zeros(0, np.int64)
    dense = data[filled]
    low = common.LOWER[dense]
    if odd.any():
        low = np.where(np.repeat(odd, np.diff(ends, prepend=0)), dense, low)
    upto = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(upto), pa.py_buffer(low)), counts, odd


class Encoder:
    """Ids of whole texts by way of ids of their units. Each distinct unit is encoded once, as long as the table holds it."""

    def __init__(self, tokenizers: tuple, limit: int = CACHE_UNITS):
        (self.tokenizer, self.plain), self.limit = tokenizers, limit
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _store(self, keys: list[str], ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        sizes = np.concatenate([np.zeros(0, np.int64), *sizes])
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys)), strict=True))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat, self.size = np.concatenate([self.flat, *ids]), np.concatenate([self.size, sizes])

    def _whole(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(keys, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def _learn(self, plain: list[str], odd: list[str]) -> None:
        """Plain units are encoded many at a time: each ends with an id that can end a word."""
        ids, sizes = [], []
        for i in range(0, len(plain), 250):
            keys = plain[i : i + 250]
            got = np.array(self.plain.encode_batch_fast([" ".join(keys)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) == len(keys) and ends[-1] == len(got):
                got = got, np.diff(ends, prepend=0)
            else:
                got = self._whole(keys)
            ids.append(got[0])
            sizes.append(got[1])
        if odd:
            got = self._whole(odd)
            ids.append(got[0])
            sizes.append(got[1])
        if ids:
            self._store([*plain, *odd], ids, sizes)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        flat, counts, odd = units(data, offsets)
        coded = flat.dictionary_encode()
        keys, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.known) > self.limit:
            self._clear()
        is_odd = np.zeros(len(keys), bool)
        is_odd[at[odd]] = True
        new = [i for i, k in enumerate(keys) if k not in self.known]
        self._learn([keys[i] for i in new if not is_odd[i]], [keys[i] for i in new if is_odd[i]])
        row = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[at]
        size = self.size[row]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at[row] - (ends - size), size)]
        return ids, np.diff(np.concatenate([[0], ends])[np.cumsum([0, *counts])])


_TOKENIZERS: dict[str, tuple] = {}


def tokenizers(name: str) -> tuple:
    """The tokenizer, and the same model for plain units alone; one pair for each worker process. Tables of units are a task's own and end with it."""
    if name not in _TOKENIZERS:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        whole, plain = (Tokenizer.from_file(name if "/" in name else tokenizer_path(name)) for _ in range(2))
        plain.normalizer = normalizers.Lowercase()
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        _TOKENIZERS[name] = whole, plain
    return _TOKENIZERS[name]


TOKENS = "doc_id long, part int, part_start long, n_tokens long, ids binary"


def tokenise(name: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (doc_id, text): one row a document with its ids (little-endian, 4 bytes each) and the tokens before it in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = Encoder(tokenizers(name)), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, off = common.string_buffers(batch.column("text"))
            for a, b in common.slices(off, SLICE_BYTES):
                ids, counts = enc.encode(data[off[a] : off[b]], off[a : b + 1] - off[a])
                sizes = counts + 1
                out = np.full(int(sizes.sum()), end_id, "<u4")
                keep = np.ones(len(out), bool)
                keep[np.cumsum(sizes) - 1] = False
                out[keep] = ids
                begin = before + np.cumsum(sizes) - sizes
                before += len(out)
                offs = np.concatenate([[0], np.cumsum(sizes) * 4]).astype(np.int32)
                blob = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offs), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.full(len(sizes), part, np.int32)), pa.array(begin), pa.array(sizes.astype(np.int64)), blob], names=["doc_id", "part", "part_start", "n_tokens", "ids"])

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, is_boundary boolean"


def cut(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (doc_id, begin, n_tokens, ids): the pieces between the multiples of length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, n = batch.column("begin").to_numpy(), batch.column("n_tokens").to_numpy()
            pieces = (begin + n - 1) // length - begin // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            seq = begin[row] // length + k
            lo, hi = np.maximum(begin[row], seq * length), np.minimum((begin + n)[row], (seq + 1) * length)
            start = lo - begin[row]
            blobs = batch.column("ids")
            crc = np.array([zlib.crc32(memoryview(blobs[r].as_buffer())[4 * s : 4 * e]) for r, s, e in zip(row.tolist(), start.tolist(), (hi - begin[row]).tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(hi - lo), pa.array(crc), pa.array(n[row]), pa.array(seq), pa.array(lo - seq * length), pa.array((pieces > 1)[row])], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, length: int = 4096, name: str = TOKENIZER, end_id: int = 2) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, is_boundary (its document is cut).

    A null or empty text has the end id alone. Repeated rows and repeated doc_ids are documents of their own. A very long
    text gives as many pieces as it needs. Other columns aren't read, so their names may clash with the result's. An
    empty table gives no piece. The order in the stream is that of the stored partitions; it is fixed once stored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    tokens = common.saved(plain.mapInArrow(tokenise(name, end_id), TOKENS), "tokens", "zstd")
    # One number a partition: as many as the scan has splits.
    totals = sorted((r[0], r[1]) for r in tokens.groupBy("part").agg(F.sum("n_tokens")).collect())
    begins = np.cumsum([0, *(t for _, t in totals)])[:-1].tolist()
    base = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, begins, strict=True)], "part int, part_begin long")
    placed = tokens.join(F.broadcast(base), "part").select("doc_id", (F.col("part_begin") + F.col("part_start")).alias("begin"), "n_tokens", "ids")
    return placed.mapInArrow(cut(length), PIECES)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
