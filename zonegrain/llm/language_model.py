"""A hierarchical Pitman-Yor language model over words.

Each previous word (or the start of a text) has a restaurant for the word that follows; all of them share a parent, the
restaurant of single words, over a uniform base. Tables are sampled by Gibbs sweeps: a sweep seats all customers of a
dish in a context anew by the Chinese-restaurant rule, given the parent and the table totals of the sweep before; then the
parent's customers (the tables below) are seated. The probability of a token is averaged over the sweeps that are kept.

Texts are tokenised once into chunks of bounded size, stored in buckets by chunk. A chunk sends its distinct words, or
pairs of words, with their counts to ranges of hashes, and gets back what all chunks together know of them, in the order
in which it sent them. So a frequent word costs a range one entry for each chunk, and no table of all words is in one place.
Random numbers are hashes of (pair, sweep, customer): each chunk that has a pair sees the same tables.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonegrain.llm import common

#: Tokens of a chunk, about.
CHUNK = 2_000_000
#: Gibbs sweeps, and how many of the last ones are averaged: those before them start from a guess.
SWEEPS, KEPT = 3, 2
STRENGTH, ROOT_STRENGTH, ROOT_DISCOUNT = 1.0, 1.0, 0.5
#: Customers of a dish who are seated one by one; later ones in blocks of a 32nd of those before, whose new tables are binomial with the chance at mid-block.
SINGLY, BLOCK = 64, 32
#: Entries of a range of hashes at most, about: a range is merged in one task.
RANGE = 8_000_000
#: Stands for a null doc_id inside chunks.
NO_ID = -(2**63)
#: The hash of the end of a text as a word, and of its start as a context.
END = np.uint64(1)

_C = common.mixed(np.arange(301, 309, dtype=np.uint64)) | np.uint64(1)
WORDS, PAIRS, FIRST_SWEEP = 0, 1, 2
_CHUNKS = "chunk long, docs binary, counts binary, held binary, vocab binary, ids binary"
_SENT = "part int, chunk long, payload binary"
_BACK = "chunk long, kind int, part int, payload binary, s0 double, s1 double, s2 double, s3 double"


# --- chunks -----------------------------------------------------------------------------------------------------------


def _chunked(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def row(held: list, k: int) -> pa.RecordBatch:
        docs, counts, out, hashes = (np.concatenate([x[i] for x in held]) for i in range(4))
        vocab, ids = np.unique(hashes, return_inverse=True)
        chunk = (TaskContext.get().partitionId() << 24) | k
        blobs = [x.tobytes() for x in (docs.astype("<i8"), counts.astype("<i8"), out.astype(np.uint8), vocab.astype("<u8"), ids.astype("<i4"))]
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)], names=["chunk", "docs", "counts", "held", "vocab", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, k = [], 0, 0
        for batch in batches:
            docs, out = batch.column("doc_id").fill_null(NO_ID).to_numpy(), np.array(batch.column("held").to_pylist(), bool)
            for a, b, w in common.word_slices(batch.column("text")):
                held.append((docs[a:b], w.counts, out[a:b], w.hashes))
                total += len(w.hashes) + b - a
                if total >= size:
                    yield row(held, k)
                    held, total, k = [], 0, k + 1
        if held:
            yield row(held, k)

    return run


@dataclass
class Chunk:
    """Tokens of some texts: words and an end for each text. Word number v (the last) is the end, as a context the start."""

    docs: np.ndarray
    n_tokens: np.ndarray
    held: np.ndarray
    hashes: np.ndarray
    word: np.ndarray
    context: np.ndarray

    @property
    def trained(self) -> np.ndarray:
        return np.repeat(~self.held, self.n_tokens)


def _chunk(table: pa.Table | pa.RecordBatch, i: int = 0) -> Chunk:
    get = lambda name, kind: np.frombuffer(table.column(name)[i].as_buffer(), kind)
    docs, counts, held, vocab, ids = get("docs", "<i8"), get("counts", "<i8"), get("held", np.uint8).astype(bool), get("vocab", "<u8"), get("ids", "<i4")
    n, v = counts + 1, len(vocab)
    ends = np.cumsum(n) - 1
    word = np.full(int(n.sum()), v, np.int64)
    keep = np.ones(len(word), bool)
    keep[ends] = False
    word[keep] = ids
    context = np.empty_like(word)
    context[1:] = word[:-1]  # after an end comes a start: both have number v
    if len(context):
        context[0] = v
    return Chunk(docs, n, held, np.append(vocab, END).astype(np.uint64), word, context)


def _pairs(c: Chunk, inverse: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and words of the distinct pairs, their hashes, and the pair of each token if asked for."""
    codes = c.context * len(c.hashes) + c.word
    if inverse:
        codes, back = np.unique(codes, return_inverse=True)
    else:
        codes, back = np.sort(codes), np.zeros(0, int)
        codes = codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes
    u, w = codes // len(c.hashes), codes % len(c.hashes)
    return u, w, common.mixed(c.hashes[u] * _C[0] + c.hashes[w]), back


# --- sending, merging and returning -----------------------------------------------------------------------------------


def _dealt(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which hashes are sent: by range; and where each range begins."""
    part = hashes % np.uint64(parts)
    part = part.astype(np.uint16 if parts <= 1 << 16 else np.int64)  # short numbers are sorted by radix
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _send(chunk: int, hashes: np.ndarray, parts: int, width: int, *values: np.ndarray) -> pa.RecordBatch:
    """A row for each range: how many, the hashes in `width` bytes each, the values in 4 bytes each."""
    order, at = _dealt(hashes, parts)
    low = np.ascontiguousarray(hashes[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    vals = [v[order].astype("<i4") for v in values]
    rows = [(p, np.int32(b - a).tobytes() + low[a:b].tobytes() + b"".join(v[a:b].tobytes() for v in vals)) for p, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "chunk", "payload"])


def _merge(kind: int, width: int, n_values: int, answer: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums the values of equal hashes of one range and returns answer(hashes, sums) = (arrays, statistics) to each chunk in its order.

    The first entry of a hash is its owner; with `owned` among the arrays' names it is told apart by a minus sign.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, hashes, values, sizes, part = [], [], [[] for _ in range(n_values)], [], 0
        for batch in batches:
            for p, chunk, blob in zip(batch.column("part").to_pylist(), batch.column("chunk").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                m = int(np.frombuffer(blob, "<i4", 1)[0])
                h = np.zeros((m, 8), np.uint8)
                h[:, :width] = np.frombuffer(blob, np.uint8, m * width, 4).reshape(m, width)
                hashes.append(h.view("<u8").ravel())
                for i in range(n_values):
                    values[i].append(np.frombuffer(blob, "<i4", m, 4 + m * width + 4 * m * i))
                chunks.append(chunk)
                sizes.append(m)
                part = p
        if not chunks:
            return
        order = np.argsort(chunks, kind="stable")  # the owner mustn't depend on the order of arrival
        hashes, sizes, chunks = [hashes[i] for i in order], [sizes[i] for i in order], [chunks[i] for i in order]
        values = [np.concatenate([v[i] for i in order]).astype(np.int64) for v in values]
        flat = np.concatenate(hashes)
        distinct, first, back = np.unique(flat, return_index=True, return_inverse=True)
        sums = [np.bincount(back, weights=v, minlength=len(distinct)).astype(np.int64) for v in values]
        arrays, stats, owned = answer(distinct, *sums)
        out = [np.asarray(a)[back] for a in arrays]
        if owned:
            mine = np.zeros(len(flat), bool)
            mine[first] = True
            out[0] = np.where(mine, -out[0], out[0])
        rows, at = [], 0
        for chunk, m in zip(chunks, sizes, strict=True):
            rows.append((chunk, kind, part, zlib.compress(b"".join(o[at : at + m].astype("<i8" if i or not owned else "<i4").tobytes() for i, o in enumerate(out)), 1), 0.0, 0.0, 0.0, 0.0))
            at += m
        rows.append((-1, kind, part, b"", *map(float, [*stats, 0, 0, 0, 0][:4])))
        names = [x.split()[0] for x in _BACK.split(", ")]
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[i : i + 64]], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary(), *(pa.float64(),) * 4))], names=names)

    return run


def _returned(table: pa.Table, kind: int, dealt: tuple[np.ndarray, np.ndarray], n_arrays: int, types: str = "<i8") -> list[np.ndarray]:
    """What came back for the hashes that were dealt so, in their own order."""
    order, at = dealt
    out = [np.zeros(len(order), np.int64) for _ in range(n_arrays)]
    kinds, where, blobs = table.column("kind").to_numpy(), table.column("part").to_numpy(), table.column("payload")
    for r in np.flatnonzero(kinds == kind).tolist():
        p = int(where[r])
        a, b = int(at[p]), int(at[p + 1])
        flat = np.frombuffer(zlib.decompress(blobs[r].as_buffer()), types)
        for i in range(n_arrays):
            out[i][order[a:b]] = flat[i * (b - a) : (i + 1) * (b - a)]
    return out


# --- seating ----------------------------------------------------------------------------------------------------------


def _uniform(key: np.ndarray, name: int) -> np.ndarray:
    return (common.mixed(key + np.uint64(name % (1 << 64))) >> np.uint64(11)).astype(float) / float(1 << 53)


def _binomial(size: np.ndarray, p: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Successes of `size` trials with chance p from uniform numbers u, v: by inversion, or the normal limit beyond a variance of 25."""
    q = np.minimum(p, 1 - p)
    mean, var = size * q, size * q * (1 - q)
    out = np.floor(mean + np.sqrt(var) * np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * v) + 0.5)
    left = np.flatnonzero(var <= 25)
    mass = (1 - q[left]) ** size[left]
    below, j = mass.copy(), 0
    out[left] = 0
    while len(left):
        more = (u[left] >= below) & (j < size[left])
        left, mass, below = left[more], mass[more], below[more]
        mass = mass * (size[left] - j) / (j + 1) * q[left] / (1 - q[left])
        below, j = below + mass, j + 1
        out[left] = j
    out = np.clip(out, 0, size)
    return np.where(p > q, size - out, out).astype(np.int64)


def seat(count: np.ndarray, pull: np.ndarray, discount: float, key: np.ndarray, salt: int) -> np.ndarray:
    """Tables of `count` customers: the first opens one, the k-th a new one with chance pull / (pull + k - 1 - discount * tables).

    pull: (strength + discount * tables of the restaurant) * parent probability. key and salt name the random numbers.
    """
    tables = (count > 0).astype(np.int64)
    live = np.flatnonzero(count > 1)
    k = 1
    while len(live):
        block = 1 if k < SINGLY else k // BLOCK
        name = k * int(_C[1]) + salt * int(_C[2])
        t, b, draw = tables[live], pull[live], _uniform(key[live], name)
        p = b / (b + k - discount * t)
        if block == 1:
            tables[live] = t + (draw >= 1 - p)
        else:
            size = np.minimum(block, count[live] - k)
            half = (size - 1) / 2
            p = b / (b + k + half - discount * (t + half * p))
            tables[live] = t + _binomial(size, p, draw, _uniform(key[live], name + int(_C[3])))
        k += block
        live = live[count[live] > k]
    return tables


def _parent(words: list[np.ndarray], stats: dict) -> np.ndarray:
    """The parent's probability of each word: from counts before the first sweep, then from its tables."""
    if stats["sweep"] == 0:
        return (words[0] + 1.0) / (stats["n"] + stats["v"] + 1)
    t, s = words[0], words[1]
    return (np.maximum(t - ROOT_DISCOUNT * s, 0) + (ROOT_STRENGTH + ROOT_DISCOUNT * stats["s"]) / (stats["v"] + 1)) / (ROOT_STRENGTH + stats["t"])


def _below(words: list[np.ndarray], stats: dict) -> np.ndarray:
    """Tables in each word's restaurant as a context: a guess before the first sweep."""
    return np.ceil(words[0] ** 0.75) if stats["sweep"] == 0 else words[2].astype(float)


def _tables(dealt: tuple[np.ndarray, np.ndarray], table: pa.Table, sweep: int, stats: list[dict], u: np.ndarray, w: np.ndarray, h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The tables of each pair after a sweep, from what was known before it."""
    before = _returned(table, WORDS if sweep == 1 else FIRST_SWEEP + sweep - 2, dealt, 1 if sweep == 1 else 3)
    pull = (STRENGTH + stats[0]["d"] * _below(before, stats[sweep - 1])[u]) * _parent(before, stats[sweep - 1])[w]
    return seat(count, pull, stats[0]["d"], h, sweep)


def _word_counts(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = _chunk(batch, i)
                yield _send(batch.column("chunk")[i].as_py(), c.hashes, parts, 8, np.bincount(c.word[c.trained], minlength=len(c.hashes)))

    return run


def _pair_counts(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = _chunk(batch, i)
                u, w, h, back = _pairs(c, True)
                yield _send(batch.column("chunk")[i].as_py(), h, parts, 6, np.bincount(back[c.trained], minlength=len(h)))

    return run


def _sweep(sweep: int, stats: list[dict], parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a cogroup of a chunk with what came back: tables of owned pairs, summed by word and by context."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([_send(-1, np.zeros(0, np.uint64), parts, 8)])
        c = _chunk(left.combine_chunks())
        right = right.combine_chunks()
        u, w, h, _ = _pairs(c)
        (signed,) = _returned(right, PAIRS, _dealt(h, parts), 1, "<i4")
        own = np.flatnonzero(signed < 0)
        u, w = u[own], w[own]
        t = _tables(_dealt(c.hashes, parts), right, sweep, stats, u, w, h[own], -signed[own])
        by = lambda x: np.bincount(x, weights=t, minlength=len(c.hashes)).astype(np.int64)
        return pa.Table.from_batches([_send(left.column("chunk")[0].as_py(), c.hashes, parts, 8, by(w), by(u))])

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(stats: list[dict], sweeps: int, kept: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in _SCORES.split(", ")]
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        c, right = _chunk(left.combine_chunks()), right.combine_chunks()
        u, w, h, back = _pairs(c, True)
        (count,) = _returned(right, PAIRS, _dealt(h, parts), 1, "<i4")
        dealt = _dealt(c.hashes, parts)
        count = np.abs(count)
        (seen,) = _returned(right, WORDS, dealt, 1)
        d, p = stats[0]["d"], np.zeros(len(h))
        for s in range(sweeps - kept + 1, sweeps + 1):
            t = _tables(dealt, right, s, stats, u, w, h, count)
            words = _returned(right, FIRST_SWEEP + s - 1, dealt, 3)
            p += (np.maximum(count - d * t, 0) + (STRENGTH + d * words[2][u]) * _parent(words, stats[s])[w]) / (STRENGTH + seen[u])
        log = np.log10(p / kept)[back]
        base = np.log10((seen + 1.0) / (stats[0]["n"] + stats[0]["v"] + 1))[c.word]
        starts = np.cumsum(c.n_tokens) - c.n_tokens
        known = (seen[c.word] > 0).astype(np.int64)
        return pa.table({n: pa.array(x) for n, x in zip(names, (c.docs, c.held, c.n_tokens, np.add.reduceat(known, starts), np.add.reduceat(base, starts), np.add.reduceat(log, starts)), strict=True)})

    return run


def _words_answer(h, n):
    return [n], [n.sum(), (n > 0).sum()], False


def _pairs_answer(h, n):
    return [n], [(n == 1).sum(), (n == 2).sum()], True


def _root_answer(sweep: int, before: dict) -> Callable:
    tables = before["s"] if before["sweep"] else before["v"]

    def answer(h, t, u):
        pull = np.full(len(h), (ROOT_STRENGTH + ROOT_DISCOUNT * tables) / (before["v"] + 1))
        s = seat(t, pull, ROOT_DISCOUNT, h, 1000 + sweep)
        return [t, s, u], [t.sum(), s.sum()], False

    return answer


def score(docs: DataFrame, held: Column, sweeps: int = SWEEPS, kept: int = KEPT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of docs (doc_id, text).

    Learns from rows for which held is false. Words: A-Z lower-cased ``[^\\x20\\x09-\\x0D]+``, then one end. base_score: add-one
    unigrams; score: log10 of the model's probability of the text. A null text is the empty text: its end alone. Texts of
    any length count whole, repeated rows are texts of their own. Words that weren't learned share one place of the base.
    An empty table gives no row; with nothing to learn from, all words have the base's probability.
    """
    spark, buckets = docs.sparkSession, common.partitions(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), common.text_column(docs).alias("text"))
    name = f"lm_chunks_{uuid.uuid4().hex}"
    try:
        # Buckets need a table; its files are in the shared folder.
        plain.mapInArrow(_chunked(chunk), _CHUNKS).write.option("compression", "zstd").option("path", common.scratch(spark, "lm-chunks")).bucketBy(buckets, "chunk").format("parquet").saveAsTable(name)
        chunks = spark.table(name)
        tokens = chunks.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] // 4
        out, n = _fitted(chunks, max(buckets, -(-tokens // RANGE)), sweeps, kept)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def _fitted(chunks: DataFrame, parts: int, sweeps: int, kept: int) -> tuple[DataFrame, float]:
    """Scores (stored) of all texts of the chunks, and the number of tokens learned from; hashes go to `parts` ranges."""

    def returned(sent: DataFrame, kind: int, width: int, n: int, answer: Callable, label: str) -> tuple[DataFrame, list[float]]:
        back = common.saved(sent.repartitionById(parts, F.col("part")).mapInArrow(_merge(kind, width, n, answer), _BACK), label)
        stats = back.where("chunk = -1").agg(*(F.coalesce(F.sum(f"s{i}"), F.lit(0.0)) for i in range(4))).first()
        return back.where("chunk >= 0").select("chunk", "kind", "part", "payload"), list(stats)

    known, (n, v, *_) = returned(chunks.mapInArrow(_word_counts(parts), _SENT), WORDS, 8, 1, _words_answer, "lm-words")
    more, (once, twice, *_) = returned(chunks.mapInArrow(_pair_counts(parts), _SENT), PAIRS, 6, 1, _pairs_answer, "lm-pairs")
    known = known.unionByName(more)
    stats = [{"sweep": 0, "n": n, "v": v, "d": min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5}]
    for s in range(1, sweeps + 1):
        sent = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_sweep(s, stats, parts), _SENT)
        more, (t, tables, *_) = returned(sent, FIRST_SWEEP + s - 1, 8, 2, _root_answer(s, stats[-1] | {"v": v}), f"lm-sweep{s}")
        known = known.unionByName(more)
        stats.append({"sweep": s, "n": n, "v": v, "t": t, "s": tables})
    return common.saved(chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_scored(stats, sweeps, kept, parts), _SCORES), "lm-scores"), n


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, common.remainder("doc_id", 7) == 2)
