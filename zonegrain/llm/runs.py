"""Periodic runs of words by scale-tiled distribution.

A run of period q and exponent 4 or more is a stretch of places i with word i = word i + q, at least 3 q long. For each
octave of periods (half <= q < 2 half) documents are exploded into overlapping tiles, one around each multiple b of 2 half: the
stretch of any run of the octave contains such a place. A tile is solved on its own by two Z-functions at its boundary b,
which say for all periods at once how far the words from b on (z) and before b (on the reversed words) agree with those a
period later. Each gives a fragment of the stretch, cut at the tile's edges; the fragments of neighbouring tiles touch.
Fragments are shuffled by document and period and stitched. A period whose block is itself a repetition is left out.

Before the Z-functions, tiles in which no period agrees at b and a few places around it are left out by vectorised
comparisons: they can't have a run. A document that is longer than a block is exploded into rows of tiles, which any task can
solve; the tiles of shorter ones are solved where the document lies. Words are told apart exactly, by their bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonegrain.llm import common

#: Words of a document whose tiles are solved where it lies; a longer one is exploded into rows of about so many words.
BLOCK = 1 << 18
#: Places on each side of a boundary that are compared one by one, and evenly up to where a run must reach.
NEAR, EVENLY = 11, 8
#: Fewest words of a run, and of its periods.
LEAST, EXPONENT = 6, 4
#: Runs of documents up to this many bytes are broadcast to their texts; beyond it a shuffled join does the same.
BROADCAST_BYTES = 32 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of texts that lie at offsets[i]:offsets[i+1] of data, equal for equal bytes alone; and words by text."""
    n = len(data)
    filled = ~_SPACE[data]
    begins = filled.copy()
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins[1:] &= ~filled[:-1] | edge[1:n]
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, offsets))
    place = np.cumsum(filled) - filled
    upto = np.append(place[starts], filled.sum()).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(upto), pa.py_buffer(np.ascontiguousarray(data[filled]))]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), counts


def z_function(s: list, upto: int) -> list[int]:
    """How far s agrees with itself from each of the places 1 to upto - 1 on."""
    z, n, left, right = [0] * upto, len(s), 0, 0
    for i in range(1, upto):
        k = z[i - left] if i < right else 0
        if i + k >= right:
            k = max(0, right - i)
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


@lru_cache(1 << 16)
def _primes(q: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return (*out, q) if q > 1 else tuple(out)


def _agree(w: np.ndarray, b: np.ndarray, q: np.ndarray, reach: np.ndarray, way: int) -> np.ndarray:
    """Which pairs of a place and a period agree at some places as far as reach."""
    alive = np.arange(len(b))
    for j in range(1, NEAR + 1):
        at = b[alive] + way * j
        alive = alive[(reach[alive] < j) | (w[at] == w[at + q[alive]])]
    for j in range(1, EVENLY + 1):
        at = b[alive] + way * (reach[alive] * j // EVENLY)
        alive = alive[w[at] == w[at + q[alive]]]
    out = np.zeros(len(b), bool)
    out[alive] = True
    return out


def solve(words: np.ndarray, octaves: tuple[int, int], first: int, last: int) -> np.ndarray:
    """Rows (period, lo, hi) of the stretches lo <= i < hi with words[i] == words[i + period] in tiles whose boundary is in [first, last).

    octaves: the first, and the one after the last. A number below 0 must be there only once; it ends a document.
    """
    pad = (3 << octaves[1]) + NEAR  # no comparison reaches beyond it
    w = np.concatenate([np.arange(pad) + (np.iinfo(np.int32).min + 1), words, np.arange(pad) + (np.iinfo(np.int32).min + pad + 1)]).astype(np.int32)
    found: list[tuple[int, int, int]] = []
    for k in range(*octaves):
        half, s = 1 << k, 2 << k
        j0, j1 = -(-first // s), -(-last // s)
        if j1 <= j0:
            continue
        rows = w[pad + j0 * s : pad + j1 * s].reshape(-1, s)
        row, q = np.nonzero(rows[:, half:] == rows[:, :1])
        b, q = pad + (j0 + row) * s, q + half
        need = np.maximum((EXPONENT - 1) * q, LEAST - q)
        reach = np.minimum((need + 1) // 2, s)
        some = _agree(w, b, q, reach - 1, 1) | _agree(w, b, q, reach, -1)
        b, q, need = b[some], q[some], need[some]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]]).tolist()
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            at = int(b[i])
            z = z_function(w[at : at + 2 * s].tolist(), s)
            back = w[at - s : at + s][::-1].tolist()
            y = z_function([*back[s:], None, *back[: half + s]], s + half + 2)
            for p, m in zip(q[i:j].tolist(), need[i:j].tolist(), strict=True):
                after, before = min(z[p], s), y[2 * s + 1 - p]
                if (after + before >= m or after == s or before == s) and not any(z[p // f] >= p - p // f for f in _primes(p)):
                    found.append((p, at - before - pad, at + after - pad))
    return _touching(np.array(found, np.int64).reshape(-1, 3))


def _touching(rows: np.ndarray) -> np.ndarray:
    """Rows (period, lo, hi) joined where those of a period touch."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    if not len(rows):
        return rows
    new = np.append(True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] > rows[:-1, 2]))
    starts = np.flatnonzero(new)
    return np.column_stack([rows[starts, 0], rows[starts, 1], np.maximum.reduceat(rows[:, 2], starts)])


_KEY = ["doc_id", "text_a", "text_b"]
#: A fragment (words is null), or a row of tiles to solve: the words from place `lo` on, boundaries first to last.
_FOUND = "doc_id long, text_a long, text_b long, period long, lo long, hi long, octave int, octaves int, first long, last long, words binary"


def _found(own: list, rows: list[list]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _FOUND.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.binary()]
    return pa.RecordBatch.from_arrays([*own, *(pa.array(x, t) for x, t in zip(rows, kinds, strict=True))], names=names)


def _fragments(own: list, of: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    none = [None] * len(rows)
    return _found([c.take(pa.array(of)) for c in own], [rows[:, 0], rows[:, 1], rows[:, 2], *[none] * 5])


def _octaves(n: int) -> int:
    """Octaves of the periods that a run in n words can have."""
    return (n // EXPONENT).bit_length() if n >= LEAST else 0


def _tiles(words: np.ndarray, block: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(place of the first word, octave, octave after the last, first and last boundary, words): octaves of small tiles together."""
    n = len(words)
    top = _octaves(n)
    low = min(top, max(1, (block // 8).bit_length() - 1))
    for octaves in [(0, low), *((k, k + 1) for k in range(low, top))]:
        s = 1 << octaves[1]
        step = max(s, block)
        for first in range(0, n, step):
            last, at = min(first + step, n), max(0, first - s)
            yield at, *octaves, first, last, words[at : min(n, last + 2 * s)].astype("<i4").tobytes()


def _explode(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = common.string_buffers(batch.column("text"))
            for a, b in common.slices(off):
                ids, counts = word_ids(data[off[a] : off[b]], off[a : b + 1] - off[a])
                own, begins = [batch.column(c).slice(a, b - a) for c in _KEY], np.cumsum(counts) - counts
                for i in np.flatnonzero(counts > block).tolist():
                    for at, octave, octaves, first, last, some in _tiles(ids[begins[i] : begins[i] + counts[i]], block):
                        yield _found([c.slice(i, 1) for c in own], [[None], [at], [None], [octave], [octaves], [first], [last], [some]])
                short = np.flatnonzero(counts <= block)
                if not len(short):
                    continue
                # Short documents end to end, each with a number of its own behind it.
                ends = np.cumsum(counts[short] + 1)
                words = np.zeros(int(ends[-1]), np.int32)
                words[ends - 1] = -1 - np.arange(len(short))
                words[words >= 0] = ids[np.repeat(counts <= block, counts)]
                rows = solve(words, (0, _octaves(int(counts[short].max()))), 0, len(words))
                of = np.searchsorted(ends, rows[:, 1], "right")
                rows[:, 1:] -= (ends - counts[short] - 1)[of][:, None]
                yield _fragments(own, short[of], rows)

    return run


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            at, octave, octaves, first, last = (batch.column(c)[i].as_py() for c in ("lo", "octave", "octaves", "first", "last"))
            rows = solve(np.frombuffer(batch.column("words")[i].as_buffer(), "<i4"), (octave, octaves), first - at, last - at)
            rows[:, 1:] += at
            yield _fragments([batch.column(c).slice(i, 1) for c in _KEY], np.zeros(len(rows), int), rows)


def fragments(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct doc_id, text_a, text_b, period, lo, hi of docs (doc_id, text_a, text_b, text)."""
    found = common.saved(docs.select(*_KEY, "text").mapInArrow(_explode(block), _FOUND), "fragments")
    tiles = found.where("words is not null").repartition("text_a", "text_b", "octave", "first").mapInArrow(_solved, _FOUND)
    return found.where("words is null").unionByName(tiles).select(*_KEY, "period", "lo", "hi").distinct()


def stitched(found: DataFrame) -> DataFrame:
    """doc_id, text_a, text_b, start, length, period of the runs: fragments of a document and period that touch are one."""
    same = Window.partitionBy(*_KEY, "period").orderBy("lo", "hi")
    reached = F.max("hi").over(same.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.col("lo") > F.coalesce(F.col("reached"), F.lit(-1))).cast("long")).over(same)
    whole = found.withColumn("reached", reached).withColumn("island", island).groupBy(*_KEY, "period", "island").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    length = F.col("hi") - F.col("start") + F.col("period")
    return whole.select(*_KEY, "start", length.alias("length"), "period").where(f"length >= {LEAST} and length >= {EXPONENT} * period")


_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words that repeat those a period before, one space between two words."""
    for batch in batches:
        for a, b in common.slices(common.string_buffers(batch.column("text"))[1]):
            part, out = batch.slice(a, b - a), []
            for text, runs in zip(part.column("text"), part.column("runs").to_pylist(), strict=True):
                words = text.as_py().encode().split()
                if runs:
                    keep = np.ones(len(words), bool)
                    for r in runs:
                        keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
                    words = compress(words, keep.tolist())
                out.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("runs"), pa.array(out, pa.string())], names=["doc_id", "runs", "collapsed"])


def periodic(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, runs (start, length, period; in words, by start and period), collapsed for each row of docs (doc_id, text).

    Words are runs of bytes other than white space of ASCII. A run is a longest stretch with its least period, of 6 words and 4 periods
    at least; collapsed has the words that no run contains after its first period. Null, empty and blank texts have no
    words, no runs (an empty array) and the empty text. Texts of any length count whole. Rows and doc_ids may repeat or be null:
    each row gives a row, by its text. An empty table gives no row. Other columns aren't read.
    """
    text = common.text_column(docs)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *common.text_keys(text), text.alias("text"))
    runs = stitched(fragments(plain, block)).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    runs, n = common.counted(runs.toDF("__id", "__a", "__b", "runs"), "runs", F.count("*").alias("docs"), F.coalesce(F.sum(F.size("runs")), F.lit(0)).alias("runs"))
    small = 40 * n["docs"] + 24 * n["runs"] <= BROADCAST_BYTES
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_a") == F.col("__a")) & (F.col("text_b") == F.col("__b"))
    told = plain.join(F.broadcast(runs) if small else runs, same, "left").select("doc_id", "text", F.coalesce("runs", F.array().cast(_RUNS)).alias("runs"))
    return told.mapInArrow(_collapsed, f"doc_id long, runs {_RUNS}, collapsed string")


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        new: dict[int, str] = {}
        for i, d in enumerate(ids):
            h = 1 if d is None else zlib.crc32(str(d).encode())
            if h % 10 == 0:
                words, g = texts[i].as_py().encode().split(), h // 10
                n = len(words)
                if n:
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    tail = words[a : a + p]
                    new[i] = b" ".join([*words[:a], *(tail * (1 + (n - a) // p))[: n - a]]).decode()
        if new:
            old = texts.to_pylist()
            texts = pa.array([new.get(i, t) for i, t in enumerate(old)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text of docs, where one document of ten ends periodically, by the crc32 of its doc_id (not those without)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    return plain.mapInArrow(_planted, "doc_id long, text string")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    # Exact: different quotients of whole numbers differ as doubles while length * period < 2^52.
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("n"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = found.withColumn("best", best)
    period = -F.col("best.p")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), period.alias("period"), F.expr("1000 * best.n div -best.p").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


ORACLE = """
WITH b AS (SELECT byte, (SELECT list_reduce(list_prepend(byte, range(0, 8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS e FROM range(0, 256) t(byte)),
tab AS (SELECT list(e ORDER BY byte) AS t FROM b),
d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text, xor(4294967295, (SELECT list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)), lambda c, ch: xor(c >> 8, t[xor(c & 255, ch) + 1])) FROM tab)) AS h FROM documents),
o AS (SELECT doc_id, rid, h, h // 10 AS g, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM o),
x AS MATERIALIZED (SELECT doc_id, rid, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM p),
m AS (SELECT rid, q, unnest(list_filter(range(0, n - q), lambda i: w[i + 1] = w[i + q + 1])) AS i FROM x, range(1, n // 4 + 1) t(q) WHERE n >= 6),
s AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM m) GROUP BY rid, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT rid, start, length, min(q) AS period FROM s GROUP BY rid, start, length),
l AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, first({'start': start, 'length': length, 'period': period} ORDER BY length / period DESC, start, period) AS best FROM r GROUP BY rid),
k AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM (SELECT rid, unnest(w) AS word, unnest(range(0, n)) AS i FROM x WHERE rid IN (SELECT rid FROM r)) ANTI JOIN k USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, (1000 * best.length) // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(CASE WHEN l.rid IS NOT NULL THEN c.text ELSE array_to_string(w, ' ') END, '')) AS collapsed_sha256 FROM x LEFT JOIN l USING (rid) LEFT JOIN c USING (rid)
"""
