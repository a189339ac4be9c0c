"""Quality by Bradley-Terry pairwise ranking.

A document's score is linear in features of its text. The weights maximise the likelihood that the better document of
each preference pair wins: logistic loss on the difference of the two feature vectors, fitted by Newton steps. Pairs
couple labelled documents of quality 1 and 0. The documents below the score quantile that equals the share of quality 0
among the labels are rejected. Features and scores run on Spark, and so does the fit where labelled rows are many: they are
dealt into blocks of bounded size, pairs are of one block, and a Newton step adds up what all pairs of all blocks say.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonegrain.llm import common

#: Labelled rows in a block, about; as many are fitted on the driver.
BLOCK_ROWS = 20_000
#: Pairs for each fitted row of the rarer class.
PAIRS_PER_ROW = 40
#: Pairs that a vectorised step handles at a time, bins of a pass for a quantile.
PAIRS, BINS = 1 << 15, 4096

_CLASSES = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": [32, 9], "line": [10, 13], "stop": [44, 46], "shout": [33, 63], "mark": [*range(35, 39), 42], "bar": [124], "bracket": [*b"<>{}[]()\\/=_^~`"], "beyond": range(128, 256)}
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _codes in enumerate(_CLASSES.values()):
    _CLASS[list(_codes)] = _i
_N = len(_CLASSES) + 1


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: shares of byte classes, and of words that are loud, marked, repeated, long or new."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    w = common.words(data, offsets)
    kind = _CLASS[data].astype(np.int64)
    of = np.repeat(np.arange(rows), size)
    bytes_by = np.bincount(of * _N + kind, minlength=rows * _N).reshape(rows, _N).astype(float)
    n = w.counts.astype(float)
    doc = np.repeat(np.arange(rows), w.counts)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=flag, minlength=rows) / np.maximum(n, 1)

    upto = lambda flag: np.concatenate([[0], np.cumsum(flag)])
    inside = lambda cum: cum[w.ends] - cum[w.starts]
    length = (w.ends - w.starts).astype(float)
    low, high = inside(upto(kind == 0)), inside(upto(kind == 1))
    odd = inside(upto((kind >= 6) & (kind <= 9) | (kind == _N - 1)))
    same = np.zeros(len(doc), bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((w.hashes, doc))
    again = np.zeros(len(doc), bool)
    if len(doc):
        h, d = w.hashes[order], doc[order]
        again[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    per = np.sqrt(bytes_by / np.maximum(size, 1)[:, None])
    return np.column_stack([per, share(length), np.sqrt(share((high > 1) & (low == 0))), np.sqrt(share(odd > 0)), np.sqrt(share((odd > 0) & (low + high > 0))), np.sqrt(share((length == odd) & (length > 0))), np.sqrt(share(same)), share(again.astype(float)) * np.log1p(n) / 10, np.sqrt(share(length > 20)), np.log1p(n) / 10, np.sqrt(bytes_by[:, 4] / np.maximum(n, 1))])


N_FEATURES = _N + 10


NOTHING = {"w": np.zeros(N_FEATURES), "mean": np.zeros(N_FEATURES), "sd": np.ones(N_FEATURES), "cut": 0.0, "scale": 1.0}


def _pairs(y: np.ndarray, pairs_per_row: int, seed: int | list[int] = 11) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the better and of the worse row of each pair."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    rng = np.random.default_rng(seed)
    m = pairs_per_row * min(len(good), len(bad))
    rare, other = (bad, good) if len(bad) <= len(good) else (good, bad)
    a, b = np.resize(rare, m), other[rng.integers(0, len(other), m)]
    return (b, a) if rare is bad else (a, b)


def _sums(z: np.ndarray, better: np.ndarray, worse: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pairs, and the sums of the gradient and of the Hessian over them, one after the other."""
    out = np.zeros(1 + len(w) + len(w) ** 2)
    out[0] = len(better)
    for k in range(0, len(better), PAIRS):
        diff = z[better[k : k + PAIRS]] - z[worse[k : k + PAIRS]]
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        out[1 : 1 + len(w)] += diff.T @ (1 - p)
        out[1 + len(w) :] += ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()
    return out


def _newton(sums: Callable[[np.ndarray], np.ndarray], n: int, ridge: float, steps: int) -> np.ndarray:
    w = np.zeros(n)
    for _ in range(steps):
        m, grad, hess = np.split(sums(w), [1, 1 + n])
        if not m[0]:
            break
        step = np.linalg.solve(hess.reshape(n, n) / m + ridge * np.eye(n), grad / m - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, pairs_per_row: int = PAIRS_PER_ROW, ridge: float = 1e-2, steps: int = 25) -> dict:
    """Weights, centre and threshold from feature rows x and labels y (1 is better): of one block."""
    better, worse = _pairs(y, pairs_per_row)
    if not len(better):
        return {"w": np.zeros(x.shape[1]), "mean": np.zeros(x.shape[1]), "sd": np.ones(x.shape[1]), "cut": 0.0, "scale": 1.0}
    mean, sd = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / sd
    w = _newton(lambda w: _sums(z, better, worse, w), x.shape[1], ridge, steps)
    s = np.sort(z @ w)
    k = int((y == 0).sum())
    # The quantile lies between two scores: halfway, so that neither sits on the edge.
    cut = float((s[min(k, len(s) - 1)] + s[k - 1]) / 2)
    return {"w": w, "mean": mean, "sd": sd, "cut": cut, "scale": float(s.std() + 1e-9)}


def _matrix(x: pa.Array | pa.ChunkedArray) -> np.ndarray:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def _added(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], np.ndarray], n: int) -> np.ndarray:
    """The n numbers that tasks answer, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(work(batches), pa.float64())], names=["i", "value"])

    out = np.zeros(n)
    for r in rows.mapInArrow(run, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect():
        out[r.i] = r.value
    return out


def _at_rank(scores: DataFrame, rank: int) -> float:
    """The number of this rank (from 0) among scores (s): bins between the ends, then bins of the one that holds it."""
    lo, hi = scores.agg(F.min("s"), F.max("s")).first()
    while lo < hi:
        bin_ = F.least(F.floor((F.col("s") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        for b in sorted(scores.where(F.col("s").between(lo, hi)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).collect()):
            if rank < b.n:
                break
            rank -= b.n
        lo, hi = b.lo, b.hi
    return lo


def fit_blocks(rows: DataFrame, blocks: int, pairs_per_row: int = PAIRS_PER_ROW, ridge: float = 1e-2, steps: int = 25) -> dict:
    """fit() of rows (dealt long, label, x) of any number: pairs couple rows of the same block, and every row is in one."""
    dealt = rows.withColumn("block", F.pmod("dealt", F.lit(blocks)).cast("int")).repartition(blocks, "block").sortWithinPartitions("block", "label", "dealt")
    dealt = common.saved(dealt, "quality-blocks")  # a file holds whole blocks
    n, n_bad = dealt.agg(F.count("*"), F.count_if(F.col("label") == 0)).first()
    if n_bad in (0, n):
        return NOTHING
    mean = _added(dealt, lambda batches: sum((_matrix(b.column("x")).sum(0) for b in batches), np.zeros(N_FEATURES)), N_FEATURES) / n
    sd = np.sqrt(_added(dealt, lambda batches: sum((((_matrix(b.column("x")) - mean) ** 2).sum(0) for b in batches), np.zeros(N_FEATURES)), N_FEATURES) / n) + 1e-6

    def sums(w: np.ndarray) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(1 + len(w) + len(w) ** 2)
            for block, t in common.stretches(batches, "block"):
                out += _sums((_matrix(t.column("x")) - mean) / sd, *_pairs(t.column("label").to_numpy(), pairs_per_row, [11, block]), w)
            return out

        return _added(dealt, work, 1 + len(w) + len(w) ** 2)

    w = _newton(sums, N_FEATURES, ridge, steps)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array((_matrix(b.column("x")) - mean) / sd @ w)], names=["s"])

    scores = common.saved(dealt.mapInArrow(scored, "s double"), "quality-scores")
    cut = (_at_rank(scores, min(n_bad, n - 1)) + _at_rank(scores, n_bad - 1)) / 2
    return {"w": w, "mean": mean, "sd": sd, "cut": cut, "scale": scores.agg(F.stddev_pop("s")).first()[0] + 1e-9}


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = common.string_buffers(batch.column("text"))
        for a, b in common.slices(off):
            x = features(data[off[a] : off[b]], off[a : b + 1] - off[a])
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), batch.column("dealt").slice(a, b - a), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["label", "dealt", "x"])


def _ranker(model: dict) -> Callable[[Column], Column]:
    @F.arrow_udf("double")
    def rank(texts: pa.Array) -> pa.Array:
        data, off = common.string_buffers(texts)
        # Summed row by row: a matrix product may round equal rows differently.
        parts = [((features(data[off[a] : off[b]], off[a : b + 1] - off[a]) - model["mean"]) / model["sd"] * model["w"]).sum(1) for a, b in common.slices(off)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return rank


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, block_rows: int = BLOCK_ROWS) -> dict:
    """The model from all labels (doc_id, quality 0 or 1) of docs. learn_from: a condition on labels' doc_id."""
    known = labels.where("quality in (0, 1)" if learn_from is None else F.expr("quality in (0, 1)") & learn_from)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    found = common.labelled(docs, known, "quality").select("label", F.xxhash64("doc_id", "text").alias("dealt"), "text")
    rows = common.saved(found.mapInArrow(_feature_rows, "label int, dealt long, x array<double>"), "quality-features")
    blocks = -(-rows.count() // block_rows)
    if not blocks:
        return NOTHING
    if blocks > 1:
        return fit_blocks(rows, blocks)
    rows = rows.toArrow()
    x, y = _matrix(rows.column("x")), rows.column("label").to_numpy()
    order = np.lexsort((*x.T, y))  # the same fit whatever order rows arrive in
    return fit(x[order], y[order])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with rank_score, score (0 to 1) and predicted (1 if score >= 0.5); columns of these names are replaced.

    A null text is the empty text, which has a score like any other; with no labels of one kind all scores are 0.5 and
    nothing is rejected. Texts of any length count whole. Repeated rows get equal scores. No row is dropped, and an
    empty table stays empty.
    """
    ranked = docs.withColumn("rank_score", _ranker(model)(common.text_column(docs)))
    z = (F.col("rank_score") - model["cut"]) * (4 / model["scale"])
    return ranked.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs that score() predicts 1 for, with their columns as they are."""
    return docs.where(_ranker(model)(common.text_column(docs)) >= model["cut"])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = learn(docs, labels, common.remainder("doc_id", 3) != 1)
    return score(docs, model).select("doc_id", (common.remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "rank_score")
