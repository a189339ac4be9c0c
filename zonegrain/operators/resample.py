"""Bootstrap by replicate weights: every row draws, from its key alone, how often each replicate has it.

A row's weight in a replicate is Poisson with mean 1 (what a resample of n of n rows tends to), made of whole-number arithmetic
on the key and the replicate, so any partitioning gives the same. Rows are sorted by score over all tasks; a task sums weights
of its stretch for all replicates at once. Totals of stretches (a vector a task) give by prefix sums what lies above each,
and a second pass over the sorted rows makes the ordered metrics exactly; a score that several tasks share is put together last.
No row is numbered, no resample is a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonegrain.sources import shared

#: Chances of a weight below 1, 2, ... in 2^32ths.
_STEPS = np.array([math.floor(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)], np.uint64)
#: Rows of a batch whose weights are held at a time.
ROWS = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """32 bits, mixed by shifts and products: whole numbers below 2^64 throughout."""
    x = x & np.uint64(0xFFFFFFFF)
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x45D9F3B)) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(16))


def weights(draw: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """(rows, replicates) weights of rows with the whole numbers draw, 0 <= draw < 2^31."""
    r = np.arange(replicates, dtype=np.uint64)
    x = draw.astype(np.uint64)[:, None] * np.uint64(2654435761) + r[None] * np.uint64(40503) + np.uint64(seed)
    return np.searchsorted(_STEPS, mixed(mixed(x) + r[None]), "right").astype(np.int64)


def _drawn(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << 31))


def _groups(pdf: pd.DataFrame, replicates: int, seed: int) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """(score, weights of positive rows, of others) for each distinct score of sorted rows; a score may come again in the next batch."""
    score, y = pdf["score"].to_numpy(float), pdf["y"].to_numpy(np.int64)
    for i in range(0, len(pdf), ROWS):
        w = weights(pdf["draw"].to_numpy(np.int64)[i : i + ROWS], replicates, seed)
        s, p = score[i : i + ROWS], y[i : i + ROWS, None]
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        pos, neg = np.add.reduceat(w * p, starts), np.add.reduceat(w * (1 - p), starts)
        yield from zip(s[starts].tolist(), pos, neg, strict=True)


def _joined(groups: Iterator[tuple[float, np.ndarray, np.ndarray]]) -> Iterator[list]:
    last = None
    for s, p, q in groups:
        if last and last[0] == s:
            last = [s, last[1] + p, last[2] + q]
        else:
            if last:
                yield last
            last = [s, p, q]
    if last:
        yield last


_VECTORS = "task int, kind string, score double, p array<bigint>, q array<bigint>, a array<double>, b array<double>"


def _row(task: int, kind: str, score: float, p: np.ndarray, q: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None) -> list:
    return [task, kind, score, p.tolist(), q.tolist(), None if a is None else a.tolist(), None if b is None else b.tolist()]


class _Sums:
    """Ordered sums of AUC (a: pairs that are in order, ties half) and average precision (b) as score groups come, the highest first."""

    def __init__(self, p: np.ndarray, q: np.ndarray):
        self.p, self.q = p.astype(float), q.astype(float)
        self.a, self.b = np.zeros(len(p)), np.zeros(len(p))

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        self.a += q * (self.p + p / 2)
        self.p, self.q = self.p + p, self.q + q
        self.b += p * self.p / np.maximum(self.p + self.q, 1)


def bootstrap(t: DataFrame, label: str, score: str, key: str | Column, metrics: tuple[str, ...] = ("auc",), replicates: int = 2000, seed: int = 42, stratified: bool = True, draw: Column | None = None) -> DataFrame:
    """metric, replicate, value for the metrics auc, average_precision and mse (of the score against the label) of each resample.

    label: 0 or 1 (any number for mse). stratified: both labels are always drawn: a replicate that lacks one has none of its
    values (as has, not stratified, one without positives or, for auc, without others). Rows without label or score aren't
    drawn. draw: whole numbers from 0 to below 2^31 in place of hashes of the key. An empty table gives no row.
    """
    spark = t.sparkSession
    n = draw if draw is not None else _drawn(F.col(key) if isinstance(key, str) else key)
    rows = t.select(n.cast("long").alias("draw"), F.col(label).cast("double").alias("y"), F.col(score).cast("double").alias("score")).where("y is not null and score is not null and not isnan(score)")
    out: list[tuple[str, int, float]] = []
    if "mse" in metrics:

        def squares(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, error = np.zeros(replicates), np.zeros(replicates)
            for pdf in parts:
                e = ((pdf["y"] - pdf["score"]) ** 2).to_numpy(float)
                for i in range(0, len(pdf), ROWS):
                    w = weights(pdf["draw"].to_numpy(np.int64)[i : i + ROWS], replicates, seed)
                    total, error = total + w.sum(0), error + e[i : i + ROWS] @ w
            yield pd.DataFrame({"n": [total.tolist()], "e": [error.tolist()]})

        found = rows.mapInPandas(squares, "n array<double>, e array<double>").collect()  # a vector a task
        n, e = (sum((np.array(r[c]) for r in found), np.zeros(replicates)) for c in "ne")
        out += [("mse", r, float(e[r] / n[r])) for r in range(replicates) if n[r] > 0]
    if set(metrics) & {"auc", "average_precision"}:
        # Equal scores may be parted between tasks: their key is drawn too.
        order = [F.desc("score"), "draw"]
        placed = shared.saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id()), "scored")

        def totals(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, list] = {}
            for pdf in parts:
                for task, own in pdf.groupby("task"):
                    p, q = held.setdefault(task, [np.zeros(replicates, np.int64), np.zeros(replicates, np.int64)])
                    for _, x, z in _groups(own, replicates, seed):
                        p += x
                        q += z
            yield pd.DataFrame([_row(k, "total", 0.0, *v) for k, v in held.items()], columns=[c.split()[0] for c in _VECTORS.split(", ")])

        whole: dict[int, list] = {}
        for r in placed.mapInPandas(totals, _VECTORS).collect():
            p, q = whole.setdefault(r["task"], [np.zeros(replicates, np.int64), np.zeros(replicates, np.int64)])
            p += np.array(r["p"])
            q += np.array(r["q"])
        above, before = {}, [np.zeros(replicates, np.int64), np.zeros(replicates, np.int64)]
        for task in sorted(whole):
            above[task] = (before[0].copy(), before[1].copy())
            before = [before[0] + whole[task][0], before[1] + whole[task][1]]
        P, Q = before

        def ordered(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            """The first and the last score of a task as they are (edge), and the sums of those between (inner)."""
            task, out = int(key[0]), []
            groups = _joined(_groups(pdf.sort_values("score", ascending=False, kind="stable"), replicates, seed))
            first, last = next(groups), None
            out.append(_row(task, "edge", *first))
            sums = _Sums(above[task][0] + first[1], above[task][1] + first[2])
            for g in groups:
                if last is not None:
                    sums.add(last[1], last[2])
                last = g
            if last is not None:
                out.append(_row(task, "edge", *last))
            out.append(_row(task, "inner", 0.0, np.zeros(0, np.int64), np.zeros(0, np.int64), sums.a, sums.b))
            return pd.DataFrame(out, columns=[c.split()[0] for c in _VECTORS.split(", ")])

        found = placed.groupBy("task").applyInPandas(ordered, _VECTORS).collect()
        a, b = np.zeros(replicates), np.zeros(replicates)
        edges: dict[float, list] = {}
        for r in found:
            if r["kind"] == "inner":
                a, b = a + np.array(r["a"]), b + np.array(r["b"])
            else:
                e = edges.setdefault(r["score"], [r["task"], np.zeros(replicates, np.int64), np.zeros(replicates, np.int64)])
                e[0] = min(e[0], r["task"])
                e[1] += np.array(r["p"])
                e[2] += np.array(r["q"])
        firsts = {r["task"]: r["score"] for r in sorted(found, key=lambda r: r["score"]) if r["kind"] == "edge"}  # the highest of a task
        for s, (task, p, q) in edges.items():
            lead = above[task]
            if firsts[task] != s:  # the last score of its task: all of the task but it lies above
                own = next(r for r in found if r["kind"] == "edge" and r["task"] == task and r["score"] == s)
                lead = (lead[0] + whole[task][0] - np.array(own["p"]), lead[1] + whole[task][1] - np.array(own["q"]))
            one = _Sums(*lead)
            one.add(p, q)
            a, b = a + one.a, b + one.b
        some = (P > 0) & (Q > 0)
        for metric, ok, value in (("auc", some, a / np.maximum(P * Q, 1)), ("average_precision", some if stratified else P > 0, b / np.maximum(P, 1))):
            if metric in metrics:
                out += [(metric, r, float(value[r])) for r in np.flatnonzero(ok).tolist()]
    return spark.createDataFrame(out, "metric string, replicate int, value double")


def intervals(drawn: DataFrame, alpha: int = 95, exact: bool = False) -> DataFrame:
    """metric, mean, low, high, replicates of values by metric. By default whole percentiles, (100 - alpha) // 2; exact: half of them."""
    lo = (100 - alpha) / 2 if exact else (100 - alpha) // 2
    hi = 100 - lo if exact else alpha + lo
    return drawn.groupBy("metric").agg(F.avg("value").alias("mean"), F.percentile("value", lo / 100).alias("low"), F.percentile("value", hi / 100).alias("high"), F.count("*").alias("replicates"))
