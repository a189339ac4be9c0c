"""Toxicity by a convolutional text classifier.

Words (A-Z lower-cased, ASCII punctuation passed over) get the sum of two hashed embeddings, so that two words meet only
where both hashes do. Filters over one, two and three words, max pooling over the whole text and a logistic output
follow. It is trained on all labelled rows, which are dealt into shards of bounded size: in an epoch numpy trains each shard
with Adagrad from the model of the epoch before, and Spark averages what shards changed. One row in five, which the training
doesn't see, calibrates a threshold for each language, which is told from function words of the text itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonegrain.llm import common

#: Labelled rows and bytes of their texts in a shard, about.
SHARD_ROWS, SHARD_BYTES = 8_000, 16 << 20
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 6
EPOCHS, BATCH, RATE = 8, 64, 0.1
EMBEDDINGS = ("e1", "e2")

# Function words by language.
FUNCTION_WORDS = {
    "en": "the of and to a in that is was for with as on be by this are from or it",
    "de": "der die und das den von zu mit im ist ein eine für auf nicht sich dem auch es an",
    "fr": "le la les de des et un une que qui pour dans sur est au par pas avec ou elle",
    "es": "el los las y en que del por una con para no se su al lo como es más o",
}


def _hash_words(words: list[str]) -> np.ndarray:
    data, off = common.string_buffers(pa.array(words))
    return common.words(data, off, bare=True).hashes


def buckets(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bucket numbers from one hash; 0 is kept for padding."""
    m = np.uint64(BUCKETS - 1)
    return (hashes % m).astype(np.int32) + 1, ((hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) % m).astype(np.int32) + 1


def language_table() -> np.ndarray:
    """A small number for each first bucket: which languages have a function word there (bits)."""
    table = np.zeros(BUCKETS + 1, np.uint8)
    for i, w in enumerate(FUNCTION_WORDS.values()):
        table[buckets(_hash_words(w.split()))[0]] |= np.uint8(1 << i)
    return table


def languages(first: np.ndarray, starts: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The language number of each text (0 with no function word)."""
    bits = table[first]
    score = np.zeros((len(counts), len(FUNCTION_WORDS)))
    for i in range(score.shape[1]):
        score[:, i] = np.diff(np.concatenate([[0], np.cumsum((bits >> i) & 1)])[np.append(starts, len(first))])
    return score.argmax(1)


def _padded(a: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a with len(WIDTHS) zeros after each text, and where each text starts."""
    pad = len(WIDTHS)
    ends = np.cumsum(counts)
    starts = ends - counts + pad * np.arange(len(counts))
    out = np.zeros(len(a) + pad * len(counts), a.dtype)
    out[np.arange(len(a)) + np.repeat(pad * np.arange(len(counts)), counts)] = a
    return out, starts


def _maps(model: dict, x: np.ndarray) -> list[np.ndarray]:
    """The filters' answers at every position, by width."""
    out = []
    for w in WIDTHS:
        k = model[f"w{w}"]
        a = x @ k[0]
        for j in range(1, w):
            a[:-j] += x[j:] @ k[j]
        out.append(a)
    return out


def logits(model: dict, first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> np.ndarray:
    i, starts = _padded(first, counts)
    x = model["e1"][i] + model["e2"][_padded(second, counts)[0]]
    if not len(starts):
        return np.zeros(0)
    beyond = i == 0  # the places between texts; an empty text has one place
    beyond[starts[counts == 0]] = False
    maps = _maps(model, x)
    for a in maps:
        a[beyond] = -np.inf
    pooled = np.concatenate([np.maximum.reduceat(a, starts) for a in maps], 1)
    return np.maximum(pooled + model["b"], 0) @ model["v"] + model["c"]


def _counted(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """Texts with a bucket, by embedding, label and bucket."""
    seen = np.zeros((2, 2, BUCKETS + 1))
    for t, label in zip(texts, y, strict=True):
        for e in (0, 1):
            seen[e, int(label), np.unique(t[e])] += 1
    return seen


def begin(seen: np.ndarray, pos: int, neg: int) -> tuple[dict, dict]:
    """Filters and embeddings before the first step, and Adagrad's sums of squares."""
    rng = np.random.default_rng(3)
    model = {"e1": np.zeros((BUCKETS + 1, DIM), np.float32), "e2": np.zeros((BUCKETS + 1, DIM), np.float32), "b": np.zeros(len(WIDTHS) * FILTERS, np.float32), "v": np.full(len(WIDTHS) * FILTERS, 0.5, np.float32), "c": np.float32(-1)}
    for w in WIDTHS:
        model[f"w{w}"] = rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32)
        model[f"w{w}"][0, 0] = np.abs(model[f"w{w}"][0, 0]) + 0.3
    pos, neg = max(1, pos), max(1, neg)
    # The first dimension starts as the log odds of a text with the word, shrunk; the others start at zero.
    for which, (no, yes) in zip(EMBEDDINGS, seen, strict=True):
        odds = np.log((yes + 0.5) / (pos + 1)) - np.log((no + 0.5) / (neg + 1))
        base = np.log(0.5 / (pos + 1)) - np.log(0.5 / (neg + 1))
        model[which][:, 0] = np.where(no + yes >= 3, np.clip(odds - np.clip(base, -1, 1), -2, 2) / 2, 0)
        model[which][0] = 0
    return model, {k: np.full_like(v, 1e-2) for k, v in model.items()}


def epoch(model: dict, square: dict, texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, pos: int, neg: int, seed: list[int]) -> None:
    """One pass over the texts in random order; pos, neg: rows of each kind in all shards, which weigh alike."""
    weight = np.where(y == 1, 0.5 / max(1, pos), 0.5 / max(1, neg)) * (pos + neg)
    order = np.random.default_rng([3, *seed]).permutation(len(y))
    for k in range(0, len(order), BATCH):
        _step(model, square, [texts[i] for i in order[k : k + BATCH]], y[order[k : k + BATCH]], weight[order[k : k + BATCH]])


def train(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> dict:
    """Filters and embeddings from bucket pairs of whole texts and labels: of one shard."""
    pos, neg = int((y == 1).sum()), int((y == 0).sum())
    model, square = begin(_counted(texts, y), pos, neg)
    for n in range(EPOCHS):
        epoch(model, square, texts, y, pos, neg, [n, 0])
    return model


def gradients(model: dict, texts: list, y: np.ndarray, weight: np.ndarray) -> tuple[dict, dict]:
    """Of the mean weighted logistic loss: by parameter; and of the embeddings as (rows touched, gradients)."""
    counts = np.array([len(t[0]) for t in texts])
    i, starts = _padded(np.concatenate([t[0] for t in texts]), counts)
    j, _ = _padded(np.concatenate([t[1] for t in texts]), counts)
    x = model["e1"][i] + model["e2"][j]
    maps, n = _maps(model, x), len(texts)
    at = [np.stack([a[s : s + max(1, c)].argmax(0) + s for s, c in zip(starts, counts, strict=True)]) for a in maps]
    pooled = np.concatenate([np.take_along_axis(a, p, 0) for a, p in zip(maps, at, strict=True)], 1) + model["b"]
    h = np.maximum(pooled, 0)
    out = h @ model["v"] + model["c"]
    d = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) * weight / n
    dh = d[:, None] * model["v"] * (pooled > 0)
    grads = {"v": h.T @ d, "c": d.sum(), "b": dh.sum(0)}
    rows, values = [], []
    for q, (w, p) in enumerate(zip(WIDTHS, at, strict=True)):
        g = dh[:, q * FILTERS : (q + 1) * FILTERS]
        grads[f"w{w}"] = np.stack([np.einsum("nfd,nf->df", x[p + s], g) for s in range(w)])
        for s in range(w):
            rows.append((p + s).ravel())
            values.append((g[:, :, None] * model[f"w{w}"][s].T[None]).reshape(-1, DIM))
    rows, values, embedded = np.concatenate(rows), np.concatenate(values), {}
    for e, of in (("e1", i), ("e2", j)):
        touched, back = np.unique(of[rows], return_inverse=True)
        g = np.zeros((len(touched), DIM), values.dtype)
        np.add.at(g, back, values)
        g[touched == 0] = 0  # padding stays zero
        embedded[e] = touched, g
    return grads, embedded


def _step(model: dict, square: dict, texts: list, y: np.ndarray, weight: np.ndarray) -> None:
    """One step of Adagrad."""
    grads, embedded = gradients(model, texts, y, weight)
    for k, g in grads.items():
        square[k] += g * g
        model[k] = (model[k] - RATE * g / np.sqrt(square[k])).astype(np.float32)
    for e, (touched, g) in embedded.items():
        square[e][touched] += g * g
        model[e][touched] -= (RATE * g / np.sqrt(square[e][touched])).astype(np.float32)


def calibrate(score: np.ndarray, y: np.ndarray, language: np.ndarray, rows: np.ndarray, least: int = 8) -> np.ndarray:
    """A threshold for each language: the best balanced accuracy, the middle of the best gap; all languages together where one has too few rows of a kind. rows: how many have this score, label and language."""

    def best(s: np.ndarray, t: np.ndarray, n: np.ndarray) -> float:
        if not (t == 1).any() or not (t == 0).any():
            return float(s.max() + 1) if len(s) and not (t == 1).any() else 0.0
        order = np.argsort(s, kind="stable")
        s, pos, neg = s[order], (n * (t == 1))[order], (n * (t == 0))[order]
        missed, right = np.cumsum(pos) / pos.sum(), np.cumsum(neg) / neg.sum()
        gain = right - missed
        step = np.flatnonzero(s[1:] > s[:-1])
        if not len(step):
            return float(s[0])
        ok = step[gain[step] >= gain[step].max() - 1e-12]
        k = ok[np.argmax(s[ok + 1] - s[ok])]
        return float((s[k] + s[k + 1]) / 2)

    whole, out = best(score, y, rows), []
    for i in range(len(FUNCTION_WORDS)):
        m = language == i
        out.append(best(score[m], y[m], rows[m]) if min(rows[m & (y == 1)].sum(), rows[m & (y == 0)].sum()) >= least else whole)
    return np.array(out)


_SAMPLE = "shard int, label int, first binary, second binary"


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in common.word_slices(batch.column("text"), bare=True):
            at = w.first
            cut = lambda x: pa.array([x[at[r] : at[r + 1]].tobytes() for r in range(b - a)], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("shard", "label")), *map(cut, buckets(w.hashes))], names=["shard", "label", "first", "second"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]]:
    """Number, texts, labels of the shards of a task, and which rows calibrate: every fifth of a shard."""
    for number, t in common.stretches(batches, "shard"):
        texts = [(np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(b.as_buffer(), np.int32)) for a, b in zip(t.column("first"), t.column("second"), strict=True)]
        yield number, texts, t.column("label").to_numpy(), np.arange(len(texts)) % 5 == 4


def _trained(shard: tuple) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    _, texts, y, cut = shard
    return [t for t, c in zip(texts, cut, strict=True) if not c], y[~cut]


_KEYS = ["kind", "bucket"]


def _summed(rows: DataFrame, work: Callable[[Iterator], Iterator[tuple[int, np.ndarray, np.ndarray]]], width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """What tasks answer for their shards (a kind, its buckets, numbers for each), added up by Spark: of fixed size, whatever the rows."""
    names = [f"v{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, at, values in work(_shards(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), *(pa.array(values[:, i].astype(float)) for i in range(width))], names=[*_KEYS, *names])

    sent = rows.mapInArrow(run, f"kind int, bucket int, {', '.join(f'{n} double' for n in names)}")
    t = sent.groupBy(*_KEYS).agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    kinds, at = t.column("kind").to_numpy(), t.column("bucket").to_numpy()
    values = np.column_stack([t.column(n).to_numpy() for n in names])
    return {int(k): (at[kinds == k], values[kinds == k]) for k in np.unique(kinds)}


def _dense(model: dict) -> np.ndarray:
    """All numbers but the embeddings, one after the other."""
    return np.concatenate([np.ravel(model[k]) for k in sorted(model) if k not in EMBEDDINGS]).astype(float)


def _fill(model: dict, dense: np.ndarray) -> None:
    at = 0
    for k in sorted(model):
        if k not in EMBEDDINGS:
            n = np.size(model[k])
            model[k], at = dense[at : at + n].reshape(np.shape(model[k])).astype(np.float32)[()], at + n


def _counts(shards: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Kinds 0, 1: texts with a bucket by label; 2: rows by label, and those that calibrate."""
    seen, rows = np.zeros((2, 2, BUCKETS + 1)), np.zeros((2, 2))
    for shard in shards:
        texts, y = _trained(shard)
        seen += _counted(texts, y)
        rows[0] += np.bincount(y, minlength=2)
        rows[1, 0] += shard[3].sum()
    for e in (0, 1):
        at = np.flatnonzero(seen[e].any(0))
        yield e, at, seen[e][:, at].T
    yield 2, np.arange(2), rows


def _changes(start, epochs: list[int]) -> Callable[[Iterator], Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """What epochs change from the start: kinds 0, 1: shards that touched a row of an embedding, its changes and those of the squares, added up; 2: of the other numbers."""

    def work(shards: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        model, square, pos, neg = start.value
        for shard in shards:
            texts, y = _trained(shard)
            if not len(y):
                continue
            # Of the embeddings only rows that the shard has; padding keeps number 0.
            m, q = ({k: v.copy() for k, v in x.items() if k not in EMBEDDINGS} for x in (model, square))
            used = []
            for n, e in enumerate(EMBEDDINGS):
                mark = np.zeros(BUCKETS + 1, bool)
                mark[0] = True
                for t in texts:
                    mark[t[n]] = True
                place = (np.cumsum(mark) - 1).astype(np.int32)
                texts = [(*t[:n], place[t[n]], *t[n + 1 :]) for t in texts]
                used.append(np.flatnonzero(mark))
                m[e], q[e] = model[e][used[n]], square[e][used[n]]
            for k in epochs:
                epoch(m, q, texts, y, pos, neg, [k, shard[0]])
            for kind, (e, at) in enumerate(zip(EMBEDDINGS, used, strict=True)):
                change = np.concatenate([m[e] - model[e][at], q[e] - square[e][at]], 1)
                moved = np.flatnonzero(change[:, DIM:].any(1))
                yield kind, at[moved], np.concatenate([np.ones((len(moved), 1)), change[moved]], 1)
            values = np.zeros((len(_dense(m)), 1 + 2 * DIM))
            values[:, 0], values[:, 1], values[:, 1 + DIM] = 1, _dense(m) - _dense(model), _dense(q) - _dense(square)
            yield 2, np.arange(len(values)), values

    return work


def _fitted(rows: DataFrame, shards: int) -> tuple[dict, bool]:
    """The model from dealt rows, and whether any row calibrates."""
    found = _summed(rows, _counts, 2)
    seen = np.zeros((2, 2, BUCKETS + 1))
    for e in (0, 1):
        if e in found:
            seen[e][:, found[e][0]] = found[e][1].T
    at, n = found[2]
    (neg, pos), (cut, _) = n[np.argsort(at)].astype(int).tolist()
    model, square = begin(seen, pos, neg)
    # One shard needs nobody else between its epochs.
    for epochs in [[*range(EPOCHS)]] if shards == 1 else [[k] for k in range(EPOCHS)]:
        start = rows.sparkSession.sparkContext.broadcast((model, square, pos, neg))  # of fixed size
        changed = _summed(rows, _changes(start, epochs), 1 + 2 * DIM)
        start.destroy()
        for kind, e in enumerate(EMBEDDINGS):
            if kind in changed:
                at, v = changed[kind]
                model[e][at] += (v[:, 1 : 1 + DIM] / v[:, :1]).astype(np.float32)
                square[e][at] += (v[:, 1 + DIM :] / v[:, :1]).astype(np.float32)
        if 2 in changed:
            at, v = changed[2]
            mean = v[np.argsort(at)] / v[:, :1]
            _fill(model, _dense(model) + mean[:, 1])
            _fill(square, _dense(square) + mean[:, 1 + DIM])
    return model, cut > 0


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, shard_rows: int = SHARD_ROWS) -> dict:
    """The model from all labels (doc_id, toxic 0 or 1) of docs; learn_from: a condition on labels' doc_id. One row in five calibrates."""
    known = labels.where("toxic in (0, 1)" if learn_from is None else F.expr("toxic in (0, 1)") & learn_from).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    found = common.labelled(docs, known, "toxic").select("label", F.xxhash64("doc_id", "text").alias("dealt"), "text")
    size = found.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    table = language_table()
    if not size["rows"]:
        return train([], np.zeros(0)) | {"cuts": np.full(len(FUNCTION_WORDS), 1.0), "languages": table}
    shards = max(-(-size["rows"] // shard_rows), -(-size["bytes"] // SHARD_BYTES))
    # Dealt by id and text and ordered, so that the fit is the same whatever order rows arrive in; a file holds whole shards.
    dealt = found.withColumn("shard", F.pmod("dealt", F.lit(shards)).cast("int")).repartition(shards, "shard").mapInArrow(_sample_rows, _SAMPLE)
    dealt = common.saved(dealt.sortWithinPartitions("shard", "label", F.length("first"), "first", "second"), "toxic-words", "zstd")
    model, some = _fitted(dealt, shards)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, y, cut in _shards(batches):
            at = np.flatnonzero(cut if some else np.ones(len(y), bool))
            for k in range(0, len(at), BATCH):
                part = [texts[i] for i in at[k : k + BATCH]]
                counts = np.array([len(t[0]) for t in part])
                first = np.concatenate([t[0] for t in part])
                z = logits(fitted.value, first, np.concatenate([t[1] for t in part]), counts)
                language = languages(first, np.cumsum(counts) - counts, counts, table)
                yield pa.RecordBatch.from_arrays([pa.array(z.astype(float).round(3)), pa.array(y[at[k : k + BATCH]]), pa.array(language.astype(np.int32))], names=["z", "label", "language"])

    fitted = docs.sparkSession.sparkContext.broadcast(model)
    # Scores to three decimals: their number doesn't grow with the rows.
    scored = dealt.mapInArrow(scores, "z double, label int, language int").groupBy("z", "label", "language").agg(F.count("*").alias("n")).toArrow()
    fitted.destroy()
    return model | {"cuts": calibrate(*(scored.column(c).to_numpy() for c in ("z", "label", "language", "n"))), "languages": table}


def _margin(model) -> Callable[[Column], Column]:
    @F.arrow_udf("struct<margin: double, language: string>")
    def margin(texts: pa.Array) -> pa.Array:
        m, names = model.value, np.array([*FUNCTION_WORDS])
        z, lang = [np.zeros(0)], [np.zeros(0, names.dtype)]
        for _, _, w in common.word_slices(texts, bare=True):
            i, j = buckets(w.hashes)
            k = languages(i, w.first[:-1], w.counts, m["languages"])
            z.append(logits(m, i, j, w.counts) - m["cuts"][k])
            lang.append(names[k])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(z).astype(float).round(4)), pa.array(np.concatenate(lang).tolist(), pa.string())], names=["margin", "language"])

    return margin


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with margin (logit above its language's threshold), language, score (0 to 1) and predicted (1 if score >= 0.5).

    Columns of these names are replaced; other columns stay. A null text is the empty text and has a score. Whole texts
    count, however long. The margin is rounded to four decimals, so that
    repeated rows get equal scores; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS x DIM
    out = docs.withColumn("__m", _margin(shared)(common.text_column(docs)))
    return out.withColumns({"margin": F.col("__m.margin"), "language": F.col("__m.language"), "score": 1 / (1 + F.exp(-F.col("__m.margin"))), "predicted": (F.col("__m.margin") >= 0).cast("int")}).drop("__m")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = learn(docs, labels, common.remainder("doc_id", 5) != 0)
    return score(docs.select("doc_id", "text"), model).select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "language")
