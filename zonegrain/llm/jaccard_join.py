"""N-gram Jaccard join by token-combination prefixes.

Documents are sets of word shingles. Tokens (shingle hashes) are ordered by class: those of one set only, those of a few
sets (rare), those of many (frequent). Two sets that link share the first k tokens they have in common within prefixes of
n - ceil(t n) + k tokens. So they share a rare token of the prefix for k = 1, or else every common token is frequent and
they share two tokens of the prefix for k = 2: rare tokens are indexed one by one, frequent ones in pairs. A long set has
too many pairs; it is indexed by the frequent tokens of its prefix for k = 1, and sets near the limit in both ways. An entry
says how many tokens a set can still have in common from there on; with that and the sizes most pairs of a group fall out,
and a group without a member that can be the smaller one of a pair falls out whole. Equal sets are one entry.

A group of the index isn't expanded into pairs. In a round each set is verified against one leader of one of its groups, and
what links is joined into components; a group within one component is settled. The first leader of a group is the set with the
smallest share of tokens of its own: a text that many edited copies resemble more than each other. When leaders find next to nothing new, the
groups that are left are gone through: leaders of their rarest components meet all other members and leave the group, more leaders
each time, until no group has two components. Jaccard distances obey the triangle inequality, so two sets whose
distances from one leader differ by more than a link's are not compared.

Sets are shuffled in packed form: a row holds the tokens of many documents that belong to one range of tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonegrain.llm import common

SHINGLE, NUMERATOR = 5, 75
#: Sets that a rare token is in at most.
RARE = 64
#: Shingles of a set that is indexed by pairs of frequent tokens at most; beyond it by single ones.
PAIRED = 64
#: Links that a round must find for each set that met a leader, for another round with one leader a set; and the leaders of a group in the rounds after that, as powers.
WORTH, GROWTH = 0.4, 4
#: Sets that share a 64-bit signature with another one and are told by a second one: at most (among 10^11 sets 300 are expected).
CLASHES = 100_000
#: Shingles that a range of tokens has at most, about.
RANGE = 4_000_000
#: Tokens that a map task holds before it sends them on.
CHUNK = 800_000

_COEFF = common.mixed(np.arange(101, 101 + 64, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, sorted distinct shingle hashes of the texts one after the other, how many each has)."""
    for a, b, w in common.word_slices(texts):
        first, h = w.first, w.hashes
        m = np.maximum(w.counts - (size - 1), np.minimum(w.counts, 1))
        out = np.zeros(int(m.sum()), np.uint64)
        starts = np.cumsum(m) - m
        long = np.repeat(w.counts >= size, m)
        if long.any():
            at = (np.arange(len(out)) - np.repeat(starts, m) + np.repeat(first[:-1], m))[long]
            s = h[at] * _COEFF[0]
            for j in range(1, size):
                s += h[at + j] * _COEFF[j]
            out[long] = s
        for r in np.flatnonzero((w.counts > 0) & (w.counts < size)).tolist():
            n = int(w.counts[r])
            out[starts[r]] = np.append(h[first[r] : first[r] + n] * _COEFF[10 : 10 + n], _COEFF[40 + n]).sum()
        out = common.mixed(out)
        for i, j in zip(starts.tolist(), (starts + m).tolist(), strict=True):
            out[i:j].sort()
        keep = np.ones(len(out), bool)
        keep[1:] = out[1:] != out[:-1]
        keep[starts[m > 0]] = True
        upto = np.concatenate([[0], np.cumsum(keep)])
        yield a, b, out[keep], upto[starts + m] - upto[starts]


def _signatures(tokens: np.ndarray, counts: np.ndarray, salt: int) -> np.ndarray:
    """64 bits for each set."""
    upto = np.concatenate([[np.uint64(0)], np.cumsum(common.mixed(tokens ^ _COEFF[salt]), dtype=np.uint64)])
    ends = np.cumsum(counts)
    return common.mixed(upto[ends] - upto[ends - counts] + counts.astype(np.uint64)).view(np.int64)


def _named(tokens: np.ndarray, counts: np.ndarray, bits: int, clashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The name of each set: its signature, or the second one where the first stands for several sets; and the second one."""
    sid, sid2 = _signatures(tokens, counts, 50), _signatures(tokens, counts, 51)
    if bits < 64:
        sid = sid & np.int64((1 << bits) - 1)
    return (np.where(np.isin(sid, clashes), sid2, sid) if len(clashes) else sid), sid2


_DOCS = "doc_id long, text_a long, text_b long, n_shingles long, sid long, sid2 long"


def _describe(size: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, tokens, counts in shingles(batch.column("text"), size):
                own = [batch.column(c).slice(a, b - a) for c in ("doc_id", "text_a", "text_b")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(counts), *map(pa.array, _named(tokens, counts, bits, np.zeros(0, np.int64)))], names=[x.split()[0] for x in _DOCS.split(", ")])

    return run


# A packed row: number of sets, their ids, sizes and counts of tokens here, then the tokens in 6 bytes each. 48 bits tell
# tokens apart: two different ones of a pair of sets are equal with a probability of about (n / 2**24)^2.
_KINDS = TOKENS, HOT_MARKS, HOT_SETS = 0, 1, 2
_PACKED = "part int, kind int, payload binary"


def _pack(sid: np.ndarray, n: np.ndarray, count: np.ndarray, tokens: np.ndarray) -> bytes:
    six = np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    return np.int32(len(sid)).tobytes() + sid.astype("<i8").tobytes() + n.astype("<i4").tobytes() + count.astype("<i4").tobytes() + six.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m = int(np.frombuffer(blob, "<i4", 1)[0])
    sid, n, count = np.frombuffer(blob, "<i8", m, 4), np.frombuffer(blob, "<i4", m, 4 + 8 * m), np.frombuffer(blob, "<i4", m, 4 + 12 * m)
    six = np.frombuffer(blob, np.uint8, -1, 4 + 16 * m).reshape(-1, 6)
    tokens = np.zeros((len(six), 8), np.uint8)
    tokens[:, :6] = six
    return sid, n, count, tokens.view("<u8").ravel().astype(np.uint64)


def _by_part(part: np.ndarray, of: np.ndarray, tokens: np.ndarray, sid: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packs tokens (of: the place of their set in sid and n, ascending) by part."""
    order = np.argsort(part, kind="stable")
    part, of, tokens = part[order], of[order], tokens[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b > a:
            runs = np.concatenate([[0], np.flatnonzero(np.diff(of[a:b])) + 1, [b - a]])
            at = of[a:b][runs[:-1]]
            yield int(part[a]), _pack(sid[at], n[at], np.diff(runs), tokens[a:b])


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.binary())], names=["part", "kind", "payload"])


def _send(size: int, rare: int, parts: int, bits: int, clashes: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tokens of each distinct set by range of tokens. A token of more than `rare` sets of a chunk is known to be frequent: only a mark goes to its range, so that no range gets more than `rare` sets of a token from a chunk."""

    def flush(held: list, chunk: int) -> Iterator[pa.RecordBatch]:
        sid, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        tokens = np.concatenate([x[2] for x in held]) & np.uint64((1 << 48) - 1)
        of = np.repeat(np.arange(len(sid)), n)
        values, back, count = np.unique(tokens, return_inverse=True, return_counts=True)
        hot = (count > rare)[back]
        part = (tokens % np.uint64(parts)).astype(np.int32)
        found = [(p, TOKENS, x) for p, x in _by_part(part[~hot], of[~hot], tokens[~hot], sid, n)]
        if hot.any():
            marks = values[count > rare]
            found += [(p, HOT_MARKS, x) for p, x in _by_part((marks % np.uint64(parts)).astype(np.int32), np.zeros(len(marks), int), marks, np.zeros(1, np.int64), np.zeros(1, np.int32))]
            # Which range passes the sets on doesn't matter: they are dealt evenly.
            found += [(p, HOT_SETS, x) for p, x in _by_part(((sid[of[hot]].view(np.uint64) + np.uint64(chunk)) % np.uint64(parts)).astype(np.int32), of[hot], tokens[hot], sid, n)]
        for i in range(0, len(found), 256):
            yield _rows(found[i : i + 256])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, sent, chunk = [], 0, set(), 0
        for batch in batches:
            for _, _, tokens, counts in shingles(batch.column("text"), size):
                sid, _ = _named(tokens, counts, bits, clashes)
                new = np.zeros(len(sid), bool)
                for i, s in enumerate(sid.tolist()):
                    if counts[i] and s not in sent:
                        sent.add(s)
                        new[i] = True
                held.append((sid[new], counts[new].astype(np.int32), tokens[np.repeat(new, counts)]))
                total += len(held[-1][2])
                if total >= CHUNK:
                    yield from flush(held, chunk)
                    held, total, chunk = [], 0, chunk + 1
        if total:
            yield from flush(held, chunk)

    return run


def _gathered(batches: Iterator[pa.RecordBatch], kinds: tuple) -> dict[int, tuple]:
    held: dict[int, list] = {k: [] for k in kinds}
    for batch in batches:
        for k, x in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            held[k].append(_unpack(x))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint64))
    return {k: tuple(np.concatenate([y[i] for y in x]) for i in range(4)) if x else none for k, x in held.items()}


def _classify(rare: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts the sets of each token of one range, and sends rare (kind 0) and frequent (kind 1) ones on by set; tokens of a single set end here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gathered(batches, _KINDS)
        sid, n, count, tokens = got[TOKENS]
        marks = np.unique(got[HOT_MARKS][3])
        of = np.repeat(np.arange(len(sid)), count)
        order = np.lexsort((sid[of], tokens))
        tokens, of = tokens[order], of[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (sid[of[1:]] != sid[of[:-1]])  # equal sets of several tasks count once
        tokens, of = tokens[new], of[new]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, int)
        size = np.diff(np.append(starts, len(tokens)))
        hot = np.isin(tokens[starts], marks) if len(starts) else np.zeros(0, bool)
        kind = np.where(hot | (size > rare), 1, np.where(size > 1, 0, -1)).repeat(size)
        found = []
        for k in (0, 1):
            m = np.flatnonzero(kind == k)
            m = m[np.argsort(of[m], kind="stable")]
            found += [(p, k, x) for p, x in _by_part((sid[of[m]].view(np.uint64) % np.uint64(parts)).astype(np.int32), of[m], tokens[m], sid, n)]
        sid, n, count, tokens = got[HOT_SETS]
        of = np.repeat(np.arange(len(sid)), count)
        found += [(p, 1, x) for p, x in _by_part((sid[of].view(np.uint64) % np.uint64(parts)).astype(np.int32), of, tokens, sid, n)]
        for i in range(0, len(found), 256):
            yield _rows(found[i : i + 256])

    return run


_SETS = "sid long, n int, n_rare int, tokens array<long>"


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated tokens, rare ones first, of sets that can link at all: that have at least as many as a link needs in common."""
    got = _gathered(batches, (0, 1))
    sid = np.concatenate([np.repeat(got[k][0], got[k][2]) for k in (0, 1)])
    n = np.concatenate([np.repeat(got[k][1], got[k][2]) for k in (0, 1)])
    tokens = np.concatenate([got[k][3] for k in (0, 1)]).astype(np.int64)
    kind = np.repeat([0, 1], [len(got[0][3]), len(got[1][3])])
    order = np.lexsort((tokens, kind, sid))
    sid, n, tokens, kind = sid[order], n[order], tokens[order], kind[order]
    new = np.ones(len(sid), bool)
    new[1:] = (sid[1:] != sid[:-1]) | (tokens[1:] != tokens[:-1])
    sid, n, tokens, kind = sid[new], n[new], tokens[new], kind[new]
    starts = np.flatnonzero(np.concatenate([[True], sid[1:] != sid[:-1]])) if len(sid) else np.zeros(0, int)
    ends = np.append(starts[1:], len(sid))
    keep = ends - starts >= -(-NUMERATOR * n[starts].astype(int) // 100)
    for i in range(0, int(keep.sum()), 2000):
        a, b = starts[keep][i : i + 2000], ends[keep][i : i + 2000]
        flat = np.concatenate([tokens[x:y] for x, y in zip(a, b, strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(sid[a]), pa.array(n[a].astype(np.int32)), pa.array([int((kind[x:y] == 0).sum()) for x, y in zip(a, b, strict=True)], pa.int32()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(b - a)]).astype(np.int32)), pa.array(flat))], names=["sid", "n", "n_rare", "tokens"])


#: rest: the tokens that the set has from the entry on; small: it can be the smaller (or equal) one of a linked pair; alone: the share of its tokens that no other set has.
_KEYS = "key long, sid long, n int, rest int, small boolean, alone float"


def _index(paired: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rare tokens of the prefix one by one, frequent ones in pairs up to `paired` shingles; one by one for sets that can link with a larger set than that."""

    def entries(n: int, n_rare: int, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = n + (-NUMERATOR * n // 100) + 1 - (n - len(t))  # what the tokens of this set alone leave of the prefix
        if left <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        single = n * 100 > paired * NUMERATOR
        keys = t[: left if single else min(n_rare, left)].view(np.uint64)
        rest = len(t) - np.arange(len(keys))
        f = t[n_rare : max(n_rare, min(len(t), left + 1))].view(np.uint64)
        if n <= paired and len(f) > 1:
            i, j = np.triu_indices(len(f), 1)
            keys = np.concatenate([keys, common.mixed(f[i] * _COEFF[60] + f[j]) | np.uint64(1 << 48)])
            rest = np.concatenate([rest, len(t) - n_rare - j + 1])
        return keys, rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for sid, n, n_rare, tokens in zip(batch.column("sid").to_pylist(), batch.column("n").to_pylist(), batch.column("n_rare").to_pylist(), batch.column("tokens"), strict=True):
                keys, rest = entries(n, n_rare, tokens.values.to_numpy())
                out.append((keys.view(np.int64), sid, n, rest, 1 - len(tokens) / n))
                size += len(keys)
                if size > 500_000:
                    yield _key_rows(out)
                    out, size = [], 0
            yield _key_rows(out)

    return run


def _key_rows(out: list) -> pa.RecordBatch:
    m = [len(x[0]) for x in out]
    sid, n = np.repeat([x[1] for x in out], m).astype(np.int64), np.repeat([x[2] for x in out], m).astype(np.int64)
    alone = np.repeat([x[4] for x in out], m).astype(np.float32)
    keys, rest = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in out)]) for i in (0, 3))
    small = rest * (100 + NUMERATOR) >= NUMERATOR * 2 * n
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sid), pa.array(n.astype(np.int32)), pa.array(rest.astype(np.int32)), pa.array(small), pa.array(alone)], names=["key", "sid", "n", "rest", "small", "alone"])


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their Jaccard distance, and whether they link."""
    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    other = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both, union = F.size(F.array_intersect("ta", "tb")).cast("long"), F.col("na") + F.col("nb") - F.col("both")
    return pairs.join(one, "a").join(other, "b").select("a", "b", "na", "nb", both.alias("both")).select("a", "b", (1 - F.col("both") / union).alias("distance"), (F.col("both") * 100 >= union * NUMERATOR).alias("links"))


def _tasks(rows: int) -> int:
    """Tasks that write a table of about so many narrow rows: small tables aren't cut into many files."""
    return max(8, -(-rows // 100_000))


def _n_rows() -> Column:
    return F.count(F.lit(1)).alias("rows")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the same all over a component.

    Each round points every node to its smallest neighbour, follows the pointers to their ends and contracts the graph;
    what is left shrinks by half or more.
    """
    spark, labels = edges.sparkSession, None
    edges, left = common.counted(edges.where("a <> b").distinct(), "edges", _n_rows())
    while left["rows"]:
        tasks = _tasks(2 * left["rows"])
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up, moved = common.saved(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "pointers", tasks=tasks), {"rows": 1}
        while moved["rows"]:
            far = up.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
            farther = up.select(F.col("node").alias("beyond"), F.col("root").alias("end"))
            ends = up.join(far, "root", "left").join(farther, "beyond", "left").select("node", F.coalesce("end", "beyond", "root").alias("root"), (F.coalesce("end", "beyond", "root") != F.col("root")).alias("moved"))
            up, moved = common.counted(ends, "pointers", F.count_if("moved").alias("rows"), tasks=tasks)
            up = up.drop("moved")
        ends = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        edges, left = common.counted(edges.join(ends("a"), "a").join(ends("b"), "b").where("a_root <> b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges", _n_rows(), tasks=tasks)
        n_labels = tasks if labels is None else n_labels
        labels = up if labels is None else common.saved(labels.join(up.select(F.col("node").alias("root"), F.col("root").alias("beyond")), "root", "left").select("node", F.coalesce("beyond", "root").alias("root")), "labels", tasks=n_labels)
    return labels if labels is not None else spark.createDataFrame([], "node long, root long")


def _settled(live: DataFrame, tasks: int | None = None) -> tuple[DataFrame, dict]:
    """The entries of groups that still have two components and a member that can be the smaller one of a pair; and how many (rows)."""
    open_ = live.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("small").alias("some")).where("lo <> hi and some").select("key")
    return common.counted(live.join(open_, "key"), "entries", _n_rows(), tasks=tasks)


def linked(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of all sets that link with another one, from the index keys (key, sid, n, rest, small, alone)."""
    n, m = F.col("n").cast("long"), F.col("m").cast("long")
    far = 1 - NUMERATOR / 100 + 1e-9
    can = (m * 100 >= n * NUMERATOR) & (n * 100 >= m * NUMERATOR) & (F.least("rest", "lead_rest") * (100 + NUMERATOR) >= (n + m) * NUMERATOR) & (F.col("small") | F.col("lead_small")) & (F.col("root") != F.col("lead_root"))
    near = ~F.coalesce((F.col("pivot") == F.col("lead_pivot")) & (F.abs(F.col("away") - F.col("lead_away")) > far), F.lit(False))
    live, left = _settled(keys.withColumns({"root": F.col("sid"), "pivot": F.lit(None).cast("long"), "away": F.lit(None).cast("double")}))
    tried = links = None
    leaders, k = 0, 0  # leaders of a group; 0 while each set meets one leader of all its groups
    while left["rows"]:
        tasks = _tasks(left["rows"])  # no table of a round but the pairs of many leaders has more rows than the entries
        # First the set that has least of its own: a text that many edited copies resemble. Then any.
        first = F.struct((F.col("alone") if k == 0 else F.lit(0.0).cast("float")).alias("alone"), F.xxhash64("sid", F.lit(k)).alias("h"))
        lead = F.struct(first.alias("o"), F.col("sid").alias("lead"), F.col("n").alias("m"), F.col("rest").alias("lead_rest"), F.col("small").alias("lead_small"), F.col("root").alias("lead_root"), F.col("pivot").alias("lead_pivot"), F.col("away").alias("lead_away"))
        if leaders:
            size = live.groupBy("key", "root").agg(F.count("*").alias("members"))
            slot = F.pmod(F.xxhash64("sid", F.lit(-k)), F.lit(leaders)).alias("slot")
            chosen = common.saved(live.join(size, ["key", "root"]).groupBy("key", slot).agg(F.min(F.struct("members", lead.alias("l"))).alias("l")).select("key", "l.l.*"), "leaders", tasks=tasks)
        else:
            chosen = live.where("small").groupBy("key").agg(F.min(lead).alias("l")).select("key", "l.*")
        met = live.join(chosen, "key").where(can & near)
        if not leaders:
            met, members = common.counted(met.groupBy("sid").agg(F.min_by("lead", "o").alias("lead")), "met", _n_rows(), tasks=tasks)
        pairs = met.select(F.least("sid", "lead").alias("a"), F.greatest("sid", "lead").alias("b")).distinct()
        found, count = common.counted(measured(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), sets), "pairs", F.count_if("links").alias("links"))
        tried = found.select("a", "b") if tried is None else tried.unionByName(found.select("a", "b"))
        links = found.where("links") if links is None else links.unionByName(found.where("links"))
        if k == 0:
            from_lead = met.join(found, (F.least("sid", "lead") == F.col("a")) & (F.greatest("sid", "lead") == F.col("b"))).select("sid", "distance", "lead")
            leads = met.select(F.col("lead").alias("sid"), F.lit(0.0).alias("distance"), "lead").distinct()
            pivots = from_lead.unionByName(leads).groupBy("sid").agg(F.min(F.struct("distance", "lead")).alias("p")).select("sid", F.col("p.lead").alias("pivot"), F.col("p.distance").alias("away"))
            live = live.drop("pivot", "away").join(pivots, "sid", "left")
        if leaders:
            live = live.join(chosen.select("key", F.col("lead").alias("sid")), ["key", "sid"], "left_anti")
        if count["links"]:
            live = live.drop("root").join(components(links).withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        (live, left), k = _settled(live, tasks), k + 1
        leaders = GROWTH * leaders if leaders else GROWTH * int(count["links"] <= WORTH * members["rows"])
    return components(links) if links is not None else keys.sparkSession.createDataFrame([], "node long, root long")


def grouped(docs: DataFrame, size: int = SHINGLE, rare: int = RARE, paired: int = PAIRED, bits: int = 64) -> DataFrame:
    """doc_id, text_a, text_b, n_shingles, root for each row of docs: root is the same for all rows of a component, null for an empty set. bits: of the first signature of a set."""
    spark, text = docs.sparkSession, common.text_column(docs)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *common.text_keys(text))
    table = common.saved(plain.mapInArrow(_describe(size, bits), _DOCS), "sets-of-docs")
    clash = table.where("n_shingles > 0").groupBy("sid").agg(F.min("sid2").alias("lo"), F.max("sid2").alias("hi")).where("lo <> hi").select("sid").limit(CLASHES + 1)
    clashes = np.array([r[0] for r in clash.collect()], np.int64)
    if len(clashes) > CLASHES:
        raise ValueError("too many sets share a signature")
    if len(clashes):
        told = spark.createDataFrame([(int(x), True) for x in clashes], "sid long, clash boolean")
        table = table.join(F.broadcast(told), "sid", "left").withColumn("sid", F.when(F.col("clash"), F.col("sid2")).otherwise(F.col("sid"))).drop("clash")
    shingled = table.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    parts = max(common.partitions(spark), -(-shingled // RANGE))
    by_token = plain.select("text").mapInArrow(_send(size, rare, parts, bits, clashes), _PACKED).repartitionById(parts, F.col("part"))
    by_set = by_token.mapInArrow(_classify(rare, parts), _PACKED).repartitionById(parts, F.col("part"))
    sets = common.saved(by_set.mapInArrow(_assemble, _SETS), "sets")
    roots = linked(sets.mapInArrow(_index(paired), _KEYS), sets)
    return common.saved(table.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "text_a", "text_b", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "sid")).alias("root")), "rooted")


def join(docs: DataFrame, size: int = SHINGLE, rare: int = RARE, paired: int = PAIRED, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text); component_id: the smallest doc_id reachable by links.

    A null text or one without words has an empty set and is its own component. Rows that repeat a text or a doc_id are
    equal sets and so linked. Texts of any length count whole; an empty table gives no row. Of docs only doc_id and text
    are read.
    """
    rooted = grouped(docs, size, rare, paired, bits)
    least = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near copies, that with the smallest doc_id, with its columns as they are.

    A row without doc_id stays if its group has no row with one (of several texts that with the least hash). Rows without
    words are groups of their own. Of rows that repeat doc_id and text one stays.
    """
    rooted = grouped(docs).where("root is not null")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_a", "text_b")
    kept = rooted.groupBy("root").agg(F.min(first).alias("k")).select("root", "k.*").toDF("root", "none", "keep_id", "keep_a", "keep_b")
    is_kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_a") == F.col("keep_a")) & (F.col("text_b") == F.col("keep_b"))
    told = common.saved(rooted.join(kept, "root").select("doc_id", "text_a", "text_b", is_kept.alias("kept")), "told")
    keys = common.text_keys(common.text_column(docs))
    left = common.without(docs, told.where("not kept").drop("kept"), keys)
    return common.once(left, told.where("kept").groupBy("doc_id", "text_a", "text_b").agg(F.count("*").alias("c")).where("c > 1").drop("c"), keys)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') AS parts FROM documents),
w AS (SELECT doc_id, list_filter(parts, lambda x: x <> '') AS w FROM d),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a WHERE r.root < e.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.root) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, len(s.s)
"""
