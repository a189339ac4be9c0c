"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from zonegrain.llm import runs


def brute(words):
    ids: dict = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words], int)
    out: dict = {}
    for q in range(1, len(x) // 4 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(int), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + q >= max(6, 4 * q):
                out.setdefault((a, b - a + q), q)  # the least period comes first
    return sorted((a, n, q) for (a, n), q in out.items())


def collapsed(words, found):
    lost = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in lost)


def documents(seed, n):
    """Words of few kinds, with repetitions of repetitions, cut and joined."""
    rng = random.Random(seed)
    for _ in range(n):
        words = []
        while len(words) < rng.randint(0, 400):
            block = [rng.choice("abcXY") for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 17, 33]))] if rng.random() < 0.7 else [rng.choice(words or ["a"]) for _ in range(4)]
            if rng.random() < 0.3:
                block *= rng.randint(2, 6)
            words += block * rng.randint(1, 7) + block[: rng.randint(0, len(block))]
        yield words[: rng.randint(0, max(1, len(words)))]


@pytest.mark.parametrize("block", [1 << 18, 64, 16])
def test_runs(spark, block):
    texts = [" ".join(w) for w in documents(block, 60)]
    a, b = ["a"], ["a", "b"]
    while len(a) < 300:
        a, b = b, b + a  # Fibonacci: no exponent of 4
    texts += [" ".join(a), "a " * 700, "a b " * 333, " ".join(["x", *(["p", "q", "r"] * 200), "y", *(["p", "q", "r"] * 200)]), "a a a a a", "a a a a a a", "A a A a A a A a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in runs.periodic(docs, block).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = brute(text.split())
        assert [(r.start, r.length, r.period) for r in got[i].runs] == want
        assert got[i].collapsed == collapsed(text.split(), want)


def test_runs_of_short_documents(spark):
    """Documents of a few words alone, where hardly an octave is tried."""
    texts = ["a a a a a a", "a a a a a a a", "b", "", "a b a b a b a b", "a a a a a b", "x " * 7 + "y"]
    for some in ([t] for t in texts), [texts]:
        for part in some:
            got = {r.doc_id: r for r in runs.periodic(spark.createDataFrame(list(enumerate(part)), "doc_id long, text string").coalesce(1)).collect()}
            assert all([tuple(x) for x in got[i].runs] == brute(t.split()) for i, t in enumerate(part))


def test_z_function():
    for words in documents(3, 50):
        z = runs.z_function(words, len(words))
        for i in range(1, len(words)):
            k = 0
            while i + k < len(words) and words[k] == words[i + k]:
                k += 1
            assert z[i] == k


def test_nasty(spark, nasty, empty):
    rows = nasty.select("doc_id", "text").collect()
    got = runs.periodic(nasty, 1000).collect()
    want = []
    for r in rows:
        words = [w.decode() for w in (r.text or "").encode().split()]
        # 40,000 words of period 5: the only run of the long text.
        found = [(0, len(words), 5)] if len(words) > 1000 else brute(words)
        want.append((str(r.doc_id), found, collapsed(words, found)))
    assert sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted(want)
    assert runs.periodic(empty).isEmpty()


def test_query(spark, data):
    texts = {r.doc_id: (r.text or "").encode().split() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = runs.op13_periodic_runs(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        w, h = [x.decode() for x in texts[r.doc_id]], zlib.crc32(str(r.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute(w)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if found else None
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4))
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, found).encode()).hexdigest()
