"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from zonegrain.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests, fanout):
    proofs, level, under = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for k, run in enumerate(runs):
            for j in range(len(run)):
                for i in under[k * fanout + j]:
                    proofs[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
        under = [sum(under[i : i + fanout], []) for i in range(0, len(level), fanout)]
        level = [sha("".join(r)) for r in runs]
    return (level[0] if level else None), proofs


def expected(rows, fanout):
    """(doc_id, leaf, subroot, root, proof) of rows (doc_id, text, lang, source, n_chars)."""
    trees: dict = {}
    for d, text, lang, source, n in rows:
        trees.setdefault(source, []).append(((d is not None, d or 0), leaf((d, source, lang, n, text)), d))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subs = [(sorted(trees[s]), *plain_tree([x[1] for x in sorted(trees[s])], fanout)) for s in names]
    root, tops = plain_tree([s[1] for s in subs], fanout)
    return sorted((str(x[2]), x[1], sub, root, p + t) for (leaves, sub, proofs), t in zip(subs, tops, strict=True) for x, p in zip(leaves, proofs, strict=True))


def found(docs, fanout=16):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in merkle.manifest(docs, fanout=fanout).collect())


@pytest.mark.parametrize(("sizes", "fanout"), [([1], 16), ([16], 16), ([17], 16), ([1, 1], 16), ([1, 300, 15, 257], 16), ([70, 1, 9], 2), ([3] * 40, 3), ([400], 2)])
def test_trees(spark, sizes, fanout):
    rows, at = [], 0
    for k, n in enumerate(sizes):
        for _ in range(n):
            rows.append((at * 7 % 1009, f"text {at}", "en", f"s{k}", at))
            at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert found(docs, fanout) == expected(rows, fanout)


def test_nasty(spark, nasty, empty):
    rows = [tuple(r) for r in nasty.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert found(nasty) == expected(rows, 16) and found(nasty.repartition(7), 2) == expected(rows, 2)
    assert merkle.manifest(empty).isEmpty()


def test_changed_bytes_are_found(spark, nasty):
    also = merkle.leaf([F.upper(F.col("text")) if f == "text" else F.col(f) for f in merkle.FIELDS])
    got = merkle.manifest(nasty, also).withColumn("same", merkle.folded(F.col("proof"), F.col("leaf")) == F.col("root")).withColumn("other", merkle.folded(F.col("proof"), F.col("also")) == F.col("root"))
    assert all(r.same and r.other == (r.leaf == r.also) for r in got.collect())


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = {d: (a, b, c, p) for d, a, b, c, p in expected(rows, 16)}
    fields = {str(r[0]): r for r in rows}
    got = merkle.op12_merkle(spark, data).collect()
    assert len(got) == len(rows) and not all(r.verified for r in got)
    for r in got:
        a, b, c, proof = want[str(r.doc_id)]
        d, text, lang, source, n = fields[str(r.doc_id)]
        x = a
        if zlib.crc32(str(d).encode()) % 5 == 0 and text is not None:
            x = leaf((d, source, lang, n, "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text)))
        for left, right in proof:
            x = sha(left + x + right)
        assert tuple(r)[1:] == (a, b, c, sha("".join(left + right for left, right in proof)), x, x == c)
