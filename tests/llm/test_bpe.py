"""BPE by prefixes against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from zonegrain.llm import bpe, packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.tokenizer_path())


@pytest.fixture(scope="module")
def words():
    return bpe.vocabulary(packing.TOKENIZER)


def texts(seed):
    rng = random.Random(seed)
    kinds = ["ab", "abcdefghij", "aeinrst", "!?-=*#", "0123456789ab", "é漢字ßİ'x", "lo wr'sed ", "  a b\x1c\x00", "ÀÉabc", "éà ñ"]
    for _ in range(300):
        yield "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 60)))
    yield from ["<|endoftext|>a<|startoftext|><|ENDOFTEXT|>", "it's they'll WE'RE", "</w> a</w>b", "a" * 5000, "!" * 3000, "ab" * 2000, "", "   ", "½²…—'s"]


def test_units_against_the_library(library, words):
    for seed in range(3):
        for text in texts(seed):
            want = library.encode(text, add_special_tokens=False).ids
            data = np.frombuffer(text.encode(), np.uint8)
            ids, counts = bpe.Encoder(words).encode(data, np.array([0, len(data)]))
            assert ids.tolist() == want and counts.tolist() == [len(want)], text
            assert [i for w in text.split() for i in words.unit(w)] == want or " " in text or " " in text or "\x1c" in text


def test_pairs_that_fit(words):
    """A pair fits if, and only if, the merges carried out on both together give the pair."""
    rng = random.Random(4)

    def merged(symbols):
        while True:
            found = [(words.rank[words.merged[p]], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in words.merged]
            if not found:
                return symbols
            i = min(found)[1]
            symbols = [*symbols[:i], words.merged[symbols[i], symbols[i + 1]], *symbols[i + 2 :]]

    def base(t):
        return [t] if words.parts[t] is None else [x for p in words.parts[t] for x in base(p)]

    inner = [t for t, p in enumerate(words.parts) if p and not words.shown[t].endswith(b"</w>")]
    for _ in range(1500):
        u, v = rng.choice(inner[:3000]), rng.choice(inner[:3000])
        assert words._fits(u, v, len(words.merged)) == (merged(base(u) + base(v)) == [u, v])


def test_documents(spark, library, nasty, empty):
    rows = nasty.select("doc_id", "text").collect()
    got = bpe.decode(bpe.encode(nasty)).collect()
    want = []
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), r.text) for r in got) == sorted(want)
    assert bpe.decode(bpe.encode(empty)).isEmpty()


def test_query(spark, library, data):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = bpe.op11_bpe(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
