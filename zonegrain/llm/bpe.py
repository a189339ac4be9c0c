"""BPE encoding and decoding by dynamic programming over prefixes.

The encoding of a string has one last token for each of its prefixes. It is the one token that ends where the prefix ends
and fits behind the last token of the prefix before it, where a pair fits if encoding both together gives the pair. So one
pass finds the last token of every prefix: an automaton over the vocabulary, by its suffix links, lists all tokens that
end at a place; the first that fits is stored; following the stored tokens back from the end emits the ids. No merge is
carried out and nothing is taken back, whatever the text.

Whether a pair fits is found by running time backwards: the merge of the pair that came later is undone again and again,
and at each stage the two tokens that touch mustn't have a merge that would have come first.

Texts are parted into units as in packing; each distinct unit of a task goes through the program once, while its table has room.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonegrain.llm import common, packing

#: Verdicts on pairs that a worker keeps at most; beyond it they are found again.
PAIRS = 2_000_000
#: Stands for the end of a word; bytes are the characters below it.
END = "Ā"


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the others from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, their merges, the automaton over them, and the parts of the tokenizer before its model."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model, of = described["model"], byte_of_char()
        suffix = model["end_of_word_suffix"]
        vocabulary: dict[str, int] = model["vocab"]
        n = 1 + max([*vocabulary.values(), *(x["id"] for x in described["added_tokens"])])
        self.parts: list[tuple[int, int] | None] = [None] * n
        self.rank = [-1] * n  # of the merge that makes the token
        self.merged: dict[tuple[int, int], int] = {}
        for i, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, t = vocabulary[left], vocabulary[right], vocabulary[left + right]
            self.merged[a, b], self.parts[t], self.rank[t] = t, (a, b), i
        self.ends_word = [False] * n
        names: list[str | None] = [None] * n
        for s, t in vocabulary.items():
            if self.parts[t] is None:
                ends = len(s) > 1 and s.endswith(suffix)
                names[t] = chr(of[s[: -len(suffix)] if ends else s]) + END * ends
        for t in sorted((t for t in range(n) if self.parts[t]), key=self.rank.__getitem__):
            a, b = self.parts[t]
            names[t] = names[a] + names[b]
        self.size = [len(s) if s else 0 for s in names]
        self.fitting: dict[int, bool] = {}
        # A token that its own string doesn't encode to is never emitted.
        real = [s is not None for s in names]
        self.automaton = ahocorasick.Automaton()
        for t in sorted((t for t in range(n) if names[t]), key=self.rank.__getitem__):
            if self.parts[t]:
                a, b = self.parts[t]
                real[t] = real[a] and real[b] and self._fits(a, b, self.rank[t])
            if real[t]:
                self.automaton.add_word(names[t], (self.size[t], t))
        self.automaton.make_automaton()
        self.shown: list[bytes] = [b""] * n
        for s, t in vocabulary.items():
            self.shown[t] = s.encode()
        self.special = {x["content"]: x["id"] for x in described["added_tokens"]}
        for s, t in self.special.items():
            self.shown[t] = s.encode()
        self._special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        whole = Tokenizer.from_file(path)
        self._normalizer, self._pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        self._bytes = {ord(c): b for c, b in of.items()}

    def _fits(self, u: int, v: int, limit: int) -> bool:
        """Whether no merge across the two tokens comes before the one of that rank, nor before those that make the tokens."""
        while True:
            t = self.merged.get((u, v))
            if t is not None and self.rank[t] < limit:
                return False
            # Equal merges go from left to right: the right one is the later.
            if self.rank[u] > self.rank[v]:
                limit, u = self.rank[u], self.parts[u][1]
            elif self.rank[v] >= 0:
                limit, v = self.rank[v] + 1, self.parts[v][0]
            else:
                return True

    def word(self, symbols: str) -> list[int]:
        """Ids of a word, its bytes as characters, without the mark of its end."""
        symbols += END
        last = [-1] * (len(symbols) + 1)
        fitting, size = self.fitting, self.size
        if len(fitting) > PAIRS:
            fitting.clear()
        for end, (n, t) in self.automaton.iter(symbols):
            if last[end + 1] >= 0:
                continue
            before = end + 1 - n
            if before:
                u = last[before]
                key = u << 32 | t
                fits = fitting.get(key)
                if fits is None:
                    fits = fitting[key] = self._fits(u, t, len(self.merged))
                if not fits:
                    continue
            last[end + 1] = t
        ids, end = [], len(symbols)
        while end:
            t = last[end]
            if t < 0:
                raise ValueError("a prefix has no token: the vocabulary lacks a byte")
            ids.append(t)
            end -= size[t]
        ids.reverse()
        return ids

    def unit(self, text: str) -> list[int]:
        """Ids of any text without white space of ASCII in it: special tokens, and the words that the tokenizer sees in the rest."""
        out, at = [], 0
        for m in [*(self._special.finditer(text) if self._special else ()), None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                for piece, _ in self._pre_tokenizer.pre_tokenize_str(self._normalizer.normalize_str(part)):
                    out += self.word(piece.translate(self._bytes))
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(name: str) -> Vocabulary:
    """One for each worker process, from the executor's own copy of the file."""
    if name not in _VOCABULARIES:
        _VOCABULARIES[name] = Vocabulary(name if "/" in name else packing.tokenizer_path(name))
    return _VOCABULARIES[name]


class Encoder(packing.Encoder):
    """Ids of whole texts; units that the table lacks go through the dynamic program."""

    def __init__(self, words: Vocabulary, limit: int = packing.CACHE_UNITS):
        self.words, self.limit = words, limit
        self._clear()

    def _learn(self, plain: list[str], odd: list[str]) -> None:
        found = [*(self.words.word(x.encode().decode("latin-1")) if x.isascii() else self.words.unit(x) for x in plain), *map(self.words.unit, odd)]
        if found:
            self._store([*plain, *odd], [np.array([i for x in found for i in x], np.uint32)], [np.array([len(x) for x in found], np.int64)])


_IDS = "doc_id long, n_tokens long, ids binary"


def _encode(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(vocabulary(name))
        for batch in batches:
            data, off = common.string_buffers(batch.column("text"))
            for a, b in common.slices(off, packing.SLICE_BYTES):
                ids, counts = enc.encode(data[off[a] : off[b]], off[a : b + 1] - off[a])
                upto = np.concatenate([[0], np.cumsum(counts) * 4]).astype(np.int32)
                blob = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(upto), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(counts.astype(np.int64)), blob], names=["doc_id", "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, name: str = packing.TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 4 bytes each) for each row of docs (doc_id, text).

    A null or empty text, and one of white space, has no ids. Texts of any length, also without a space, count whole.
    Rows and doc_ids may repeat, and doc_id may be null: each row gives a row. Strings of special tokens in a text are those
    tokens. An empty table gives no row. Other columns aren't read.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    return plain.mapInArrow(_encode(name), _IDS)


def _decode(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = vocabulary(name).shown
        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time: the text of a row is several times its ids
                part = batch.slice(i, 1)
                blob = part.column("ids")[0].as_buffer()
                ids = np.frombuffer(blob, "<u4").tolist() if blob is not None else []
                text = b" ".join([s for s in map(shown.__getitem__, ids) if s])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([text.decode()])], names=["doc_id", "n_tokens", "ids", "text"])

    return run


def decode(encoded: DataFrame, name: str = packing.TOKENIZER) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) with the text of the ids: tokens as the vocabulary writes them, with a space between two. No ids give the empty text."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decode(name), f"{_IDS}, text string")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
