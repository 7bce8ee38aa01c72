"""BPE with word ends: speculate with greedy longest match, verify, merge the rest.

The work is per distinct unit (see units.py). No pre-token spans two units, so
a unit's ids do not depend on what stands around it and a worker encodes each
unit once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.units import Memory
from seqloom.session import ship

NO_RANK = int(np.iinfo(np.int64).max)


class WordBpe:
    """Encoder and decoder for a tokenizer file whose model has word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.byte_chars = str.maketrans(byte_alphabet())
        self.longest = max(map(len, self.vocab))
        self._merges(model["merges"])
        self.memory = Memory(self._learn, (np.uint32, np.uint8))

    def _merges(self, merges) -> None:
        size = max(self.names) + 1
        #: The merge that forms a token; its parts; a token without one is a base.
        self.rank = np.full(size, NO_RANK, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.merged: dict[int, int] = {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if (x, y) not in self.pair_rank:
                self.pair_rank[x, y] = rank
                self.merged[rank] = z
            if self.rank[z] == NO_RANK:
                self.rank[z], self.left[z], self.right[z] = rank, x, y
        for z in np.flatnonzero(self.left >= 0).tolist():
            for part in (self.left[z], self.right[z]):
                if self.left[part] >= 0 and self.rank[part] >= self.rank[z]:
                    raise ValueError("a merge stands before the merges of its parts")
        keys = np.array([x * size + y for x, y in self.pair_rank], np.int64)
        order = np.argsort(keys)
        self.size, self.pair_keys = size, keys[order]
        self.pair_ranks = np.array(list(self.pair_rank.values()), np.int64)[order]

    def speculate(self, word: str) -> list[int] | None:
        """Greedy longest match from the left; None if some place has no match."""
        vocab, end, n, at, out = self.vocab, self.end, len(word), 0, []
        while at < n:
            for to in range(min(n, at + self.longest), at, -1):
                found = vocab.get(word[at:to] + end if to == n else word[at:to])
                if found is not None:
                    break
            else:
                return None
            out.append(found)
            at = to
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair, whether merging in rank order leaves the border alone.

        Both tokens are taken apart towards the border, latest merge first. At
        each step the parts that meet at the border must have no merge earlier
        than those that use them up; of equal merges the left one comes first.
        """
        a, b = left.astype(np.int64), right.astype(np.int64)
        good = np.ones(len(a), bool)
        a_used, b_used = np.full(len(a), NO_RANK), np.full(len(a), NO_RANK)
        open_ = np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK)
            bad = (rank < a_used[open_]) & (rank <= b_used[open_]) & (rank != NO_RANK)
            good[open_[bad]] = False
            open_ = open_[~bad]
            x, y = a[open_], b[open_]
            rx, ry = np.where(self.left[x] >= 0, self.rank[x], -1), np.where(self.left[y] >= 0, self.rank[y], -1)
            go = (rx >= 0) | (ry >= 0)
            open_, x, y, rx, ry = open_[go], x[go], y[go], rx[go], ry[go]
            from_left = rx >= ry
            w = open_[from_left]
            a_used[w], a[w] = rx[from_left], self.right[x[from_left]]
            w = open_[~from_left]
            b_used[w], b[w] = ry[~from_left], self.left[y[~from_left]]
        return good

    def merge(self, word: str) -> list[int]:
        """Exact merging in rank order, the leftmost first."""
        parts = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.end]]
        rank_of = self.pair_rank.get
        while len(parts) > 1:
            ranks = [rank_of(p, NO_RANK) for p in zip(parts, parts[1:], strict=False)]
            rank = min(ranks)
            if rank == NO_RANK:
                break
            at, token = ranks.index(rank), self.merged[rank]
            x, y = parts[at], parts[at + 1]
            out, i, n = parts[:at], at, len(parts)
            while i < n:
                if parts[i] == x and i + 1 < n and parts[i + 1] == y:
                    out.append(token)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """The ids of these pre-tokens, given in byte characters."""
        todo = list(words)
        guesses = [self.speculate(w) for w in todo]
        flat = np.array([i for g in guesses if g for i in g], np.int64)
        sizes = np.array([len(g) if g else 0 for g in guesses], np.int64)
        failed = np.zeros(len(todo), bool)
        if len(flat) > 1:
            of = np.repeat(np.arange(len(todo)), sizes)
            same = of[1:] == of[:-1]
            pairs, back = np.unique(flat[:-1][same] * self.size + flat[1:][same], return_inverse=True)
            good = self.compatible(pairs // self.size, pairs % self.size)
            failed[of[1:][same][~good[back]]] = True
        return {w: self.merge(w) if bad or guess is None else guess for w, guess, bad in zip(todo, guesses, failed.tolist(), strict=True)}

    def pre_tokens(self, run: str) -> list[str | int]:
        """Pre-tokens in byte characters; an int is a special token."""
        out: list[str | int] = []
        for i, part in enumerate(self.specials.split(run) if "<|" in run else [run]):
            if i % 2:
                out.append(self.special[part])
            elif part.isascii():
                out += [w if w.isprintable() else self._bytes(w) for w in self.words.findall(part.lower())]
            elif any(unicodedata.category(c) == "Cn" for c in part):
                out += self._by_library(part)
            elif part:
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += [self._bytes(w) for w in self.words.findall(plain)]
        return out

    def _bytes(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.byte_chars)

    def _by_library(self, part: str) -> list[str]:
        """Pre-tokens of a run with characters newer than this Python's Unicode."""
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]

    def _learn(self, units: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        names = self.names
        pre = [self.pre_tokens(u.decode()) for u in units]
        known = self.encode_words({w for ws in pre for w in ws if isinstance(w, str)})
        ids = [[i for w in ws for i in ([w] if isinstance(w, int) else known[w])] for ws in pre]
        return [np.array(x, np.uint32) for x in ids], [np.frombuffer("".join([f"{names[i]} " for i in x]).encode(), np.uint8) for x in ids]

    def encode_batch(self, texts: list[bytes]):
        """Yields (ids as little-endian uint32, decoded text in UTF-8) of each text."""
        for ids, decoded in self.memory.texts(texts, fold=True):
            yield ids.astype("<u4", copy=False).tobytes(), decoded[:-1].tobytes()


def byte_alphabet() -> dict[int, str]:
    """The usual printable character for each byte of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One encoder per worker and file."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of docs(doc_id, text), whole texts.

    A null text counts as empty: no ids and an empty decoded text.
    """

    def run(batches):
        bpe = loaded(path or default_path())
        for pdf in batches:
            got = list(bpe.encode_batch([x or b"" for x in pdf["data"]]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [array("I", g[0]).tolist() for g in got], "decoded": [g[1].decode() for g in got]})

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data")).mapInPandas(run, "doc_id bigint, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() in digest form."""

    def run(batches):
        bpe = loaded(path or default_path())
        for pdf in batches:
            got = list(bpe.encode_batch([x or b"" for x in pdf["data"]]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(g[0]) // 4 for g in got], "ids_sha256": [hashlib.sha256(g[0]).hexdigest() for g in got], "decoded_sha256": [hashlib.sha256(g[1]).hexdigest() for g in got]})

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data")).mapInPandas(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_bpe_encode(spark, sf_dir) -> DataFrame:
    """The contract's query over all documents."""
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), os.environ.get("SEQLOOM_WORD_BPE"))
