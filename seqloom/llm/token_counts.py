"""Token counts under a unigram model, by dynamic programming over a shared trie.

Distinct pre-tokens of a batch are walked in sorted order, which is the walk of
their trie from the left: what two neighbours share is kept, so the scores of a
prefix are computed once however many pre-tokens begin with it. At a pre-token's
end its count is stored; a document's count is a sum over its pre-tokens.

The vocabulary is a public tokenizer's. Its pieces get a probability
proportional to 1 / (rank + 2.7), a fixed law, as the file has no probabilities.
"""

from __future__ import annotations

import base64
import math
import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import ship

#: Pre-tokens kept by a worker; beyond it the memory is begun anew.
KEPT = 700_000
#: Longer pre-tokens share no prefixes and are scored by logarithms.
LONGEST = 48
#: Logarithms nearer than this are taken as equal.
TIE = 1e-9
SHIFT = 2.7
PRE_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


class Unigram:
    """Pieces of bytes with probabilities; every byte is a piece."""

    def __init__(self, weight: dict[bytes, float]):
        least = min(weight.values(), default=1.0)
        weight = {bytes([b]): least / 2 for b in range(256)} | weight
        whole = math.fsum(weight.values())
        self.prob = {piece: w / whole for piece, w in weight.items()}
        self.longest = max(map(len, self.prob))
        self.memory: dict[bytes, int] = {}
        self.stored = np.empty((0, 3))

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        """Ranks from a file of lines `base64 rank`."""
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        return cls({base64.b64decode(a): 1 / (int(b) + SHIFT) for a, b in rows})

    def many(self, words) -> dict[bytes, tuple[int, float, float]]:
        """{word: (tokens of the best segmentation, its log, log of the sum over all)}.

        Forward scores of prefixes: best and count of the best segmentation, of
        equal ones that of fewer tokens, and the total over all segmentations.
        Each shared prefix is scored once. Up to LONGEST bytes plain
        probabilities don't underflow; longer words are scored by long().
        """
        get, longest, out = self.prob.get, self.longest, {}
        best, count, total = [1.0], [0], [1.0]
        before = b""
        for word in sorted(words):
            if len(word) > LONGEST:
                out[word] = self.long(word)
                continue
            keep = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                keep += 1
            del best[keep + 1 :], count[keep + 1 :], total[keep + 1 :]
            for i in range(keep + 1, len(word) + 1):
                top, parts, mass = 0.0, 0, 0.0
                for j in range(i - longest if i > longest else 0, i):
                    p = get(word[j:i])
                    if p is not None:
                        mass += total[j] * p
                        v = best[j] * p
                        if v > top or v == top and count[j] + 1 < parts:
                            top, parts = v, count[j] + 1
                best.append(top)
                count.append(parts)
                total.append(mass)
            out[word] = (count[-1], math.log(best[-1]), math.log(total[-1]))
            before = word
        return out

    def long(self, word: bytes) -> tuple[int, float, float]:
        """As many(), of one word of any length, by logarithms."""
        get, longest, log, exp = self.prob.get, self.longest, math.log, math.exp
        best, count, total = [0.0], [0], [0.0]
        for i in range(1, len(word) + 1):
            top, parts, masses = -math.inf, 0, []
            for j in range(i - longest if i > longest else 0, i):
                p = get(word[j:i])
                if p is not None:
                    p = log(p)
                    masses.append(total[j] + p)
                    v = best[j] + p
                    # equal products may differ in the last places of their logs
                    if v > top + TIE or v > top - TIE and count[j] + 1 < parts:
                        top, parts = v, count[j] + 1
            most = max(masses)
            best.append(top)
            count.append(parts)
            total.append(most + log(math.fsum(exp(m - most) for m in masses)))
        return count[-1], best[-1], total[-1]

    def runs(self, data: bytes) -> list[bytes]:
        """Pre-tokens: runs of letters and bytes above 127, of digits, of other non-space."""
        return PRE_TOKEN.findall(data)

    def count(self, texts: list[bytes]) -> list[tuple[int, int, float, float]]:
        """(pre-tokens, tokens, best score, log probability) of each text."""
        if len(self.memory) > KEPT:
            self.memory.clear()
            self.stored = np.empty((0, 3))
        found = [self.runs(t) for t in texts]
        new = self.many(set().union(*found).difference(self.memory))
        if new:
            self.memory.update(zip(new, range(len(self.memory), len(self.memory) + len(new)), strict=True))
            self.stored = np.concatenate([self.stored, np.array(list(new.values()))])
        out, at = [], self.memory.__getitem__
        for ws in found:
            tokens, best, total = self.stored[np.fromiter(map(at, ws), np.int64, len(ws))].sum(axis=0).tolist()
            out.append((len(ws), int(tokens), best, total))
        return out


_LOADED: dict[str, Unigram] = {}


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, best_score, log_prob) of docs(doc_id, text).

    Whole texts as UTF-8; pre-tokens as in Unigram.runs. n_tokens: of
    each pre-token's best segmentation; log_prob: natural log of the summed
    probability of all segmentations. A null or empty text has zeros.
    """

    def run(batches):
        at = path
        if at is None:
            import public_tokenizers

            at = public_tokenizers.path("byte_bpe_50k.tiktoken")
        if at not in _LOADED:
            _LOADED[at] = Unigram.from_file(at)
        for pdf in batches:
            out = pd.DataFrame(_LOADED[at].count([x or b"" for x in pdf["data"]]), columns=["n_pretokens", "n_tokens", "best_score", "log_prob"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data")).mapInPandas(run, "doc_id bigint, n_pretokens bigint, n_tokens bigint, best_score double, log_prob double")


def op3_token_counts(spark, sf_dir) -> DataFrame:
    """Counts of every document with the byte vocabulary."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), os.environ.get("SEQLOOM_BYTE_BPE"))
