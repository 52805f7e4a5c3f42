"""Token counts under a public byte-level BPE vocabulary. The vocabulary file is a parameter; every executor reads it at that path."""

from __future__ import annotations

import base64
import re
import sys
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
MOST_KEPT = 400_000


class Counter:
    """Number of tokens of texts. No piece of the pattern goes on from other signs into white space, so a text is the
    sum of its chunks, white space and what follows up to the next, and repeated chunks and pieces are looked up."""

    def __init__(self, vocabulary: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}
        self.encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.chunks: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.split = re.compile(r"\s*\S+|\s+").findall
        self.ascii = re.compile(ASCII_PATTERN, re.A).findall

    def chunk(self, c: str) -> int:
        if not c.isascii():
            n = len(self.encode(c))
        else:
            n = 0
            for p in self.ascii(c):
                k = self.pieces.get(p)
                if k is None:
                    k = len(self.encode(p))
                    if len(self.pieces) < MOST_KEPT:
                        self.pieces[p] = k
                n += k
        if len(self.chunks) < MOST_KEPT and len(c) < 16:
            self.chunks[c] = n
        return n

    def parts(self, text: str) -> tuple[list[str], list[int]]:
        """Chunks and the tokens of each."""
        got = self.split(text)
        get, chunk = self.chunks.get, self.chunk
        return got, [n if (n := get(c)) is not None else chunk(c) for c in got]

    def count(self, text: str) -> int:
        return sum(self.parts(text)[1])


def counter(vocabulary: str = VOCABULARY) -> Counter:
    """The worker's counter; kept in the interpreter, as a Python worker runs many tasks."""
    kept = sys.__dict__.setdefault("_public_token_counters", {})
    if vocabulary not in kept:
        kept[vocabulary] = Counter(vocabulary)
    return kept[vocabulary]


def counted(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) in one Arrow pass; null and empty texts have 0 tokens; equal rows come once."""

    def run(batches):
        c = counter(vocabulary)
        for b in batches:
            n = [c.count(t) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, tokens long").distinct()
