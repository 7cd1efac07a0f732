"""Encoding of texts by a byte-level BPE vocabulary (problem 8).

Method: per piece of the pre-tokenizer's pattern, a segment tree over the byte
positions holds the leftmost minimum pair rank; a merge updates the ranks of
the live neighbours, logarithmic in the length of the piece. A long run without
a blank hence costs n log n, not n².
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessella.plans.runtime import spread

#: Folder of the vocabulary files; a parameter of every function here.
VOCABULARIES = os.environ.get("TESSELLA_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern that splits a text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker remembers; the table is emptied when full.
REMEMBERED = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: token bytes to rank, which is the id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """An encoder by ranks, the rank of a token being its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        token = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << max(0, (n - 1).bit_length())
        # A node is rank << 32 | position, so that the least one is the leftmost of the least rank.
        none = 1 << 62
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = rank << 32 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(at: int, value: int) -> None:
            at += size
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                least = a if a < b else b
                if tree[at] == least:
                    break
                tree[at] = least
                at >>= 1

        while tree[1] != none:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            k = after[j]
            token[i] += token[j]
            after[i] = k
            put(j, none)
            if k < n:
                before[k] = i
                rank = ranks.get(token[i] + token[k])
                put(i, none if rank is None else rank << 32 | i)
            else:
                put(i, none)
            h = before[i]
            if h >= 0:
                rank = ranks.get(token[h] + token[i])
                put(h, none if rank is None else rank << 32 | h)
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens; null and empty texts give an empty list."""
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8"))
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


_ENCODERS: dict[str, ByteBpe] = {}


def encode_column(text: Column, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> Column:
    """The ids of a string column (see ``ByteBpe.encode``)."""
    path = os.path.join(folder or VOCABULARIES, vocabulary)

    @pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _ENCODERS:
            _ENCODERS[path] = ByteBpe(load_ranks(path))
        encode = _ENCODERS[path].encode
        for batch in batches:
            yield pd.Series([encode(x) for x in batch], dtype=object)

    return ids(text)


def encode_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """``(key, ids)`` of each document; equal rows give one row, as results are sets."""
    rows = spread(documents.select(key, text))
    return rows.select(key, encode_column(F.col(text), vocabulary, folder).alias("ids"))
