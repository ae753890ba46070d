"""Byte-level BPE by longest matches and backtracking, exact to the merges and linear in the text."""

from __future__ import annotations

import base64
import os
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files of public tokenizers are; every executor has them there.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed by the tokenizer: how it cuts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of up to this many bytes are remembered, this many at most.
MEMO_BYTES, MEMO_PIECES = 64, 400_000
MEMO_PAIRS = 2_000_000


class Encoder:
    """Encodes as the merges do, without performing them.

    In byte-level BPE whose ids are ordered by merge, a token sequence is the encoding of its bytes exactly if every two
    adjacent tokens are: whether (a, b) can stand side by side depends on these two alone. So the longest token at each
    position is tried, then shorter ones, and a position from which nothing fits is never tried again. Bytes are
    Latin-1 characters, as the automaton takes strings.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.automaton = ahocorasick.Automaton()
        self.length = [0] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
            self.length[rank] = len(token)
        self.automaton.make_automaton()
        self.halves: list[tuple[int, int] | None] = [None] * len(self.length)
        self.merged: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: OrderedDict[bytes, list[int]] = OrderedDict()
        # the two tokens a token is merged from are the encoding of its bytes by earlier tokens
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._walk(token, below=rank)
                if len(parts) != 2:
                    raise ValueError(f"token {rank} isn't a merge of two earlier ones")
                self.halves[rank] = (parts[0], parts[1])
                self.merged[parts[0], parts[1]] = rank
                # only this pair's own answer can change: later merges come too late for all others
                self.pairs.pop((parts[0], parts[1]), None)

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay apart: no merge across their border comes before those that made them."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stay_apart(a, b)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        """Undoes the later of the two tokens step by step; at each step the tokens at the border must not have merged
        before the last undone merge."""
        before = len(self.length)  # merges from here on came too late to matter
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < before:
                return False
            left, right = self.halves[a], self.halves[b]
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                before, a = a, left[1]
            else:
                # at equal rank the left one merges first, so a merge of b's own rank across the border counts
                before, b = b + 1, right[0]

    def _matches(self, piece: bytes, below: int) -> list[list[tuple[int, int]]]:
        """For each position the tokens that begin there, shortest first."""
        at: list[list[tuple[int, int]]] = [[] for _ in piece]
        for end, hit in self.automaton.iter(piece.decode("latin-1")):
            if hit[1] < below:
                at[end - hit[0] + 1].append(hit)
        return at  # matches come by their end, so those of one start come by length

    def _walk(self, piece: bytes, below: int) -> list[int]:
        at = self._matches(piece, below)
        n, pos = len(piece), 0
        out: list[int] = []
        tried: list[int] = []  # index of the match taken at each step
        dead = bytearray(n + 1)
        k = len(at[0])
        while pos < n:
            here = at[pos]
            while k:
                k -= 1
                size, token = here[k]
                if not dead[pos + size] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    tried.append(k)
                    pos += size
                    k = len(at[pos]) if pos < n else 0
                    break
            else:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                dead[pos] = 1
                pos -= self.length[out.pop()]
                k = tried.pop()
        return out

    def piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > MEMO_BYTES:
            return self._walk(piece, len(self.length))
        ids = self.memo.get(piece)
        if ids is None:
            if len(self.memo) >= MEMO_PIECES:
                for _ in range(MEMO_PIECES // 4):
                    self.memo.popitem(last=False)
            ids = self.memo[piece] = self._walk(piece, len(self.length))
        return ids


_CUT = regex.compile(PATTERN)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file; one per worker process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Encoder(ranks)


def encode(text: str | None, path: str) -> list[int]:
    """Ids of a text without special tokens; none for empty and null texts."""
    if not text:
        return []
    e, out = encoder(path), []
    piece, ranks = e.piece, e.ranks
    for m in _CUT.finditer(text):
        b = m.group().encode()
        whole = ranks.get(b)
        if whole is not None:
            out.append(whole)
        else:
            out += piece(b)
    return out


def token_ids(text: Column | str, tokenizer_dir: str = TOKENIZER_DIR) -> Column:
    """Ids of a text column: array<int>, empty for empty and null texts."""
    path = f"{tokenizer_dir}/{VOCABULARY}"

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([encode(t, path) for t in s], dtype=object)

    return ids(F.col(text) if isinstance(text, str) else text)


def token_count(text: Column | str, tokenizer_dir: str = TOKENIZER_DIR) -> Column:
    """Number of tokens of a text column, 0 for empty and null texts; the ids don't leave the worker."""
    path = f"{tokenizer_dir}/{VOCABULARY}"

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([len(encode(t, path)) for t in s], dtype="int64")

    return count(F.col(text) if isinstance(text, str) else text)


def encode_corpus(documents: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, ids) of every document. Row by row, without a shuffle; repeated rows are encoded like any other."""
    return documents.select("doc_id", token_ids("text", tokenizer_dir).alias("ids"))
